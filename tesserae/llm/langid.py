"""Language identification by hyperdimensional profiles.

Every letter (any code point of a letter category, in lower case) has its own random vector of +1
and -1, drawn from its code point; whatever is no letter shares one. A trigram's vector binds its
letters' vectors, permuted (rolled) by place, by multiplication; a document's vector bundles
(adds) its trigrams' vectors. The prototype of a language is the sum of its training documents'
vectors, each scaled to unit length, less the mean of all prototypes; documents are compared with
the prototypes by cosine, less the same mean.

Null text and text without a letter have no vector and are predicted `und` with score 0. Rows
without a language are not learned from; without any, everything is `und`. Ties go to the
language that sorts first. Repeated rows, also of one id, are learned from and predicted each on
its own; equal texts get equal predictions. An empty table gives an empty result. Only the columns
asked for are kept, whatever their names. Very long texts cost memory in proportion to one text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae.llm.textblocks import mix, releasing, values

DIM = 1024
#: Fixed-point scale in which vectors are summed, so that sums do not depend on their order.
SCALE = 1 << 20
BLOCK = 1 << 19
#: Rows handled and sent back at a time.
ROWS = 1024
#: Different trigrams whose vectors are bundled at a time.
SLICE = 2048
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x33500):  # no letter lies beyond
        if unicodedata.category(chr(cp))[0] == "L":
            out[cp] = ord(chr(cp).lower()[0])
    return out


def letter_vectors(some: np.ndarray, dim: int) -> np.ndarray:
    """(letters, dim) of +1 and -1, from the bits of hashes of each code point."""
    words = np.arange(-(-dim // 64), dtype=np.uint64)
    seed = mix(some.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))[:, None]
    bits = np.unpackbits(mix(mix(seed ^ mix(words + np.uint64(1)))).view(np.uint8), axis=1)
    return bits[:, :dim].astype(np.int8) * 2 - 1


def bundle(texts: list[bytes], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Document vectors (float32, not scaled), and which documents have a letter."""
    decoded = [t.decode("utf-8", "replace") for t in texts]
    codes = letters()[np.frombuffer("\0\0".join(["", *decoded, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in decoded])
    doc = np.concatenate((np.zeros(2, np.int64), doc))  # two separators come first
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    seen[0] = True
    used = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[used] = np.arange(len(used))
    codes = place[codes]
    left, mid, right = codes[:-2], codes[1:-1], codes[2:]
    real = (mid != 0) | ((left != 0) & (right != 0))
    n, k = len(texts), len(used)  # k**3 * n is far below 2**63: letters fill 17 bits, documents 8
    of = doc[1:-1][real]
    has = np.zeros(n, bool)
    has[of[mid[real] != 0]] = True
    key, counts = np.unique(((left[real] * k + mid[real]) * k + right[real]) * n + of, return_counts=True)
    gram, of = key // n, key % n
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    kinds, kind = gram[new], np.cumsum(new) - 1
    base = letter_vectors(used, dim)
    a, b = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    out = np.zeros((n, dim), np.float32)
    for lo in range(0, len(kinds), SLICE):
        some = kinds[lo : lo + SLICE]
        bound = (a[some // (k * k)] * b[some // k % k] * base[some % k]).astype(np.float32)
        i, j = np.searchsorted(kind, (lo, lo + SLICE))
        share = np.zeros((n, len(some)), np.float32)
        share[of[i:j], kind[i:j] - lo] = counts[i:j]
        out += share @ bound
    return out, has


def grouped(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of documents with about BLOCK bytes together, 256 documents at most."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and (total + len(t) > BLOCK or i - lo == 256):
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def learn(train: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Prototypes from (text, lang): languages, and a row of dim integers for each.

    Each task sends one vector a language; the driver gets languages x dim numbers, which do not
    grow with the documents.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = values(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
            for lo, hi in grouped(texts):
                vectors, _ = bundle(texts[lo:hi], dim)
                scaled = np.rint(unit(vectors) * SCALE).astype(np.int64)
                for lang in set(langs[lo:hi]):
                    sums[lang] = sums.get(lang, 0) + scaled[langs[lo:hi] == lang].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    parts = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(releasing(partial), "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("v")).orderBy("lang").collect()
    return [r["lang"] for r in rows], np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dim)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, keep: list[str], dim: int = DIM, declared: str | None = None) -> DataFrame:
    """keep's columns with lang_pred and score, the cosine with the prototype (0 if negative).

    With declared, one of keep's columns, also margin: the best cosine less that of the declared
    language; null without a letter, or without a prototype of that language.
    """
    profile = unit(prototypes) if len(languages) else np.zeros((1, dim))
    centre = profile.mean(axis=0) if len(languages) > 1 else np.zeros(dim)
    heads = unit(profile - centre).astype(np.float32)
    centre, names = centre.astype(np.float32), [*languages, UNDETERMINED]
    at = keep.index("text") if "text" in keep else len(keep)
    kept = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("__text"))
    place = {name: i for i, name in enumerate(languages)}
    out_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                yield part(whole.slice(lo, ROWS))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = values(batch.column(at))
        best, cosine = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
        margin = np.full(len(texts), np.nan)
        own = np.array([place.get(x, -1) for x in batch.column(keep.index(declared)).to_pylist()], np.int64) if declared else None
        for lo, hi in grouped(texts) if languages else ():
            vectors, has = bundle(texts[lo:hi], dim)
            cos = unit(unit(vectors) - centre) @ heads.T
            top = cos.argmax(axis=1)
            best[lo:hi] = np.where(has, top, len(names) - 1)
            cosine[lo:hi] = np.where(has, np.clip(cos[np.arange(hi - lo), top], 0, 1), 0)
            if declared:
                told = has & (own[lo:hi] >= 0)
                margin[lo:hi][told] = (cos[np.arange(hi - lo), top] - cos[np.arange(hi - lo), own[lo:hi]])[told]
        cols = [batch.column(i) for i in range(len(keep))]
        more = {"lang_pred": pa.array([names[i] for i in best], pa.string()), "score": pa.array(cosine)}
        if declared:
            more["margin"] = pa.array(margin, from_pandas=True)
        return pa.RecordBatch.from_arrays([*cols, *more.values()], names=[*keep, *more])

    return kept.mapInArrow(releasing(score), f"{out_fields}, lang_pred string, score double" + ", margin double" * bool(declared))
