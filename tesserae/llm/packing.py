"""Best-fit packing with certified bounds.

Documents become token pieces of at most CAPACITY tokens. Pieces are dealt to groups of bounded
size; each group is packed by best-fit decreasing, and lower bounds from dual-feasible functions
certify its number of bins. Groups whose number exceeds the bound release their loosest bins;
the released bins' documents are dealt anew, whole bins together, and packed again, which is
kept where it takes fewer bins. This goes on while a round saves bins; certified() tells what
remains above the bound of all pieces.

Null and empty texts are one piece with the end id alone; equal rows are packed as separate
pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae.llm.common import materialize
from tesserae.llm.textblocks import releasing

CAPACITY = 1024
END_ID = 2
GROUP = 1 << 16
#: Sequence ids have seven bits for the round.
ROUNDS = 127
#: White space characters in a row that tiktoken is given at most; it fails at about a million.
LONG_RUN = 100_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint, loose boolean"


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to the ids that a tokenizers JSON file gives it.

    tiktoken, over the file's vocabulary, takes the text between added tokens, whose literals
    become their ids. Its pattern overflows the stack on very long runs of white space; texts
    with a long one go to tokenizers.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    library = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))  # as large as all the rest, and rarely needed
    spare = iter(range(256, 512))
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves in the vocabulary
    to_byte = {chr(b if b in shown else next(spare)): b for b in range(256)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if any(t[k] for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return lambda text: library().encode(text, add_special_tokens=False).ids
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    ordinary = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    literals = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")

    def encode(text: str) -> list[int]:
        if len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in re.finditer(r"\s+", text)):
            return library().encode(text, add_special_tokens=False).ids
        out, at = [], 0
        for m in literals.finditer(text):
            out += [*ordinary(text[at : m.start()]), special[m[0]]]
            at = m.end()
        return out + ordinary(text[at:])

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what full pieces leave."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            ids, texts, rows = batch.column("doc_id").to_pylist(), batch.column("text"), []
            for doc_id, text in zip(ids, texts):
                tokens = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(tokens[s : s + n])) for k, (s, n) in enumerate(cut(len(tokens), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), PIECES)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs; counts[n] pieces have n tokens, of len(counts) - 1 at most.

    Dual-feasible functions: the identity, the one that rounds sizes above capacity - e up and
    those below e down, for every e up to half, and floor((k + 1) x / c) / k for k up to 20.
    """
    c = len(counts) - 1
    n = np.arange(c + 1)
    best = -(-int((counts * n).sum()) // c)
    over = np.cumsum(counts[::-1])[::-1]  # pieces of n tokens or more
    mass = np.concatenate(([0], np.cumsum(counts * n)))
    for e in range(1, c // 2 + 1):
        full = int(over[c - e + 1])
        rest = int(mass[c - e + 1] - mass[e])
        best = max(best, full + -(-rest // c))
    for k in range(1, 21):
        whole = (k + 1) * n % c == 0
        value = np.where(whole, n * k, (k + 1) * n // c * c)  # times c * k
        best = max(best, -(-int((counts * value).sum()) // (c * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and the free tokens of each bin."""
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins, offsets, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: a bin has g free tokens
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = gaps >> n
        if fits:
            g = n + (fits & -fits).bit_length() - 1
            b = stacks[g].pop()
            if not stacks[g]:
                gaps &= ~(1 << g)
        else:
            g, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - g
        free[b] = left = g - n
        if left:
            stacks[left].append(b)
            gaps |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def packer(round_no: int, last: bool, capacity: int):
    """Packs one group (key, then PACKED's columns); sequence ids hold the round, the group and the bin."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy().astype(np.int64)
        bins, offsets, free = best_fit(lengths, capacity)
        old = group.column("sequence_id").to_numpy()
        if round_no and len(np.unique(old)) <= len(free):  # no better than before
            kinds, bins = np.unique(old, return_inverse=True)
            offsets, ids = group.column("offset").to_numpy(), old
            free = capacity - np.bincount(bins, weights=lengths).astype(np.int64)
        else:
            ids = (round_no << 56 | key[0].as_py() << 24) + bins
        gap = len(free) - lower_bound(np.bincount(lengths, minlength=capacity + 1))
        loose = np.zeros(len(free), bool)
        if gap > 0 and not last:
            share = max(256, len(free) // 4)
            loose[np.argsort(-free, kind="stable")[:share]] = True
            loose &= free > 0
        out = group.select([x.split()[0] for x in PIECES.split(", ")])
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).append_column("loose", pa.array(loose[bins]))

    return run


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """PIECES with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    todo = materialize(cut_pieces, "pieces").withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("loose", F.lit(True))
    done: list[DataFrame] = []
    bins = F.count(F.when(F.col("offset") == 0, 1))  # each has one piece at its start
    for k in range(rounds):
        n, before = todo.agg(F.count(F.lit(1)), bins).first()
        groups = max(1, -(-n // GROUP))
        last = k == rounds - 1 or (k > 0 and groups == 1)
        dealt = todo.withColumn("lot", F.pmod(F.xxhash64("sequence_id", F.lit(k)), F.lit(groups)))
        packed = materialize(dealt.groupBy("lot").applyInArrow(packer(k, last, capacity), PACKED), f"packed-{k}")
        if last or (k > 0 and packed.agg(bins).first()[0] >= before):
            done.append(packed.drop("loose"))
            break
        done.append(packed.where("not loose").drop("loose"))
        todo = packed.where("loose")
        if todo.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def certified(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """The number of sequences, and the number that any packing of all their pieces needs."""
    rows = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("offset") == 0, 1)).alias("bins")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows:
        counts[r["length"]] = r["n"]
    return sum(r["bins"] for r in rows), lower_bound(counts)
