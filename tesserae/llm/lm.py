"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of the trigram, the bigram, the unigram and a
uniform distribution: p(w | g h) = l3 c(g h w) / c(g h) + l2 c(h w) / c(h) + l1 c(w) / N +
l0 / (V + 1). The weights depend on the bucket of the longest context that was seen: the bit
length of c(g h), or where that is 0, of c(h); estimates of unseen contexts have weight 0. They
are learned by expectation-maximisation: counts of one part of the training documents give the
estimates, and the held-out rest is what they must explain. Final counts take both parts. With
order 2, trigrams are left out.

Documents are dealt to chunks of bounded size. A chunk's distinct words go, as 128-bit keys with
their counts, to word buckets, which add the counts up and give every word a number. Pairs and
triples are then exact numbers of words, not hashes: the chunk sends its distinct pairs, and under
each the words that follow it, to the bucket of the pair, which answers the corpus counts in the
order of the question. A frequent word or pair is one entry a chunk. Counts are 64-bit. What is
sent grows with the corpus.

Null and empty texts are the end token alone. Equal texts get equal scores; repeated rows are
scored and counted as often as they occur. Rows without an id are scored like others (whether
they are learned from is up to the condition). With no training text, every word is unknown and
all tokens are uniform. An empty table gives an empty result. Other columns are ignored. Very
long texts cost memory in proportion to one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae.llm.common import chunks_for, freed_shuffles, materialize, text_bytes
from tesserae.llm.textblocks import blocks, mix, rank_pairs, values, words

#: Numbers of the sentinels; words have larger ones.
BEGIN, END, FIRST = 0, 1, 2
#: Weights are kept for so many buckets: bit lengths of c(g h), then 64 + bit lengths of c(h).
BUCKETS = 128
#: Steps of a halving of probability in the histogram from which the weights are learned.
STEPS = 4
#: Bytes of text whose words, and whose pairs and triples, one bucket adds up.
WORD_BYTES, GRAM_BYTES = 32 << 20, 6 << 20

FIT, DEV, OTHER = 0, 1, 2

QUESTIONS = "chunk int, kind int, bucket int, a binary, b binary, n binary, more binary, c binary, m binary"
ANSWERS = "chunk int, kind int, level int, bucket int, number binary, train binary, fit binary, train3 binary, fit3 binary, n_train bigint, n_fit bigint, kinds bigint"
SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def squeeze(a: np.ndarray) -> bytes:
    """Non-negative 64-bit integers, byte plane by byte plane, compressed."""
    a = np.ascontiguousarray(a, "<i8")
    width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], width * n, codec="zstd"), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").reshape(-1)


def tabled(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def dense(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for every distinct (x, y), and how many there are."""
    bits = int(y.max()).bit_length() if len(y) else 0
    if len(x) and int(x.max()).bit_length() + bits <= 63:
        kinds, number = np.unique(x << bits | y, return_inverse=True)
        return number, len(kinds)
    order = np.lexsort((y, x))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, int(new.sum())


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by radix
    order = np.argsort(bucket, kind="stable")
    used, cuts = np.unique(bucket[order], return_index=True)
    return list(zip(used.tolist(), np.split(order, cuts[1:]))) if len(used) else []


@dataclass
class Words:
    """Of a chunk: its distinct words, and which of them each token is (-1 for an end)."""

    h: np.ndarray
    check: np.ndarray
    counts: np.ndarray
    token: np.ndarray
    doc: np.ndarray
    n_docs: int

    def buckets(self, n: int) -> list[tuple[int, np.ndarray]]:
        return by_bucket(((self.h >> np.uint64(33)) % np.uint64(n)).astype(np.int64))


def read_words(texts: list[bytes]) -> Words:
    h, check, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in blocks(texts):
        w = words(b, fold=True)
        for out, k in zip((h, check), w.keys()):
            out.append(k)
        sizes.append(np.diff(w.bounds))
    h, check, sizes = np.concatenate(h), np.concatenate(check), np.concatenate(sizes)
    first, number, counts = rank_pairs(h, check)
    token = np.full(len(h) + len(texts), -1, np.int64)
    is_word = np.ones(len(token), bool)
    is_word[np.cumsum(sizes + 1) - 1] = False
    token[is_word] = number
    return Words(h[first], check[first], counts, token, np.repeat(np.arange(len(texts)), sizes + 1), len(texts))


@dataclass
class Grams:
    """Of a chunk, in the order of the words' numbers: pairs (with the pair of two BEGINs) and triples."""

    number: np.ndarray  # of each local word, ascending
    word: np.ndarray  # local word of each token
    before: np.ndarray  # local word before it
    a: np.ndarray  # local words of each distinct pair
    b: np.ndarray
    n: np.ndarray
    pair: np.ndarray  # of each token
    history: np.ndarray  # the pair before each token
    of: np.ndarray  # the pair that each distinct triple extends, ascending
    c: np.ndarray
    m: np.ndarray
    triple: np.ndarray  # of each token

    def buckets(self, n: int) -> tuple[list[tuple[int, np.ndarray]], list[np.ndarray]]:
        """Pairs of each bucket, and their triples."""
        key = mix((self.number[self.a] * 0x2545F4914F6CDD1D + self.number[self.b]).view(np.uint64))
        bucket = ((key >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
        pairs = by_bucket(bucket)
        triples = dict(by_bucket(bucket[self.of]))
        return pairs, [triples.get(k, np.zeros(0, np.int64)) for k, _ in pairs]


def read_grams(w: Words, numbers: np.ndarray, order: int) -> Grams:
    rank = np.argsort(numbers)
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank)) + FIRST
    number = np.concatenate((np.array([BEGIN, END], np.int64), numbers[rank]))
    word = np.append(place, END)[w.token]
    n, size = len(word), len(number)
    begins = np.searchsorted(w.doc, np.arange(w.n_docs))
    before = np.concatenate((word[:1], word[:-1]))
    before[begins] = BEGIN
    keys, pair, counts = np.unique(np.concatenate((before * size + word, np.full(w.n_docs, BEGIN * size + BEGIN))), return_inverse=True, return_counts=True)
    pair = pair[:n]
    history = np.concatenate((pair[:1], pair[:-1]))
    history[begins] = 0  # the pair of two BEGINs is the least
    triples, triple, m = np.unique(history * size + word, return_inverse=True, return_counts=True) if order > 2 else (np.zeros(0, np.int64), np.zeros(n, np.int64), np.zeros(0, np.int64))
    return Grams(number, word, before, keys // size, keys % size, counts, pair, history, triples // size, triples % size, m, triple)


def ask_words(n_buckets: int) -> Callable:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        chunk, kind, w = key[0].as_py(), key[1].as_py(), read_words(values(group.column("text")))
        return tabled(QUESTIONS, [(chunk, kind, b, w.h[o].tobytes(), w.check[o].tobytes(), squeeze(w.counts[o]), None, None, None) for b, o in w.buckets(n_buckets)])

    return run


def sums(kinds: list[int], counts: list[np.ndarray], number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts in training and in fitting documents."""
    every = np.concatenate(counts)
    kind = np.repeat(kinds, [len(c) for c in counts])
    train, fit = (np.zeros(n, np.int64) for _ in range(2))
    np.add.at(train, number, np.where(kind != OTHER, every, 0))
    np.add.at(fit, number, np.where(kind == FIT, every, 0))
    return train, fit


def answer_words(n_buckets: int) -> Callable:
    """Numbers and counts of one bucket's words for each chunk that asks; a row without a chunk has the bucket's totals."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket, kinds = key[0].as_py(), group.column("kind").to_pylist()
        h, check = ([np.frombuffer(k, np.uint64) for k in group.column(c).to_pylist()] for c in ("a", "b"))
        first, at, _ = rank_pairs(np.concatenate(h), np.concatenate(check))
        train, fit = sums(kinds, [expand(n) for n in group.column("n").to_pylist()], at, len(first))
        # frequent words get the smaller numbers, which take fewer bytes in questions about pairs
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(-train, kind="stable")] = np.arange(len(first))
        rows = []
        for chunk, kind, w in zip(group.column("chunk").to_pylist(), kinds, np.split(at, np.cumsum([len(k) for k in h])[:-1])):
            rows.append((chunk, kind, 1, bucket, squeeze(FIRST + bucket + rank[w] * n_buckets), squeeze(train[w]), squeeze(fit[w]) if kind == DEV else None, None, None, None, None, None))
        return tabled(ANSWERS, [*rows, (-1, -1, 1, bucket, *[None] * 5, int(train.sum()), int(fit.sum()), int((train > 0).sum()))])

    return run


def ask_grams(n_words: int, n_buckets: int, order: int) -> Callable:
    def run(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        w = read_words(values(group.column("text")))
        g = read_grams(w, told(answers, 1, "number", [o for _, o in w.buckets(n_words)], len(w.h)), order)
        chunk, kind, follow = key[0].as_py(), group.column("kind")[0].as_py(), np.bincount(g.of, minlength=len(g.a))
        rows = []
        for (b, pairs), triples in zip(*g.buckets(n_buckets)):
            a = np.diff(g.number[g.a[pairs]], prepend=0)  # pairs ascend by their first word
            rows.append((chunk, kind, b, squeeze(a), squeeze(g.number[g.b[pairs]]), squeeze(g.n[pairs]), squeeze(follow[pairs]), squeeze(g.number[g.c[triples]]), squeeze(g.m[triples])))
        return tabled(QUESTIONS, rows)

    return run


def answer_grams(key: tuple, group: pa.Table) -> pa.Table:
    bucket, kinds = key[0].as_py(), group.column("kind").to_pylist()
    a, b, n, more, c, m = ([expand(x) for x in group.column(f).to_pylist()] for f in ("a", "b", "n", "more", "c", "m"))
    pair, n_pairs = dense(np.concatenate([np.cumsum(x) for x in a]), np.concatenate(b))
    train, fit = sums(kinds, n, pair, n_pairs)
    triple, n_triples = dense(np.repeat(pair, np.concatenate(more)), np.concatenate(c))
    train3, fit3 = sums(kinds, m, triple, n_triples)
    rows = []
    cut = lambda x, sizes: np.split(x, np.cumsum([len(s) for s in sizes])[:-1])
    for chunk, kind, p, t in zip(group.column("chunk").to_pylist(), kinds, cut(pair, n), cut(triple, m)):
        of_fit = (squeeze(fit[p]), squeeze(fit3[t])) if kind == DEV else (None, None)
        rows.append((chunk, kind, 2, bucket, None, squeeze(train[p]), of_fit[0], squeeze(train3[t]), of_fit[1], None, None, None))
    return tabled(ANSWERS, rows)


def told(answers: pa.Table, level: int, column: str, places: list[np.ndarray], n: int) -> np.ndarray:
    """The answers to a chunk's questions of a level, by the places that each bucket was asked about."""
    level_rows = answers.filter(pa.array([x == level for x in answers.column("level").to_pylist()], pa.bool_())).sort_by("bucket")
    out = np.zeros(n, np.int64)
    for at, raw in zip(places, level_rows.column(column).to_pylist(), strict=True):
        out[at] = expand(raw)
    return out


@dataclass(frozen=True)
class Counts:
    """What the driver knows of the documents that give the estimates."""

    column: str  # of the answers
    tokens: int  # with ends
    documents: int
    kinds: int  # distinct tokens in all training documents
    n_words: int
    n_grams: int
    order: int


@dataclass
class Estimates:
    """Of each token of a chunk: bucket of its context, estimates, and the token's count."""

    bucket: np.ndarray
    p3: np.ndarray
    p2: np.ndarray
    p1: np.ndarray
    count: np.ndarray
    doc: np.ndarray


def ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.zeros(len(x)), where=y > 0)


def bit_length(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def estimates(texts: list[bytes], answers: pa.Table, s: Counts) -> Estimates:
    w = read_words(texts)
    places = [o for _, o in w.buckets(s.n_words)]
    numbers = told(answers, 1, "number", places, len(w.h))
    g = read_grams(w, numbers, s.order)
    count = told(answers, 1, s.column, places, len(w.h))
    count = np.concatenate((np.full(2, s.documents), count[np.argsort(numbers)]))  # as many BEGINs and ends as documents
    pairs, triples = g.buckets(s.n_grams)
    of_pair = told(answers, 2, s.column, [o for _, o in pairs], len(g.a))
    c_w, c_h, c_hw = count[g.word], count[g.before], of_pair[g.pair]
    p3, bucket = np.zeros(len(c_w)), 64 + bit_length(c_h)
    if s.order > 2:
        of_triple = told(answers, 2, s.column + "3", triples, len(g.c))
        c_gh = of_pair[g.history]
        p3 = ratio(of_triple[g.triple], c_gh)
        bucket = np.where(c_gh > 0, bit_length(c_gh), bucket)
    return Estimates(bucket, p3, ratio(c_hw, c_h), c_w / max(1, s.tokens), c_w, w.doc)


def dev_histogram(s: Counts) -> Callable:
    """Cells (bucket, halvings of p3, p2 and p1) of the held-out tokens of a chunk, with sums."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        e = estimates(values(docs.column("text")), answers, s)
        cell = e.bucket
        for p in (e.p3, e.p2, e.p1):
            cell = cell << 10 | np.where(p > 0, np.floor(-np.log2(np.maximum(p, 1e-70)) * STEPS) + 1, 0).astype(np.int64)
        cell, at = np.unique(cell, return_inverse=True)
        parts = [np.bincount(at, weights=x, minlength=len(cell)) for x in (np.ones(len(at)), e.p3, e.p2, e.p1)]
        return pa.table([pa.array(cell), *(pa.array(x) for x in parts)], names=["cell", "n", "p3", "p2", "p1"])

    return run


def maximise(n: np.ndarray, p: np.ndarray, m: np.ndarray, iterations: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """Mixture weights of the rows of p (a column a cell with n tokens) by expectation-maximisation from m; zeros of m stay."""
    for _ in range(iterations):
        share = m[:, None] * p
        share /= share.sum(axis=0)
        old, m = m, (share * n).sum(axis=1) / n.sum()
        if np.abs(m - old).max() < tolerance:
            break
    return m


def start_of(bucket: int) -> np.ndarray:
    """Weights before learning: what an unseen context cannot estimate has none."""
    return np.array([0.4, 0.3, 0.2, 0.1] if bucket < 64 else [0, 0.5, 0.4, 0.1] if bucket > 64 else [0, 0, 0.8, 0.2])


def learn_bucket(uniform: float) -> Callable:
    def run(key: tuple, cells: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        n, p3, p2, p1 = (cells.column(c).to_numpy() for c in ("n", "p3", "p2", "p1"))
        start = start_of(bucket)
        m = maximise(n, np.stack((p3 / n, p2 / n, p1 / n, np.full(len(n), uniform))), start)
        m = np.where(start > 0, np.maximum(m, 1e-9), 0)
        return pa.table([pa.array([bucket], pa.int64()), *(pa.array([x]) for x in m / m.sum())], names=["bucket", "m3", "m2", "m1", "m0"])

    return run


def all_weights(learned: dict[int, np.ndarray]) -> np.ndarray:
    """(BUCKETS, 4); a bucket without held-out tokens takes the weights of the nearest one below, or else above, of its kind."""
    out = np.stack([learned.get(b, start_of(b)) for b in range(BUCKETS)])
    for lo, hi in ((1, 64), (65, BUCKETS)):
        known = np.array([b for b in sorted(learned) if lo <= b < hi])
        for b in range(lo, hi):
            if b not in learned and len(known):
                below = known[known < b]
                out[b] = learned[int(below[-1] if len(below) else known[0])]
    return out


def scorer(s: Counts, weights: np.ndarray) -> Callable:
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = values(docs.column("text"))
        e = estimates(texts, answers, s)
        m = weights[e.bucket]
        p = m[:, 0] * e.p3 + m[:, 1] * e.p2 + m[:, 2] * e.p1 + m[:, 3] / (s.kinds + 1)
        base = (e.count + 0.1) / (s.tokens + 0.1 * (s.kinds + 1))
        total = [np.bincount(e.doc, weights=x, minlength=len(texts)) for x in (np.ones(len(p)), e.count > 0, np.log10(base), np.log10(p))]
        columns = [pa.array(x.astype(np.int64)) for x in total[:2]] + [pa.array(np.full(len(texts), s.tokens, np.int64))] + [pa.array(x) for x in total[2:]]
        return pa.table([docs.column("doc_id"), *columns], names=[f.split()[0] for f in SCORES.split(", ")])

    return run


def meet(some: DataFrame, answers: DataFrame, run: Callable, schema: str) -> DataFrame:
    return some.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def learn(docs: DataFrame, training, order: int) -> tuple[DataFrame, DataFrame, Counts, np.ndarray]:
    """The documents by chunk, the answers to each chunk, and what the driver knows of the training documents, with the weights."""
    total = text_bytes(docs)
    n_chunks, n_words, n_grams = chunks_for(total), max(16, -(-total // WORD_BYTES)), max(16, -(-total // GRAM_BYTES))
    dev = F.pmod(F.xxhash64("doc_id", F.lit("dev")), F.lit(9)) == 0
    kind = F.coalesce(F.when(~training, OTHER).when(dev, DEV).otherwise(FIT), F.lit(OTHER)).cast("int")
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks))
    # a tenth of the chunks for each of the two smaller kinds
    small = -(-n_chunks // 8)
    chunk = F.when(F.col("kind") == FIT, spread).otherwise(n_chunks + (F.col("kind") - 1) * small + F.pmod(spread, F.lit(small)))
    dealt = docs.select("doc_id", "text", kind.alias("kind")).withColumn("chunk", chunk.cast("int"))
    n_docs = {r["kind"]: r["count"] for r in dealt.groupBy("kind").count().collect()}

    questions = dealt.groupBy("chunk", "kind").applyInArrow(ask_words(n_words), QUESTIONS)
    of_words = materialize(questions.groupBy("bucket").applyInArrow(answer_words(n_words), ANSWERS), "words")
    totals = [x or 0 for x in of_words.where("chunk = -1").agg(F.sum("n_train"), F.sum("n_fit"), F.sum("kinds")).first()]
    of_words = of_words.where("chunk >= 0")
    # a chunk of empty texts asks about no word
    questions = meet(dealt, of_words, ask_grams(n_words, n_grams, order), QUESTIONS)
    of_grams = materialize(questions.groupBy("bucket").applyInArrow(answer_grams, ANSWERS), "grams")
    answers = of_words.unionByName(of_grams)

    n_fit, n_train = n_docs.get(FIT, 0), n_docs.get(FIT, 0) + n_docs.get(DEV, 0)
    kinds = totals[2] + (n_train > 0)
    fit = Counts("fit", totals[1] + n_fit, n_fit, kinds, n_words, n_grams, order)
    of_dev = lambda df: df.where(F.col("kind") == DEV)
    cells = meet(of_dev(dealt), of_dev(answers), dev_histogram(fit), "cell bigint, n double, p3 double, p2 double, p1 double")
    cells = cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "p3", "p2", "p1"))).withColumn("bucket", F.shiftright("cell", 30))
    learned = cells.groupBy("bucket").applyInArrow(learn_bucket(1 / (kinds + 1)), "bucket bigint, m3 double, m2 double, m1 double, m0 double").collect()
    weights = all_weights({r["bucket"]: np.array([r["m3"], r["m2"], r["m1"], r["m0"]]) for r in learned})
    train = Counts("train", totals[0] + n_train, n_train, kinds, n_words, n_grams, order)
    return dealt, answers, train, weights


def score(docs: DataFrame, training, order: int = 3) -> DataFrame:
    """SCORES of (doc_id, text); training: a condition on doc_id, true for the documents to learn from.

    A ninth of the training documents, by the hash of their id, is what the weights must explain.
    """
    with freed_shuffles(docs.sparkSession):
        dealt, answers, train, weights = learn(docs, training, order)
    return meet(dealt, answers, scorer(train, weights), SCORES)
