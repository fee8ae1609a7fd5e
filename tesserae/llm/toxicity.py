"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed word and word-stem presence, limited to features whose share differs
significantly between confirmed and unlabelled texts, is trained in numpy from confirmed toxic
texts and unlabelled texts only: the risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
with the logistic loss; where the second term is negative, its gradient is taken back. The prior
is the share of toxic among labelled rows.

Null and empty texts have no feature and get the bias's score. Without a positive row every
score is the prior's. Equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae.llm.textblocks import Block, blocks, mix, prefix_hash, span_hash, values, words, _FOLD

BITS = 21
STEMS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample, and the optimiser's parameters."""

    positives: int = 6000
    unlabelled: int = 12000
    least_documents: int = 4
    significance: float = 6.0
    epochs: int = 300
    rate: float = 0.05
    decay: float = 1e-3
    seed: int = 4


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each word and stem (first bytes of a longer word)."""
    w = words(block, fold=True)
    counts = np.diff(w.bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    prefix = prefix_hash(_FOLD[block.data])
    ids, docs = [w.each()], [doc]
    for stem in STEMS:
        long = np.flatnonzero(w.ends - w.starts > stem)
        ids.append(mix(span_hash(prefix, w.starts[long], w.starts[long] + stem) + np.uint64(stem)))
        docs.append(doc[long])
    return np.concatenate(docs), (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_features(docs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(docs << BITS | ids)
    return key >> BITS, key & ((1 << BITS) - 1)


def feature_rows(sample: DataFrame) -> DataFrame:
    """(positive, ids) of each sampled text."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = values(batch.column("text"))
            out: list[bytes] = []
            for b in blocks(rows):
                docs, ids = distinct_features(*features(b))
                cuts = np.searchsorted(docs, np.arange(1, len(b.starts)))
                out += [x.astype(np.int32).tobytes() for x in np.split(ids, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(out, pa.binary())], names=["positive", "ids"])

    return sample.select("positive", "text").mapInArrow(extract, "positive boolean, ids binary")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def significant(of_p: np.ndarray, of_u: np.ndarray, n_p: int, n_u: int, s: Settings) -> np.ndarray:
    """Features whose shares differ by s.significance standard errors, in s.least_documents documents at least."""
    c_p, c_u = np.bincount(of_p, minlength=1 << BITS), np.bincount(of_u, minlength=1 << BITS)
    pooled = (c_p + c_u) / max(1, n_p + n_u)
    error = np.sqrt(pooled * (1 - pooled) * (1 / max(1, n_p) + 1 / max(1, n_u)))
    z = np.abs(c_p / max(1, n_p) - c_u / max(1, n_u))
    return np.flatnonzero((c_p + c_u >= s.least_documents) & (z >= s.significance * error) & (error > 0))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights of all features and the bias."""
    everything = positive + unlabelled
    ids = np.concatenate(everything) if everything else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(everything)), [len(x) for x in everything])
    used = significant(ids[row < len(positive)], ids[row >= len(positive)], len(positive), len(unlabelled), s)
    weights = np.zeros(1 << BITS)
    prior = float(np.clip(prior, 1e-4, 0.9999))
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled or not len(used):
        return weights, bias
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    col = place[ids]
    row, col = row[col >= 0], col[col >= 0]
    n, n_p = len(everything), len(positive)
    w, mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = bias
    for step in range(1, s.epochs + 1):
        f = np.bincount(row, weights=w[col], minlength=n) + w[-1]
        p = sigmoid(f)
        # derivatives of the losses by f: toxic log(1 + e^-f): p - 1; clean log(1 + e^f): p
        risk_u = np.logaddexp(0, f[n_p:]).mean()
        risk_p_neg = np.logaddexp(0, f[:n_p]).mean()
        negative = risk_u - prior * risk_p_neg
        g = np.zeros(n)
        sign = 1.0 if negative >= 0 else -1.0
        if negative >= 0:
            g[:n_p] += prior * (p[:n_p] - 1) / n_p
        g[:n_p] -= sign * prior * p[:n_p] / n_p
        g[n_p:] += sign * p[n_p:] / (n - n_p)
        grad = np.append(np.bincount(col, weights=g[row], minlength=len(used)), g.sum())
        grad[:-1] += s.decay * w[:-1]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        w -= s.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """docs: (doc_id, text) to learn from; labels: (doc_id, toxic) to learn from.

    The sample has s.positives confirmed rows and s.unlabelled documents at most, by the hash of
    their ids; its ids are joined by broadcast.
    """
    by_hash = lambda df: df.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    chosen = by_hash(known.where("toxic = 1")).limit(s.positives).select("doc_id", F.lit(True).alias("positive"))
    others = by_hash(docs.where("doc_id is not null")).limit(s.unlabelled).select("doc_id", F.lit(False).alias("positive"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.unionByName(others)), "doc_id")
    rows = [(r["positive"], np.frombuffer(r["ids"], np.int32)) for r in feature_rows(sample).toLocalIterator()]
    return train([x for y, x in rows if y], [x for y, x in rows if not y], prior or 0.0, s)


def score(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str], least: float = 1e-3) -> DataFrame:
    """keep's columns with score. The weights are a table of fixed size."""
    used = np.flatnonzero(np.abs(weights) >= least)
    w = weights[used]
    out_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.float64)
        table[used] = w
        live = table != 0
        for batch in batches:
            rows = values(batch.column(batch.num_columns - 1))
            out = np.full(len(rows), bias)
            for b in blocks(rows):
                docs_, ids = features(b)
                hit = live[ids]
                d, i = distinct_features(docs_[hit], ids[hit])
                out[b.lo : b.lo + len(b.starts)] += np.bincount(d, weights=table[i], minlength=len(b.starts))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sigmoid(out))], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{out_fields}, score double")
