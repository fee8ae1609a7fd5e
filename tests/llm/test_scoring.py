"""op3, op4 and op6."""

import collections
import glob
import math
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import langid, lm, toxicity
from tesserae.llm.common import CLEANUP, split_of
from tesserae.llm.queries_langid import op6_hyperdimensional
from tesserae.llm.queries_lm import op3_deleted_interpolation
from tesserae.llm.queries_toxicity import op4_positive_unlabelled
from tests.llm.fixtures import edge_rows, split

crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode())


@pytest.mark.parametrize("small", [True, False])
def test_op3_base_score(spark, sf, edge, docs, small):
    rows = [(r[0], r[1]) for r in edge_rows()] if small else list(docs.items())
    tokens = [(d, [*split(t, fold=True), None]) for d, t in rows]
    count = collections.Counter(w for d, ws in tokens if crc(d) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    want = collections.Counter((d, crc(d) % 10 == 0, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for d, ws in tokens)
    out = op3_deleted_interpolation(spark, edge if small else sf).collect()
    got = collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out)
    assert got == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in out)
    if not small:
        held = [r for r in out if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_scores(rows, dev, order):
    """(doc_id, score) of every row: counts by tuples of words, weights by a plain EM over the cells."""
    tokens = [(d, ["<s>", "<s>", *split(t, fold=True), None]) for d, t in rows]

    def counts(chosen):
        c = collections.Counter()
        for d, w in tokens:
            if chosen(d):
                for i in range(2, len(w)):
                    c.update([("3", *w[i - 2 : i + 1]), ("h3", *w[i - 2 : i]), ("2", *w[i - 1 : i + 1]), ("h2", w[i - 1]), ("1", w[i])])
        return c

    trained = lambda d: crc(d) % 10 != 0
    train, fit = counts(trained), counts(lambda d: trained(d) and not dev[d])
    v = sum(k[0] == "1" for k in train)

    def parts(c, n, g, h, w):
        gh, hh = c["h3", g, h] if order > 2 else 0, c["h2", h]
        bucket = gh.bit_length() if gh else 64 + hh.bit_length()
        return bucket, (c["3", g, h, w] / gh if gh else 0.0, c["2", h, w] / hh if hh else 0.0, c["1", w] / max(1, n), 1 / (v + 1))

    total = lambda c: sum(x for k, x in c.items() if k[0] == "1")
    n_train, n_fit = total(train), total(fit)
    cells = collections.defaultdict(lambda: np.zeros(4))
    for d, w in tokens:
        if trained(d) and dev[d]:
            for i in range(2, len(w)):
                b, p = parts(fit, n_fit, *w[i - 2 : i + 1])
                cells[b, *(math.floor(-math.log2(x) * lm.STEPS) + 1 if x else 0 for x in p[:3])] += (1, *p[:3])
    learned = {}
    for b in {k[0] for k in cells}:
        mine = [(x[0], np.append(x[1:] / x[0], 1 / (v + 1))) for k, x in cells.items() if k[0] == b]
        m = lm.start_of(b)
        for _ in range(200):
            old, m = m, sum(n * m * p / (m @ p) for n, p in mine) / sum(n for n, _ in mine)
            if np.abs(m - old).max() < 1e-7:
                break
        m = np.where(lm.start_of(b) > 0, np.maximum(m, 1e-9), 0)
        learned[b] = m / m.sum()
    weights = lm.all_weights(learned)
    out = collections.Counter()
    for d, w in tokens:
        each = [parts(train, n_train, *w[i - 2 : i + 1]) for i in range(2, len(w))]
        out[d, round(sum(math.log10(weights[b] @ np.array(p)) for b, p in each), 3)] += 1
    return out


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("small", [True, False])
def test_op3_score_is_brute_force(spark, sf, edge, docs, small, order):
    rows = [(r[0], r[1]) for r in edge_rows()] if small else list(docs.items())
    df = spark.read.parquet(f"{edge if small else sf}/documents.parquet")
    dev = {r["doc_id"]: r["dev"] for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'dev'), 9) = 0 dev").collect()}
    got = lm.score(df, split_of(F.col("doc_id"), 10) != 0, order).collect()
    assert collections.Counter((r["doc_id"], round(r["score"], 3)) for r in got) == brute_scores(rows, dev, order)


def test_op3_empty(spark, empty):
    assert op3_deleted_interpolation(spark, empty).count() == 0


def test_op3_frees_shuffle_files_between_steps(spark, sf):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p for d in manager.localDirsString() for p in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    kept = spark.conf.get(CLEANUP)
    before = files()
    scored = op3_deleted_interpolation(spark, sf)
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(CLEANUP) == kept
    assert sorted(scored.collect()) == sorted(scored.collect())


def test_frequent_words_have_small_numbers():
    """Two chunks ask about words of one bucket: equal words get one number, the most frequent the least."""
    keys = lambda *a: np.array(a, np.uint64).tobytes()
    asked = [(0, lm.FIT, 3, keys(5, 7, 9), keys(1, 1, 1), lm.squeeze(np.array([1, 2, 50])), *[None] * 3), (1, lm.DEV, 3, keys(7), keys(1), lm.squeeze(np.array([9])), *[None] * 3)]
    rows = lm.answer_words(4)((pa.scalar(3),), lm.tabled(lm.QUESTIONS, asked)).to_pylist()
    assert [lm.expand(r["number"]).tolist() for r in rows[:2]] == [[lm.FIRST + 3 + 8, lm.FIRST + 3 + 4, lm.FIRST + 3], [lm.FIRST + 3 + 4]]
    assert lm.expand(rows[0]["train"]).tolist() == [1, 11, 50] and lm.expand(rows[1]["train"]).tolist() == [11]


def test_counts_beyond_32_bits():
    """A word that two chunks hold five thousand million times each, by the messages that say so."""
    n = 5_000_000_000
    key = np.array([7], np.uint64).tobytes()
    asked = lm.tabled(lm.QUESTIONS, [(c, lm.FIT, 3, key, key, lm.squeeze(np.array([n])), None, None, None) for c in (0, 1)])
    rows = lm.answer_words(5)((pa.scalar(3),), asked).to_pylist()
    assert lm.expand(rows[0]["train"]).tolist() == [2 * n] and rows[2]["n_train"] == 2 * n
    one = lm.squeeze(np.array([1]))
    asked = lm.tabled(lm.QUESTIONS, [(c, lm.FIT, 3, one, one, lm.squeeze(np.array([n])), one, one, lm.squeeze(np.array([n]))) for c in (0, 1)])
    rows = lm.answer_grams((pa.scalar(3),), asked).to_pylist()
    assert lm.expand(rows[0]["train"]).tolist() == lm.expand(rows[1]["train3"]).tolist() == [2 * n]


def test_numbers_of_any_width():
    for a in ([], [0], [255, 0, 1], [1 << 40, 3], [(1 << 63) - 1, 1 << 62]):
        assert lm.expand(lm.squeeze(np.array(a, np.int64))).tolist() == a
    x, y = np.array([1 << 40, 3, 1 << 40, 3]), np.array([1 << 50, 4, 1 << 50, 5])
    assert lm.dense(x, y)[0].tolist() == [2, 0, 2, 1] and lm.dense(x & 7, y & 7)[1] == 3


def test_em_prefers_the_better_estimate():
    p = np.array([[0.6, 0.4], [0.01, 0.02], [1e-3, 1e-3], [1e-4, 1e-4]])
    m = lm.maximise(np.array([100.0, 50.0]), p, lm.start_of(4))
    assert m[0] > 0.95 and abs(m.sum() - 1) < 1e-9
    w = lm.all_weights({4: m})
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[64][0] == w[64][1] == w[70][0] == 0 and (w[9] == m).all()


def test_op4_finds_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in op4_positive_unlabelled(spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall()
    held = [(got[d]["predicted"], y) for d, y in labels if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (crc(d) % 5 == 0) for d, _ in labels)
    toxic = [p for p, y in held if y == 1]
    clean = [p for p, y in held if y == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.03


def test_op4_edges(spark, edge, empty):
    out = op4_positive_unlabelled(spark, edge).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert op4_positive_unlabelled(spark, empty).count() == 0


def test_nnpu_without_positives():
    w, b = toxicity.train([], [np.array([1, 2], np.int32)], 0.0, toxicity.Settings())
    assert not w.any() and np.isfinite(b)


def test_op6_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op6_hyperdimensional(spark, sf).collect()}
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall()
    assert all(got[d]["held_out"] == (crc(d) % 4 == 2) for d, _ in truth)
    assert np.mean([got[d]["lang_pred"] == lang for d, lang in truth if got[d]["held_out"]]) > 0.95


def test_op6_edges(spark, edge, empty):
    rows = edge_rows()
    out = op6_hyperdimensional(spark, edge).collect()
    assert len(out) == len(rows)
    no_letter = {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")} - {None}
    for r in out:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (r["doc_id"] in no_letter)
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
    assert op6_hyperdimensional(spark, empty).count() == 0


def brute_vector(text, dim):
    """Sum of the bound vectors of every trigram with a letter in it or around it."""
    low = [0, 0, *(langid.letters()[ord(x)] for x in text), 0, 0]
    vec = {x: langid.letter_vectors(np.array([x]), dim)[0].astype(np.int64) for x in set(low)}
    out = np.zeros(dim, np.int64)
    for x, y, z in zip(low, low[1:], low[2:]):
        if y or (x and z):
            out += np.roll(vec[x], 2) * np.roll(vec[y], 1) * vec[z]
    return out


def test_op6_bundles_equal_bound_vectors(monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 3)
    texts = ["abc", "12", "", "Straße, Ärger", "日本語 テスト", "привет " * 9, "é1é", "x" * 700]
    got, has = langid.bundle([t.encode() for t in texts], 64)
    assert has.tolist() == [any(c.isalpha() for c in t) for t in texts]
    assert all((g == brute_vector(t, 64)).all() for g, t in zip(got, texts))


def test_op6_letters_have_vectors_of_their_own():
    some = langid.letters()[[ord(x) for x in "abzäßж語本日ひ"]]
    vectors = langid.letter_vectors(some, 1024).astype(int)
    angles = vectors @ vectors.T / 1024
    assert np.abs(angles - np.eye(len(some))).max() < 0.15


def test_op6_prediction_is_brute_force(spark, sf, docs):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet'").fetchall()
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    vectors = {d: unit(brute_vector(t or "", langid.DIM)) for d, t, _ in rows if len(t or "") < 6000}
    names = sorted({lang for *_, lang in rows})
    # long documents take the operator's own bundles: the one above is held against brute force
    vectors |= {d: unit(langid.bundle([t.encode()])[0][0].astype(float)) for d, t, _ in rows if d not in vectors}
    protos = np.stack([unit(sum(vectors[d] for d, t, x in rows if x == lang and crc(d) % 4 != 2)) for lang in names])
    heads = np.stack([unit(p - protos.mean(axis=0)) for p in protos])
    for r in op6_hyperdimensional(spark, sf).collect():
        cos = heads @ unit(vectors[r["doc_id"]] - protos.mean(axis=0))
        assert r["lang_pred"] == names[cos.argmax()] and abs(r["score"] - max(0, cos.max())) < 1e-3
