"""Texts longer than a block, with copies of passages inside, through every operator; and stages against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tesserae.llm import contain, langid, lm, minhash, packing, sharding, substring, suffix, textblocks, toxicity
from tesserae.llm.queries_media import SCHEMA, digest
from tesserae.llm.queries_packing import tokenizer_path
from tesserae.llm.queries_sharding import shard
from tests.llm.fixtures import split
from tests.llm.test_dedup import brute_bytes, brute_words, components
from tests.llm.test_tables import check_packing


def prose(n, seed):
    rnd = random.Random(seed)
    return [f"w{rnd.randint(0, 3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    a, b = prose(140_000, 1), prose(130_000, 2)
    near = list(a)
    for i in range(0, len(near), 400):
        near[i] = f"x{i}"
    b[5000:5300] = a[90_000:90_300]
    out = [(1, " ".join(a)), (2, " ".join(near)), (3, " ".join(b)), (4, " ".join(a[70_000:70_200])), (5, ""), (6, "short one")]
    assert min(len(t) for _, t in out[:3]) > textblocks.BLOCK
    return out


@pytest.fixture(scope="module")
def long_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_op1(long_docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(long_docs).collect()}
    assert got == components(rows) and got[2][1] == 1


@pytest.mark.parametrize("module,brute", [(suffix, brute_bytes), (substring, brute_words)])
def test_op5_and_op9(long_docs, rows, module, brute):
    assert collections.Counter(tuple(r) for r in module.removal_digests(long_docs, segment=1 << 16).collect()) == collections.Counter(brute(rows))


def test_op2(spark, long_docs, rows):
    words = rows[0][1].split()
    items = [(1, " ".join(words[100_000:100_050])), (2, " ".join(words[:30] + ["no"] * 30)), (3, rows[3][1]), (4, rows[2][1])]
    grams = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set()
    sets, want = {i: grams(t) for i, t in items}, set()
    for d, t in rows:
        mine = grams(t)
        want |= {(d, i, len(s), len(s & mine)) for i, s in sets.items() if len(s & mine) >= 0.8 * len(s) - 1e-9}
    got = {tuple(r) for r in contain.search(long_docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == want and len(want) >= 4


def test_op3(long_docs, rows):
    tokens = {d: [*split(t, fold=True), None] for d, t in rows}
    count = collections.Counter(w for d in (1, 2, 4, 6) for w in tokens[d])
    n, v = sum(count.values()), len(count)
    from pyspark.sql import functions as F

    for r in lm.score(long_docs, F.col("doc_id").isin(1, 2, 4, 6)).collect():
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), abs=1e-3)
        assert np.isfinite(r["score"]) and r["score"] < 0


def test_op4_score_is_brute_force(spark, long_docs, rows):
    """The sigmoid of the bias and the weights of all distinct words and stems, for long and short texts and none."""
    weights = np.random.default_rng(3).normal(0, 0.05, 1 << toxicity.BITS)
    key = lambda h: int(h) >> (64 - toxicity.BITS)

    def features(word):
        block = next(textblocks.blocks([word.encode()]))
        out = {key(textblocks.words(block, fold=True).each()[0])}
        prefix, raw = textblocks.prefix_hash(textblocks._FOLD[block.data]), word.encode()
        for stem in toxicity.STEMS:
            if len(raw) > stem:
                h = textblocks.span_hash(prefix, np.array([0]), np.array([stem]))
                out.add(key(textblocks.mix(h + np.uint64(stem))[0]))
        return out

    known = {}
    for r in toxicity.score(long_docs, weights, -0.3, ["doc_id"], least=0.0).collect():
        mine = set()
        for w in set(split(dict(rows)[r["doc_id"]], fold=True)):
            known[w] = known.get(w) or features(w)
            mine |= known[w]
        assert r["score"] == pytest.approx(float(toxicity.sigmoid(np.array(-0.3 + weights[sorted(mine)].sum()))), abs=1e-9)


def test_op4_gradient_is_that_of_the_non_negative_risk():
    """One step from the start, against numbers: the risk's slope by each weight, in the case that is corrected and in the one that is not."""
    s = toxicity.Settings(epochs=1, least_documents=1, significance=0.0, decay=0.0, rate=1e-3)
    pos, unl = [np.array([1, 2]), np.array([1])], [np.array([2, 3]), np.array([3]), np.array([1, 3])]
    for prior in (0.1, 0.9):
        w, b = toxicity.train(pos, unl, prior, s)
        bias = math.log(prior / (1 - prior))

        def parts(d):
            f = lambda ids: bias + d.get("b", 0) + sum(d.get(i, 0) for i in ids)
            soft = lambda x: math.log1p(math.exp(x))
            p, n = np.mean([soft(-f(x)) for x in pos]), np.mean([soft(f(x)) for x in unl]) - prior * np.mean([soft(f(x)) for x in pos])
            return prior * p, n

        for i in (1, 2, 3, "b"):
            (p1, n1), (p0, n0) = parts({i: 1e-6}), parts({i: -1e-6})
            slope = (p1 - p0 + n1 - n0) / 2e-6 if parts({})[1] >= 0 else -(n1 - n0) / 2e-6
            step = (b - bias) if i == "b" else w[i]
            assert abs(slope) < 1e-9 or np.sign(step) == -np.sign(slope)  # Adam's first step has the rate's size


def test_op6(long_docs, rows):
    names, heads = ["aa", "bb"], np.random.default_rng(1).normal(0, 1, (2, langid.DIM))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(long_docs, names, heads, ["doc_id"]).collect()}
    unit = lambda v: v / np.linalg.norm(v)
    profile = np.stack([unit(h) for h in heads])
    centre = profile.mean(axis=0)
    for d, t in rows:
        v = langid.bundle([t.encode()])[0][0].astype(float)
        want = names[int(np.argmax([unit(p - centre) @ unit(unit(v) - centre) for p in profile]))] if t else "und"
        assert got[d] == want


def test_op7(rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
    for _, t in rows:
        b = t.encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        r = dict(zip(names, digest(b)))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["n_frames"] == max(1, -(-len(p) // 4096))


def test_op8(long_docs, rows):
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in shard(long_docs, 4).collect()}
    assert got == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows} and sharding.N_SLOTS == 4096


def test_op10(long_docs, rows):
    out = packing.pack(packing.pieces(long_docs, tokenizer_path())).collect()
    n = check_packing(out, rows)
    assert n <= 1.01 * -(-sum(r["length"] for r in out) // 1024) + 1


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_suffix_stage_is_brute_force(spark, sf, docs):
    stage = corpus_pipeline.suffix_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    rows = sorted(docs.items())
    seen, want = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if not gone.any() or kept.strip(" "):
            want[d] = (kept, len(kept))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage.collect()} == want


def test_decontamination_stage_is_brute_force(spark, sf, docs):
    import duckdb

    grams = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := split(t, fold=True)) else set()
    items = [grams(t) for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    sets = {d: grams(t) for d, t in docs.items()}
    want = {d for d, s in sets.items() if not any(i and len(i & s) >= 0.8 * len(i) - 1e-9 for i in items)}
    got = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert {r["doc_id"] for r in got.collect()} == want and len(want) < len(docs)
