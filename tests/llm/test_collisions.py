"""Words whose polynomial hashes modulo 2**64 are equal under every odd base, and the limits of packed places."""

import collections

import numpy as np
import pytest

from tesserae.llm import contain, minhash, substring, suffix, textblocks
from tests.llm.test_dedup import brute_bytes, brute_words, components


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


X, Y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_the_pair_collides_modulo_two_to_the_64():
    p = textblocks.prefix_hash(np.frombuffer((X + Y).encode(), np.uint8))
    a, b = textblocks.span_hash(p, np.array([0, 1024]), np.array([1024, 2048]))
    assert a == b
    w = textblocks.words(next(textblocks.blocks([(X + " " + Y).encode()])), fold=True)
    assert len(set(w.each(0).tolist())) == len(set(w.each(1).tolist())) == 2


def rows():
    prose = [f"w{i}" for i in range(120)]
    out = [(1, X), (2, Y), (3, " ".join([X] * 40)), (4, " ".join([Y] * 40)), (5, " ".join(prose[:60] + [X] + prose[60:])), (6, " ".join(prose[:60] + [Y] + prose[60:]))]
    return [*out, (7, X), (8, Y + Y), (9, X + X)]


def test_op1(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows(), "doc_id bigint, text string")).collect()}
    assert got == components(rows())


@pytest.mark.parametrize("module,brute", [(suffix, brute_bytes), (substring, brute_words)])
def test_op5_and_op9(spark, module, brute):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string")
    for limits in ({}, {"crowded": 0}, {"segment": 50}):
        assert collections.Counter(tuple(r) for r in module.removal_digests(docs, **limits).collect()) == collections.Counter(brute(rows()))


def test_op2(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, Y), (2, " ".join([Y] * 6))], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contain.search(docs, items).collect()} == {(2, 1), (4, 2)}


def test_lanes_are_polynomials_over_the_field(monkeypatch):
    monkeypatch.setattr(textblocks, "SEGMENT", 5)
    textblocks.field_powers.cache_clear()
    data = np.random.default_rng(0).integers(0, 256, 41).astype(np.uint8)
    for lane, x in enumerate(textblocks.POINTS):
        p = textblocks.lane_prefix(data, lane)
        for i, j in ((0, 41), (3, 4), (7, 30), (12, 17)):
            want = sum((int(data[k]) + 1) * pow(x, k - i, textblocks.FIELD) for k in range(i, j)) % textblocks.FIELD
            assert textblocks.lane_span(p, np.array([i]), np.array([j]), lane)[0] == textblocks.mix(np.array([want], np.uint64))[0]
    textblocks.field_powers.cache_clear()


def test_pairs_with_one_half_in_common_are_told_apart():
    h, check = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    first, number, counts = textblocks.rank_pairs(h, check)
    assert first.tolist() == [0, 1, 2] and number.tolist() == [0, 1, 2, 0] and counts.tolist() == [2, 1, 1]


def test_sketches_count_a_string_once():
    from tesserae.llm.anchors import estimate

    bits = np.uint32(1) << np.minimum(np.random.default_rng(1).geometric(0.5, 5000) - 1, 31).astype(np.uint32)
    many = estimate(np.bitwise_or.reduce(bits, keepdims=True))[0]
    assert 1000 < many < 40000 and estimate(np.array([1, 2, 8], np.uint32)).max() < 3


def test_op1_rows_that_share_an_id_keep_their_own_links(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:50], "x", *base[50:]])
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(3, " ".join(base)), (5, other), (5, near), (7, other + " "), (9, "alone")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(3, 98, 3, True), (5, 48, 5, True), (5, 99, 3, False), (7, 48, 5, False), (9, 1, 9, True)]


def test_word_keys_tell_words_of_any_length_apart():
    texts = ["a", "a\0", "\0", "\0\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "é" * 4, "é" * 5, X, Y, "a"]
    w = textblocks.words(next(textblocks.blocks([" ".join(texts).encode()])), fold=False)
    assert len(set(zip(*(k.tolist() for k in w.keys())))) == len(set(texts))
