"""op1, op5 and op9 against brute force."""

import collections
import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tesserae.llm import queries_minhash, queries_substring, queries_suffix, substring, suffix
from tesserae.llm.queries_minhash import op1_min_max_hashing
from tesserae.llm.queries_substring import op9_suffix_automata
from tesserae.llm.queries_suffix import op5_interval_expansion
from tesserae.llm.substring import SuffixAutomaton
from tesserae.llm.suffix import deduplicated, long_common_prefixes, suffix_order
from tests.llm.fixtures import edge_rows, split


def rows_of(docs):
    return sorted(docs.items())


def edge_docs():
    """Rows in the operators' order: by doc_id, then text, rows without an id last."""
    rows = [(r[0], r[1]) for r in edge_rows()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


def components(rows):
    sets = {}
    for d, t in rows:
        w = split(t, fold=True)
        sets[d] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if d is not None]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("small", [True, False])
def test_op1(spark, sf, edge, docs, small):
    rows = edge_docs() if small else rows_of(docs)
    got = op1_min_max_hashing(spark, edge if small else sf).collect()
    want = components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
        else:
            assert r["component_id"] is None and r["kept"]


def test_op1_keeps_links_in_one_large_group(spark, tmp_path):
    """Copies of a text with random edits: many are linked through the original only."""
    rnd = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(1000, " ".join(base))]
    for i in range(300):
        w = list(base)
        for at in rnd.choice(150, rnd.integers(1, 9), replace=False):
            w[at] = f"x{rnd.integers(1 << 40)}"
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = components(rows)
    for r in op1_min_max_hashing(spark, str(tmp_path)).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def brute_bytes(rows):
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows):
    words = [(d, [w.encode() for w in split(t)]) for d, t in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    out = []
    for d, w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("query,brute", [(op5_interval_expansion, brute_bytes), (op9_suffix_automata, brute_words)])
def test_op5_and_op9(spark, sf, edge, docs, small, query, brute):
    got = collections.Counter(tuple(r) for r in query(spark, edge if small else sf).collect())
    assert got == collections.Counter(brute(edge_docs() if small else rows_of(docs)))


@pytest.mark.parametrize("module", [queries_minhash, queries_suffix, queries_substring])
def test_sql(spark, sf, module):
    ((name, sql),) = module.ORACLE_SQL.items()
    got = getattr(module, name)(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert collections.Counter(map(tuple, got.select(*names).collect())) == collections.Counter(want.fetchall())


@pytest.mark.parametrize("module,brute", [(suffix, brute_bytes), (substring, brute_words)])
def test_a_passage_in_many_contexts(spark, module, brute):
    """Its edges give each document another string under the same anchors, which are split into windows."""
    rnd = np.random.default_rng(8)
    prose = lambda n: " ".join("".join(rnd.choice(list("abcdefgh"), rnd.integers(1, 8))) for _ in range(n))
    passage, other = prose(60), prose(50)
    rows = [(i, prose(40) + " " + (passage if i % 3 else passage[: 150 + i]) + " " + prose(30) + (" " + other if i % 7 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for limits in ({}, {"crowded": 10, "solve_bytes": 1000, "segment": 64}, {"crowded": 0}):
        got = collections.Counter(tuple(r) for r in module.removal_digests(docs, **limits).collect())
        assert got == collections.Counter(brute(rows))


@pytest.mark.parametrize("query", [op1_min_max_hashing, op5_interval_expansion, op9_suffix_automata])
def test_empty_table(spark, empty, query):
    assert query(spark, empty).count() == 0


def test_suffix_texts_stay_whole_characters(spark, edge):
    got = deduplicated(spark.read.parquet(f"{edge}/documents.parquet"), keep=("lang",))
    assert got.columns == ["doc_id", "text", "lang", "n_removed"]
    for r in got.where("n_removed > 0").collect():
        r["text"].encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 8))
def test_interval_expansion(symbols, length):
    text = np.array([*symbols, 0], np.int64)
    order = suffix_order(text, length)
    got = long_common_prefixes(text, order, length)
    key = lambda i: tuple(text[i : i + length])
    for i in range(1, len(order)):
        a, b = key(order[i - 1]), key(order[i])
        if 0 not in a and 0 not in b and len(a) == len(b) == length:
            assert got[i] == (a == b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 2), max_size=25), min_size=1, max_size=4), st.integers(1, 5))
def test_suffix_automaton(sequences, length):
    a = SuffixAutomaton()
    for s in sequences:
        a.add(s, 1)
    a.finish()
    count = collections.Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    for s in sequences:
        assert a.repeated_ends(s, length) == [i for i in range(length, len(s) + 1) if count[tuple(s[i - length : i])] > 1]
