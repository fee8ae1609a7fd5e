"""op2, op7, op8, op10 and the pipeline."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from tesserae.llm import media, packing
from tesserae.llm.queries_contain import ORACLE_SQL, op2_containment
from tesserae.llm.queries_media import op7_avi_motion_jpeg
from tesserae.llm.queries_packing import op10_best_fit_packing, tokenizer_path
from tesserae.llm.queries_sharding import op8_virtual_slots, shard
from tests.llm.fixtures import edge_rows


@pytest.mark.parametrize("small", [True, False])
def test_op2(spark, sf, edge, small):
    path = edge if small else sf
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet{'/*.parquet' if small else ''}'")
    want = con.execute(ORACLE_SQL["op2_containment"]).fetchall()
    got = [tuple(r) for r in op2_containment(spark, path).collect()]
    assert collections.Counter(got) == collections.Counter(want) and got


def test_op2_blocks(spark, edge):
    from tesserae.llm import contain

    docs, items = spark.read.parquet(f"{edge}/documents.parquet"), spark.read.parquet(f"{edge}/benchmark.parquet")
    one, many = contain.search(docs, items), contain.search(docs, items, block_bytes=40)
    assert collections.Counter(map(tuple, one.collect())) == collections.Counter(map(tuple, many.collect()))


def test_op2_partitions_by_size(spark, empty):
    """Items of sizes from one shingle to thousands, at the border of containment, inside longer documents."""
    from tesserae.llm import contain

    rnd = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rnd.integers(0, 400, n)]
    items = [(i, " ".join(word(n))) for i, n in enumerate([3, 5, 6, 9, 17, 40, 130, 700, 3000])]
    docs = []
    for i, text in items:
        w = text.split()
        for share in (0.7, 0.8, 0.85, 1.0):
            docs.append((len(docs), " ".join([*word(30), *w[: int(share * len(w)) + 4], *word(50)])))
    docs += [(None, items[4][1]), (500, items[0][1]), (501, None), (502, "")]
    grams = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set()
    want = {(d, i, len(grams(t)), n) for d, x in docs for i, t in items if (n := len(grams(x) & grams(t))) and n >= 0.8 * len(grams(t)) - 1e-9}
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} bigint, text string")
    got = contain.search(frame(docs, "doc_id"), frame(items, "item_id"), block_bytes=4000).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and len(want) > 20
    assert len(contain.Sketches([i for i, _ in items], [t.encode() for _, t in items], 5, 0.8).partitions) >= 6
    assert op2_containment(spark, empty).isEmpty()


def padded(text):
    b = (text or "").encode()
    return b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))


def test_op7(spark, edge, empty):
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(padded(r[1])), hashlib.sha256(padded(r[1])).hexdigest(), zlib.crc32(padded(r[1])[-64:])) for r in edge_rows())
    out = op7_avi_motion_jpeg(spark, edge).collect()
    assert collections.Counter(tuple(r)[:5] for r in out) == want
    by_text = collections.defaultdict(set)
    for r in out:
        by_text[r["payload_sha256"]].add(tuple(r)[2:])
    assert all(len(v) == 1 for v in by_text.values())
    assert op7_avi_motion_jpeg(spark, empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=9000))
def test_avi_round_trip(payload):
    got, avi = media.decode(media.encode(payload))
    assert got == payload and len(avi.frames) == max(1, -(-len(payload) // media.PER_FRAME))


def test_avi_frames_are_jpeg_and_shots_are_found(spark):
    rnd = np.random.default_rng(1)
    scenes = [rnd.integers(0, 60, media.PER_FRAME * 5), rnd.integers(120, 250, media.PER_FRAME * 4)]
    stored = media.encode(np.concatenate(scenes).astype(np.uint8).tobytes())
    frames = media.parse(stored).frames
    assert all(b"\xff" not in f[len(media.header(64)) : -2] for f in frames)
    df = spark.createDataFrame([(1, bytearray(stored)), (2, None)], "id int, media binary")
    rows = [tuple(r) for r in media.clips(df, "media", ["id"]).collect()]
    assert [(r[0], r[2], r[3]) for r in rows] == [(1, 0, 5), (1, 5, 9)] and rows[1][4] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        media.parse(b"RIFFxxxx")


def test_frames_decode_alike_in_a_full_decoder():
    """Every block of a frame decodes to its sample, by the full decoder, too."""
    payload = np.random.default_rng(3).integers(0, 256, 64 * 5, np.uint8)
    (frame,) = media.parse(media.encode(payload.tobytes())).frames
    picture = media.frame_picture(frame)
    assert picture.shape == (40, 512) and (picture == np.kron(payload.reshape(5, 64), np.ones((8, 8), np.uint8))).all()
    assert (media.frame_samples(frame) == payload).all()
    extremes = np.array([0, 255, 0, 128, 255, 1] + [7] * 58, np.uint8)
    assert (media.frame_samples(media.parse(media.encode(extremes.tobytes())).frames[0]) == extremes).all()


def test_clips_of_a_file_by_another_maker(spark):
    """Colour frames of another size, coded by the library's encoder: shots come from what they show."""
    from tesserae.codecs import jpeg

    rnd = np.random.default_rng(4)
    scene = lambda level: [np.dstack([np.clip(level + rnd.normal(0, 3, (16, 24)), 0, 255).astype(np.uint8)] * 3 + [np.full((16, 24), 255, np.uint8)]) for _ in range(3)]
    frames = [jpeg.encode(f, 90) for f in scene(40) + scene(200)]
    movi, index = b"movi", b""
    for f in frames:
        index += b"00dc" + (16).to_bytes(4, "little") + len(movi).to_bytes(4, "little") + len(f).to_bytes(4, "little")
        movi += media.chunk(b"00dc", f)
    avih = (100_000).to_bytes(4, "little") + bytes(52)
    data = media.chunk(b"RIFF", b"AVI " + media.chunk(b"LIST", b"hdrl" + media.chunk(b"avih", avih)) + media.chunk(b"LIST", movi) + media.chunk(b"idx1", index))
    df = spark.createDataFrame([(1, bytearray(data))], "id int, media binary")
    assert [(r["first_frame"], r["end_frame"], round(r["start_s"], 3)) for r in media.clips(df, "media", ["id"]).collect()] == [(0, 3, 0.0), (3, 6, 0.3)]


@pytest.mark.parametrize("small", [True, False])
def test_op8(spark, sf, edge, docs, small):
    rows = [(r[0], r[1]) for r in edge_rows()] if small else list(docs.items())
    out = op8_virtual_slots(spark, edge if small else sf).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    places = collections.defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < 16 and r["law"] == "bytes" and r["grown_shard"] is None
        places[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    if not small:
        load = collections.Counter()
        for r in out:
            load[r["shard"]] += r["size"]
        assert max(load.values()) < 1.05 * min(load.values())


def rebalanced(loads, shard_of, n_shards):
    """The rule of sharding.rebalance, slot by slot."""
    mean, out, moved = -(-sum(loads.values()) // n_shards), {}, []
    load = [0] * n_shards
    for s in {shard_of[v] for v in loads}:
        total = 0
        for v in sorted((v for v in loads if shard_of[v] == s), key=lambda v: (-loads[v], v)):
            total += loads[v]
            if total <= mean and s < n_shards:
                out[v] = s
                load[s] += loads[v]
            else:
                moved.append(v)
    for v in sorted(moved, key=lambda v: (-loads[v], v)):
        s = load.index(min(load))
        out[v] = s
        load[s] += loads[v]
    return out


def test_op8_stores_loads_and_edits_its_map(spark, sf, tmp_path):
    docs, folder = spark.read.parquet(f"{sf}/documents.parquet"), f"file://{tmp_path}/map"
    maps = []
    for n_shards, version in ((16, 2), (16, 3), (20, 4)):
        out = shard(docs, n_shards, folder).collect()
        assert {r["map_version"] for r in out} == {version}
        loads = collections.Counter()
        for r in out:
            loads[r["vslot"]] += r["size"]
        old = maps[-1] if maps else {v: v % n_shards for v in loads}
        maps.append({r["vslot"]: r["shard"] for r in out})
        assert maps[-1] == rebalanced(loads, old, n_shards)
    assert maps[0] == maps[1] or sum(maps[0][v] != maps[1][v] for v in maps[0]) < len(maps[0]) // 4
    stored = {r["version"] for r in spark.read.parquet(folder).select("version").distinct().collect()}
    assert stored == {1, 2, 3, 4}


def test_op8_empty(spark, empty):
    assert op8_virtual_slots(spark, empty).count() == 0


def check_packing(out, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = collections.defaultdict(list)
    for d, text in texts:
        ids[d].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    want = collections.Counter()
    for d, many in ids.items():
        for x in many:
            want.update((d, k, s, n, zlib.crc32(x[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(x))))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    return len(sequences)


@pytest.mark.parametrize("small", [True, False])
def test_op10(spark, sf, edge, docs, small):
    texts = [(r[0], r[1]) for r in edge_rows()] if small else list(docs.items())
    out = op10_best_fit_packing(spark, edge if small else sf).collect()
    n = check_packing(out, texts)
    assert n <= 1.02 * -(-sum(r["length"] for r in out) // 1024) + 1


def test_op10_empty(spark, empty):
    assert op10_best_fit_packing(spark, empty).count() == 0


def test_packing_exchanges_between_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rnd = np.random.default_rng(2)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rnd.integers(300, 700, 400))]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES)).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(range(400))
    load = collections.Counter()
    for r in out:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 1024


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=7))
def test_bounds_hold(lengths):
    """The bound is below, and best fit above, the best of all packings."""

    def best(rest, bins):
        if not rest:
            return len(bins)
        n, out = rest[0], 99
        for i in range(len(bins)):
            if bins[i] + n <= 16:
                out = min(out, best(rest[1:], bins[:i] + (bins[i] + n,) + bins[i + 1 :]))
        return min(out, best(rest[1:], (*bins, n)))

    a = np.array(lengths)
    exact = best(tuple(sorted(lengths, reverse=True)), ())
    assert packing.lower_bound(np.bincount(a, minlength=17)) <= exact <= len(packing.best_fit(a, 16)[2])


def test_pipeline(spark, sf, edge, empty):
    con = duckdb.connect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(kept["language"]) == 200
    assert kept["decontamination"] < kept["suffix_dedup"] <= kept["near_dedup"] < kept["language"]
    for path in (edge, empty):
        out = corpus_pipeline.run(spark, path)
        assert "sequence_id" in out.columns
        assert out.count() > 0 if path == edge else out.isEmpty()
    con.close()


def test_pipeline_near_dedup_is_brute_force(spark, sf, docs):
    from tests.llm.fixtures import split

    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := split(t, fold=True)) else frozenset() for d, t in docs.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert {r["doc_id"] for r in got.collect()} == {d for d in ids if find(d) == d}
