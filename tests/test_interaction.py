"""Draw modes, the SQL hit test, files written whole, remote slides and the disk cache in the load path."""

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tesserae.functions import annotations as A
from tesserae.functions.register import register_functions
from tesserae.operators import disk_cache, slides
from tesserae.operators.cache import Lru
from tesserae.operators.interaction import Drafts
from tesserae.sinks import files
from tesserae.sources import bytesource
from tests.test_slides import make


def test_drafts():
    d, out = Drafts(), []
    log = [("tap", None, 1, 1), ("mode", "polyline", 0, 0), ("tap", None, 1, 2), ("finish", None, 0, 0), ("tap", None, 3, 4), ("finish", None, 0, 0), ("finish", None, 0, 0)]
    log += [("tap", None, 5, 5), ("mode", "polygon", 0, 0), ("tap", None, 6, 6), ("tap", None, 7, 7), ("finish", None, 0, 0), ("tap", None, 8, 6), ("mode", "polygon", 0, 0), ("finish", None, 0, 0)]
    log += [("mode", "rectangle", 0, 0), ("tap", None, 9, 9), ("start", None, 1, 1), ("end", None, 0, 0), ("start", None, 1, 1), ("move", None, 4, 5), ("end", None, 0, 0), ("start", None, 2, 2), ("cancel", None, 0, 0), ("end", None, 0, 0)]
    log += [("mode", "point", 0, 0), ("tap", None, 3, 3)]
    for e in log:
        if shape := d.handle(*e):
            out.append(shape)
    assert out == [("polyline", [(1, 2), (3, 4)]), ("polygon", [(6, 6), (7, 7), (8, 6)]), ("rectangle", [(1, 1), (4, 5)]), ("point", [(3, 3)])]


def test_hit_test_in_sql(spark):
    register_functions(spark)
    rnd = np.random.default_rng(9)
    rows = []
    for i in range(300):
        kind = ["point", "polyline", "rectangle", "polygon"][i % 4]
        points = [(float(x), float(y)) for x, y in rnd.integers(0, 12, (1 if kind == "point" else int(rnd.integers(1, 6)), 2))]
        rows.append((kind, points, bool(i % 3), float(rnd.integers(0, 13)), float(rnd.integers(0, 13)), float(rnd.integers(0, 3))))
    df = spark.createDataFrame(rows, f"kind string, points {A.POINTS}, filled boolean, px double, py double, tolerance double")
    got = df.select(F.expr("hit_test(kind, points, filled, px, py, tolerance)").alias("a"), A.hit(*(F.col(c) for c in df.columns)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and {r["a"] for r in got} == {True, False}


def test_cache_ranges_touch():
    lru = Lru(30)
    for x in (1, 2, 3):
        lru.put((0, x, 0, 0), 10)
    assert lru.visit_range(0, 0, 1, 1, 0, 0) == [(0, 1, 0, 0)] and lru.visit_range(0, 0, -50, 50, -50, 50)[-1] == (0, 1, 0, 0)
    assert lru.put((0, 4, 0, 0), 10) == [(0, 2, 0, 0)]
    assert lru.offer((0, 4, 0, 0), 10, 1, True) is None and lru.offer((0, 9, 0, 0), 10, 0, False) is None
    assert lru.offer((0, 4, 0, 0), 10, 0, True) == [] and lru.shrink_to(10) == [(0, 3, 0, 0), (0, 1, 0, 0)]


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    files.register(spark)
    (tmp_path / "a.bin").write_bytes(b"old")
    df = spark.createDataFrame([(f"{x}.bin", bytearray(x.encode() * 5_000_000)) for x in "ab"], "name string, data binary").repartition(2)
    df.write.format("slide_files").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "b.bin"] and (tmp_path / "a.bin").read_bytes() == b"a" * 5_000_000
    bad = spark.createDataFrame([("c.bin", bytearray(b"c")), ("../d.bin", bytearray(b"d"))], "name string, data binary").repartition(2)
    with pytest.raises(Exception):
        bad.write.format("slide_files").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "b.bin"]
    path = f"{tmp_path}/s.svs"
    image = make(path, 100, 80, 32, 33005)
    assert slides.region_to_file(spark, path, f"{tmp_path}/r.bmp", 0, 3, 4, 20, 10, "bmp") == (tmp_path / "r.bmp").stat().st_size
    n = slides.level_to_file(spark, path, f"{tmp_path}/l.raw", 0, kind=None)
    assert n == 32000 and (np.frombuffer((tmp_path / "l.raw").read_bytes(), np.uint8).reshape(80, 100, 4) == image).all()
    assert slides.associated_to_file(spark, path, f"{tmp_path}/label.png", "label") > 60
    with pytest.raises(ValueError):
        slides.associated_to_file(spark, path, f"{tmp_path}/macro.png", "macro")
    assert not (tmp_path / "macro.png").exists()


def test_info(spark, tmp_path):
    make(f"{tmp_path}/s.svs", 100, 80, 32)
    (r,) = slides.read_info(spark, f"{tmp_path}/s.svs").collect()
    assert r["metadata"]["MPP"] == "0.4990" and r["levels"][0]["tags"]["ImageWidth"]["ints"] == [100]
    assert [a["kind"] for a in r["associated"]] == ["label"] and r["associated"][0]["tags"]["ImageDescription"]["text"] == "my label"


def test_remote_slides(monkeypatch, tmp_path):
    image = make(f"{tmp_path}/s.svs", 100, 80, 32, 33005)
    monkeypatch.setattr(bytesource, "file_system", lambda uri: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), uri.removeprefix("store://bucket").lstrip("/")))
    assert bytesource.expand("store://bucket/*.svs") == bytesource.expand("store://bucket") == bytesource.expand("store://bucket/s.svs") == ["store://bucket/s.svs"]
    from tesserae.codecs import raster
    from tesserae.sources.slide import open_slide

    s = open_slide("store://bucket/s.svs")
    assert (raster.decode_tile(s.tile_bytes(0, 1, 1), 33005)[:, :, :3] == image[32:64, 32:64, :3]).all()
    assert s.source.read(10**9, 5) == b"" and 0 < s.source.bytes_read < (tmp_path / "s.svs").stat().st_size
    s.close()


def test_load_path(spark, tmp_path):
    path, folder = f"{tmp_path}/s.svs", f"{tmp_path}/cache"
    image = make(path, 100, 80, 32, 33005, sparse={(2, 0)})
    ask = spark.createDataFrame([(path, 0, 0, 0, 0, True), (path, 0, 1, 0, 0, False), (path, 0, 2, 0, 0, True), (path, 0, 1, 1, 1, True), (path, 7, 0, 0, 0, True)], "slide_id string, level int, tx int, ty int, reduction int, visible boolean")
    origins = lambda: {(r["level"], r["tx"], r["ty"]): (r["origin"], r["width"]) for r in disk_cache.load(ask, folder).collect()}
    first = origins()
    assert first == {(0, 0, 0): ("slide", 32), (0, 1, 0): ("slide", 32), (0, 2, 0): ("sparse", None), (0, 1, 1): ("slide", 16), (7, 0, 0): ("error", None)}
    assert origins() == first | {(0, 0, 0): ("disk", 32)}
    got = [r for r in disk_cache.load(ask, folder).collect() if r["origin"] == "disk"]
    assert (np.frombuffer(got[0]["rgba"], np.uint8).reshape(32, 32, 4) == image[:32, :32]).all()


def test_a_crop_reads_only_its_tiles(spark, tmp_path):
    """Of a slide of 30 x 30 tiles, a crop of four tiles reads the directory, the tables and those tiles."""
    path = f"{tmp_path}/big.svs"
    make(path, 960, 960, 32, 7, label=False)
    one = spark.createDataFrame([(0, path, 0, 40, 40, 40, 40)], "region_id long, slide_id string, level int, x int, y int, width int, height int")
    r = slides.read_regions(spark, path, one, kind=None).first()
    size = (tmp_path / "big.svs").stat().st_size
    assert r["bytes_read"] < 4 * (4000 + size // 900 * 3) and r["bytes_read"] < size // 20
