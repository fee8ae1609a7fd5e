"""Every catalogue query against its SQL, and golden values of the expressions."""

import os

import duckdb
import pytest
from pyspark.sql import Row, functions as F

import __spark_entry__ as entry
from tesserae import catalogue
from tesserae.functions import annotations as A, geometry as G, metadata as M
from tesserae.functions.adjust import Adjustments
from tesserae.operators import annotate, viewport
from tesserae.operators.cache import Lru, evictions

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    a = catalogue.queries()[name](spark, SF).toPandas()
    b = con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    c = sorted(a.columns)
    a, b = (x[c].sort_values(c).reset_index(drop=True) for x in (a, b))
    for k in c:
        assert ((a[k] == b[k]) | (a[k].isna() & b[k].isna())).all(), k


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_levels_spans_and_reductions(spark):
    ds = F.array(F.lit(1.0), F.lit(4.0), F.lit(16.0))
    assert [value(spark, G.select_level(ds, F.lit(s))) for s in (1.0, 2.0, 0.1, 0.02)] == [0, 0, 1, 2]
    odd = F.array(F.lit(1.0), F.lit(9.0), F.lit(2.0))  # the last that fits, not the coarsest
    assert value(spark, G.select_level(odd, F.lit(0.1))) == 2
    assert [value(spark, G.select_span(F.lit(s))) for s in (78.0, 64.0, 63.9, 7.68, 0.001)] == [0, 0, 1, 4, 6]
    assert [value(spark, G.select_reduction(F.lit(p))) for p in (1.3, 0.66, 0.65, 0.3, 0.1, 0.001)] == [0, 0, 1, 2, 3, 3]
    assert [value(spark, G.reduced_extent(F.lit(e), F.lit(r))) for e, r in ((240, 3), (71, 1), (1, 3))] == [30, 36, 1]


@pytest.mark.parametrize(
    "box,margin,want",
    [((0, 0, 300, 200), 0, (0, 1, 0, 0)), ((500, 500, 100, 100), 1, (0, 3, 0, 2)), ((10000, 10000, 100, 100), 0, (3, 3, 2, 2)), ((0, 0, 256, 256), 0, (0, 1, 0, 1))],
)
def test_visible_tiles(spark, box, margin, want):
    x, y, w, h = (float(v) for v in box)
    one = lambda o, n, tiles: G.visible_range(F.lit(o), F.lit(n), F.lit(1.0), F.lit(1.0), F.lit(256), F.lit(tiles).cast("long"), margin)
    got = (*one(x, w, 4), *one(y, h, 3))
    assert tuple(spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(got))).first()) == want


def test_wanted_counts(spark):
    """A slide of 64000 x 64000 in one level, seen whole at 1920 x 1080."""
    level = [{"width": 64000, "height": 64000, "tile_w": 256, "tile_h": 256, "downsample": 1.0}]
    s = 1080 / 64000
    v = spark.createDataFrame([(1, 1920.0, 1080.0, s, (64000 - 1920 / s) / 2, 0.0)], "vid long, w double, h double, scale double, ox double, oy double")
    planned = viewport.plan(v, level)
    count = lambda **k: viewport.wanted(planned, **k).count()
    grid = planned.first()
    assert grid["span"] == 4
    assert count(cache_bytes=150 << 20, most=50) == 50
    every = viewport.wanted(planned, cache_bytes=150 << 20)
    assert every.count() == (grid["max_tx_p"] - grid["min_tx_p"] + 1) * (grid["max_ty_p"] - grid["min_ty_p"] + 1)
    assert count(cache_bytes=150 << 20, pressured=True) <= every.where("priority = 'visible'").count()


def test_blit_plan(spark):
    n = lambda v: F.lit(v).cast("long")
    plan = lambda left: value(spark, G.blit_plan((n(100), n(50), n(400), n(250)), (n(left), n(0)), (n(256), n(256)), (n(100), n(50)), n(300)))
    assert plan(0).asDict() == {"rows": 200, "cols": 156, "src_first": 12900, "src_stride": 256, "dst_first": 0, "dst_stride": 300}
    assert (plan(256)["cols"], plan(256)["src_first"], plan(256)["dst_first"]) == (144, 12800, 156)
    assert plan(512) is None


def test_pyramid_dims(spark):
    dims = lambda w, h, t, k=None: [(r["width"], r["height"]) for r in value(spark, G.pyramid_dims(F.lit(w), F.lit(h), F.lit(t), k))]
    assert dims(500, 350, 128) == [(500, 350), (250, 175), (125, 88)]
    assert dims(800, 800, 128, 2) == [(800, 800), (400, 400)]


def test_measures(spark):
    pts = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    m = lambda kind, p, mx=1.0, my=1.0: tuple(value(spark, A.measure(F.lit(kind), p, F.lit(mx), F.lit(my))))
    assert m("rectangle", pts((0, 0), (10, 20)), 1.0, 2.0) == (100.0, 400.0)
    assert m("polygon", pts((0, 0), (4, 0), (0, 3))) == (12.0, 6.0)
    assert m("polyline", pts((0, 0), (3, 4))) == (5.0, None) and m("point", pts((1, 1))) == (None, None)
    assert m("polyline", pts((1, 1))) == (None, None) and m("polygon", pts((0, 0), (1, 1))) == (None, None)
    assert value(spark, A.measure(F.lit("polyline"), pts((0, 0), (3, 4)), F.lit(None).cast("double"), F.lit(1.0)))["length_um"] is None
    assert [value(spark, A.format_length(F.lit(v))) for v in (999.9, 1000.0)] == ["999.9 µm", "1.00 mm"]
    assert value(spark, A.format_area(F.lit(2e6))) == "2.00 mm²"


def test_hits(spark):
    pts = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    hit = lambda kind, p, filled, x, y, tol=1.0: value(spark, A.hit(F.lit(kind), p, F.lit(filled), F.lit(float(x)), F.lit(float(y)), F.lit(tol)))
    box = pts((0, 0), (10, 10))
    assert hit("rectangle", box, True, 5, 5) and not hit("rectangle", box, False, 5, 5) and hit("rectangle", box, False, 5, 0.5)
    assert hit("rectangle", box, True, 0, 0, 0.0) and not hit("rectangle", box, True, 11.5, 5)
    tri = pts((0, 0), (10, 0), (0, 10))
    assert hit("polygon", tri, True, 2, 2) and not hit("polygon", tri, False, 2, 2) and hit("polygon", tri, False, 5, 5)
    assert not hit("polyline", tri, False, 0, 5) and hit("polyline", tri, False, 5, 0.9)
    assert hit("point", pts((3, 3)), False, 3, 4) and not hit("point", pts((3, 3)), False, 3, 4.1)


def test_json_keeps_annotations(spark):
    pts = F.array(F.struct(F.lit(1.5).alias("x"), F.lit(2.0).alias("y")))
    text = A.to_json(F.lit("a"), F.lit("point"), pts, F.lit(4278190335).cast("long"), F.lit(3.0), F.lit(True), F.lit(None).cast("string"))
    assert value(spark, text) == '{"id":"a","type":"point","points":[[1.5,2.0]],"color":4278190335,"strokeWidth":3.0,"filled":true}'
    short = A.from_json(F.lit('{"id":"a","type":"polyline","points":[[1,2],[3,4]],"color":1}'))
    assert value(spark, short) == Row(id="a", type="polyline", points=[Row(x=1.0, y=2.0), Row(x=3.0, y=4.0)], color=1, stroke_width=2.0, filled=False, label=None)
    with pytest.raises(Exception, match="unknown annotation type"):
        value(spark, A.from_json(F.lit('{"id":"a","type":"star","points":[],"color":1}')))


def test_metadata(spark):
    text = "Aperio v11|AppMag = 20|MPP = 0.4990|A=b=c|x|=y|A = z | K=1d"
    one = lambda c: value(spark, c)
    assert one(M.fields(F.lit(text))) == {"AppMag": "20", "MPP": "0.4990", "A": "z", "K": "1d"}
    assert one(M.mpp(F.lit(text))) == 0.499 and one(M.app_mag(F.lit(text))) == 20
    assert one(M.mpp(F.lit("h|MPP=0.5f"))) is None and one(M.app_mag(F.lit("MPP=1|AppMag=2.0"))) is None
    assert one(M.mpp(F.lit("h|MPP"))) is None and one(M.jpeg_quality(F.lit("JPEG/RGB"))) is None
    assert one(M.associated_kind(F.lit("a Label of the Macro"))) == "macro" and one(M.associated_kind(F.lit(None).cast("string"))) == "thumbnail"
    assert one(M.tag_name(F.lit(65000))) == "Tag65000" and one(M.tag_name(F.lit(270))) == "ImageDescription"
    assert one(A.fixed_exact(F.lit(0.49905), 4)) == "0.4990"


def test_adjustments(spark):
    assert Adjustments().matrix() is None and Adjustments(brightness=1).matrix()[4] == 127.5
    a = Adjustments(brightness=0.1, contrast=0.3, shadows=0.5, highlights=-0.4)
    got = [r["v"] for r in spark.range(256).select(a.column(F.col("id"), F.lit(0)).alias("v"), "id").orderBy("id").collect()]
    assert got == a.table().tolist()
    assert value(spark, a.column(F.lit(9).cast("long"), F.lit(3))) == 9


def test_evictions(spark):
    e = spark.createDataFrame([(1, i, 10) for i in range(3)], "s int, seq int, size int")
    assert [r["seq"] for r in evictions(e, 25, 10, "s").orderBy("seq").collect()] == [0, 1]
    assert evictions(e, 25, 30, "s").count() == 3  # a reserve beyond the budget evicts everything
    assert evictions(e, 40, 10, "s").count() == 0


def test_lru():
    c = Lru(30)
    key = lambda i, level=0, span=0: (level, i, 0, span)
    for i in range(3):
        assert c.put(key(i), 10) == []
    assert c.get(key(0)) and not c.get(key(9))
    assert c.put(key(3), 10) == [key(1)]
    assert c.count_in_range(0, 0, 0, 2, 0, 0) == 2 and c.groups() == {(0, 0)}
    assert not c.admit(key(7), 10, 0, wanted=False) and c.admit(key(7), 10, 0, wanted=True)
    assert not c.admit(key(7), 10, 1, wanted=True)  # a sharper copy is there
    c.clear()
    assert c.bytes == 0


def test_drafts(spark):
    v = spark.createDataFrame([("a", 2, 1.0, 1.0), ("a", 1, 0.0, 0.0), ("b", 1, 0.0, 0.0)], "draft string, seq int, x double, y double")
    got = annotate.finished_paths(v, 2).collect()
    assert [(r["draft"], r["points"][0]["x"]) for r in got] == [("a", 0.0)]
    assert os.path.exists("/root/testdata")
