"""Catalogue: pixels, tiles, regions and pyramids of the virtual slide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tesserae.functions import geometry as G
from tesserae.functions.adjust import Adjustments
from tesserae.operators import pyramid, region
from tesserae.plans.slide import PIXELS_SQL, TILE, grid_width, pixels, table, tiles

WITH = f"WITH {PIXELS_SQL}"
SETTING = Adjustments(brightness=0.25, contrast=0.5)
#: The affine map of SETTING, in SQL.
SLOPE, SHIFT = 1.5, (-0.5 * 1.5 + 0.5 + 0.125) * 255


def _extent(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    e = table(spark, sf_dir, "embeddings")
    n, w = e.count(), grid_width(e)
    return w * TILE, -(-n // w) * TILE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of the slide, adjusted and halved."""
    p = region.crop(pixels(spark, sf_dir), 5, 3, 40, 30, TILE)
    return pyramid.halve(p.withColumn("v", SETTING.column(F.col("v"), F.col("c"))))


def pixels_explode(spark, sf_dir):
    return pixels(spark, sf_dir)


def tile_index(spark, sf_dir):
    t = pixels(spark, sf_dir).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("byte_count"), F.sum("v").alias("total"))
    e = table(spark, sf_dir, "embeddings")
    return t.select("tx", "ty", (F.col("ty") * grid_width(e) + F.col("tx")).alias("tile"), "byte_count", "total")


def sparse_tiles(spark, sf_dir):
    w, h = (n // TILE for n in _extent(spark, sf_dir))
    grid = spark.range(w * h).select((F.col("id") % w).alias("tx"), F.floor(F.col("id") / w).cast("long").alias("ty"))
    return grid.join(tiles(spark, sf_dir).select("tx", "ty"), ["tx", "ty"], "left_anti")


def region_crop(spark, sf_dir):
    return region.crop(pixels(spark, sf_dir), 5, 3, 40, 30, TILE)


def region_overhang(spark, sf_dir):
    return region.padded(spark, region.crop(pixels(spark, sf_dir), -6, -4, 30, 20, TILE), 30, 20)


def _rects(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = lambda c: c.cast("long")
    return p.select(n(F.col("p_partkey")).alias("region_id"), n(F.col("p_partkey") * 7 % 60).alias("x0"), n(F.col("p_partkey") * 11 % 50).alias("y0"), n(F.col("p_size") % 9 + 1).alias("w"), n(F.col("p_size") % 7 + 1).alias("h"))


def regions_batch(spark, sf_dir):
    return region.totals(_rects(spark, sf_dir), pixels(spark, sf_dir), TILE)


def blit_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey").cast("long"), lambda v: F.lit(v).cast("long")
    left, top = k % 40 - 10, k % 30 - 5
    plan = G.blit_plan((left, top, left + F.col("p_size").cast("long"), top + 20), (k * 3 % 50, k * 5 % 40), (n(16), n(12)), (left, top), F.col("p_size").cast("long"))
    return p.select(k.alias("p_partkey"), plan.alias("p")).select("p_partkey", "p.*")


def adjust_affine(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return p.select("x", "y", "c", SETTING.column(F.col("v"), F.col("c")).alias("v"))


def _level(n):
    def query(spark, sf_dir):
        return pyramid.level(pixels(spark, sf_dir), n)

    return query


def pyramid_odd_tile(spark, sf_dir):
    return pyramid.level(pixels(spark, sf_dir), 2, tile=5)


def pyramid_dims(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w, h = F.lit(100) + F.col("p_size").cast("long") * 37, F.lit(80) + F.col("p_size").cast("long") * 23
    rows = p.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.explode(G.pyramid_dims(w, h, F.lit(64).cast("long"), 3)).alias("d"))
    return rows.select("p_partkey", "d.level", "d.width", "d.height")


def thumbnail_resize(spark, sf_dir):
    w, h = _extent(spark, sf_dir)
    return pyramid.resize(pixels(spark, sf_dir), w, h, 13, 11)


def level_region_map(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    levels = spark.createDataFrame([(1, 400, 300, 2.0), (2, 100, 75, 8.0)], "level int, width long, height long, downsample double")
    met = s.join(F.broadcast(levels))
    k = F.col("k")
    r = G.level_region(k * 3 - 20, k * 2 - 10, k * 5 % 300 + 1, k * 7 % 200 + 1, F.col("downsample"), F.col("width"), F.col("height"))
    return met.select(k.alias("s_suppkey"), F.col("level").cast("long").alias("level"), r.alias("r")).select("s_suppkey", "level", "r.*")


def predictor_undo(spark, sf_dir):
    w = Window.partitionBy("y", "c").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return pixels(spark, sf_dir).select("x", "y", "c", (F.sum("v").over(w) % 256).alias("v"))


def png_sub_residual(spark, sf_dir):
    w = Window.partitionBy("y", "c").orderBy("x")
    return pixels(spark, sf_dir).select("x", "y", "c", F.pmod(F.col("v") - F.lag("v", 1, 0).over(w), F.lit(256)).alias("v"))


def value_histogram(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))


def tile_offsets(spark, sf_dir):
    """File offsets of blobs in sequence, each aligned to an even place, per source.

    A running sum in two levels: within ranges of ids, and over the sums of the ranges, so that no
    source is summed up in one task.
    """
    n = F.col("byte_count")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("long").alias("byte_count"), F.floor(F.col("doc_id") / 4096).alias("range"))
    sums = d.groupBy("source", "range").agg(F.sum(n + n % 2).alias("sum"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "range", F.coalesce(F.sum("sum").over(before.partitionBy("source").orderBy("range")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum(n + n % 2).over(before.partitionBy("source", "range").orderBy("doc_id")), F.lit(0))
    return d.withColumn("inside", inside).join(bases, ["source", "range"]).select("doc_id", "source", "byte_count", (F.col("base") + F.col("inside") + 16).alias("file_offset"))


_FULL = "(SELECT CAST((n + tw - 1) // tw AS BIGINT) AS th FROM grid)"
_HALF = "SELECT x // 2 AS x, y // 2 AS y, c, CAST((2 * sum(v) + count(*)) // (2 * count(*)) AS BIGINT) AS v FROM {0} GROUP BY ALL"
_ODD = "SELECT x // 2 AS x, (y // 5) * 3 + (y % 5) // 2 AS y, c, CAST((2 * sum(v) + count(*)) // (2 * count(*)) AS BIGINT) AS v FROM {0} GROUP BY ALL"
_RECTS = "SELECT CAST(p_partkey AS BIGINT) AS region_id, CAST(p_partkey * 7 % 60 AS BIGINT) AS x0, CAST(p_partkey * 11 % 50 AS BIGINT) AS y0, CAST(p_size % 9 + 1 AS BIGINT) AS w, CAST(p_size % 7 + 1 AS BIGINT) AS h FROM part"

QUERIES = {
    "pixels_explode": (pixels_explode, f"{WITH} SELECT * FROM pixels"),
    "tile_index": (tile_index, f"{WITH} SELECT tx, ty, ty * (SELECT tw FROM grid) + tx AS tile, count(*) AS byte_count, CAST(sum(v) AS BIGINT) AS total FROM pixels GROUP BY tx, ty"),
    "sparse_tiles": (sparse_tiles, f"{WITH} SELECT i % tw AS tx, i // tw AS ty FROM (SELECT tw, unnest(range(0, tw * ((n + tw - 1) // tw))) AS i FROM grid) g WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = g.i)"),
    "region_crop": (region_crop, f"{WITH} SELECT x - 5 AS x, y - 3 AS y, c, v FROM pixels WHERE x BETWEEN 5 AND 44 AND y BETWEEN 3 AND 32"),
    "region_overhang": (
        region_overhang,
        f"{WITH} SELECT g.x, g.y, g.c, coalesce(p.v, 0) AS v FROM (SELECT CAST(i // 4 % 30 AS BIGINT) AS x, CAST(i // 120 AS BIGINT) AS y, CAST(i % 4 AS BIGINT) AS c FROM range(0, 2400) t(i)) g LEFT JOIN pixels p ON p.x - (-6) = g.x AND p.y - (-4) = g.y AND p.c = g.c",
    ),
    "regions_batch": (regions_batch, f"{WITH}, r AS ({_RECTS}) SELECT region_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM r JOIN pixels ON x BETWEEN x0 AND x0 + w - 1 AND y BETWEEN y0 AND y0 + h - 1 GROUP BY region_id"),
    "blit_plan": (
        blit_plan,
        """WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_partkey % 40 - 10 AS cl, p_partkey % 30 - 5 AS ct, CAST(p_size AS BIGINT) AS w, p_partkey * 3 % 50 AS tl, p_partkey * 5 % 40 AS tt FROM part),
o AS (SELECT *, greatest(cl, tl) AS l, greatest(ct, tt) AS t, least(cl + w, tl + 16) AS r, least(ct + 20, tt + 12) AS b FROM t)
SELECT p_partkey, CASE WHEN ok THEN b - t END AS rows, CASE WHEN ok THEN r - l END AS cols, CASE WHEN ok THEN (t - tt) * 16 + l - tl END AS src_first, CASE WHEN ok THEN CAST(16 AS BIGINT) END AS src_stride,
CASE WHEN ok THEN (t - ct) * w + l - cl END AS dst_first, CASE WHEN ok THEN w END AS dst_stride FROM (SELECT *, r > l AND b > t AS ok FROM o)""",
    ),
    "adjust_affine": (adjust_affine, f"{WITH} SELECT x, y, c, CASE WHEN c = 3 THEN v ELSE CAST(round(least(greatest(v * CAST({SLOPE} AS DOUBLE) + CAST({SHIFT} AS DOUBLE), 0), 255)) AS BIGINT) END AS v FROM pixels"),
    "pyramid_level1": (_level(1), f"{WITH} {_HALF.format('pixels')}"),
    "pyramid_level2": (_level(2), f"{WITH}, a AS ({_HALF.format('pixels')}) {_HALF.format('a')}"),
    "pyramid_level3": (_level(3), f"{WITH}, a AS ({_HALF.format('pixels')}), b AS ({_HALF.format('a')}) {_HALF.format('b')}"),
    "pyramid_odd_tile": (pyramid_odd_tile, f"{WITH}, a AS ({_ODD.format('pixels')}) {_ODD.format('a')}"),
    "pyramid_dims": (
        pyramid_dims,
        """WITH RECURSIVE d AS (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(0 AS BIGINT) AS level, CAST(100 + p_size * 37 AS BIGINT) AS width, CAST(80 + p_size * 23 AS BIGINT) AS height FROM part
UNION ALL SELECT p_partkey, level + 1, (width + 1) // 2, height // 64 * 32 + (height % 64 + 1) // 2 FROM d WHERE (width > 64 OR height > 64) AND level < 2) SELECT * FROM d""",
    ),
    "thumbnail_resize": (
        thumbnail_resize,
        f"""{WITH}, e AS (SELECT tw * 4 AS w, ((n + tw - 1) // tw) * 4 AS h FROM grid),
fx AS (SELECT CAST(o AS BIGINT) AS ox, least(o * w // 13, w - 1) AS a, greatest(least(o * w // 13, w - 1) + 1, least((o + 1) * w // 13, w)) AS b FROM e, range(0, 13) t(o)),
fy AS (SELECT CAST(o AS BIGINT) AS oy, least(o * h // 11, h - 1) AS a, greatest(least(o * h // 11, h - 1) + 1, least((o + 1) * h // 11, h)) AS b FROM e, range(0, 11) t(o))
SELECT ox AS x, oy AS y, c, CAST((sum(v) + count(*) // 2) // count(*) AS BIGINT) AS v FROM pixels JOIN fx ON x >= fx.a AND x < fx.b JOIN fy ON y >= fy.a AND y < fy.b GROUP BY ox, oy, c""",
    ),
    "level_region_map": (
        level_region_map,
        """WITH l(level, width, height, ds) AS (VALUES (CAST(1 AS BIGINT), CAST(400 AS BIGINT), CAST(300 AS BIGINT), CAST(2.0 AS DOUBLE)), (2, 100, 75, 8.0)),
t AS (SELECT CAST(s_suppkey AS BIGINT) AS k, l.* FROM supplier, l),
r AS (SELECT k, level, width, height, greatest(0, least(CAST(round((k * 3 - 20) / ds) AS BIGINT), width - 1)) AS x, greatest(0, least(CAST(round((k * 2 - 10) / ds) AS BIGINT), height - 1)) AS y,
CAST(round((k * 5 % 300 + 1) / ds) AS BIGINT) AS rw, CAST(round((k * 7 % 200 + 1) / ds) AS BIGINT) AS rh FROM t)
SELECT k AS s_suppkey, level, x, y, greatest(1, least(rw, width - x)) AS width, greatest(1, least(rh, height - y)) AS height FROM r""",
    ),
    "predictor_undo": (predictor_undo, f"{WITH} SELECT x, y, c, CAST(sum(v) OVER (PARTITION BY y, c ORDER BY x) % 256 AS BIGINT) AS v FROM pixels"),
    "png_sub_residual": (png_sub_residual, f"{WITH} SELECT x, y, c, (v - lag(v, 1, 0) OVER (PARTITION BY y, c ORDER BY x) + 256) % 256 AS v FROM pixels"),
    "value_histogram": (value_histogram, f"{WITH} SELECT c, v, count(*) AS n FROM pixels GROUP BY c, v"),
    "tile_offsets": (tile_offsets, "SELECT doc_id, source, n_chars AS byte_count, CAST(coalesce(sum(n_chars + n_chars % 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 16 AS BIGINT) AS file_offset FROM documents"),
}
