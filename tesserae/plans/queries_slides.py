"""Catalogue: slide files written from the virtual slide, read by the sources, cropped and rebuilt."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.codecs import jpeg2000, raster, webp_reader
from tesserae.functions.adjust import Adjustments
from tesserae.operators import disk_cache, slides
from tesserae.plans.queries_codecs import read_bmp, read_png, read_tiff
from tesserae.plans.slide import PIXELS_SQL, TILE, grid_width, pixels, table
from tesserae.sinks.tiff_writer import LevelSpec, write
from tesserae.sources.datasource import register

WITH = f"WITH {PIXELS_SQL}"
SIDE = 16
DESCRIPTION = "virtual|AppMag = 20|MPP = 0.5000"


def local_path(spark: SparkSession, folder: str | None) -> str | None:
    """Where a folder, which is made, stands as files: with or without file:, by the default store, or behind a mount of viewfs."""
    if not folder:
        return None
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.getUri().getScheme() not in ("file", "viewfs"):
            return None
        store.mkdirs(path)
        found = store.resolvePath(path).toUri()
    except (Py4JJavaError, PySparkException):  # a store that is not known, or not there
        return None
    return found.getPath() if found.getScheme() == "file" else None


def is_shared(spark: SparkSession, folder: str) -> bool:
    """Whether tasks see what the driver writes to a local folder, and the driver what they write."""
    n = 2 * spark.sparkContext.defaultParallelism
    with open(os.path.join(folder, "driver"), "w"):
        pass

    def look(i: int) -> bool:
        with contextlib.suppress(OSError):
            os.makedirs(folder, exist_ok=True)  # on a disk of its own it would be missing
            with open(os.path.join(folder, f"task-{i}"), "w"):
                return os.path.exists(os.path.join(folder, "driver"))
        return False

    seen = spark.sparkContext.parallelize(range(n), n).map(look).collect()
    return all(seen) and all(os.path.exists(os.path.join(folder, f"task-{i}")) for i in range(n))


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share, removed at the end of the process.

    It lies below spark.checkpoint.dir, or below the warehouse if tasks do share that. Files are
    read and written by their places, so a store that is no file system doesn't do. In local mode
    without spark.checkpoint.dir it is a temporary folder.
    """
    context = spark.sparkContext
    named = local_path(spark, context.getConf().get("spark.checkpoint.dir"))
    if not named and re.fullmatch(r"local(\[.*\])?", context.master):
        path = tempfile.mkdtemp(prefix="tesserae-")
    else:
        found = named or local_path(spark, spark.conf.get("spark.sql.warehouse.dir"))
        path = os.path.join(found, f"tesserae-{uuid.uuid4().hex}") if found else None
        if path:
            os.makedirs(path)
        if not path or not (named or is_shared(spark, path)):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share as files")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def slide_file(spark: SparkSession, sf_dir: str) -> str:
    """The virtual slide (its colours) as a lossless JPEG 2000 slide with tiles of SIDE pixels.

    Tiles are composed and encoded in groups; the driver writes them one by one in file order.
    """
    register(spark)
    e = table(spark, sf_dir, "embeddings")
    n, across = e.count(), grid_width(e)
    width, height = across * TILE, -(-n // across) * TILE
    nx = -(-width // SIDE)
    p = pixels(spark, sf_dir).where("c < 3")
    key = (F.floor(F.col("y") / SIDE) * nx + F.floor(F.col("x") / SIDE)).cast("int")

    def compose(key: tuple, group: pa.Table) -> pa.Table:
        out = np.zeros((SIDE, SIDE, 3), np.uint8)
        x, y, c, v = (group.column(k).to_numpy() for k in ("x", "y", "c", "v"))
        out[y % SIDE, x % SIDE, c] = v
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([jpeg2000.encode(out)], pa.binary())})

    folder = workspace(spark)
    p.withColumn("tile", key).groupBy("tile").applyInArrow(compose, "tile int, data binary").write.parquet(f"file://{folder}/tiles")
    stored = spark.read.parquet(f"file://{folder}/tiles").orderBy("tile")
    sizes = [0] * (nx * -(-height // SIDE))
    for r in stored.select("tile", F.octet_length("data").alias("n")).toLocalIterator():
        sizes[r["tile"]] = r["n"]
    path = os.path.join(folder, "virtual.svs")
    with open(path, "wb") as f:  # sparse tiles have no bytes
        write(f, [LevelSpec(width, height, SIDE, SIDE, raster.JP2K, DESCRIPTION)], [sizes], in_places(stored, len(sizes)))
    return path


def in_places(stored: DataFrame, n: int) -> Iterator[bytes]:
    """The tiles (tile, data) in order, b"" where there is none."""
    at = 0
    for r in stored.toLocalIterator():
        yield from (b"" for _ in range(at, r["tile"]))
        yield bytes(r["data"])
        at = r["tile"] + 1
    yield from (b"" for _ in range(at, n))


#: Samples of an image handed on at a time.
SAMPLES = 1 << 18


def samples(a: np.ndarray, x0: int = 0, y0: int = 0) -> Iterator[list[pa.Array]]:
    """x, y, c and v of the colours of an image that stands at (x0, y0), in bands of its rows."""
    step = max(1, SAMPLES // max(1, a.shape[1] * 3))
    for top in range(0, a.shape[0], step):
        band = a[top : top + step, :, :3]
        y, x, c = (i.reshape(-1) for i in np.indices(band.shape))
        yield [pa.array(k) for k in (x + x0, y + (y0 + top), c, band.reshape(-1).astype(np.int64))]


def raster_pixels(rasters: DataFrame, tile: int) -> DataFrame:
    """(level, x, y, c, v) of the colours of decoded tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["rgba"] is None:
                    continue
                for columns in samples(slides.array(r["width"], r["height"], r["rgba"]), r["tx"] * tile, r["ty"] * tile):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), r["level"])), *columns], names=["level", "x", "y", "c", "v"])

    return rasters.select("level", "tx", "ty", "width", "height", "rgba").mapInArrow(run, "level bigint, x bigint, y bigint, c bigint, v bigint")


def slide_levels(spark, sf_dir):
    path = slide_file(spark, sf_dir)
    long = lambda c: F.col(c).cast("long").alias(c)
    return spark.read.format("slide_levels").load(path).select(*(long(c) for c in ("level", "width", "height", "tile_w", "tile_h", "compression", "photometric", "tiles_x", "tiles_y")), "downsample", "description")


def slide_tags(spark, sf_dir):
    path = slide_file(spark, sf_dir)
    tags = spark.read.format("slide_tags").load(path).where("ifd_index = 0 and size(value.ints) = 1 and tag_id not in (324, 325)")
    return tags.select(F.col("tag_id").cast("long").alias("tag_id"), "tag_name", F.col("value.ints")[0].alias("value"))


def slide_region(spark, sf_dir):
    """A crop of the file, as pixels."""
    path = slide_file(spark, sf_dir)
    one = spark.createDataFrame([(0, path, 0, 5, 3, 40, 30)], "region_id long, slide_id string, level int, x int, y int, width int, height int")
    image = slides.read_regions(spark, path, one, kind=None)
    as_tile = image.select(F.lit(0).alias("level"), F.lit(0).alias("tx"), F.lit(0).alias("ty"), "width", "height", F.col("image").alias("rgba"))
    return raster_pixels(as_tile, 0).drop("level")


def slide_pyramid(spark, sf_dir):
    """The rebuilt file's second and third level, as pixels."""
    path = slide_file(spark, sf_dir)
    folder = workspace(spark)
    target = os.path.join(folder, "rebuilt.svs")
    slides.rebuild(spark, path, target, f"file://{folder}/work", match_source=False, encoding=slides.Encoding(raster.JP2K, ratio=0), tile=SIDE, level_count=3)
    tiles = spark.read.format("slide_tiles").load(target).where("level > 0")
    sizes = spark.read.format("slide_levels").load(target).select(F.col("level").cast("long").alias("level"), "width", "height")
    p = raster_pixels(slides.decode_tiles(tiles), SIDE).join(F.broadcast(sizes), "level")
    return p.where("x < width and y < height").select("level", "x", "y", "c", "v")


def decoded_pixels(images: DataFrame, read) -> DataFrame:
    """(x, y, c, v) of the colours of encoded images, by a reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("image"):
                for columns in samples(read(data.as_py())):
                    yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "c", "v"])

    return images.select("image").mapInArrow(run, "x bigint, y bigint, c bigint, v bigint")


def exported(kind: str, read):
    """A crop exported as an image file, with its highlights raised, read back."""

    def query(spark, sf_dir):
        path = slide_file(spark, sf_dir)
        one = spark.createDataFrame([(0, path, 0, 2, 7, 33, 21)], "region_id long, slide_id string, level int, x int, y int, width int, height int")
        return decoded_pixels(slides.read_regions(spark, path, one, kind, adjustments=Adjustments(brightness=0.5)), read)

    return query


def level_export(spark, sf_dir):
    """The whole level as a file written beside its target, read back."""
    path = slide_file(spark, sf_dir)
    target = os.path.join(workspace(spark), "level.bmp")
    slides.level_to_file(spark, path, target, 0, kind="bmp")
    return decoded_pixels(spark.read.format("binaryFile").load(target).select(F.col("content").alias("image")), read_bmp)


def preserved_levels(spark, sf_dir):
    """A crop with the source's own levels, each cut from the matching one: the second level of a rebuilt slide."""
    path, folder = slide_file(spark, sf_dir), workspace(spark)
    lossless = slides.Encoding(raster.JP2K, ratio=0)
    rebuilt, target = os.path.join(folder, "rebuilt.svs"), os.path.join(folder, "crop.svs")
    slides.rebuild(spark, path, rebuilt, f"file://{folder}/work", match_source=False, encoding=lossless, tile=SIDE, level_count=2)
    slides.to_file(slides.export_preserving, spark, rebuilt, target, f"file://{folder}/crop", level=0, x=8, y=4, width=32, height=24, encoding=lossless, tile=SIDE)
    tiles = spark.read.format("slide_tiles").load(target)
    return raster_pixels(slides.decode_tiles(tiles), SIDE).where("x < shiftright(32, cast(level as int)) and y < shiftright(24, cast(level as int))")


def span_composites(spark, sf_dir):
    """Composites of 2 x 2 tiles at half size."""
    path = slide_file(spark, sf_dir)
    merged = slides.composites(slides.decode_tiles(spark.read.format("slide_tiles").load(path)), 1, 1, SIDE, SIDE)
    return raster_pixels(merged, SIDE).drop("level")


def slide_info(spark, sf_dir):
    """The dump of a slide: every number that its level's directory has by name, and its metadata."""
    info = slides.read_info(spark, slide_file(spark, sf_dir))
    tags = info.select("metadata", F.explode(F.get("levels", F.lit(0))["tags"]).alias("name", "value"))
    some = tags.where(F.size("value.ints") == 1).select("name", F.col("value.ints")[0].alias("value"), F.col("metadata")["AppMag"].alias("app_mag"))
    return some.where("name not in ('TileOffsets', 'TileByteCounts')")


def load_path(spark, sf_dir):
    """Every tile asked for twice: the second time from the disk cache, where the first was on the screen."""
    path, folder = slide_file(spark, sf_dir), os.path.join(workspace(spark), "cache")
    index = spark.read.format("slide_tile_index").load(path)
    ask = index.select("slide_id", "level", "tx", "ty", F.lit(0).alias("reduction"), ((F.col("tx") + F.col("ty")) % 2 == 0).alias("visible"))
    disk_cache.load(ask, folder).count()  # fills the cache
    again = disk_cache.load(ask, folder)
    long = lambda c: F.col(c).cast("long").alias(c)
    return again.select(long("tx"), long("ty"), "origin", long("width"), long("height"))


def disk_listing(spark, sf_dir):
    """The cache's folder as a table: names, and sizes of 8 bytes and four a pixel."""
    path, folder = slide_file(spark, sf_dir), os.path.join(workspace(spark), "cache")
    index = spark.read.format("slide_tile_index").load(path)
    disk_cache.load(index.select("slide_id", "level", "tx", "ty", F.lit(0).alias("reduction"), F.lit(True).alias("visible")), folder).count()
    (sub,) = os.listdir(folder)
    return disk_cache.listing(spark, os.path.join(folder, sub)).select(*(F.col(c).cast("long").alias(c) for c in ("level", "tx", "ty", "size")))


_SIZE = "(SELECT tw * 4 AS w, ((n + tw - 1) // tw) * 4 AS h FROM grid)"
_HALF = "SELECT x // 2 AS x, y // 2 AS y, c, CAST((2 * sum(v) + count(*)) // (2 * count(*)) AS BIGINT) AS v FROM {0} GROUP BY ALL"
_GRID = f"""g AS (SELECT x, unnest(range(0, h)) AS y, w, h FROM (SELECT unnest(range(0, w)) AS x, w, h FROM {_SIZE}) t),
full_px AS (SELECT CAST(g.x AS BIGINT) AS x, CAST(g.y AS BIGINT) AS y, CAST(k.c AS BIGINT) AS c, coalesce(p.v, 0) AS v FROM g CROSS JOIN range(0, 3) k(c) LEFT JOIN pixels p ON p.x = g.x AND p.y = g.y AND p.c = k.c)"""

#: All pixels of the stored tiles, which are padded to whole tiles.
_TILED = f"""s AS (SELECT DISTINCT x // 16 AS tx, y // 16 AS ty FROM pixels),
tiled_px AS (SELECT CAST(s.tx * 16 + k % 16 AS BIGINT) AS x, CAST(s.ty * 16 + k // 16 AS BIGINT) AS y, CAST(j.c AS BIGINT) AS c, coalesce(p.v, 0) AS v FROM s CROSS JOIN range(0, 256) r(k) CROSS JOIN range(0, 3) j(c) LEFT JOIN pixels p ON p.x = s.tx * 16 + k % 16 AND p.y = s.ty * 16 + k // 16 AND p.c = j.c)"""

QUERIES = {
    "slide_levels": (
        slide_levels,
        f"{WITH} SELECT CAST(0 AS BIGINT) AS level, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST(16 AS BIGINT) AS tile_w, CAST(16 AS BIGINT) AS tile_h, CAST(33005 AS BIGINT) AS compression, CAST(2 AS BIGINT) AS photometric, CAST((w + 15) // 16 AS BIGINT) AS tiles_x, CAST((h + 15) // 16 AS BIGINT) AS tiles_y, CAST(1 AS DOUBLE) AS downsample, '{DESCRIPTION}' AS description FROM {_SIZE}",
    ),
    "slide_tags": (
        slide_tags,
        f"{WITH} SELECT CAST(id AS BIGINT) AS tag_id, name AS tag_name, CAST(value AS BIGINT) AS value FROM (SELECT unnest([256, 257, 259, 262, 277, 322, 323]) AS id, unnest(['ImageWidth', 'ImageLength', 'Compression', 'PhotometricInterpretation', 'SamplesPerPixel', 'TileWidth', 'TileLength']) AS name, unnest([w, h, 33005, 2, 3, 16, 16]) AS value FROM {_SIZE})",
    ),
    "slide_region": (slide_region, f"{WITH} SELECT x - 5 AS x, y - 3 AS y, c, v FROM pixels WHERE x BETWEEN 5 AND 44 AND y BETWEEN 3 AND 32 AND c < 3"),
    "slide_pyramid": (slide_pyramid, f"{WITH}, {_GRID}, a AS ({_HALF.format('full_px')}), b AS ({_HALF.format('a')}) SELECT CAST(1 AS BIGINT) AS level, * FROM a UNION ALL SELECT CAST(2 AS BIGINT), * FROM b"),
    "level_export": (level_export, f"{WITH}, {_GRID} SELECT x, y, c, v FROM full_px"),
    "preserved_levels": (
        preserved_levels,
        f"{WITH}, {_GRID}, a AS ({_HALF.format('full_px')}) SELECT CAST(0 AS BIGINT) AS level, x - 8 AS x, y - 4 AS y, c, v FROM full_px WHERE x BETWEEN 8 AND 39 AND y BETWEEN 4 AND 27 UNION ALL SELECT CAST(1 AS BIGINT), x - 4, y - 2, c, v FROM a WHERE x BETWEEN 4 AND 19 AND y BETWEEN 2 AND 13",
    ),
    "span_composites": (
        span_composites,
        f"{WITH}, {_TILED}, a AS ({_HALF.format('tiled_px')}) SELECT * FROM a",
    ),
    "slide_info": (
        slide_info,
        f"{WITH}, s AS (SELECT w, h FROM {_SIZE}) SELECT name, CAST(value AS BIGINT) AS value, '20' AS app_mag FROM (SELECT unnest(['ImageWidth', 'ImageLength', 'Compression', 'PhotometricInterpretation', 'SamplesPerPixel', 'TileWidth', 'TileLength']) AS name, unnest([w, h, 33005, 2, 3, 16, 16]) AS value FROM s)",
    ),
    "load_path": (
        load_path,
        f"{WITH}, t AS (SELECT x AS tx, unnest(range(0, (h + 15) // 16)) AS ty FROM (SELECT unnest(range(0, (w + 15) // 16)) AS x, h FROM {_SIZE}) u), s AS (SELECT DISTINCT x // 16 AS tx, y // 16 AS ty FROM pixels) SELECT CAST(t.tx AS BIGINT) AS tx, CAST(t.ty AS BIGINT) AS ty, CASE WHEN s.tx IS NULL THEN 'sparse' WHEN (t.tx + t.ty) % 2 = 0 THEN 'disk' ELSE 'slide' END AS origin, CASE WHEN s.tx IS NOT NULL THEN CAST(16 AS BIGINT) END AS width, CASE WHEN s.tx IS NOT NULL THEN CAST(16 AS BIGINT) END AS height FROM t LEFT JOIN s USING (tx, ty)",
    ),
    "disk_listing": (disk_listing, f"{WITH} SELECT DISTINCT CAST(0 AS BIGINT) AS level, CAST(x // 16 AS BIGINT) AS tx, CAST(y // 16 AS BIGINT) AS ty, CAST(8 + 16 * 16 * 4 AS BIGINT) AS size FROM pixels"),
}
_BRIGHT = "CAST(floor(least(greatest(v + 63.75, 0), 255) + 0.5) AS BIGINT)"
for _kind, _read in (("png", read_png), ("bmp", read_bmp), ("tiff", read_tiff), ("webp", webp_reader.read)):
    QUERIES[f"export_{_kind}"] = (exported(_kind, _read), f"{WITH}, {_GRID} SELECT x - 2 AS x, y - 7 AS y, c, {_BRIGHT} AS v FROM full_px WHERE x BETWEEN 2 AND 34 AND y BETWEEN 7 AND 27")
