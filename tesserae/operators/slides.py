"""Regions and pyramids of slide files, in tile form.

Tiles are rows with a binary payload; they are decoded, composed and encoded by Arrow functions
on groups of bounded size: the tiles of a region, the four tiles under one of the next level, or,
for odd tile sizes, a band of tiles. The driver only writes the file, tile by tile in file order.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.codecs import raster
from tesserae.functions.adjust import Adjustments
from tesserae.functions.metadata import POSITIONAL, fields, named_tags
from tesserae.sinks.tiff_writer import ImageSpec, LevelSpec, write
from tesserae.session import reachable
from tesserae.sinks.files import write_file
from tesserae.sources.bytesource import expand
from tesserae.sources.datasource import register
from tesserae.sources.slide import Associated, Level, Slide, open_slide

RASTERS = "slide_id string, level int, tx int, ty int, width int, height int, rgba binary"
TILES = "level int, tx int, ty int, width int, height int, rgba binary"
ROWS = 32


def array(width: int, height: int, rgba: bytes) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def decode_tiles(tiles: DataFrame, reduction: int = 0) -> DataFrame:
    """RASTERS of slide_tiles rows; sparse tiles have a null raster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                rows = whole.slice(at, ROWS).to_pylist()
                images = [r["data"] and raster.decode_tile(r["data"], r["compression"], r["photometric"], r["tables"], reduction) for r in rows]
                yield pa.RecordBatch.from_pylist(
                    [
                        {"slide_id": r["slide_id"], "level": r["level"], "tx": r["tx"], "ty": r["ty"], "width": None if a is None else a.shape[1], "height": None if a is None else a.shape[0], "rgba": None if a is None else a.tobytes()}
                        for r, a in zip(rows, images)
                    ],
                    schema=pa.schema([("slide_id", pa.string()), ("level", pa.int32()), ("tx", pa.int32()), ("ty", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())]),
                )

    return tiles.mapInArrow(run, RASTERS)


PLAN = "region_id bigint, slide_id string, level int, x int, y int, width int, height int, lw bigint, lh bigint, tile_w int, tile_h int, tx int, ty int"
PIECES = "region_id bigint, width int, height int, px int, py int, w int, h int, rgba binary, bytes_read bigint"
#: Tiles of a plan handed on at a time.
PLAN_ROWS = 4096


def plan_regions(regions: DataFrame) -> DataFrame:
    """PLAN: the tiles that each rectangle (region_id, slide_id, level, x, y, width, height) needs.

    Only directories are read, by the tasks that hold the rectangles. A rectangle of a level that
    the slide does not have has no row; one that lies off its level is an error.
    """
    names = [f.split()[0] for f in PLAN.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in PLAN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, slide = None, None
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                if r["slide_id"] != path:
                    if slide:
                        slide.close()
                    path, slide = r["slide_id"], open_slide(r["slide_id"])
                if not 0 <= r["level"] < len(slide.levels):
                    continue
                v, x, y, w, h = slide.levels[r["level"]], r["x"], r["y"], r["width"], r["height"]
                if w <= 0 or h <= 0 or x >= v.width or y >= v.height or x + w <= 0 or y + h <= 0:
                    raise ValueError(f"region {r['region_id']} lies outside its level")
                for ty in range(max(0, y) // v.tile_h, (min(v.height, y + h) - 1) // v.tile_h + 1):
                    for tx in range(max(0, x) // v.tile_w, (min(v.width, x + w) - 1) // v.tile_w + 1):
                        rows.append((r["region_id"], path, r["level"], x, y, w, h, v.width, v.height, v.tile_w, v.tile_h, tx, ty))
                        if len(rows) == PLAN_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], names=names)
                            rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], names=names)
        if slide:
            slide.close()

    return regions.select("region_id", "slide_id", "level", "x", "y", "width", "height").mapInArrow(run, PLAN)


def read_pieces(planned: DataFrame) -> DataFrame:
    """PIECES: of every planned tile the part inside its rectangle, decoded; nothing else is read or sent on.

    The plan is dealt by tile and sorted, so a tile that several rectangles need is decoded once.
    bytes_read: read for the row, directories included with the first tile of a slide.
    """
    schema = pa.schema([("region_id", pa.int64()), *((c, pa.int32()) for c in ("width", "height", "px", "py", "w", "h")), ("rgba", pa.binary()), ("bytes_read", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, slide, told, key, image = None, None, 0, None, None
        tables: dict = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                out = []
                for r in whole.slice(lo, ROWS).to_pylist():
                    if r["slide_id"] != path:
                        if slide:
                            slide.close()
                        path, slide, told, tables = r["slide_id"], open_slide(r["slide_id"]), 0, {}
                    v, tile = slide.levels[r["level"]], (path, r["level"], r["tx"], r["ty"])
                    if tile != key:
                        if r["level"] not in tables:
                            tables[r["level"]] = v.ifd.raw(347)
                        data = slide.tile_bytes(r["level"], r["tx"], r["ty"])
                        image = raster.decode_tile(data, v.compression, v.photometric, tables[r["level"]]) if data else None
                        if image is not None:  # a tile at the edge may be padded beyond its level
                            image = image[: v.height - r["ty"] * v.tile_h, : v.width - r["tx"] * v.tile_w]
                        key = tile
                    cut = None
                    left, top = r["tx"] * v.tile_w, r["ty"] * v.tile_h
                    x0, y0 = max(left, r["x"]), max(top, r["y"])
                    if image is not None:
                        cut = image[y0 - top : r["y"] + r["height"] - top, x0 - left : r["x"] + r["width"] - left]
                    w, h = (0, 0) if cut is None else (cut.shape[1], cut.shape[0])
                    out.append((r["region_id"], r["width"], r["height"], x0 - r["x"], y0 - r["y"], w, h, None if cut is None else cut.tobytes(), slide.source.bytes_read - told))
                    told = slide.source.bytes_read
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], names=schema.names)
        if slide:
            slide.close()

    return planned.repartition("slide_id", "level", "tx", "ty").sortWithinPartitions("slide_id", "level", "tx", "ty").mapInArrow(run, PIECES)


def read_regions(spark: SparkSession, paths: str | None, regions: DataFrame, kind: str | None = "png", quality: int = 92, adjustments: Adjustments = Adjustments()) -> DataFrame:
    """(region_id, width, height, image, bytes_read) of many rectangles (region_id, slide_id, level, x, y, width, height).

    Rectangles are in pixels of their level; what lies off the level or in a sparse tile stays 0,
    and one that lies off it as a whole is an error. image is encoded as kind, or raw RGBA if None.
    Tiles are planned first, then read and decoded in as many tasks as there are partitions, so
    that one rectangle of a whole level is decoded in parallel; only its parts meet to be composed.
    paths, if given, are the slides that may be read.
    """
    reachable(spark)
    if paths is not None:
        regions = regions.where(F.col("slide_id").isin(expand(paths)))

    def compose(key: tuple, group: pa.Table) -> pa.Table:
        width, height = group.column("width")[0].as_py(), group.column("height")[0].as_py()
        out = np.zeros((height, width, 4), np.uint8)
        for x, y, w, h, rgba in zip(*(group.column(c).to_pylist() for c in ("px", "py", "w", "h")), group.column("rgba")):
            if rgba.is_valid:
                raster.paste(out, np.frombuffer(rgba.as_buffer(), np.uint8).reshape(h, w, 4), x, y)
        image = adjustments.apply(out).tobytes() if kind is None else raster.encode_image(out, kind, quality, adjustments)
        read = pc.sum(group.column("bytes_read")).as_py()
        return pa.table({"region_id": pa.array([key[0].as_py()], pa.int64()), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "image": pa.array([image], pa.binary()), "bytes_read": pa.array([read], pa.int64())})

    return read_pieces(plan_regions(regions)).groupBy("region_id").applyInArrow(compose, "region_id bigint, width int, height int, image binary, bytes_read bigint")


def export_region(spark: SparkSession, path: str, level: int, x: int, y: int, width: int, height: int, kind: str | None = "png", quality: int = 92, adjustments: Adjustments = Adjustments(), max_pixels: int | None = None) -> bytes:
    """One rectangle as an image file (raw RGBA if kind is None)."""
    if max_pixels is not None and width * height > max_pixels:
        raise ValueError(f"{width * height} pixels are more than {max_pixels}")
    one = spark.createDataFrame([(0, path, level, x, y, width, height)], "region_id long, slide_id string, level int, x int, y int, width int, height int")
    got = read_regions(spark, path, one, kind, quality, adjustments).collect()
    if not got:
        raise IndexError(f"the slide has no level {level}")
    return bytes(got[0]["image"])


def export_level(spark: SparkSession, path: str, level: int, **options) -> bytes:
    """A whole level; without a limit of pixels unless max_pixels is given."""
    slide = open_slide(path)
    size = slide.levels[level].width, slide.levels[level].height
    slide.close()
    return export_region(spark, path, level, 0, 0, *size, **options)


def region_to_file(spark: SparkSession, path: str, target: str, level: int, x: int, y: int, width: int, height: int, kind: str = "png", **options) -> int:
    """export_region() into a file, whole or not at all; returns its bytes."""
    return write_file(target, export_region(spark, path, level, x, y, width, height, kind, **options))


def level_to_file(spark: SparkSession, path: str, target: str, level: int, **options) -> int:
    return write_file(target, export_level(spark, path, level, **options))


def associated_to_file(spark: SparkSession, path: str, target: str, kind: str, **options) -> int:
    return write_file(target, export_associated(spark, path, kind, **options))


def read_info(spark: SparkSession, paths: str) -> DataFrame:
    """One row a slide: all tags of its levels and associated images by name, and its metadata.

    (slide_id, metadata, levels, associated), the last two arrays of (ifd_index, kind, tags). A
    tag that cannot be read has an error instead of a value.
    """
    register(spark)
    load = lambda table: spark.read.format(table).option("mode", "PERMISSIVE").load(paths)
    tags = load("slide_tags").groupBy("slide_id", "ifd_index").agg(named_tags(F.col("tag_id"), F.col("value")).alias("tags"))
    levels = load("slide_levels").select("slide_id", "ifd_index", F.lit("level").alias("kind"), "description", "level")
    images = load("slide_associated").select("slide_id", "ifd_index", "kind", "description", F.lit(None).cast("int").alias("level"))
    each = levels.unionByName(images).join(tags, ["slide_id", "ifd_index"], "left")
    item = F.struct("ifd_index", "kind", "tags")
    listed = lambda some: F.array_sort(F.collect_list(F.when(some, item)), lambda a, b: a["ifd_index"] - b["ifd_index"])
    base = F.max(F.when(F.col("level") == 0, F.col("description")))
    grouped = each.groupBy("slide_id").agg(base.alias("d"), listed(F.col("level").isNotNull()).alias("levels"), listed(F.col("level").isNull()).alias("associated"))
    return grouped.select("slide_id", fields(F.col("d")).alias("metadata"), "levels", "associated")


def associated_images(spark: SparkSession, paths: str) -> DataFrame:
    """(slide_id, ifd_index, kind, width, height, rgba) of the decodable associated images."""
    register(spark)
    images = spark.read.format("slide_associated").load(paths).where("decodable")
    strips = spark.read.format("slide_strips").load(paths)
    tables = spark.read.format("slide_tags").load(paths).where("tag_id = 347").select("slide_id", "ifd_index", F.col("value.raw").alias("tables"))
    met = images.drop("description", "decodable").join(strips, ["slide_id", "ifd_index"]).join(F.broadcast(tables), ["slide_id", "ifd_index"], "left")

    def stack(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["strip"])
        f = rows[0]
        out = raster.stack_strips([(r["row0"], r["rows"], r["data"]) for r in rows], f["width"], f["height"], f["compression"], f["samples_per_pixel"], f["predictor"], f["tables"], f["photometric"])
        return pa.table({"slide_id": [f["slide_id"]], "ifd_index": pa.array([f["ifd_index"]], pa.int32()), "kind": [f["kind"]], "width": pa.array([f["width"]], pa.int32()), "height": pa.array([f["height"]], pa.int32()), "rgba": pa.array([out.tobytes()], pa.binary())})

    return met.groupBy("slide_id", "ifd_index").applyInArrow(stack, "slide_id string, ifd_index int, kind string, width int, height int, rgba binary")


def export_associated(spark: SparkSession, path: str, kind: str, image_format: str = "png", quality: int = 92, adjustments: Adjustments = Adjustments()) -> bytes:
    got = associated_images(spark, path).where(F.col("kind") == kind).orderBy("ifd_index").limit(1).collect()
    if not got:
        raise ValueError(f"the slide has no decodable {kind}")
    return raster.encode_image(array(got[0]["width"], got[0]["height"], bytes(got[0]["rgba"])), image_format, quality, adjustments)


def composites(rasters: DataFrame, span: int, reduction: int, tile_w: int, tile_h: int) -> DataFrame:
    """RASTERS merged 2**span x 2**span: members shrunk to 1 / 2**reduction at their place.

    A group is the tiles of one composite; sparse members stay blank, and a group of sparse
    members only is sparse.
    """
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(span))

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        slide, level, tx, ty = (k.as_py() for k in key)
        rows = [r for r in group.to_pylist() if r["rgba"] is not None]
        row = {"slide_id": slide, "level": level, "tx": tx, "ty": ty, "width": None, "height": None, "rgba": None}
        if rows:
            place = lambda r: ((r["tx"] - (tx << span)) * tile_w, (r["ty"] - (ty << span)) * tile_h)
            w = max(place(r)[0] + r["width"] for r in rows)
            h = max(place(r)[1] + r["height"] for r in rows)
            out = np.zeros(((h + (1 << reduction) - 1) >> reduction, (w + (1 << reduction) - 1) >> reduction, 4), np.uint8)
            for r in rows:
                x, y = place(r)
                raster.paste(out, raster.shrink(array(r["width"], r["height"], r["rgba"]), reduction), x >> reduction, y >> reduction)
            row |= {"width": out.shape[1], "height": out.shape[0], "rgba": out.tobytes()}
        kinds = {"slide_id": pa.string(), "rgba": pa.binary()}
        return pa.table({k: pa.array([v], kinds.get(k, pa.int32())) for k, v in row.items()})

    return rasters.groupBy("slide_id", "level", up("tx").alias("cx"), up("ty").alias("cy")).applyInArrow(merge, RASTERS)


# ---- pyramids ----


@dataclass(frozen=True)
class Encoding:
    compression: int = raster.JPEG
    quality: int = 90
    ratio: float = 20.0
    tile: int = 256


def pieces(rasters: DataFrame, tile_w: int, tile_h: int, x: int, y: int, width: int, height: int, level_w: int, level_h: int, tile: int) -> DataFrame:
    """Source rasters cut at the grid of a crop: (tx, ty, px, py, width, height, rgba)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["rgba"] is None:
                    continue
                left, top = r["tx"] * tile_w, r["ty"] * tile_h
                image = array(r["width"], r["height"], r["rgba"])[: level_h - top, : level_w - left]
                x0, y0 = max(left, x, 0), max(top, y, 0)
                x1, y1 = min(left + image.shape[1], x + width), min(top + image.shape[0], y + height)
                rows = []
                for ty in range((y0 - y) // tile, (y1 - y - 1) // tile + 1) if x1 > x0 and y1 > y0 else ():
                    for tx in range((x0 - x) // tile, (x1 - x - 1) // tile + 1):
                        a0, b0 = max(x0, x + tx * tile), max(y0, y + ty * tile)
                        a1, b1 = min(x1, x + (tx + 1) * tile), min(y1, y + (ty + 1) * tile)
                        cut = image[b0 - top : b1 - top, a0 - left : a1 - left]
                        rows.append((tx, ty, a0 - x - tx * tile, b0 - y - ty * tile, a1 - a0, b1 - b0, cut.tobytes()))
                columns = list(zip(*rows)) or [[]] * 7
                kinds = [pa.int32()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tx", "ty", "px", "py", "width", "height", "rgba"])

    return rasters.mapInArrow(run, "tx int, ty int, px int, py int, width int, height int, rgba binary")


def _tile_row(level: int, tx: int, ty: int, a: np.ndarray) -> pa.Table:
    ints = lambda v: pa.array([v], pa.int32())
    return pa.table({"level": ints(level), "tx": ints(tx), "ty": ints(ty), "width": ints(a.shape[1]), "height": ints(a.shape[0]), "rgba": pa.array([a.tobytes()], pa.binary())})


def tiled(spark: SparkSession, cut: DataFrame, level: int, width: int, height: int, tile: int, adjustments: Adjustments = Adjustments()) -> DataFrame:
    """TILES of a level from pieces; places without a piece are 0."""
    across, down = -(-width // tile), -(-height // tile)
    grid = spark.range(across * down).select((F.col("id") % across).cast("int").alias("tx"), F.floor(F.col("id") / across).cast("int").alias("ty"), *(F.lit(0).alias(c) for c in ("px", "py", "width", "height")), F.lit(b"").alias("rgba"))

    def compose(key: tuple, group: pa.Table) -> pa.Table:
        tx, ty = key[0].as_py(), key[1].as_py()
        out = np.zeros((min(tile, height - ty * tile), min(tile, width - tx * tile), 4), np.uint8)
        for p in group.to_pylist():
            if p["rgba"]:
                raster.paste(out, array(p["width"], p["height"], p["rgba"]), p["px"], p["py"])
        return _tile_row(level, tx, ty, adjustments.apply(out))

    return cut.unionByName(grid).groupBy("tx", "ty").applyInArrow(compose, TILES)


def next_level(spark: SparkSession, tiles: DataFrame, level: int, width: int, height: int, tile: int) -> DataFrame:
    """The halved level (width and height: of the new one) of TILES.

    An even tile's halves come from the four tiles above it. With an odd size, rows pair up within
    a band and columns across tiles, so whole bands are halved.
    """
    if tile % 2 == 0:

        def four(key: tuple, group: pa.Table) -> pa.Table:
            tx, ty = key[0].as_py(), key[1].as_py()
            rows = group.to_pylist()
            w = max(r["width"] + (r["tx"] - 2 * tx) * tile for r in rows)
            h = max(r["height"] + (r["ty"] - 2 * ty) * tile for r in rows)
            whole = np.zeros((h, w, 4), np.uint8)
            for r in rows:
                raster.paste(whole, array(r["width"], r["height"], r["rgba"]), (r["tx"] - 2 * tx) * tile, (r["ty"] - 2 * ty) * tile)
            return _tile_row(level, tx, ty, raster.halve(whole))

        up = lambda c: F.floor(F.col(c) / 2).cast("int")
        return tiles.groupBy(up("tx").alias("ux"), up("ty").alias("uy")).applyInArrow(four, TILES)

    def band(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        whole = np.zeros((rows[0]["height"], max(r["tx"] * tile + r["width"] for r in rows), 4), np.uint8)
        for r in rows:
            raster.paste(whole, array(r["width"], r["height"], r["rgba"]), r["tx"] * tile, 0)
        half, top, out = raster.halve(whole), key[0].as_py() * -(-tile // 2), []
        for ty in range(top // tile, (top + len(half) - 1) // tile + 1):
            y0, y1 = max(top, ty * tile), min(top + len(half), (ty + 1) * tile)
            for tx in range(-(-half.shape[1] // tile)):
                c = half[y0 - top : y1 - top, tx * tile : (tx + 1) * tile]
                out.append((tx, ty, 0, y0 - ty * tile, c.shape[1], c.shape[0], c.tobytes()))
        columns = list(zip(*out))
        kinds = [pa.int32()] * 6 + [pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tx", "ty", "px", "py", "width", "height", "rgba"])

    cut = tiles.groupBy("ty").applyInArrow(band, "tx int, ty int, px int, py int, width int, height int, rgba binary")
    return tiled(spark, cut, level, width, height, tile)


def encoded(tiles: DataFrame, e: Encoding) -> DataFrame:
    """(level, tx, ty, data) of TILES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [raster.encode_tile(array(r["width"], r["height"], r["rgba"]), e.compression, e.tile, e.quality, e.ratio) for r in batch.select(["width", "height", "rgba"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("level"), batch.column("tx"), batch.column("ty"), pa.array(data, pa.binary())], names=["level", "tx", "ty", "data"])

    return tiles.mapInArrow(run, "level int, tx int, ty int, data binary")


def pyramid_sizes(width: int, height: int, tile: int) -> list[tuple[int, int]]:
    """Halved until both sides fit a tile; heights halve band by band."""
    out = [(width, height)]
    while max(out[-1]) > tile:
        w, h = out[-1]
        out.append((-(-w // 2), h // tile * -(-tile // 2) + -(-(h % tile) // 2)))
    return out


def fit_square(width: int, height: int, most: int) -> tuple[int, int]:
    if max(width, height) <= most:
        return width, height
    s = most / max(width, height)
    return max(1, int(width * s + 0.5)), max(1, int(height * s + 0.5))


def metadata_entries(description: str | None) -> dict[str, str]:
    out = {}
    for part in (description or "").split("|")[1:]:
        key, eq, value = part.partition("=")
        if eq and key.strip():
            out[key.strip()] = value.strip()
    return out


def _number(text: str | None, kind: Callable):
    try:
        return kind(text) if text is not None else None
    except ValueError:
        return None


def describe(width: int, height: int, e: Encoding, mpp: float | None, mag: int | None, source: dict[str, str]) -> str:
    label = "JP2000/RGB" if e.compression == raster.JP2K else f"JPEG/RGB Q={e.quality}"
    fields = [f"AppMag = {mag}"] if mag is not None else []
    fields += [f"MPP = {mpp:.4f}"] if mpp is not None else []
    fields += [f"{k} = {v}" for k, v in source.items() if k not in ("AppMag", "MPP", *POSITIONAL)]
    head = f"Aperio Image Library v1.0\r\n{width}x{height} [0,0 {width}x{height}] ({e.tile} x {e.tile}) {label}"
    return "|".join([head, *fields])


def source_encoding(level: Level, e: Encoding, tile: int | None) -> Encoding:
    """The encoding that a level itself seems to have, else e's values."""
    size = tile or level.tile_w
    if level.compression == raster.JP2K:
        counts = level.tile_table()[1]
        k = min(8, len(counts))
        some = [c for c in (counts[i * len(counts) // k] for i in range(k)) if c > 0]
        ratio = min(500.0, max(1.0, level.tile_w * level.tile_h * 3 / (sum(some) / len(some)))) if some else e.ratio
        return Encoding(raster.JP2K, e.quality, ratio, size)
    import re

    found = re.search(r"Q\s*=\s*(\d+)", level.ifd.text(270) or "")
    return Encoding(raster.JPEG, int(found[1]) if found else e.quality, e.ratio, size)


def copied(slide: Slide, image: Associated) -> ImageSpec:
    offsets, counts = image.strip_table()
    data = [slide.source.read(o, n) if n else b"" for o, n in zip(offsets, counts)]
    return ImageSpec(image.width, image.height, image.compression, image.photometric, image.samples, image.bits, image.rows_per_strip, data, image.predictor, image.ifd.text(270))


def _level_tiles(spark: SparkSession, path: str, lv: Level, x: int, y: int, width: int, height: int, out_level: int, tile: int, adjustments: Adjustments) -> DataFrame:
    x0, x1 = max(0, x) // lv.tile_w, (min(lv.width, x + width) - 1) // lv.tile_w
    y0, y1 = max(0, y) // lv.tile_h, (min(lv.height, y + height) - 1) // lv.tile_h
    stored = spark.read.format("slide_tiles").load(path).where((F.col("level") == lv.index) & F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1))
    cut = pieces(decode_tiles(stored), lv.tile_w, lv.tile_h, x, y, width, height, lv.width, lv.height, tile)
    return tiled(spark, cut, out_level, width, height, tile, adjustments)


def _assemble(spark: SparkSession, slide: Slide, out, specs: list[LevelSpec], tiles: list[DataFrame], e: Encoding, thumb: Callable[[np.ndarray], np.ndarray] | None, thumb_size: tuple[int, int], keep_images: bool, workspace: str) -> int:
    """Encodes all levels in parallel into a table of workspace, then writes the file in its order."""
    every = tiles[0]
    for t in tiles[1:]:
        every = every.unionByName(t)
    encoded(every, e).write.mode("overwrite").parquet(workspace)
    stored = spark.read.parquet(workspace).orderBy("level", "ty", "tx")
    sizes: list[list[int]] = [[] for _ in specs]
    for r in stored.select("level", F.length("data").alias("n"), "ty", "tx").toLocalIterator():
        sizes[r["level"]].append(r["n"])
    small = np.zeros((thumb_size[1], thumb_size[0], 4), np.uint8)
    last = specs[-1]
    band, rows_done = None, 0
    for r in [*tiles[-1].orderBy("ty", "tx").toLocalIterator(), None]:
        if band is not None and (r is None or r["ty"] != band[0]):
            image = band[1]
            if thumb is None:  # band by band, each to its share of the rows
                a = int(rows_done * thumb_size[1] / last.height + 0.5)
                b = int((rows_done + len(image)) * thumb_size[1] / last.height + 0.5)
                if b > a:
                    raster.paste(small, raster.resize(image, thumb_size[0], b - a), 0, a)
                rows_done += len(image)
            band = None
        if r is not None:
            if band is None:
                band = (r["ty"], np.zeros((r["height"], last.width, 4), np.uint8))
            raster.paste(band[1], array(r["width"], r["height"], bytes(r["rgba"])), r["tx"] * e.tile, 0)
    images = [ImageSpec(*thumb_size, raster.JPEG, 6, 3, [8, 8, 8], thumb_size[1], [raster.encode_image(small, "jpeg", e.quality)])]
    images += [copied(slide, a) for a in slide.associated if keep_images and a.kind in ("label", "macro")]
    return write(out, specs, sizes, (bytes(r["data"]) for r in stored.toLocalIterator()), images)


def export_pyramid(
    spark: SparkSession,
    path: str,
    out,
    workspace: str,
    level: int = 0,
    x: int = 0,
    y: int = 0,
    width: int | None = None,
    height: int | None = None,
    encoding: Encoding = Encoding(),
    tile: int | None = None,
    level_count: int | None = None,
    match_source: bool = False,
    keep_metadata: bool = True,
    keep_images: bool = True,
    adjustments: Adjustments = Adjustments(),
) -> int:
    """Writes a crop of a level as a new pyramid whose levels halve; returns its bytes.

    workspace: a folder that executors and the driver share, for the encoded tiles.
    """
    register(spark)
    slide = open_slide(path)
    try:
        lv = slide.levels[level]
        width, height = width or lv.width - x, height or lv.height - y
        if width <= 0 or height <= 0 or (level_count is not None and level_count < 1):
            raise ValueError("an empty crop, or no level")
        e = source_encoding(lv, encoding, tile) if match_source else Encoding(encoding.compression, encoding.quality, encoding.ratio, tile or encoding.tile)
        for top in range(y, y + height, e.tile):  # every band is read on its own, and must meet the level
            if top >= lv.height or min(top + e.tile, y + height) <= 0 or x >= lv.width or x + width <= 0:
                raise ValueError("a band of the crop lies outside the level")
        meta = metadata_entries(slide.description)
        mpp, mag = _number(meta.get("MPP"), float), _number(meta.get("AppMag"), int)
        sizes = pyramid_sizes(width, height, e.tile)[:level_count]
        text = describe(width, height, e, None if mpp is None else mpp * lv.downsample, mag, meta if keep_metadata else {})
        specs = [LevelSpec(w, h, e.tile, e.tile, e.compression, text if i == 0 else None) for i, (w, h) in enumerate(sizes)]
        levels = [_level_tiles(spark, path, lv, x, y, width, height, 0, e.tile, adjustments)]
        for i, (w, h) in enumerate(sizes[1:], 1):
            # each level is stored once: it feeds both its encoding and the next level
            levels[-1].write.mode("overwrite").parquet(f"{workspace}/level-{i - 1}")
            levels[-1] = spark.read.schema(TILES).parquet(f"{workspace}/level-{i - 1}")
            levels.append(next_level(spark, levels[-1], i, w, h, e.tile))
        return _assemble(spark, slide, out, specs, levels, e, None, fit_square(*sizes[-1], e.tile), keep_images, f"{workspace}/encoded")
    finally:
        slide.close()


def export_preserving(
    spark: SparkSession, path: str, out, workspace: str, level: int, x: int, y: int, width: int, height: int, encoding: Encoding = Encoding(), tile: int | None = None, match_source: bool = False, keep_metadata: bool = True, keep_images: bool = True, adjustments: Adjustments = Adjustments()
) -> int:
    """Writes a crop with the source's own levels, each cut from the matching level."""
    register(spark)
    slide = open_slide(path)
    try:
        base = slide.levels[level]
        e = source_encoding(base, encoding, tile) if match_source else Encoding(encoding.compression, encoding.quality, encoding.ratio, tile or encoding.tile)
        meta = metadata_entries(slide.description)
        mpp, mag = _number(meta.get("MPP"), float), _number(meta.get("AppMag"), int)
        box = [v * base.downsample for v in (x, y, width, height)]
        specs, levels = [], []
        for lv in slide.levels[level:]:
            rx, ry, rw, rh = (int(np.floor(v / lv.downsample + 0.5)) for v in box)
            rx, ry = max(0, min(rx, lv.width - 1)), max(0, min(ry, lv.height - 1))
            rw, rh = max(1, min(rw, lv.width - rx)), max(1, min(rh, lv.height - ry))
            text = describe(rw, rh, e, None if mpp is None else mpp * base.downsample, mag, meta if keep_metadata else {}) if not specs else None
            levels.append(_level_tiles(spark, path, lv, rx, ry, rw, rh, len(specs), e.tile, adjustments))
            specs.append(LevelSpec(rw, rh, e.tile, e.tile, e.compression, text))
        return _assemble(spark, slide, out, specs, levels, e, None, fit_square(specs[-1].width, specs[-1].height, e.tile), keep_images, f"{workspace}/encoded")
    finally:
        slide.close()


def to_file(export: Callable, spark: SparkSession, path: str, target: str, workspace: str, **options) -> int:
    """An export into a file, which replaces an existing one."""
    if os.path.exists(target):
        os.remove(target)
    with open(target, "wb") as f:
        return export(spark, path, f, workspace, **options)


def to_bytes(export: Callable, spark: SparkSession, path: str, workspace: str, **options) -> bytes:
    buffer = io.BytesIO()
    export(spark, path, buffer, workspace, **options)
    return buffer.getvalue()


def rebuild(spark: SparkSession, path: str, target: str, workspace: str, match_source: bool = True, **options) -> int:
    """The whole of level 0 as a new pyramid."""
    return to_file(export_pyramid, spark, path, target, workspace, match_source=match_source, **options)


def rebuild_in_place(spark: SparkSession, path: str, workspace: str, **options) -> int:
    """rebuild() into a file beside path, which takes its place; path stays as it is on a failure."""
    if not path:
        raise ValueError("a path is needed")
    beside = f"{path}.rebuild.tmp"
    try:
        n = rebuild(spark, path, beside, workspace, **options)
        os.replace(beside, path)
        return n
    finally:
        if os.path.exists(beside):
            os.remove(beside)
