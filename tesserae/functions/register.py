"""Codecs and planners as SQL functions and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from tesserae.codecs import raster, strips
from tesserae.session import reachable
from tesserae.sources.datasource import tag_value
from tesserae.sources.slide import open_slide
from tesserae.functions.metadata import TAG_NAMES

RASTER = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("rgba", BinaryType())])


def _raster(a: np.ndarray) -> dict:
    return {"width": a.shape[1], "height": a.shape[0], "rgba": a.tobytes()}


def _rows(columns: list[pd.Series], f) -> pd.DataFrame:
    none = {"width": None, "height": None, "rgba": None}
    return pd.DataFrame([none if v[0] is None else _raster(f(*v)) for v in zip(*columns)], columns=list(none))


@F.pandas_udf(RASTER)
def decode_tile(data: pd.Series, compression: pd.Series, photometric: pd.Series, reduction: pd.Series) -> pd.DataFrame:
    """A stored tile without shared tables as a raster."""
    return _rows([data, compression, photometric, reduction], lambda d, c, p, r: raster.decode_tile(bytes(d), int(c), int(p), None, int(r)))


@F.pandas_udf(BinaryType())
def encode_image(width: pd.Series, height: pd.Series, rgba: pd.Series, kind: pd.Series, quality: pd.Series) -> pd.Series:
    def one(w, h, b, k, q):
        return None if b is None else raster.encode_image(np.frombuffer(b, np.uint8).reshape(int(h), int(w), 4), k, int(q))

    return pd.Series([one(*v) for v in zip(width, height, rgba, kind, quality)])


@F.pandas_udf(BinaryType())
def decompress_strip(data: pd.Series, compression: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else strips.decompress(bytes(d), int(c), int(n)) for d, c, n in zip(data, compression, size)])


@udtf(returnType=StructType([StructField("ifd_index", IntegerType()), StructField("tag_id", IntegerType()), StructField("tag_name", StringType()), StructField("text", StringType())]))
class SlideTags:
    """slide_tags(path): every tag of a file, its value as text."""

    def eval(self, path: str) -> Iterator[tuple]:
        slide = open_slide(path)
        for ifd in slide.ifds:
            for t in ifd.tags.values():
                value = next((v for v in tag_value(ifd, t.id, False) if v is not None), None)
                yield ifd.index, t.id, TAG_NAMES.get(t.id, f"Tag{t.id}"), None if value is None else str(value)
        slide.close()


@udtf(returnType=StructType([StructField(c, IntegerType()) for c in ("tx", "ty", "ring")]))
class VisibleTiles:
    """visible_tiles(min_tx, max_tx, min_ty, max_ty, center_tx, center_ty): a range's tiles with their ring."""

    def eval(self, x0: int, x1: int, y0: int, y1: int, cx: int, cy: int) -> Iterator[tuple]:
        for ty in range(y0, y1 + 1):
            for tx in range(x0, x1 + 1):
                yield tx, ty, max(abs(tx - cx), abs(ty - cy))


#: hit_test in SQL, with the rules of annotations.hit.
HIT_TEST = """CREATE OR REPLACE TEMPORARY FUNCTION hit_test(kind STRING, points ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, filled BOOLEAN, px DOUBLE, py DOUBLE, tolerance DOUBLE)
RETURNS BOOLEAN RETURN {body}"""


def hit_test_sql() -> str:
    """The body of hit_test, from its building blocks."""
    distance = lambda a, b: (
        f"(transform(array(named_struct('a', {a}, 'b', {b})), s -> transform(array(if(s.a.x = s.b.x and s.a.y = s.b.y, 0D, least(greatest(((px - s.a.x) * (s.b.x - s.a.x) + (py - s.a.y) * (s.b.y - s.a.y))"
        " / nullif((s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y), 0D), 0D), 1D))), t -> sqrt(pow(px - (s.a.x + (s.b.x - s.a.x) * t), 2) + pow(py - (s.a.y + (s.b.y - s.a.y) * t), 2)))[0])[0])"
    )
    near = lambda points, closed: f"exists(sequence(0, size({points}) - 1), i -> (i + 1 < size({points}) or ({closed} and size({points}) > 2) or size({points}) = 1) and {distance(f'{points}[i]', f'{points}[(i + 1) % size({points})]')} <= tolerance)"
    edge = lambda e: f"transform(points, p -> p.{e})"
    left, top, right, bottom = f"array_min({edge('x')})", f"array_min({edge('y')})", f"array_max({edge('x')})", f"array_max({edge('y')})"
    corner = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    box = f"array({corner(left, top)}, {corner(right, top)}, {corner(right, bottom)}, {corner(left, bottom)})"
    crosses = "(points[i].y > py) <> (points[(i + 1) % size(points)].y > py) and px < (points[(i + 1) % size(points)].x - points[i].x) * (py - points[i].y) / nullif(points[(i + 1) % size(points)].y - points[i].y, 0D) + points[i].x"
    inside = f"size(filter(sequence(0, size(points) - 1), i -> {crosses})) % 2 = 1"
    return (
        f"CASE kind WHEN 'point' THEN {distance('points[0]', 'points[0]')} <= tolerance WHEN 'polyline' THEN {near('points', 'false')}"
        f" WHEN 'rectangle' THEN (filled and px >= {left} and px < {right} and py >= {top} and py < {bottom}) or {near(box, 'true')}"
        f" WHEN 'polygon' THEN (filled and {inside}) or {near('points', 'true')} END"
    )


def register_functions(spark: SparkSession) -> None:
    reachable(spark)
    spark.udf.register("decode_tile", decode_tile)
    spark.udf.register("encode_image", encode_image)
    spark.udf.register("decompress_strip", decompress_strip)
    spark.sql(HIT_TEST.format(body=hit_test_sql()))
    spark.udtf.register("slide_tags", SlideTags)
    spark.udtf.register("visible_tiles", VisibleTiles)
