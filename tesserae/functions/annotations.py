"""Vector annotations as Column expressions over array<struct<x double, y double>>.

Points are level-0 pixels. Types: point, rectangle (bounding box of its points), polyline, polygon.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, functions as F

POINTS = "array<struct<x:double,y:double>>"
#: JSON layout of an annotation; points are [x, y] pairs.
JSON = "id string, type string, points array<array<double>>, color bigint, strokeWidth double, filled boolean, label string"


def bounding_box(points: Column) -> Column:
    of = lambda f, axis: f(F.transform(points, lambda p: p[axis]))
    return F.struct(of(F.array_min, "x").alias("left"), of(F.array_min, "y").alias("top"), of(F.array_max, "x").alias("right"), of(F.array_max, "y").alias("bottom"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def corners(b: Column) -> Column:
    """The four corners of a bounding box, clockwise from the top left."""
    at = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(at("left", "top"), at("right", "top"), at("right", "bottom"), at("left", "bottom"))


def _edges(points: Column, closed: Column, edge: Callable[[Column, Column], Column]) -> Column:
    """edge(a, b) of consecutive points, and of the last and first if closed."""
    n = F.size(points)
    last = F.when(closed, n - 1).otherwise(n - 2)
    ids = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    ends = F.transform(ids, lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, (i + 1) % n).alias("b")))
    return F.transform(ends, lambda e: edge(e["a"], e["b"]))


def segment_distance(px: Column, py: Column, a: Column, b: Column) -> Column:
    """Distance of a point from the segment a b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((px - a["x"]) * dx + (py - a["y"]) * dy) / F.nullif(square, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    ex, ey = px - (a["x"] + dx * t), py - (a["y"] + dy * t)
    return F.sqrt(ex * ex + ey * ey)


def on_outline(points: Column, px: Column, py: Column, tolerance: Column, closed: Column) -> Column:
    """Within tolerance of the outline; a closing edge only for three points or more."""
    near = F.exists(_edges(points, closed & (F.size(points) > 2), lambda a, b: segment_distance(px, py, a, b)), lambda d: d <= tolerance)
    first = F.get(points, F.lit(0))
    return F.when(F.size(points) == 1, segment_distance(px, py, first, first) <= tolerance).otherwise(near)


def in_polygon(points: Column, px: Column, py: Column) -> Column:
    """Even-odd rule, half open in y."""

    def crosses(a: Column, b: Column) -> Column:
        rise = F.nullif(b["y"] - a["y"], F.lit(0.0))
        return ((a["y"] > py) != (b["y"] > py)) & F.coalesce(px < (b["x"] - a["x"]) * (py - a["y"]) / rise + a["x"], F.lit(False))

    return F.aggregate(_edges(points, F.lit(True), crosses), F.lit(False), lambda acc, c: acc != c)


def hit(kind: Column, points: Column, filled: Column, px: Column, py: Column, tolerance: Column) -> Column:
    """Whether a tap hits the shape: its outline within tolerance, or its inside if filled.

    A rectangle's inside has its left and top edges and not the others.
    """
    inside = lambda b: (px >= b["left"]) & (px < b["right"]) & (py >= b["top"]) & (py < b["bottom"])
    outline = lambda b: bind(corners(b), lambda c: on_outline(c, px, py, tolerance, F.lit(True)))
    first = F.get(points, F.lit(0))
    return (
        F.when(kind == "point", segment_distance(px, py, first, first) <= tolerance)
        .when(kind == "polyline", on_outline(points, px, py, tolerance, F.lit(False)))
        .when(kind == "rectangle", bind(bounding_box(points), lambda b: (filled & inside(b)) | outline(b)))
        .when(kind == "polygon", (filled & in_polygon(points, px, py)) | on_outline(points, px, py, tolerance, F.lit(True)))
    )


def path_length(points: Column, mpp_x: Column, mpp_y: Column, closed: Column) -> Column:
    def length(a: Column, b: Column) -> Column:
        dx, dy = (b["x"] - a["x"]) * mpp_x, (b["y"] - a["y"]) * mpp_y
        return F.sqrt(dx * dx + dy * dy)

    return F.aggregate(_edges(points, closed, length), F.lit(0.0), lambda acc, d: acc + d)


def polygon_area(points: Column, mpp_x: Column, mpp_y: Column) -> Column:
    cross = lambda a, b: (a["x"] * mpp_x) * (b["y"] * mpp_y) - (b["x"] * mpp_x) * (a["y"] * mpp_y)
    return F.abs(F.aggregate(_edges(points, F.lit(True), cross), F.lit(0.0), lambda acc, d: acc + d)) / 2


def measure(kind: Column, points: Column, mpp_x: Column, mpp_y: Column) -> Column:
    """struct(length_um, area_um2); null where a shape has none, or the scale is unknown."""
    n, b = F.size(points), bounding_box(points)
    w, h = (b["right"] - b["left"]) * mpp_x, (b["bottom"] - b["top"]) * mpp_y
    known = mpp_x.isNotNull() & mpp_y.isNotNull()
    rectangle, polygon = known & (kind == "rectangle") & (n >= 2), known & (kind == "polygon") & (n >= 3)
    length = F.when(known & (kind == "polyline") & (n >= 2), path_length(points, mpp_x, mpp_y, F.lit(False))).when(rectangle, 2 * (w + h)).when(polygon, path_length(points, mpp_x, mpp_y, F.lit(True)))
    area = F.when(rectangle, w * h).when(polygon, polygon_area(points, mpp_x, mpp_y))
    return F.struct(length.alias("length_um"), area.alias("area_um2"))


def label_anchor(kind: Column, points: Column) -> Column:
    """Where a label stands: the centre of a rectangle, else the mean of the vertices."""
    b, n = bounding_box(points), F.size(points)
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[axis]) / n
    x = F.when(kind == "rectangle", (b["left"] + b["right"]) / 2).otherwise(mean("x"))
    y = F.when(kind == "rectangle", (b["top"] + b["bottom"]) / 2).otherwise(mean("y"))
    return F.struct(x.alias("x"), y.alias("y"))


def to_json(id_: Column, kind: Column, points: Column, color: Column, stroke: Column, filled: Column, label: Column) -> Column:
    """One annotation as JSON; a null label is left out."""
    pairs = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(id_.alias("id"), kind.alias("type"), pairs.alias("points"), color.alias("color"), stroke.alias("strokeWidth"), filled.alias("filled"), label.alias("label")))


def from_json(text: Column) -> Column:
    """The annotation of a JSON text; a stroke of 2 and not filled by default, an unknown type is an error."""
    raw = F.from_json(text, JSON)
    known = raw["type"].isin("point", "rectangle", "polyline", "polygon")
    kind = F.when(known, raw["type"]).otherwise(F.raise_error(F.concat(F.lit("unknown annotation type: "), F.coalesce(raw["type"], F.lit("none")))))
    return F.struct(
        raw["id"].alias("id"),
        kind.alias("type"),
        F.transform(raw["points"], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"),
        raw["color"].alias("color"),
        F.coalesce(raw["strokeWidth"], F.lit(2.0)).alias("stroke_width"),
        F.coalesce(raw["filled"], F.lit(False)).alias("filled"),
        raw["label"].alias("label"),
    )



def format_length(um: Column, fixed: Callable[[Column, int], Column] | None = None) -> Column:
    """Microns below a millimetre, else millimetres; fixed: fixed_exact for doubles, fixed_decimal for decimals."""
    fixed = fixed or fixed_exact
    return F.when(um < 1000, F.concat(fixed(um, 1), F.lit(" µm"))).otherwise(F.concat(fixed(um / 1000, 2), F.lit(" mm")))


def format_area(um2: Column, fixed: Callable[[Column, int], Column] | None = None) -> Column:
    fixed = fixed or fixed_exact
    return F.when(um2 < 1_000_000, F.concat(fixed(um2, 1), F.lit(" µm²"))).otherwise(F.concat(fixed(um2 / 1_000_000, 2), F.lit(" mm²")))


def fixed_decimal(v: Column, digits: int) -> Column:
    """Decimals of a decimal value, ties away from zero: 2.445 is 2.45, where the double next to it lies below the tie."""
    return F.round(v, digits).cast("string")


def fixed_exact(v: Column, digits: int) -> Column:
    """Decimals of the exact binary value, ties away from zero.

    Catalyst casts doubles by their shortest decimal form, which rounds 0.49905 up although its
    binary value lies below; so this runs in Python, batch by batch.
    """
    step = Decimal(1).scaleb(-digits)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else str(Decimal(x).quantize(step, ROUND_HALF_UP)))

    return run(v.cast("double"))


# Lengths of a scale bar in microns.
SCALE_BARS = (0.1, 0.2, 0.5, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000)


def scale_bar(um_per_pixel: Column, most: float = 120.0) -> Column:
    """struct(length_um, pixels, label): the longest bar of at most `most` screen pixels, or the shortest bar."""
    nice = F.array(*(F.lit(float(v)) for v in SCALE_BARS))
    length = F.coalesce(F.array_max(F.filter(nice, lambda v: v / um_per_pixel <= most)), F.lit(SCALE_BARS[0]))
    label = F.when(length >= 1000, F.concat((length / 1000).cast("long").cast("string"), F.lit(" mm"))).when(length % 1 == 0, F.concat(length.cast("long").cast("string"), F.lit(" µm"))).otherwise(F.concat(fixed_exact(length, 1), F.lit(" µm")))
    return F.when(um_per_pixel > 0, F.struct(length.alias("length_um"), (length / um_per_pixel).alias("pixels"), label.alias("label")))


def hud(scale: Column, min_scale: Column, mag: Column) -> Column:
    """struct(zoom_percent, coverage_percent, magnification)."""
    m = mag * scale
    text = F.when(m < 10, fixed_exact(m, 2)).otherwise(fixed_exact(m, 0))
    return F.struct(F.round(scale * 100).cast("long").alias("zoom_percent"), F.round(min_scale / scale * 100).cast("long").alias("coverage_percent"), text.alias("magnification"))
