"""Slide and viewport geometry as Column expressions.

Coordinates: level-0 pixels (doubles) for viewports, level pixels (integers) for regions, tile
indices for grids. Rounding is half away from zero, integer division truncates.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_UPSAMPLE = 1.3
MIN_TILE_SCREEN = 64.0
MAX_SPAN = 6


def long(c: Column) -> Column:
    return c.cast("long")


def tiles_across(extent: Column, tile: Column) -> Column:
    """Tiles that cover extent pixels."""
    return long(F.ceil(extent / tile))


def clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(v, lo), hi)


def select_level(levels: Column, scale: Column, max_upsample: float = MAX_UPSAMPLE) -> Column:
    """Index of the last of levels (an array of downsamples) whose texels are at most max_upsample screen pixels; else 0."""
    fits = F.filter(F.sequence(F.lit(0), F.size(levels) - 1), lambda i: F.get(levels, i) * scale <= max_upsample)
    return F.coalesce(F.array_max(fits), F.lit(0))


def select_span(tile_screen: Column, least: float = MIN_TILE_SCREEN, most: int = MAX_SPAN) -> Column:
    """The smallest span (tiles merged per side, as a power of two) at which a tile has `least` screen pixels."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: tile_screen * F.pow(F.lit(2.0), i) >= least)
    return F.coalesce(F.array_min(fits), F.lit(most))


def select_reduction(texel_screen: Column, most: int = 3, max_upsample: float = MAX_UPSAMPLE) -> Column:
    """The deepest decode-time halving whose pixels are at most max_upsample screen pixels."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: (i == 0) | (texel_screen * F.pow(F.lit(2.0), i) <= max_upsample))
    return F.array_max(fits)


def reduced_extent(extent: Column, reduction: Column) -> Column:
    return F.call_function("shiftright", long(extent) + F.call_function("shiftleft", F.lit(1).cast("long"), reduction) - 1, reduction)


def visible_range(origin: Column, extent: Column, scale: Column, downsample: Column, tile: Column, tiles: Column, margin: int = 0) -> tuple[Column, Column]:
    """First and last visible tile index along one axis, clamped to the grid.

    The last one is the floor of the exclusive edge, so an edge on a boundary includes a tile more.
    """
    first = long(F.floor(origin / downsample / tile)) - margin
    last = long(F.floor((origin + extent / scale) / downsample / tile)) + margin
    return clamp(first, F.lit(0).cast("long"), tiles - 1), clamp(last, F.lit(0).cast("long"), tiles - 1)


def ring(tx: Column, ty: Column, cx: Column, cy: Column) -> Column:
    """Chebyshev distance from the centre tile."""
    return F.greatest(F.abs(tx - cx), F.abs(ty - cy))


def ring_order(tx: Column, ty: Column, cx: Column, cy: Column) -> Column:
    """Order inside a ring: top row, bottom row, left column, right column, each ascending."""
    r = ring(tx, ty, cx, cy)
    side = F.when(ty == cy - r, 0).when(ty == cy + r, 1).when(tx == cx - r, 2).otherwise(3)
    return F.struct(r.alias("r"), side.alias("side"), F.when(side < 2, tx).otherwise(ty).alias("i"))


def wanted_limit(tile_bytes: Column, cache_bytes: int, pressured: bool = False, most: int = 4096) -> Column:
    """Tiles that may be wanted at once under the cache's budget."""
    budget = cache_bytes * 0.8 * (0.5 if pressured else 1.0)
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), long(F.floor(F.lit(budget) / tile_bytes))))


def fit_scale(view_w: Column, view_h: Column, width: Column, height: Column, cover: bool = False) -> Column:
    pick = F.greatest if cover else F.least
    return pick(view_w / width, view_h / height)


def zoomed(origin: Column, focal_from: Column, focal_to: Column, scale: Column, factor: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Scale and origin after zooming by factor about a focal point (one axis)."""
    new = clamp(scale * factor, lo, hi)
    return new, origin + focal_from / scale - focal_to / new


def recentred(point: Column, extent: Column, scale: Column) -> Column:
    """Origin that centres point (one axis)."""
    return point - extent / (2 * scale)


def wheel_factor(dy: Column) -> Column:
    return F.exp(-dy * 0.001)


def to_screen(level0: Column, origin: Column, scale: Column) -> Column:
    return (level0 - origin) * scale


def fit_square(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Extents scaled down to most, at least 1 and unchanged if they fit."""
    s = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda n: F.when(F.greatest(width, height) <= most, long(n)).otherwise(F.greatest(F.lit(1).cast("long"), long(F.round(n * s))))
    return side(width), side(height)


def blit_plan(clip: tuple[Column, Column, Column, Column], tile: tuple[Column, Column], tile_size: tuple[Column, Column], dst: tuple[Column, Column], dst_stride: Column) -> Column:
    """Copy plan of a tile into a region's buffer, null where they are disjoint.

    clip: left, top, right, bottom to fill; tile: its left and top; dst: origin of the buffer.
    """
    left, top = F.greatest(clip[0], tile[0]), F.greatest(clip[1], tile[1])
    right, bottom = F.least(clip[2], tile[0] + tile_size[0]), F.least(clip[3], tile[1] + tile_size[1])
    plan = F.struct(
        (bottom - top).alias("rows"),
        (right - left).alias("cols"),
        ((top - tile[1]) * tile_size[0] + left - tile[0]).alias("src_first"),
        tile_size[0].alias("src_stride"),
        ((top - dst[1]) * dst_stride + left - dst[0]).alias("dst_first"),
        dst_stride.alias("dst_stride"),
    )
    return F.when((right > left) & (bottom > top), plan)


def chunked_halve(extent: Column, chunk: Column) -> Column:
    """Rows of the next level when each band of chunk rows is halved on its own."""
    full, rest = F.floor(extent / chunk), extent % chunk
    return long(full * F.ceil(chunk / 2) + F.ceil(rest / 2))


def pyramid_dims(width: Column, height: Column, tile: Column, most: int | None = None) -> Column:
    """Array of (level, width, height), halved until both fit one tile."""
    item = lambda i, w, h: F.struct(long(i).alias("level"), long(w).alias("width"), long(h).alias("height"))
    first = F.array(item(F.lit(0), width, height))

    def step(acc: Column, i: Column) -> Column:
        last = F.element_at(acc, -1)
        more = (last["width"] > tile) | (last["height"] > tile)
        return F.when(more, F.concat(acc, F.array(item(i, F.ceil(last["width"] / 2), chunked_halve(last["height"], tile))))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit((most or 64) - 1)), first, step) if most != 1 else first


def level_region(x: Column, y: Column, w: Column, h: Column, downsample: Column, width: Column, height: Column) -> Column:
    """The rectangle on a level that shows a level-0 rectangle, moved and cut to the level."""
    one = F.lit(1).cast("long")
    scaled = lambda v: long(F.round(v / downsample))
    rx = F.greatest(F.lit(0).cast("long"), F.least(scaled(x), width - 1))
    ry = F.greatest(F.lit(0).cast("long"), F.least(scaled(y), height - 1))
    return F.struct(rx.alias("x"), ry.alias("y"), F.greatest(one, F.least(scaled(w), width - rx)).alias("width"), F.greatest(one, F.least(scaled(h), height - ry)).alias("height"))


def overview_matches(w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether an associated image can serve as the overview of a slide."""
    ratio = (w / h) / (width / height)
    return (F.abs(ratio - 1) < 0.02) & (w.cast("long") * h <= 4096 * 4096)


def tile_screen_rect(tx: Column, ty: Column, span: Column, reduction: Column, image_w: Column, image_h: Column, tile: tuple[Column, Column], downsample: Column, scale: Column, origin: tuple[Column, Column]) -> Column:
    """Where a decoded tile lies on the screen, with a pixel of overlap into its neighbours.

    Sized by the decoded image: an edge tile may be smaller than the grid's.
    """
    shift = lambda v, n: F.call_function("shiftleft", v, n)
    texels = shift(F.lit(1).cast("long"), reduction) * downsample
    x, y = tx * shift(tile[0], span) * downsample, ty * shift(tile[1], span) * downsample
    return F.struct(
        to_screen(x, origin[0], scale).alias("left"),
        to_screen(y, origin[1], scale).alias("top"),
        (image_w * texels * scale + 1).alias("width"),
        (image_h * texels * scale + 1).alias("height"),
    )


def minimap(width: Column, height: Column, view: tuple[Column, Column], origin: tuple[Column, Column], scale: Column, most: float) -> Column:
    """Size of a minimap's box, and the viewport's rectangle in it, cut to the box."""
    aspect = width / height
    w = F.when(aspect >= 1, F.lit(most)).otherwise(most * aspect)
    h = F.when(aspect >= 1, most / aspect).otherwise(F.lit(most))
    zero = F.lit(0.0)
    left, top = origin[0] * w / width, origin[1] * h / height
    right, bottom = left + view[0] / scale * w / width, top + view[1] / scale * h / height
    return F.struct(w.alias("box_w"), h.alias("box_h"), F.greatest(left, zero).alias("left"), F.greatest(top, zero).alias("top"), F.least(right, w).alias("right"), F.least(bottom, h).alias("bottom"))


def minimap_target(local: Column, box: Column, extent: Column) -> Column:
    """The level-0 coordinate that a tap on the minimap means (one axis)."""
    return clamp(local / box, F.lit(0.0), F.lit(1.0)) * extent
