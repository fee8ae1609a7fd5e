"""Tile requests of viewports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tesserae.functions import geometry as G


def plan(viewports: DataFrame, levels: list[dict], max_upsample: float = G.MAX_UPSAMPLE) -> DataFrame:
    """viewports (vid, w, h, scale, ox, oy) with level, span, reduction, grid and centre tile.

    levels: dicts with width, height, tile_w, tile_h, downsample, finest first.
    """
    arr = F.array(*(F.struct(F.lit(i).alias("level"), *(F.lit(l[k]).cast("long").alias(k) for k in ("width", "height", "tile_w", "tile_h")), F.lit(float(l["downsample"])).alias("downsample")) for i, l in enumerate(levels)))
    v = viewports.withColumn("level", G.select_level(F.array(*(F.lit(float(l["downsample"])) for l in levels)), F.col("scale"), max_upsample))
    v = v.withColumn("g", F.get(arr, F.col("level")))
    texel = F.col("g.downsample") * F.col("scale")
    v = v.withColumn("span", G.select_span(F.least("g.tile_w", "g.tile_h") * texel))
    v = v.withColumn("reduction", F.when(F.col("span") == 0, G.select_reduction(texel, 3, max_upsample)).otherwise(G.select_reduction(texel, 9, max_upsample)))
    shift = lambda c: F.call_function("shiftleft", F.col(c), F.col("span"))
    v = v.withColumn("tw", shift("g.tile_w")).withColumn("th", shift("g.tile_h"))
    v = v.withColumn("tiles_x", G.tiles_across(F.col("g.width"), F.col("tw"))).withColumn("tiles_y", G.tiles_across(F.col("g.height"), F.col("th")))
    ds = F.col("g.downsample")
    for margin, tag in ((0, ""), (1, "_p")):
        x = G.visible_range(F.col("ox"), F.col("w"), F.col("scale"), ds, F.col("tw"), F.col("tiles_x"), margin)
        y = G.visible_range(F.col("oy"), F.col("h"), F.col("scale"), ds, F.col("th"), F.col("tiles_y"), margin)
        for name, c in zip(("min_tx", "max_tx", "min_ty", "max_ty"), (*x, *y)):
            v = v.withColumn(name + tag, c)
    centre = lambda o, n, t, lo, hi: G.clamp(F.floor((F.col(o) + F.col(n) / (2 * F.col("scale"))) / ds / F.col(t)).cast("long"), F.col(lo), F.col(hi))
    v = v.withColumn("cx", centre("ox", "w", "tw", "min_tx", "max_tx")).withColumn("cy", centre("oy", "h", "th", "min_ty", "max_ty"))
    v = v.withColumn("pcx", centre("ox", "w", "tw", "min_tx_p", "max_tx_p")).withColumn("pcy", centre("oy", "h", "th", "min_ty_p", "max_ty_p"))
    return v.withColumn("tile_bytes", G.reduced_extent(F.col("tw"), F.col("reduction")) * G.reduced_extent(F.col("th"), F.col("reduction")) * 4)


def wanted(planned: DataFrame, cache_bytes: int, prefetch: bool = True, pressured: bool = False, most: int = 4096) -> DataFrame:
    """Ranked tile requests (vid, level, tx, ty, span, reduction, priority, rank): visible tiles nearest first, then the margin's.

    Tiles farther from the centre than the limit can reach are not generated: with a columns in
    the range, the rings of radius r hold min(a, 2 r + 1) tiles in a row at least, so rows are cut to the
    least r that holds the limit. A zoomed-out view costs a small multiple of the limit.
    """
    p = planned.withColumn("lim", G.wanted_limit(F.col("tile_bytes"), cache_bytes, pressured, most))

    def ranked(tag: str, cx: str, cy: str, priority: int) -> DataFrame:
        across = F.col(f"max_tx{tag}") - F.col(f"min_tx{tag}") + 1
        down = F.col(f"max_ty{tag}") - F.col(f"min_ty{tag}") + 1
        # the margin's rows come after the visible ones, which lie inside
        need = F.col("lim") + (F.lit(0) if not tag else (F.col("max_tx") - F.col("min_tx") + 1) * (F.col("max_ty") - F.col("min_ty") + 1))
        # rings reach one side of the range at least half as far as the other: a quarter of a square is always inside
        short = F.least(across, down)
        radius = F.greatest(F.ceil(F.sqrt(need)), F.ceil(need / short)).cast("long") + 1
        cut = lambda lo, hi, c: F.sequence(F.greatest(F.col(lo), F.col(c) - radius), F.least(F.col(hi), F.col(c) + radius))
        t = p.withColumn("ty", F.explode(cut(f"min_ty{tag}", f"max_ty{tag}", cy))).withColumn("tx", F.explode(cut(f"min_tx{tag}", f"max_tx{tag}", cx)))
        if tag:
            core = F.col("tx").between(F.col("min_tx"), F.col("max_tx")) & F.col("ty").between(F.col("min_ty"), F.col("max_ty"))
            t = t.where(~core)
        order = G.ring_order(F.col("tx"), F.col("ty"), F.col(cx), F.col(cy))
        return t.select("vid", "level", "tx", "ty", "span", "reduction", "lim", F.lit(priority).alias("pri"), order.alias("o"))

    both = ranked("", "cx", "cy", 0)
    if prefetch and not pressured:
        both = both.unionByName(ranked("_p", "pcx", "pcy", 1))
    w = Window.partitionBy("vid").orderBy("pri", "o")
    out = both.withColumn("rank", F.row_number().over(w)).where("rank <= lim")
    return out.select("vid", "level", "tx", "ty", "span", "reduction", F.when(F.col("pri") == 0, "visible").otherwise("prefetch").alias("priority"), F.col("rank").cast("long"))


def needs_fetch(requests: DataFrame, cached: DataFrame, in_flight: DataFrame, sparse: DataFrame) -> DataFrame:
    """requests that are not in flight, not known sparse, and not cached at least as sharp."""
    key = ["level", "tx", "ty", "span"]
    out = requests.join(in_flight.select(*key).distinct(), key, "left_anti").join(sparse.select(*key).distinct(), key, "left_anti")
    sharp = cached.select(*key, F.col("reduction").alias("have"))
    r, s = out.alias("r"), sharp.alias("s")
    same = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in key]
    return r.join(s, [*same, F.col("s.have") <= F.col("r.reduction")], "left_anti")


def stale(in_flight: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests in flight (vid, level, tx, ty, span) that their viewport no longer wants, to be cancelled."""
    key = ["vid", "level", "tx", "ty", "span"]
    return in_flight.join(requests.select(*key), key, "left_anti")


def refreshed(requests: DataFrame, in_flight: DataFrame, cached: DataFrame, sparse: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the new queue, which replaces the old one; the requests in flight to cancel)."""
    gone = stale(in_flight, requests)
    key = ["vid", "level", "tx", "ty", "span"]
    return needs_fetch(requests, cached, in_flight.join(gone.select(*key), key, "left_anti"), sparse), gone


def fallback(viewports: DataFrame, planned: DataFrame, cached: DataFrame, levels: list[dict]) -> DataFrame:
    """(vid, level, span) of the cached group that stands in for missing tiles.

    Of the groups with a tile in view, the level nearest to the wanted one, coarser first, then
    the nearest span. The groups are few; tiles meet viewports by group.
    """
    arr = F.array(*(F.struct(*(F.lit(l[k]).cast("long").alias(k) for k in ("width", "height", "tile_w", "tile_h")), F.lit(float(l["downsample"])).alias("downsample")) for l in levels))
    aim = planned.select("vid", F.col("level").alias("aim_level"), F.col("span").alias("aim_span"))
    groups = cached.where(F.col("level") < len(levels)).select("level", "span").distinct()
    v = viewports.join(aim, "vid").join(F.broadcast(groups)).where((F.col("level") != F.col("aim_level")) | (F.col("span") != F.col("aim_span")))
    v = v.withColumn("g", F.get(arr, F.col("level").cast("int")))
    side = lambda c: F.call_function("shiftleft", F.col(c), F.col("span").cast("int"))
    v = v.withColumn("tw", side("g.tile_w")).withColumn("th", side("g.tile_h"))
    for axis, o, n, t, extent in (("x", "ox", "w", "tw", "g.width"), ("y", "oy", "h", "th", "g.height")):
        lo, hi = G.visible_range(F.col(o), F.col(n), F.col("scale"), F.col("g.downsample"), F.col(t), G.tiles_across(F.col(extent), F.col(t)))
        v = v.withColumn(f"lo_{axis}", lo).withColumn(f"hi_{axis}", hi)
    # one row a row of tiles: whether a tile of it is in view is a lookup in its columns
    rows = cached.groupBy("level", "span", "ty").agg(F.collect_set("tx").alias("txs"))
    seen = v.join(rows, ["level", "span"]).where(F.col("ty").between(F.col("lo_y"), F.col("hi_y"))).where(F.exists("txs", lambda x: x.between(F.col("lo_x"), F.col("hi_x"))))
    order = F.struct(F.abs(F.col("level") - F.col("aim_level")), -F.col("level"), F.abs(F.col("span") - F.col("aim_span")))
    best = seen.groupBy("vid").agg(F.min_by(F.struct("level", "span"), order).alias("b"))
    return best.select("vid", F.col("b.level").cast("long").alias("level"), F.col("b.span").cast("long").alias("span"))


def layered(pixels: DataFrame) -> DataFrame:
    """What is seen of layers (layer, x, y, c, v) painted over one another: the highest at each place."""
    return pixels.groupBy("x", "y", "c").agg(F.max_by("v", "layer").alias("v"))
