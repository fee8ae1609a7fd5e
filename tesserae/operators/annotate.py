"""Annotation tables: edit logs, hit tests and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def fold_edits(edits: DataFrame) -> DataFrame:
    """The state after a log (slide_id, seq, op add | update | remove | clear, id, payload).

    Updates keep the place of the add; updates of unknown ids and edits before the last clear do
    nothing; an id that was removed and added again takes its new place.
    """
    cleared = edits.where("op = 'clear'").groupBy("slide_id").agg(F.max("seq").alias("cleared"))
    live = edits.where("op <> 'clear'").join(cleared, "slide_id", "left").where("cleared is null or seq > cleared")
    births = Window.partitionBy("slide_id", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    live = live.withColumn("removed", F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(Window.partitionBy("slide_id", "id")))
    live = live.where("op <> 'remove' and (removed is null or seq > removed)")
    live = live.withColumn("born", F.min(F.when(F.col("op") == "add", F.col("seq"))).over(births)).where("born is not null")
    return live.groupBy("slide_id", "id").agg(F.min("born").alias("ord"), F.max_by("payload", "seq").alias("payload"))


def topmost(hits: DataFrame) -> DataFrame:
    """Of hits (probe, ord, id), the last added annotation of each probe."""
    return hits.groupBy("probe").agg(F.max_by("id", "ord").alias("id"))


def finished_paths(vertices: DataFrame, least: int) -> DataFrame:
    """Draft vertices (draft, seq, x, y) as paths; drafts with fewer than least vertices are dropped."""
    p = vertices.groupBy("draft").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("points"))
    return p.where(F.size("points") >= least)


def rectangle_drafts(drags: DataFrame) -> DataFrame:
    """Rectangles (draft, points) of drags (draft, seq, x, y): from the first to the last point; without extent, none."""
    at = lambda f: f(F.struct("x", "y"), "seq")
    d = drags.groupBy("draft").agg(at(F.min_by).alias("a"), at(F.max_by).alias("b"))
    return d.where((F.col("a.x") != F.col("b.x")) | (F.col("a.y") != F.col("b.y"))).select("draft", F.array("a", "b").alias("points"))


def taps(pointers: DataFrame, slop: float = 18.0) -> DataFrame:
    """Taps (session, gesture, seq, x, y) of pointer events (session, seq, pointer, op down | move | up, x, y).

    A gesture lasts from the first pointer down to the last one up. It is a tap if a single
    pointer took part and never moved beyond the slop.
    """
    order = Window.partitionBy("session").orderBy("seq")
    step = F.when(F.col("op") == "down", 1).when(F.col("op") == "up", -1).otherwise(0)
    e = pointers.withColumn("down", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("begins", ((F.col("op") == "down") & (F.col("down") == 1)).cast("int"))
    e = e.withColumn("gesture", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min_by(F.struct("x", "y"), "seq").over(Window.partitionBy("session", "gesture"))
    far = F.sqrt((F.col("x") - F.col("start.x")) ** 2 + (F.col("y") - F.col("start.y")) ** 2) > slop
    e = e.withColumn("start", start).withColumn("moved", (F.col("op") == "move") & far)
    g = e.groupBy("session", "gesture").agg(F.max("moved").alias("moved"), F.max("down").alias("most"), F.min_by("down", -F.col("seq")).alias("left"), F.max_by(F.struct("seq", "op", "x", "y"), "seq").alias("last"))
    return g.where("gesture > 0 and not moved and most = 1 and left = 0 and last.op = 'up'").select("session", "gesture", "last.seq", "last.x", "last.y")
