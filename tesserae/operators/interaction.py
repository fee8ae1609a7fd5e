"""Taps, draw modes, drafts and selections as event logs.

A log's rows have a session and a seq that orders them. Modes are none, point, rectangle,
polyline and polygon; points are level-0 pixels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserae.functions import annotations as A
from tesserae.operators.folds import fold

#: Screen pixels within which a tap hits an outline.
TOLERANCE = 12.0
LEAST_VERTICES = {"polyline": 2, "polygon": 3}
SHAPE = "session string, seq bigint, id string, type string, points array<struct<x:double,y:double>>"


def with_mode(log: DataFrame) -> DataFrame:
    """The log (session, seq, op, mode, ...) with current, the mode each row finds: the last one set before it, or none."""
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    set_to = F.when(F.col("op") == "mode", F.col("mode"))
    return log.withColumn("current", F.coalesce(F.last(set_to, ignorenulls=True).over(before), F.lit("none")))


def dispatched(taps: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """What taps (session, seq, x, y, scale, ox, oy, current) do, in level-0 pixels: (session, seq, action, px, py, tolerance).

    A tap commits a point, adds a vertex, or without a mode asks what is hit; in the rectangle
    mode it does nothing.
    """
    action = F.when(F.col("current") == "point", "commit_point").when(F.col("current").isin(*LEAST_VERTICES), "add_vertex").when(F.col("current") == "none", "hit_test")
    at = lambda screen, origin: F.col(origin) + F.col(screen) / F.col("scale")
    return taps.withColumn("action", action).where("action is not null").select("session", "seq", "action", at("x", "ox").alias("px"), at("y", "oy").alias("py"), (F.lit(tolerance) / F.col("scale")).alias("tolerance"))


def hits(probes: DataFrame, shapes: DataFrame, cell: float, most_tolerance: float) -> DataFrame:
    """Pairs of probes (slide, probe, px, py, tolerance) and shapes (slide, ord, id, type, points, filled) that they hit.

    An equi-join on the cells of a grid: a shape stands in all cells that its bounding box, grown
    by the largest tolerance, meets; a probe in one.
    """
    at = lambda v: F.floor(v / cell)
    reach = F.lit(float(most_tolerance))
    box = shapes.withColumn("box", A.bounding_box(F.col("points")))
    span = lambda lo, hi: F.explode(F.sequence(at(F.col(f"box.{lo}") - reach), at(F.col(f"box.{hi}") + reach)))
    dealt = box.withColumn("gx", span("left", "right")).withColumn("gy", span("top", "bottom"))
    met = probes.withColumn("gx", at(F.col("px"))).withColumn("gy", at(F.col("py"))).join(dealt, ["slide", "gx", "gy"])
    t = F.col("tolerance")
    near = F.col("px").between(F.col("box.left") - t, F.col("box.right") + t) & F.col("py").between(F.col("box.top") - t, F.col("box.bottom") + t)
    return met.where(near).where(A.hit(F.col("type"), F.col("points"), F.col("filled"), F.col("px"), F.col("py"), t)).drop("gx", "gy", "box")


def tallied(probes: DataFrame, shapes: DataFrame, cell: float, most_tolerance: float) -> DataFrame:
    """(probe, n, id) of the probes that hit anything: how many shapes, and the id of the last added of them.

    Columns as for hits(), whose pairs are never listed by row: taps of one place and tolerance are
    one, and so are the equal shapes of a slide, with their number and last id. Pairs that remain
    are those of taps and shapes that differ.
    """
    place = ["slide", "px", "py", "tolerance"]
    last = F.max_by("id", "ord").alias("id"), F.max("ord").alias("ord")
    kinds = shapes.groupBy("slide", "type", "points", "filled").agg(F.count(F.lit(1)).alias("n"), *last)
    met = hits(probes.select(*place).distinct(), kinds, cell, most_tolerance).groupBy(*place).agg(F.sum("n").alias("n"), *last)
    return probes.join(met, place).groupBy("probe").agg(F.sum("n").alias("n"), last[0])


def selection(log: DataFrame, live: DataFrame) -> DataFrame:
    """(session, selected_id, selected) after a log (session, seq, op, id) of selects; a null id clears.

    live: (session, id, payload) of the annotations that exist; selected is null where the id no
    longer does, though it stays selected.
    """
    last = log.where("op = 'select'").groupBy("session").agg(F.max_by("id", "seq").alias("selected_id"))
    there = live.select("session", F.col("id").alias("selected_id"), F.col("payload").alias("selected"))
    return last.join(there, ["session", "selected_id"], "left")


def copy_with(old: dict[str, Column], new: dict[str, Column]) -> list[Column]:
    """old's fields replaced by new's where those are not null, so a label cannot be cleared; id and type stay."""
    return [(F.coalesce(new[name], value) if name in new and name not in ("id", "type") else value).alias(name) for name, value in old.items()]


def annotation_id(*key: Column) -> Column:
    """An id that is the same whenever the row is computed again: retried tasks must not make new ones."""
    return F.concat_ws("-", F.lower(F.hex(F.xxhash64(*key))), *(k.cast("string") for k in key))


@dataclass
class Drafts:
    """A session's draw mode and draft; handle() gives the shape that an event commits."""

    mode: str = "none"
    kind: str | None = None
    points: list[tuple[float, float]] = field(default_factory=list)

    def drop(self) -> None:
        self.kind, self.points = None, []

    def handle(self, op: str, mode: str | None, x: float, y: float) -> tuple[str, list[tuple[float, float]]] | None:
        """op: mode, tap, start, move, end (of a drag), finish or cancel."""
        if op == "mode" and mode != self.mode:
            self.drop()
            self.mode = mode or "none"
        elif op == "cancel":
            self.drop()
        elif op == "tap" and self.mode == "point":
            return "point", [(x, y)]
        elif op == "tap" and self.mode in LEAST_VERTICES:
            self.kind = self.mode
            self.points = [*self.points, (x, y)]
        elif op == "start" and self.mode == "rectangle":
            self.kind, self.points = "rectangle", [(x, y), (x, y)]
        elif op == "move" and self.kind == "rectangle":
            self.points = [self.points[0], (x, y)]
        elif op == "end" and self.kind == "rectangle":
            done = self.points
            self.drop()
            return ("rectangle", done) if done[0] != done[1] else None
        elif op == "finish" and len(self.points) >= LEAST_VERTICES.get(self.kind or "", 1 << 30):
            done = self.kind, self.points
            self.drop()
            return done
        return None


def drawn(log: DataFrame) -> DataFrame:
    """SHAPE: what each session's log (session, seq, op, mode, x, y) commits, with the seq of the committing event.

    Whether a finish commits depends on all events since the last commit, so a session's events
    fold one after the other.
    """

    def handle(drafts: Drafts, e) -> list[tuple]:
        shape = drafts.handle(e.op, e.mode, e.x, e.y)
        return [(e.session, e.seq, shape[0], [x for x, _ in shape[1]], [y for _, y in shape[1]])] if shape else []

    rows = fold(log.select("session", "seq", "op", "mode", "x", "y"), "session", "seq", Drafts, handle, "session string, seq bigint, type string, xs array<double>, ys array<double>")
    points = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p["xs"].alias("x"), p["ys"].alias("y")))
    return rows.select("session", "seq", annotation_id(F.col("session"), F.col("seq")).alias("id"), "type", points.alias("points"))
