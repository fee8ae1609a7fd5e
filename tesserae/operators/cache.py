"""Tile-cache policy: evictions by window sums, and traces by an ordered fold."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, Window, functions as F

from tesserae.operators.folds import fold


def evictions(entries: DataFrame, max_bytes: int, reserve: int, by: str) -> DataFrame:
    """The entries (by, seq, size) to evict, oldest first, until the sizes and the reserve fit.

    With a reserve above max_bytes everything goes.
    """
    before = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    over = F.sum("size").over(whole) - F.coalesce(F.sum("size").over(before), F.lit(0)) + reserve > max_bytes
    return entries.withColumn("evict", over).where("evict").drop("evict")


class Lru:
    """A byte-budget LRU of tiles."""

    def __init__(self, max_bytes: int):
        self.max_bytes, self.bytes = max_bytes, 0
        self.entries: OrderedDict[tuple, tuple[int, int]] = OrderedDict()

    def get(self, key: tuple) -> bool:
        if key not in self.entries:
            return False
        self.entries.move_to_end(key)
        return True

    def reduction_of(self, key: tuple) -> int | None:
        return self.entries[key][1] if key in self.entries else None

    def put(self, key: tuple, size: int, reduction: int = 0) -> list[tuple]:
        """Stores a tile; returns the keys evicted for it."""
        if key in self.entries:
            self.bytes -= self.entries.pop(key)[0]
        gone = []
        while self.entries and self.bytes + size > self.max_bytes:
            old, (n, _) = self.entries.popitem(last=False)
            self.bytes -= n
            gone.append(old)
        self.entries[key] = (size, reduction)
        self.bytes += size
        return gone

    def admit(self, key: tuple, size: int, reduction: int, wanted: bool) -> bool:
        """Whether a late result is stored: an unwanted one only where nothing is evicted, none over a sharper copy."""
        return self.offer(key, size, reduction, wanted) is not None

    def offer(self, key: tuple, size: int, reduction: int, wanted: bool) -> list[tuple] | None:
        """admit(), but the keys evicted for the tile; None if it is not stored."""
        have = self.reduction_of(key)
        if have is not None and have < reduction or not wanted and self.bytes + size > self.max_bytes:
            return None
        return self.put(key, size, reduction)

    def visit_range(self, level: int, span: int, x0: int, x1: int, y0: int, y1: int) -> list[tuple]:
        """The keys in a range, which become the most recent, in the order of the smaller of range and cache."""
        if (x1 - x0 + 1) * (y1 - y0 + 1) < len(self.entries):
            hits = [k for y in range(y0, y1 + 1) for x in range(x0, x1 + 1) if (k := (level, x, y, span)) in self.entries]
        else:
            hits = [k for k in self.entries if k[0] == level and k[3] == span and x0 <= k[1] <= x1 and y0 <= k[2] <= y1]
        for k in hits:
            self.entries.move_to_end(k)
        return hits

    def shrink_to(self, max_bytes: int) -> list[tuple]:
        """Sets the budget; the keys evicted for it."""
        self.max_bytes, gone = max_bytes, []
        while self.entries and self.bytes > max_bytes:
            old, (n, _) = self.entries.popitem(last=False)
            self.bytes -= n
            gone.append(old)
        return gone

    def count_in_range(self, level: int, span: int, x0: int, x1: int, y0: int, y1: int) -> int:
        return sum(k[0] == level and k[3] == span and x0 <= k[1] <= x1 and y0 <= k[2] <= y1 for k in self.entries)

    def groups(self) -> set[tuple[int, int]]:
        return {(k[0], k[3]) for k in self.entries}

    def clear(self) -> None:
        self.entries.clear()
        self.bytes = 0


TRACE = "session string, seq bigint, op string, hit boolean, evicted bigint, bytes bigint, tiles bigint"


def trace(events: DataFrame, max_bytes: int) -> DataFrame:
    """Replays cache events (session, seq, op get or put, level, tx, ty, span, byte_size) per session, in order.

    A session's events fold one after the other, in batches: a long session needs no more memory.
    """

    def handle(lru: Lru, e) -> list[tuple]:
        key = (e.level, e.tx, e.ty, e.span)
        hit, gone = (lru.get(key), []) if e.op == "get" else (key in lru.entries, lru.put(key, e.byte_size))
        return [(e.session, e.seq, e.op, hit, len(gone), lru.bytes, len(lru.entries))]

    return fold(events, "session", "seq", lambda: Lru(max_bytes), handle, TRACE)


def admitted(results: DataFrame, budgets: DataFrame, cached: DataFrame) -> DataFrame:
    """What becomes of results (session, seq, level, tx, ty, span, reduction, byte_size, wanted, wanted_reduction, priority, from_disk).

    budgets: (session, used, max_bytes); cached: (session, level, tx, ty, span, reduction). A
    result is stored unless the viewport stopped wanting it and it would evict something, or a
    sharper copy is cached; a stored and wanted one that is blurrier than now wanted is fetched
    again, and one of a single tile at full resolution on the screen, not from disk, is persisted.
    """
    key = ["session", "level", "tx", "ty", "span"]
    have = cached.groupBy(*key).agg(F.min("reduction").alias("have"))
    r = results.join(budgets, "session").join(have, key, "left")
    stored = (F.col("wanted") | (F.col("used") + F.col("byte_size") <= F.col("max_bytes"))) & F.coalesce(F.col("have") >= F.col("reduction"), F.lit(True))
    r = r.withColumn("stored", stored)
    kept = F.col("stored") & F.col("wanted")
    persist = kept & ~F.col("from_disk") & (F.col("reduction") == 0) & (F.col("span") == 0) & (F.col("priority") == "visible")
    return r.withColumn("fetch_again", kept & (F.col("reduction") > F.col("wanted_reduction"))).withColumn("persist", persist).drop("used", "max_bytes", "have")


#: Tiles that may wait to be written to the disk cache; more are left out.
BACKLOG = 8


def persist_queue(stored: DataFrame, most: int = BACKLOG) -> DataFrame:
    """Of a batch's tiles to persist (session, seq, ...), the first `most` of each session, numbered in the order of writing."""
    order = Window.partitionBy("session").orderBy("seq")
    return stored.where("persist").withColumn("turn", F.row_number().over(order).cast("long")).where(F.col("turn") <= most)


def count_in_range(entries: DataFrame, level: int, span: int, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    here = (F.col("level") == level) & (F.col("span") == span) & F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1)
    return entries.where(here).agg(F.count(F.lit(1)).alias("n"))


def cached_groups(entries: DataFrame) -> DataFrame:
    return entries.groupBy("level", "span").agg(F.count(F.lit(1)).alias("n"))
