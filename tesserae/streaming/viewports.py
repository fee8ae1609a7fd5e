"""Viewport events as streams: debounce, tile requests, cached tiles and edits.

State is kept by session with applyInPandasWithState; requests and edits of a micro-batch are
planned by the batch operators, in foreachBatch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.operators import viewport
from tesserae.operators.cache import Lru

#: How late events may come.
LATENESS = "10 seconds"
QUIET_MS = 80
#: A memory warning halves the budget and stops prefetching for so long.
PRESSURE_MS = 30_000

EVENT = "session string, ts timestamp, w double, h double, scale double, ox double, oy double, flush boolean"


def settle(rows: pd.DataFrame, pending: tuple | None, quiet_ms: int = QUIET_MS) -> tuple[list[tuple], tuple | None]:
    """Events that stand after a burst, in event time, and the one that still waits.

    An event waits until none follows within quiet_ms; a flush goes through at once and drops
    what waits.
    """
    out = []
    for e in rows.sort_values("ts", kind="stable").itertuples(index=False):
        if pending is not None and not e.flush and (e.ts - pending[1]).total_seconds() * 1000 >= quiet_ms:
            out.append(pending)
        if e.flush:
            out.append(tuple(e))
            pending = None
        else:
            pending = tuple(e)
    return out, pending


def debounced(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """The last event of each burst of a session, and all flushes."""
    columns = [c.split()[0] for c in EVENT.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = pickle.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([pending], columns=columns)
            return
        out, pending = settle(pd.concat(list(batches)), pending, quiet_ms)
        if pending is None:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(pending),))
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(out, columns=columns)

    return events.groupBy("session").applyInPandasWithState(run, EVENT, "pending binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


CACHED = "session string, seq bigint, hit boolean, stored boolean, evicted bigint, bytes bigint"
RESULT = "session string, seq bigint, ts timestamp, op string, level int, tx int, ty int, span int, reduction int, byte_size bigint, wanted boolean"
#: A session without an event for so long is forgotten.
IDLE_MS = 3_600_000


class Replay:
    """A session's cache under events in order."""

    def __init__(self, max_bytes: int, pressure_ms: int):
        self.max_bytes, self.pressure_ms = max_bytes, pressure_ms
        self.lru, self.pressed_at = Lru(max_bytes), None

    def handle(self, e) -> tuple[bool, bool, int, int]:
        """(hit, stored, evicted, bytes) of an event.

        A memory warning drops the queue and clears the cache; from then on, for pressure_ms of
        event time, the budget is halved.
        """
        if self.pressed_at is not None and (e.ts - self.pressed_at).total_seconds() * 1000 >= self.pressure_ms:
            self.pressed_at = None
            self.lru.shrink_to(self.max_bytes)
        tile, hit, stored, evicted = (e.level, e.tx, e.ty, e.span), False, False, 0
        if e.op == "get":
            hit = self.lru.get(tile)
        elif e.op == "put":
            stored, evicted = True, len(self.lru.put(tile, e.byte_size, e.reduction))
        elif e.op == "late":
            gone = self.lru.offer(tile, e.byte_size, e.reduction, bool(e.wanted))
            stored, evicted = gone is not None, len(gone or ())
        elif e.op == "pressure":
            self.pressed_at, evicted = e.ts, len(self.lru.entries)
            self.lru.clear()
            self.lru.shrink_to(self.max_bytes // 2)
        return hit, stored, evicted, self.lru.bytes


def cached(results: DataFrame, max_bytes: int, pressure_ms: int = PRESSURE_MS, lateness: str = LATENESS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Replays gets, puts, late results (op late) and memory warnings (op pressure) per session.

    A late result of a tile that is no longer wanted is stored only where nothing is evicted for
    it. Sessions end idle_ms after their last event, by the watermark, so state does not grow with
    all sessions there ever were.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        replay = pickle.loads(state.get[0]) if state.exists else Replay(max_bytes, pressure_ms)
        events = pd.concat(list(batches)).sort_values("seq")
        rows = [(key[0], e.seq, *replay.handle(e)) for e in events.itertuples()]
        state.update((pickle.dumps(replay),))
        end = int(events["ts"].max().timestamp() * 1000) + idle_ms
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CACHED.split(", ")])

    return results.withWatermark("ts", lateness).groupBy("session").applyInPandasWithState(run, CACHED, "cache binary", "append", GroupStateTimeout.EventTimeTimeout)


def under_pressure(events: DataFrame, pressure_ms: int = PRESSURE_MS) -> DataFrame:
    """events (session, ts, op, ...) with pressed: whether a memory warning came within pressure_ms before."""
    before = Window.partitionBy("session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("op") == "pressure", F.col("ts"))).over(before)
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(last.cast("timestamp"))
    return events.withColumn("pressed", F.coalesce(ms < pressure_ms, F.lit(False)))


def request_writer(levels: list[dict], cache_bytes: int, write: Callable[[DataFrame, int], None], pressured: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that plans the tiles of each session's last viewport; a new plan replaces the old."""

    def run(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("session").agg({"ts": "max"}).withColumnRenamed("max(ts)", "ts")
        latest = batch.join(last, ["session", "ts"]).withColumnRenamed("session", "vid").select("vid", "w", "h", "scale", "ox", "oy")
        write(viewport.wanted(viewport.plan(latest, levels), cache_bytes, pressured=pressured), batch_id)

    return run
