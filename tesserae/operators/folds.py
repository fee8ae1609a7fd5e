"""Ordered folds: state that passes from one event of a group to the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(events: DataFrame, by: str, order: str, new: Callable[[], object], handle: Callable[[object, tuple], list[tuple]], schema: str) -> DataFrame:
    """The rows that handle(state, event) gives for each group's events in order, from a new() state.

    Groups are dealt to partitions and sorted there, so a task holds one group's state and one
    batch of events, however long a group is or however many there are.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            rows: list[tuple] = []
            for e in batch.itertuples(index=False):
                own = getattr(e, by)
                if state is None or own != key:
                    key, state = own, new()
                rows += handle(state, e)
            yield pd.DataFrame(rows, columns=names)

    return events.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, schema)
