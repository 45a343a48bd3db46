"""Sliding-window rate limits over arrivals."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy


def recent_arrivals(events: DataFrame, key: str, ts: str, window_ms: int) -> DataFrame:
    """events with ``recent``: arrivals of the key within the window, its own included. Accepts nothing and refuses nothing."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(ms).rangeBetween(-(window_ms - 1), 0)
    return events.withColumn("recent", F.count("*").over(w))


class Recent:
    """A key's accepted times within the window: all that a limiter remembers, at most ``limit`` of them."""

    def __init__(self, limit: int, window_ms: int, times: list[int] | None = None):
        self.limit, self.window_ms, self.times = limit, window_ms, times or []

    def arrive(self, at: int) -> tuple[bool, int, int]:
        """Whether an arrival is accepted, how many more would be, and after how many milliseconds to try again."""
        self.times = [t for t in self.times if t > at - self.window_ms]
        if len(self.times) >= self.limit:
            return False, 0, max(0, self.window_ms - (at - self.times[0]))
        self.times.append(at)
        return True, self.limit - len(self.times), 0


def limited(events: DataFrame, key: str, ts: str, limit: int, window_ms: int, tie: str) -> DataFrame:
    """events' keys and ties with ``allowed``, ``remaining`` and ``retry_after_ms``, as a limiter decides them one after another.

    An arrival is accepted if fewer than ``limit`` accepted ones lie less than the window before it. Each partition is
    sorted and read once with one key's window at hand, so a key with very many arrivals needs no more memory than others.
    """
    kinds = dict(events.dtypes)
    timed = events.select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"), tie).repartition(key).sortWithinPartitions(key, "at_ms", tie)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window = None, Recent(limit, window_ms)
        for batch in batches:
            rows = []
            for k, at in zip(batch[key].tolist(), batch["at_ms"].tolist(), strict=True):
                if k != now and not (pd.isna(k) and pd.isna(now)):  # a null key is one key, though it may arrive as a number that equals none
                    now, window = k, Recent(limit, window_ms)
                rows.append(window.arrive(at))
            yield pd.concat([batch[[key, tie]].reset_index(drop=True), pd.DataFrame(rows, columns=["allowed", "remaining", "retry_after_ms"])], axis=1)

    return timed.mapInPandas(decide, f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean, remaining int, retry_after_ms long")


def limited_stream(events: DataFrame, key: str, ts: str, limit: int, window_ms: int) -> DataFrame:
    """The same decisions over a stream: a key's state is the times of its last accepted arrivals, at most ``limit``."""
    schema = f"{key} {dict(events.dtypes)[key]}, at_ms long, allowed boolean, remaining int, retry_after_ms long"

    def decide(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = Recent(limit, window_ms, list(state.get[0]) if state.exists else [])
        rows = [(keys[0], at, *window.arrive(at)) for at in sorted(int(t) for b in batches for t in b["at_ms"])]
        state.update((window.times,))
        yield pd.DataFrame(rows, columns=[key, "at_ms", "allowed", "remaining", "retry_after_ms"])

    timed = events.select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"))
    return timed.groupBy(key).applyInPandasWithState(decide, schema, "times array<long>", "append", "NoTimeout")
