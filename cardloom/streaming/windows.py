"""Windows, sessions, deduplication and newest versions of a stream with late, repeated and out-of-order rows.

Each function takes a batch or a stream. State is bounded by the watermark:
rows later than ``delay`` after the newest one seen are left out, all others
give what a batch over the same rows gives, also after a restart from the
checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key; a key is remembered for ``delay`` after its row's time, for as long as a repeat may come."""
    if not rows.isStreaming:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def _grouped(rows: DataFrame, window: Column, by: list[str], at: str, delay: str, totals: dict[str, Column]) -> DataFrame:
    rows = rows.withWatermark(at, delay) if rows.isStreaming and delay else rows  # without a delay the stream's own watermark holds
    told = rows.groupBy(window.alias("w"), *by).agg(*(c.alias(name) for name, c in totals.items()))
    return told.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *totals)


def tumbling(rows: DataFrame, at: str, width: str, by: list[str], totals: dict[str, Column], delay: str = "", slide: str | None = None) -> DataFrame:
    """(start, end, by, totals) of windows of ``width``, every ``slide`` (by default one after the other); totals are named aggregates."""
    return _grouped(rows, F.window(at, width, slide), by, at, delay, totals)


def sessions(rows: DataFrame, at: str, gap: str, by: list[str], totals: dict[str, Column], delay: str = "") -> DataFrame:
    """(start, end, by, totals) of stretches without a pause of ``gap``; a late row may join two of them."""
    return _grouped(rows, F.session_window(at, gap), by, at, delay, totals)


def newest(rows: DataFrame, key: str, order: str, at: str, delay: str) -> DataFrame:
    """Each key's rows that were, when they came, greater by ``order`` than all before (ties: none but the first).

    The state of a key is one value, kept until ``delay`` has passed since
    its last row's time; a repeat or an older version gives nothing. The last
    row for a key is its newest version.
    """
    shape = rows.schema
    state = T.StructType([T.StructField("best", shape[order].dataType)])

    def step(key_: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        best, last, seen = (held.get[0] if held.exists else None), None, held.getCurrentWatermarkMs()
        for part in parts:
            seen = max(seen, int(part[at].max().timestamp() * 1_000))
            new = part.sort_values(order, kind="stable")
            new = new if best is None else new[new[order] > best]
            if len(new):
                last, best = new.tail(1), new[order].iloc[-1].item() if hasattr(new[order].iloc[-1], "item") else new[order].iloc[-1]
        held.update((best,))
        held.setTimeoutTimestamp(seen + _millis(delay))
        if last is not None:
            yield last

    return rows.withWatermark(at, delay).groupBy(key).applyInPandasWithState(step, shape, state, "update", GroupStateTimeout.EventTimeTimeout)


def _millis(delay: str) -> int:
    number, unit = delay.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}[unit.rstrip("s")] * 1_000
