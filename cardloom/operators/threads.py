"""Conversations in overlapping windows, and how well typed cards are filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(messages: DataFrame, thread: str, position: str, size: int = 800, overlap: int = 50) -> DataFrame:
    """Each message once for each window (from 0) of its thread that holds it; the first window to reach the end is the last.

    ``position`` counts a thread's messages from 0. A long thread isn't
    brought together: its length comes from a partial aggregate, a message
    works out its own windows. Rows of a null thread or position are left out.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    step = size - overlap
    known = messages.filter(F.col(thread).isNotNull() & F.col(position).isNotNull())
    ends = known.groupBy(thread).agg((F.max(position) + 1).alias("__n"))
    first = F.greatest(F.lit(0), F.ceil((F.col(position) - size + 1) / step))
    last = F.least(F.floor(F.col(position) / step), F.greatest(F.lit(0), F.ceil((F.col("__n") - size) / step)))
    held = known.join(ends, thread).withColumns({"__first": first, "__last": last}).filter("__first <= __last")
    return held.withColumn("window", F.explode(F.sequence("__first", "__last"))).drop("__n", "__first", "__last")


def filled(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))


def field_population(cards: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """``by``, field, and the share of its cards in which the field is filled, to four digits."""
    shares = cards.groupBy(by).agg(*(F.round(F.avg(F.when(filled(F.col(f)), 1.0).otherwise(0.0)), 4).alias(f) for f in fields))
    return shares.unpivot(by, fields, "field", "populated")


def extraction_confidence(critical: list[Column]) -> Column:
    """Share of the critical fields that are filled, to two digits; 1 for a type without any."""
    return F.round(sum((F.when(filled(c), 1.0).otherwise(0.0) for c in critical), F.lit(0.0)) / len(critical), 2) if critical else F.lit(1.0)
