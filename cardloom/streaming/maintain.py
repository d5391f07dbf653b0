"""Upkeep of a keyed table from a stream: each batch is written once, the latest row of a key is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``, then by its other columns; a partial aggregate, so hot keys do no harm."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__row"))
    return best.select(*keys, *(F.col("__row")[c].alias(c) for c in (*order, *rest))).select(*rows.columns)


def maintain(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Works off all that the stream has now and ends; what was done is in ``checkpoint``.

    A batch goes to its own folder, which it overwrites when it is run again,
    so a lost driver or executor doubles nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = latest(prepare(batch) if prepare else batch, keys, order)
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The table as of the last batch."""
    return latest(spark.read.parquet(path).drop("batch_id"), keys, order)


def compact(spark: SparkSession, path: str, target: str, keys: list[str], order: list[str]) -> None:
    """Writes the current table to ``target`` as its batch 0; run it while no stream writes."""
    current(spark, path, keys, order).write.mode("overwrite").parquet(f"{target}/batch_id=0")
