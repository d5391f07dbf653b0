"""Places of rows within groups of any size, and digests of ordered groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.sources.shared import written


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, their place from 0 by ``order`` within ``by``; rows equal in both are placed one after the other.

    Rows are sorted by range, so that a group of a third of all rows spans as
    many tasks as it needs; a row's place is its rank among all rows less that
    of its group's first, which a small table by group tells.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = written(rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sorted_rows.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a partition
    numbered = sorted_rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return _with_group(numbered, by, F.min("_rank").alias("_first")).withColumn(name, F.col("_rank") - F.col("_first")).drop("_at", "_part", "_start", "_rank", "_first")


def _with_group(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """``rows`` with an aggregate of their group; null is a group like any other."""
    told = rows.groupBy(*by).agg(value)
    told = told.select(told.columns[-1], *(F.col(b).alias(f"_g{i}") for i, b in enumerate(by)))
    return rows.join(told, [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]).drop(*(f"_g{i}" for i in range(len(by))))


def folded_digests(rows: DataFrame, by: list[str], digest: Column, order: list[str], width: int = 256) -> DataFrame:
    """``by`` and ``digest``: one SHA-256 for the ordered digests of each group.

    Blocks of ``width`` digests, joined by line ends, give a digest each,
    blocks of these again, until each group has one: no row holds more than
    ``width`` digests, however many a group has, and each level has a
    ``width``-th of the rows of the one before.
    """
    level, done = ranked(rows.select(*by, *(o for o in order if o not in by), digest.alias("digest")), by, order), None
    while True:
        held = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        blocks = level.groupBy(*by, F.floor(F.col("place") / width).alias("block")).agg(F.sha2(F.array_join(held, "\n"), 256).alias("digest"))
        level = written(blocks.withColumnRenamed("block", "place"), "digests")
        both = _with_group(level, by, F.max("place").alias("_last"))
        now = both.filter("_last = 0").select(*by, "digest")
        done, level = now if done is None else done.unionByName(now), both.filter("_last > 0").drop("_last")
        if level.isEmpty():
            return done
