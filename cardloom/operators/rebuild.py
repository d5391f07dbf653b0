"""Derived tables kept by bucket of uid: after a change only the buckets that it touches are written again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.sources.shared import written

MANIFEST = ("uid", "rel_path", "slug", "mtime", "size", "content_hash", "version")


@dataclass(frozen=True)
class Derived:
    """``folder`` holds a manifest and the tables of ``rules``, each by bucket.

    A rule makes a table, with a uid a row, of cards and of all cards' slugs:
    ``rule(cards, slugs)``. A card's rows may depend on itself and on which
    slugs exist (uid, slug), on nothing else.
    """

    spark: SparkSession
    folder: str
    rules: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]
    buckets: int = 64

    def bucket(self, uid: Column) -> Column:
        return F.pmod(F.xxhash64(uid), F.lit(self.buckets)).cast("int")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}").drop("bucket")

    def _write(self, rows: DataFrame, name: str) -> None:
        """The rows' buckets in place of what they held; the files of other buckets stay. A bucket spans several tasks if its rows are many."""
        placed = rows.withColumn("bucket", self.bucket(F.col("uid")))
        placed.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "uid").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def _emptied(self, name: str, touched: list[int], rows: DataFrame) -> None:
        """Remove the folders of touched buckets that have no rows any more: an overwrite only knows buckets with rows."""
        left = {r[0] for r in rows.select(self.bucket(F.col("uid"))).distinct().collect()}  # no more than buckets
        for b in set(touched) - left:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/bucket={b}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def build(self, cards: DataFrame) -> None:
        """All tables from ``cards``, which have the columns of :data:`MANIFEST` besides their own."""
        slugs = cards.select("uid", "slug")
        for name, rule in self.rules.items():
            self._write(rule(cards, slugs), name)
        self._write(cards.select(*MANIFEST), "manifest")

    def delta(self, cards: DataFrame, references: DataFrame) -> DataFrame:
        """(uid, state): new, changed, deleted or escalated cards since the last build; unchanged ones have no row.

        A card is changed if its content, path, slug or rule version is; a file
        whose time and size are as before counts as unchanged without its
        hash. Escalated are cards that refer (``references``: uid, slug) to a
        slug that came, went or passed to another card.
        """
        old = self.table("manifest").select("uid", *(F.col(c).alias(f"_{c}") for c in MANIFEST[1:]))
        both = cards.select(*MANIFEST).withColumn("_now", F.lit(True)).join(old.withColumn("_then", F.lit(True)), "uid", "full_outer")
        differs = lambda *names: ~F.array_min(F.array(*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names)))
        changed = differs("rel_path", "slug", "version") | (differs("mtime", "size") & differs("content_hash"))
        state = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(changed, "changed")
        own = written(both.select("uid", state.alias("state"), "slug", "_slug").filter("state is not null"), "delta")
        moved = own.filter("not (slug <=> _slug)").select(F.explode(F.array_compact(F.array("slug", "_slug"))).alias("slug")).distinct()
        escalated = references.join(moved, "slug").select("uid").distinct().join(own, "uid", "left_anti").withColumn("state", F.lit("escalated"))
        return own.select("uid", "state").unionByName(escalated)

    def update(self, cards: DataFrame, references: DataFrame) -> list[int]:
        """The tables as a full build of ``cards`` would leave them; the buckets that were written.

        Cards of the touched buckets alone are derived again, from ``cards``.
        A run that ends early can be run again: the manifest is written last.
        """
        touched = sorted(r[0] for r in self.delta(cards, references).select(self.bucket(F.col("uid")).alias("b")).distinct().collect())  # no more than buckets
        if not touched:
            return []
        some, slugs = cards.filter(self.bucket(F.col("uid")).isin(touched)), cards.select("uid", "slug")
        for name, rows in [(name, rule(some, slugs)) for name, rule in self.rules.items()] + [("manifest", some.select(*MANIFEST))]:
            rows = written(rows, "rebuilt")
            self._write(rows, name)
            self._emptied(name, touched, rows)
        return touched
