"""Deltas against a manifest, watermarks, samples, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.ranks import folded_digests


def manifest_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, changed, unchanged or deleted, by rel_path and content_hash (nulls are equal to nulls)."""
    a, b = old.select("rel_path", F.col("content_hash").alias("h0"), F.lit(1).alias("in0")), new.select("rel_path", F.col("content_hash").alias("h1"), F.lit(1).alias("in1"))
    state = F.when(F.col("in0").isNull(), "new").when(F.col("in1").isNull(), "deleted").when(F.col("h0").eqNullSafe(F.col("h1")), "unchanged").otherwise("changed")
    return a.join(b, "rel_path", "full_outer").select("rel_path", state.alias("state"))


def referencing(changed: DataFrame, people: DataFrame) -> DataFrame:
    """Cards to rebuild because a person (person) that they name has changed."""
    return people.join(changed, "person", "left_semi").select("uid").distinct()


def log_tail(log: DataFrame, at: str, watermark: str) -> DataFrame:
    return log.filter(F.col(at) > F.lit(watermark).cast("timestamp_ntz"))


def stale(knowledge: DataFrame, log: DataFrame) -> DataFrame:
    """Stale if anything of a type it depends on came after its watermark; fresh if it depends on nothing."""
    last = log.groupBy("kind").agg(F.max("at").alias("last"))
    needs = knowledge.select("id", "watermark", F.explode_outer("depends_on").alias("kind")).join(last, "kind", "left")
    return needs.groupBy("id").agg(F.max(F.coalesce(F.col("last") > F.col("watermark"), F.lit(False))).alias("stale"))


def smallest_by_hash(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Of each group, the rows of the ``most`` smallest SHA-1 of the key: the same sample in every run."""
    order = Window.partitionBy(group).orderBy(F.sha1(F.col(key).cast("string")), key)
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")


def assemble_threads(messages: DataFrame, thread: str, turn: str, role: str, text: str) -> DataFrame:
    """A row per thread: how many messages, who speaks, and the digest of the messages' digests in order.

    Messages give their digests before they are brought together, and digests
    meet in blocks (:func:`~cardloom.operators.ranks.folded_digests`), so no
    row holds a long thread.
    """
    digest = F.sha2(F.concat(F.col(role), F.lit(": "), F.coalesce(F.col(text), F.lit(""))), 256)
    rows = messages.select(F.col(thread).alias("_thread"), turn, role, digest.alias("d"))
    told = rows.groupBy("_thread").agg(F.count("*").alias("n_messages"), F.array_join(F.array_sort(F.collect_set(role)), ",").alias("roles"))
    folded = folded_digests(rows, ["_thread"], F.col("d"), [turn, role, "d"]).select(F.col("_thread").alias("_t"), F.col("digest").alias("thread_sha"))
    return told.join(folded, F.col("_thread").eqNullSafe(F.col("_t"))).select(F.col("_thread").alias(thread), "n_messages", "roles", "thread_sha")


def purged(rows: DataFrame, gone: DataFrame, key: str = "uid") -> DataFrame:
    """A derived table without the rows of cards that are gone or rebuilt (uid)."""
    return rows.join(gone.select(F.col("uid").alias(key)).distinct(), key, "left_anti")


def purged_edges(edges: DataFrame, rebuilt: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges after cards were rebuilt or deleted: none that start at either, none that end at a deleted one; those that end at a rebuilt one stay."""
    gone = rebuilt.select("uid").unionByName(deleted.select("uid"))
    return purged(purged(edges, gone, "source_uid"), deleted, "target_uid")


def rebuild_mode(delta: DataFrame, people_changed: DataFrame, most: int = 5_000) -> DataFrame:
    """One row: mode (noop, full, person_triggered or incremental) and how many cards changed, by the delta and the cards that changed persons touch."""
    n = delta.agg(F.count(F.when(F.col("state") != "unchanged", 1)).alias("changed")).join(people_changed.agg(F.count("*").alias("touched")))  # a row each
    mode = F.when((F.col("changed") == 0) & (F.col("touched") == 0), "noop").when(F.col("touched") > most, "full").when(F.col("touched") > 0, "person_triggered").otherwise("incremental")
    return n.withColumn("mode", mode)


def advanced_cursors(cursors: DataFrame, fetched: DataFrame) -> DataFrame:
    """(source, position) after a fetch (source, position): the furthest that each source has come; sources never go back."""
    return cursors.select("source", "position").unionByName(fetched.select("source", "position")).groupBy("source").agg(F.max("position").alias("position"))


def unseen(items: DataFrame, cursors: DataFrame) -> DataFrame:
    """The items (source, position, ...) after their source's cursor; all of a source without one."""
    known = cursors.select("source", F.col("position").alias("_at"))
    return items.join(known, "source", "left").filter("_at is null or position > _at").drop("_at")


def tumbling(events: DataFrame, at: str, every: str, by: str, slide: str | None = None) -> DataFrame:
    """Events per window (tumbling, or sliding by ``slide``) and group: n. Works on streams too, with a watermark."""
    return events.groupBy(F.window(at, every, slide or every).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(events: DataFrame, at: str, gap: str, by: str) -> DataFrame:
    """Runs of a group's events with no gap of ``gap`` or more between them: start, end, n."""
    return events.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
