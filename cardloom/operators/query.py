"""Structured queries over cards: filters, timeline, temporal neighbours, statistics, duplicates, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_bounds(start: str | None, end: str | None) -> tuple[str | None, str | None]:
    """Timestamps of an inclusive range; a bare date means its first or last microsecond."""
    bare = lambda s: s is not None and len(s) == 10
    return (f"{start} 00:00:00" if bare(start) else start), (f"{end} 23:59:59.999999" if bare(end) else end)


def filter_cards(
    cards: DataFrame, type: str | None = None, source: str | None = None, people: DataFrame | None = None, person: str | None = None,
    orgs: DataFrame | None = None, org: str | None = None, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """The conjunction of the given filters; bridge tables (uid, person / org) as semi joins."""
    start, end = day_bounds(start, end)
    for given, test in ((type, F.col("type") == type), (source, F.col("source") == source)):
        cards = cards.filter(test) if given else cards
    cards = cards.filter(F.col("activity_at") >= F.lit(start).cast("timestamp_ntz")) if start else cards
    cards = cards.filter(F.col("activity_at") <= F.lit(end).cast("timestamp_ntz")) if end else cards
    cards = cards.join(people.filter(F.col("person") == person), "uid", "left_semi") if person else cards
    return cards.join(orgs.filter(F.col("org") == org), "uid", "left_semi") if org else cards


def query_cards(cards: DataFrame, limit: int, **filters) -> DataFrame:
    """Newest first, cards without a date before all others, then by path."""
    found = filter_cards(cards, **filters).select("rel_path", "summary", "type", "activity_at")
    return found.orderBy(F.col("activity_at").desc_nulls_first(), "rel_path").limit(limit)


def timeline(cards: DataFrame, start: str | None, end: str | None, limit: int) -> DataFrame:
    return filter_cards(cards, start=start, end=end).select("rel_path", "type", "activity_at").orderBy(F.col("activity_at").asc_nulls_last(), "rel_path").limit(limit)


def temporal_neighbors(cards: DataFrame, at: str, limit: int, direction: str = "both") -> DataFrame:
    """Cards around a moment, in up to three legs of ``limit`` rows.

    forward: from the moment on, oldest first; backward: up to it, newest
    first; during: intervals that hold it, always asked. A card of several
    legs counts for the first of them. All are then put in ascending order
    and cut to ``limit``, so old rows may crowd out later ones.
    """
    moment = F.lit(at).cast("timestamp_ntz")
    a, e = F.col("activity_at"), F.col("activity_end_at")
    legs = []
    if direction in ("forward", "both"):
        legs.append((0, "forward", a >= moment, a.asc()))
    if direction in ("backward", "both"):
        legs.append((1, "backward", a <= moment, a.desc()))
    legs.append((2, "during", (a <= moment) & (e.isNull() | (e >= moment)), a.asc()))
    found = [
        cards.filter(test).orderBy(order, "uid").limit(limit).select("uid", "activity_at", F.lit(name).alias("leg"), F.lit(n).alias("n"))
        for n, name, test, order in legs
    ]
    first = F.row_number().over(Window.partitionBy("uid").orderBy("n"))
    rows = reduce(DataFrame.unionByName, found).withColumn("r", first).filter("r = 1")
    return rows.orderBy("activity_at", "uid").limit(limit).select("uid", "activity_at", "leg")


def stats(cards: DataFrame, column: str) -> DataFrame:
    return cards.groupBy(column).agg(F.count("*").alias("n"))


def duplicate_uids(rows: DataFrame) -> DataFrame:
    """Paths that lost their uid to another card: one without a hash at its end keeps it before others, then a shorter, then a smaller path.

    The winner and the group's size are aggregated before they are joined
    back, so that no task holds all paths of one uid.
    """
    order = F.struct(F.col("rel_path").rlike(r"-[0-9a-f]{8}\.md$").alias("hashed"), F.length("rel_path").alias("n"), "rel_path")
    groups = rows.groupBy("uid").agg(F.min_by("rel_path", order).alias("kept_path"), F.count("*").alias("group_size")).filter("group_size > 1")
    return rows.join(groups, "uid").filter("rel_path <> kept_path").select("uid", F.col("rel_path").alias("duplicate_path"), "kept_path", "group_size")


def quality_report(scored: DataFrame) -> DataFrame:
    """Per type: n, mean and percentiles of quality_score."""
    return scored.groupBy("type").agg(
        F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("avg_quality"),
        *(F.round(F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY quality_score)"), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)),
    )


def top_flags(scored: DataFrame, most: int = 5) -> DataFrame:
    counts = scored.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "flag").limit(most)


def confidence(exact: Column, n: Column) -> Column:
    return F.when(exact | (n > 10), "high").when(n >= 3, "medium").otherwise("low")


def classify_timestamp(text: Column) -> Column:
    """utc_z, offset, naive, date_only, empty or unparseable."""
    t = F.trim(F.coalesce(text, F.lit("")))
    day, clock = r"^\d{4}-\d{2}-\d{2}", r"[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
    return (
        F.when(t == "", "empty").when(t.rlike(day + "$"), "date_only").when(t.rlike(day + clock + "Z$"), "utc_z")
        .when(t.rlike(day + clock + r"[+-]\d{2}:?\d{2}$"), "offset").when(t.rlike(day + clock + "$"), "naive").otherwise("unparseable")
    )


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """key and value: how many rows each table has."""
    return reduce(DataFrame.unionByName, (t.agg(F.lit(k).alias("key"), F.count("*").alias("value")) for k, t in tables.items()))


def read_many(cards: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cards of the paths or uids in ``wanted`` (ref), each once."""
    by = lambda c: cards.join(wanted.select(F.col("ref").alias(c)).distinct(), c, "left_semi")
    return by("rel_path").unionByName(by("uid")).dropDuplicates(["uid", "rel_path"])


def with_prefix(cards: DataFrame, prefix: str) -> DataFrame:
    """Cards below a folder; on a table partitioned or sorted by path the filter reaches the scan."""
    return cards.filter(F.col("rel_path").startswith(prefix))


def person_by_slug(cards: DataFrame, wanted: DataFrame) -> DataFrame:
    """slug, and the path of the person of that slug, else of any card of it; null without one."""
    at = lambda name, rows: rows.groupBy("slug").agg(F.min("rel_path").alias(name))
    found = wanted.select("slug").distinct().join(at("person", cards.filter("type = 'person'")), "slug", "left").join(at("other", cards), "slug", "left")
    return found.select("slug", F.coalesce("person", "other").alias("rel_path"))


def knowledge_for_domain(knowledge: DataFrame, domain: str, limit: int) -> DataFrame:
    """The newest fresh card of a domain among its ``5 * limit`` newest ones (uid, domain, activity_at, stale)."""
    newest = knowledge.filter(F.col("domain") == domain).orderBy(F.col("activity_at").desc_nulls_last(), "uid").limit(5 * limit)
    return newest.filter("not stale").orderBy(F.col("activity_at").desc_nulls_last(), "uid").limit(1)
