"""Checks of a built archive: structure, deployment, behaviour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _row(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))


def structural(cards: DataFrame, edges: DataFrame, people: DataFrame, chunks: DataFrame, embedded: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """check, n (how many break it) and ok.

    ``cards`` (uid, slug, type, summary, activity_at), ``edges`` (edge_type,
    target_uid, target_slug), ``people`` (card_uid, value), ``chunks`` and
    ``embedded`` (chunk_key). ``expected``: the fewest cards by type. Missing
    embeddings and dates are counted, but break nothing.
    """
    slugs = cards.select(F.col("slug").alias("target_slug")).distinct()
    persons = cards.filter("type = 'person'")
    named = F.regexp_replace("value", r"\[\[|\]\]", "")
    lost = people.join(persons.select(F.col("uid").alias("value")), "value", "left_anti").withColumn("_slug", named).join(persons.select(F.col("slug").alias("_slug")).distinct(), "_slug", "left_anti")
    checks = [
        _row("duplicate_uids", cards.groupBy("uid").agg(F.count("*").alias("c")).filter("c > 1")),
        _row("orphaned_wikilinks", edges.filter("edge_type = 'wikilink' and target_uid = ''").join(slugs, "target_slug", "left_anti")), _row("orphaned_person_refs", lost),
        _row("cards_missing_summary", cards.filter("coalesce(trim(summary), '') = ''")), _row("cards_missing_activity_at", cards.filter("activity_at is null")),
        _row("chunks_without_embedding", chunks.join(embedded.select("chunk_key").distinct(), "chunk_key", "left_anti")),
    ]
    for kind, least in (expected or {}).items():
        short = F.greatest(F.lit(least) - F.count(F.when(F.col("type") == kind, 1)), F.lit(0))
        checks.append(cards.agg(F.lit(f"card_count:{kind}").alias("check"), short.alias("n")))
    soft = F.col("check").isin("cards_missing_activity_at", "chunks_without_embedding")
    return reduce(DataFrame.unionByName, checks).withColumn("ok", (F.col("n") == 0) | soft)


def silent_rules(cards: DataFrame, edges: DataFrame, rules) -> DataFrame:
    """card_type and edge_type of the rules whose card type there is and of which no edge has come."""
    spark = cards.sparkSession
    told = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("card_type"), F.lit(e).alias("edge_type")) for k, e in sorted({(r.card_type, r.edge_type) for r in rules})))))
    there = told.join(cards.select(F.col("type").alias("card_type")).distinct(), "card_type", "left_semi")
    return there.join(edges.select("edge_type").distinct(), "edge_type", "left_anti").select("card_type", "edge_type")


def behaviour(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per query: precision, recall and the three most frequent types of what it returned.

    ``results`` (query_id, uid, type), ``wanted`` (query_id, uid).
    """
    hits = results.join(wanted.select("query_id", "uid", F.lit(1).alias("hit")).distinct(), ["query_id", "uid"], "left")
    got = hits.groupBy("query_id").agg(F.count("*").alias("returned"), F.count("hit").alias("hits"))
    asked = wanted.groupBy("query_id").agg(F.countDistinct("uid").alias("asked"))
    types = results.groupBy("query_id", "type").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "type"))).alias("t"))  # as many as types
    top = F.array_join(F.transform(F.slice("t", 1, 3), lambda x: x["type"]), ",")
    out = asked.join(got, "query_id", "left").join(types, "query_id", "left")
    n, hit = F.coalesce("returned", F.lit(0)), F.coalesce("hits", F.lit(0))
    return out.select("query_id", F.when(n == 0, 0.0).otherwise(F.round(hit / n, 6)).alias("precision"), F.round(hit / F.col("asked"), 6).alias("recall"), F.coalesce(top, F.lit("")).alias("top_types"))


def population(before: DataFrame, after: DataFrame, by: str = "type") -> DataFrame:
    """Per type: cards before and after, and the change."""
    n = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    both = n(before, "before").join(n(after, "after"), by, "full_outer")
    a, b = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return both.select(by, a.alias("before"), b.alias("after"), (b - a).alias("change"))
