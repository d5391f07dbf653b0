"""The driver's tables as cards, bridge tables, edges and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _card(df: DataFrame, kind: str, key: str, summary, source, at=None, end=None, folder: str = "") -> DataFrame:
    none = F.lit(None).cast("timestamp_ntz")
    return df.select(
        F.concat(F.lit(f"card-{kind}-"), F.col(key)).alias("uid"), F.concat(F.lit(f"{folder}/"), F.col(key), F.lit(".md")).alias("rel_path"),
        F.lit(kind).alias("type"), summary.alias("summary"), source.alias("source"),
        (at.cast("timestamp_ntz") if at is not None else none).alias("activity_at"), (end.cast("timestamp_ntz") if end is not None else none).alias("activity_end_at"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, rel_path, type, summary, source, activity_at, activity_end_at; a row per card."""
    t = lambda name: table(spark, sf_dir, name)
    start = F.col("ts").cast("timestamp_ntz")
    parts = [
        _card(t("customer"), "person", "c_custkey", F.col("c_name"), F.lit("crm"), folder="People"),
        _card(t("supplier"), "organization", "s_suppkey", F.col("s_name"), F.lit("crm"), folder="Organizations"),
        _card(t("orders"), "finance", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderpriority")), F.lit("orders"), F.col("o_orderdate"), folder="Finance"),
        _card(
            t("events").filter("event_type = 'signup'"), "calendar_event", "event_id", F.concat(F.lit("signup "), F.col("user_id")), F.lit("events"),
            start, F.expr("cast(ts as timestamp_ntz) + make_dt_interval(0, 0, cast(floor(value) as int), 0)"), folder="Calendar",
        ),
        _card(t("documents"), "document", "doc_id", F.left("text", F.lit(40)), F.col("source"), folder="Documents"),
    ]
    return reduce(DataFrame.unionByName, parts)


CARDS_SQL = """
cards AS (
  SELECT 'card-person-' || c_custkey AS uid, 'People/' || c_custkey || '.md' AS rel_path, 'person' AS type, c_name AS summary, 'crm' AS source, NULL::TIMESTAMP AS activity_at, NULL::TIMESTAMP AS activity_end_at FROM customer
  UNION ALL SELECT 'card-organization-' || s_suppkey, 'Organizations/' || s_suppkey || '.md', 'organization', s_name, 'crm', NULL, NULL FROM supplier
  UNION ALL SELECT 'card-finance-' || o_orderkey, 'Finance/' || o_orderkey || '.md', 'finance', 'Order ' || o_orderpriority, 'orders', o_orderdate::TIMESTAMP, NULL FROM orders
  UNION ALL SELECT 'card-calendar_event-' || event_id, 'Calendar/' || event_id || '.md', 'calendar_event', 'signup ' || user_id, 'events', ts::TIMESTAMP, ts::TIMESTAMP + to_minutes(floor(value)::BIGINT) FROM events WHERE event_type = 'signup'
  UNION ALL SELECT 'card-document-' || doc_id, 'Documents/' || doc_id || '.md', 'document', substr(text, 1, 40), source, NULL, NULL FROM documents
)"""


def card_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("card-finance-"), "o_orderkey").alias("uid"), F.concat(F.lit("card-person-"), "o_custkey").alias("person")
    )


def card_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.concat(F.lit("card-finance-"), "o_orderkey").alias("uid"), F.lower("c_mktsegment").alias("org"))


PEOPLE_SQL = "card_people AS (SELECT 'card-finance-' || o_orderkey AS uid, 'card-person-' || o_custkey AS person FROM orders)"
ORGS_SQL = "card_orgs AS (SELECT 'card-finance-' || o_orderkey AS uid, lower(c_mktsegment) AS org FROM orders JOIN customer ON o_custkey = c_custkey)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_uid, target_uid, edge_type, confidence: order to customer, customer and supplier to nation, nation to region."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, x, b, y, kind, conf: df.select(
        F.concat(F.lit(f"card-{a}-"), F.col(x)).alias("source_uid"), F.concat(F.lit(f"card-{b}-"), F.col(y)).alias("target_uid"),
        F.lit(kind).alias("edge_type"), F.lit(conf).alias("confidence"),
    )
    parts = [
        edge(t("orders"), "finance", "o_orderkey", "person", "o_custkey", "counterparty", 1.0),
        edge(t("customer"), "person", "c_custkey", "place", "c_nationkey", "lives_in", 0.8),
        edge(t("supplier"), "organization", "s_suppkey", "place", "s_nationkey", "located_in", 0.9),
        edge(t("nation"), "place", "n_nationkey", "region", "n_regionkey", "part_of", 1.0),
    ]
    return reduce(DataFrame.unionByName, parts)


EDGES_SQL = """
edges AS (
  SELECT 'card-finance-' || o_orderkey AS source_uid, 'card-person-' || o_custkey AS target_uid, 'counterparty' AS edge_type, 1.0::DOUBLE AS confidence FROM orders
  UNION ALL SELECT 'card-person-' || c_custkey, 'card-place-' || c_nationkey, 'lives_in', 0.8 FROM customer
  UNION ALL SELECT 'card-organization-' || s_suppkey, 'card-place-' || s_nationkey, 'located_in', 0.9 FROM supplier
  UNION ALL SELECT 'card-place-' || n_nationkey, 'card-region-' || n_regionkey, 'part_of', 1.0 FROM nation
)"""
