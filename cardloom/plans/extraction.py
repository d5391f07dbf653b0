"""Queries on receipt mail, chunks, typed tables and settled matches; they join those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import chunking, emails, matching, projections, vectors
from cardloom.plans.catalog import register
from cardloom.sources.bridge import table

_SENDERS = tuple(d for r in emails.RULES for d in r.domains) + ("example.org",)
_SUBJECTS = ("Your Uber Eats receipt", "Your trip receipt", "Order confirmation", "Package on the way", "50% off deal", "Your newsletter", "Flight confirmation", "")
_BODIES = ("Subtotal and total", "Track your package", "Your reservation", "Nothing here", "")


def _pick(values: tuple[str, ...], n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_sql, values)) + "]"


def _routing_sql() -> str:
    found = lambda pattern: f"regexp_matches(subject, {_sql('(?is)' + pattern)})"

    def takes(r: emails.Rule) -> str:
        out = "(" + " OR ".join(f"ends_with(sender, {_sql('@' + d)})" for d in r.domains) + ")"
        out += f" AND {found(r.subject)}" if r.subject else ""
        out += f" AND NOT {found(r.unless)}" if r.unless else ""
        return f"({out})" + (f" OR sender IN ({', '.join(map(_sql, r.addresses))})" if r.addresses else "")

    which = "CASE " + " ".join(f"WHEN {takes(r)} THEN {i}" for i, r in enumerate(emails.RULES)) + " END"
    good = "CASE which " + " ".join(
        f"WHEN {i} THEN NOT {found(r.junk)} AND ({' OR '.join(f'contains(lower(body), {_sql(w)})' for w in r.words)})" for i, r in enumerate(emails.RULES)) + " END"
    return f"""WITH m AS (SELECT 'a@' || ({_list(_SENDERS)})[o_orderkey % {len(_SENDERS)} + 1] AS sender, ({_list(_SUBJECTS)})[o_custkey % {len(_SUBJECTS)} + 1] AS subject,
 ({_list(_BODIES)})[(o_orderkey + o_custkey) % {len(_BODIES)} + 1] AS body FROM orders), w AS (SELECT *, {which} AS which FROM m),
 r AS (SELECT ({_list(r.name for r in emails.RULES)})[which + 1] AS extractor, ({_list(r.card_type for r in emails.RULES)})[which + 1] AS card_type, {good} AS is_receipt FROM w)
 SELECT extractor, card_type, is_receipt, count(*) AS n FROM r GROUP BY ALL"""


@register("email_routing", _routing_sql())
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mail = table(spark, d, "orders").select(
        F.concat(F.lit(" A@"), _pick(_SENDERS, k)).alias("from_email"), _pick(_SUBJECTS, c).alias("subject"), _pick(_BODIES, k + c).alias("body"))
    return emails.route(mail).groupBy("extractor", "card_type", "is_receipt").agg(F.count("*").alias("n"))


def _order_fields():
    """Orders as the raw fields of rides and flights."""
    key = F.col("o_orderkey")
    return F.create_map(
        F.lit("uid"), F.concat(F.lit("r-"), key), F.lit("pickup_location"), F.when(key % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.lit("dropoff_location"), F.lit("home"),
        F.lit("fare"), F.when(key % 5 == 0, "free").otherwise((key % 40).cast("string")), F.lit("pickup_at"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("service"), F.lit("[bus, tram]"), F.lit("summary"), F.lit("ride"), F.lit("source"), F.lit("orders"))


@register("extraction_confidence", """SELECT o_orderkey, round_even(((o_orderkey % 3 <> 0)::INT + 1 + (o_orderkey % 5 <> 0 AND o_orderkey % 40 > 0)::INT) / 3.0, 2)::DOUBLE AS confidence FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", emails.confidence(F.lit("ride"), _order_fields()).alias("confidence"))


@register("suspected_copies", """WITH r AS (SELECT 'r-' || o_orderkey AS uid, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 40 END AS fare FROM orders)
 SELECT 'ride,' || day || ',' || fare || '.0' AS key, count(*) AS n, min(uid) AS uid FROM r GROUP BY day, fare HAVING count(*) > 1""")
def _(spark, d):
    cards = table(spark, d, "orders").select(F.lit("ride").alias("type"), _order_fields().alias("fields"))
    return emails.suspected_copies(cards).withColumn("key", F.array_join("key", ","))


@register("typed_rides", """SELECT 'r-' || o_orderkey AS card_uid, 'ride' AS card_type, 'orders' AS primary_source, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 3 <> 0 AS canonical_ready,
 CASE WHEN o_orderkey % 3 = 0 THEN 'pickup_location' ELSE '' END AS migration_notes, 'bus' AS service, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS pickup_location,
 CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 40 END::DOUBLE AS fare FROM orders""")
def _(spark, d):
    cards = table(spark, d, "orders").select(F.concat(F.lit("r-"), "o_orderkey").alias("uid"), F.lit("x.md").alias("rel_path"), F.lit("ride").alias("type"), _order_fields().alias("fields"))
    typed = projections.project(cards, "ride", "service, *pickup_location, *dropoff_location, pickup_at, fare:dbl")
    return typed.select(
        "card_uid", "card_type", "primary_source", F.date_format("activity_at", "yyyy-MM-dd").alias("day"), "canonical_ready", "migration_notes", "service", "pickup_location", "fare")


@register("settled_matches", """WITH s AS (SELECT l_orderkey AS source, l_linenumber AS target, (l_partkey * 37 % 1000) / 1000.0::DOUBLE AS score FROM lineitem),
 r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM s WHERE score > 0.05 WINDOW w AS (PARTITION BY source ORDER BY score DESC, target)),
 b AS (SELECT source, target, score, score - coalesce(second, 0) AS gap FROM r WHERE r = 1)
 SELECT a.source, CASE WHEN score IS NULL OR score < 0.55 THEN 'none' WHEN gap >= 0.12 THEN 'confident' ELSE 'ambiguous' END AS outcome, CASE WHEN score >= 0.55 THEN target END AS target,
  score, round(gap, 6) AS gap FROM (SELECT DISTINCT source FROM s) a LEFT JOIN b ON a.source = b.source""")
def _(spark, d):
    score = (F.col("l_partkey") * 37 % 1000) / 1000.0
    scored = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("target"), score.alias("score"))
    return matching.settle(scored, "source", "target", "score")


@register("hash_embedding", """WITH c AS (SELECT doc_id, k, sha256(encode(coalesce(text, '')) || ('\\x00\\x00\\x00\\x0' || k)::BLOB) AS h FROM documents, range(4) r(k)),
 p AS (SELECT doc_id, k, h, unnest(range(16)) AS i FROM c)
 SELECT doc_id, (k * 16 + i)::INT AS dim, ('0x' || substr(h, (i * 4 + 1)::INT, 4))::INT / 65535.0::DOUBLE * 2.0 - 1.0 AS value FROM p""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(vectors.hash_embedding(F.col("text"), 64)).alias("dim", "value"))


@register("chunk_rows")
def _(spark, d):
    """Without SQL: packing paragraphs is sequential. Tested against brute force."""
    return chunking.chunk_rows(table(spark, d, "documents"), "doc_id", {"body": F.col("text")})


@register("rolling_windows")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.rolling_windows(F.col("text"))).alias("window", "content"))
