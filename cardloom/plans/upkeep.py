"""Archive queries for stores, lookups, slices, incremental rebuilds, windows, checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cardloom.functions.normalize import wikilinks
from cardloom.operators import features, graph, health, incremental, query
from cardloom.plans.cards import items_sql, ref_sql
from cardloom.plans.catalog import register
from cardloom.sources import bridge, stores
from cardloom.sources.bridge import CARDS_SQL, EDGES_SQL, table
from cardloom.sources.records import record_sql, records
from cardloom.sources.shared import shared_folder


def _new(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# lookups

@register("prefix_scan", f"WITH {record_sql('email_message', 'email_thread', 'person')} SELECT uid, rel_path FROM (SELECT uid, rel_path FROM email_message UNION ALL SELECT uid, rel_path FROM email_thread UNION ALL SELECT uid, rel_path FROM person) WHERE rel_path LIKE 'Email/%'")
def _(spark, d):
    return query.with_prefix(records(spark, d, "email_message", "email_thread", "person"), "Email/").select("uid", "rel_path")


@register("read_many", f"WITH {record_sql('finance', 'person')}, c AS (SELECT uid, rel_path, body FROM finance UNION ALL SELECT uid, rel_path, body FROM person), w AS (SELECT 'card-finance-' || (l_orderkey % 900) AS ref FROM lineitem UNION SELECT 'People/customer-' || l_suppkey || '.md' FROM lineitem) SELECT uid, rel_path, sha256(body) AS body_sha FROM c WHERE uid IN (SELECT ref FROM w) OR rel_path IN (SELECT ref FROM w)")
def _(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    wanted = l.select(F.concat(F.lit("card-finance-"), F.col("l_orderkey") % 900).alias("ref")).unionByName(l.select(F.concat(F.lit("People/customer-"), "l_suppkey", F.lit(".md")).alias("ref")))
    return query.read_many(records(spark, d, "finance", "person"), wanted).select("uid", "rel_path", F.sha2("body", 256).alias("body_sha"))


@register("person_by_slug", f"WITH {record_sql('finance', 'person')}, w AS (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN 'customer-' || user_id WHEN 1 THEN 'order-' || user_id ELSE 'none-' || user_id END AS slug FROM events) SELECT w.slug, coalesce(p.rel_path, f.rel_path) AS rel_path FROM w LEFT JOIN person p USING (slug) LEFT JOIN finance f USING (slug)")
def _(spark, d):
    slug = F.expr("case user_id % 3 when 0 then concat('customer-', user_id) when 1 then concat('order-', user_id) else concat('none-', user_id) end")
    return query.person_by_slug(records(spark, d, "finance", "person"), table(spark, d, "events").select(slug.alias("slug")))


@register("knowledge_for_domain", "SELECT o_orderkey AS uid FROM (SELECT * FROM orders WHERE o_orderpriority = '3-MEDIUM' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25) WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 1")
def _(spark, d):
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("domain"), F.col("o_orderdate").alias("activity_at"), (F.col("o_orderstatus") == "F").alias("stale"))
    return query.knowledge_for_domain(k, "3-MEDIUM", 5).select("uid")


@register("csv_lookup", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'First' WHEN 1 THEN 'Second' ELSE '' END AS city FROM orders")
def _(spark, d):
    path = _new(spark, "lookup")
    spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("code"), F.lit(b).alias("city")) for a, b in (("aaa", " First"), (" BBB", "Second"), ("", "None")))))).write.option("header", True).csv(path)
    rows = table(spark, d, "orders").withColumn("code", F.expr("case o_orderkey % 3 when 0 then 'AAA' when 1 then 'bbb' else 'ccc' end"))
    return stores.looked_up(rows, "code", stores.read_lookup(spark, path, "code", "city"), "city").select("o_orderkey", "city")


@register("json_lines", "SELECT event_id, user_id FROM events WHERE event_id % 7 <> 0")
def _(spark, d):
    path = _new(spark, "lines")
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", "user_id"))).alias("value"))
    e.write.text(path)
    return stores.read_json_lines(spark, path, "event_id long, user_id long")


# stores

def _with_provenance(spark, d):
    f = F.expr("map('summary', summary, 'amount', cast(o_orderkey as string))")
    one = F.struct(F.lit("crm").alias("source"), F.lit("2024-01-01").alias("date"), F.lit("deterministic").alias("method"), F.array().cast("array<struct<source: string, date: string, method: string>>").alias("prior"))
    told = F.when(F.col("o_orderkey") % 5 == 0, F.map_from_arrays(F.array(F.lit("summary")), F.array(one))).otherwise(F.map_from_arrays(F.array(F.lit("summary"), F.lit("amount")), F.array(one, one)))
    uid = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.concat(F.lit("u-"), "o_orderkey"))
    path = F.when(F.col("o_orderkey") % 13 == 0, "../x.md").otherwise(F.concat(F.lit("Finance/"), "o_orderkey", F.lit(".md")))
    rows = table(spark, d, "orders").withColumn("summary", F.col("o_orderpriority"))
    return rows.select("o_orderkey", uid.alias("uid"), path.alias("rel_path"), F.lit("finance").alias("type"), f.alias("fields"), told.alias("provenance"))


@register("card_write", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 5 = 0 THEN concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'no uid' END, CASE WHEN o_orderkey % 13 = 0 THEN 'path outside the vault' END, CASE WHEN o_orderkey % 5 = 0 THEN 'fields without provenance' END) ELSE 'written' END AS outcome FROM orders")
def _(spark, d):
    path = _new(spark, "cards")
    refused = stores.write_cards(_with_provenance(spark, d), path)
    done = spark.read.parquet(path).select("o_orderkey", F.lit("written").alias("outcome"))
    return done.unionByName(refused.select("o_orderkey", F.array_join("reasons", ",").alias("outcome")))


@register("frontmatter_patch", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderpriority END AS summary, CASE WHEN o_orderkey % 2 = 0 THEN 'absent' ELSE o_orderkey::VARCHAR END AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'absent' END AS extra FROM orders")
def _(spark, d):
    cards = _with_provenance(spark, d).withColumn("uid", F.concat(F.lit("u-"), "o_orderkey"))
    patches = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("u-"), "o_orderkey").alias("uid"), F.expr("map('summary', 'new', 'amount', cast(null as string), 'extra', 'x')").alias("fields"))
    of = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("absent")).alias(n)
    return stores.patched(cards, patches).select("o_orderkey", of("summary"), of("amount"), of("extra"))


@register("embedding_import", "SELECT vec_id AS chunk_key FROM embeddings WHERE vec_id % 3 <> 0")
def _(spark, d):
    path, e = _new(spark, "embeddings"), table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_key"), F.lit("m").alias("model"), "embedding")
    stores.export_embeddings(e.unionByName(e.filter("chunk_key % 5 = 0")), path)
    return stores.import_embeddings(spark, path, e.filter("chunk_key % 3 = 0")).select("chunk_key")


@register("cross_schema_copy", "SELECT vec_id AS chunk_key FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) AND vec_id % 4 <> 1")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_key"), "label")
    return stores.copied(e, table(spark, d, "documents").select(F.col("doc_id").alias("chunk_key")), e.filter("chunk_key % 4 = 1"), "chunk_key").select("chunk_key")


@register("embedding_preservation", "SELECT count(*) AS pre, count(*) FILTER (vec_id % 2 = 0) AS post, count(*) FILTER (vec_id % 2 = 0 AND vec_id % 3 = 0) AS valid, count(*) FILTER (vec_id % 2 = 0 AND vec_id % 3 <> 0) AS orphan FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_key"))
    return stores.preservation(e, e.filter("chunk_key % 2 = 0"), e.filter("chunk_key % 3 = 0"))


@register("staging_report", f"WITH {record_sql('finance', 'shipment', 'person')}, c AS (SELECT uid, type FROM finance UNION ALL SELECT uid, type FROM shipment UNION ALL SELECT uid, type FROM person) SELECT type, count(*) AS n, array_to_string(list_sort(list(uid))[1:3], ',') AS samples FROM c GROUP BY type")
def _(spark, d):
    return stores.staging_report(records(spark, d, "finance", "shipment", "person"))


@register("staging_promotion", f"WITH {record_sql('shipment', 'email_message')} SELECT uid, 'Shipment/2024-01/' || uid || '.md' AS rel_path FROM shipment UNION ALL SELECT uid, 'EmailMessage/2024-01/' || uid || '.md' FROM email_message")
def _(spark, d):
    return stores.promoted_paths(records(spark, d, "shipment", "email_message")).select("uid", "rel_path")


# slices

REFS_SQL = f"""refs AS (SELECT uid AS source_uid, unnest(regexp_extract_all(body, '\\[\\[([^\\]|]+)', 1)) AS slug FROM finance UNION ALL SELECT uid, unnest(list_transform({items_sql('counterparty')}, lambda x: {ref_sql('x')})) FROM finance UNION ALL SELECT uid, {ref_sql('reports_to')} FROM person),
 known AS (SELECT uid, slug FROM finance UNION ALL SELECT uid, slug FROM person), links AS (SELECT DISTINCT source_uid, known.uid AS target_uid FROM refs JOIN known ON known.slug = lower(replace(trim(refs.slug), ' ', '-')))"""


def _refs(spark, d):
    cards = records(spark, d, "finance", "person")
    text = F.concat_ws("\n", F.map_values("fields"), F.array("body"))
    named = F.array_union(wikilinks(text), F.array(features.reference(F.coalesce(F.try_element_at("fields", F.lit("counterparty")), F.lit("")))))
    rows = cards.select(F.col("uid").alias("source_uid"), F.explode(named).alias("slug")).withColumn("slug", F.lower(F.replace(F.trim("slug"), F.lit(" "), F.lit("-"))))
    return rows.join(cards.select("slug", F.col("uid").alias("target_uid")), "slug").select("source_uid", "target_uid").distinct()


# Customer 7's name is no slug, so "reports to" reaches no one; charges reach customers and other charges
@register("closure_slice", f"WITH RECURSIVE {record_sql('finance', 'person')}, {REFS_SQL}, w(seed, uid) AS (SELECT 'card-finance-' || o_orderkey, 'card-finance-' || o_orderkey FROM orders WHERE o_orderkey % 100 = 3 UNION SELECT seed, target_uid FROM w JOIN links ON source_uid = uid) SELECT seed, count(*) AS n FROM w GROUP BY seed HAVING count(*) <= 12")
def _(spark, d):
    seeds = table(spark, d, "orders").filter("o_orderkey % 100 = 3").select(F.concat(F.lit("card-finance-"), "o_orderkey").alias("uid"))
    return graph.seed_clusters(_refs(spark, d), seeds, 12).groupBy("seed").agg(F.count("*").alias("n"))


@register("dangling_resolve", f"WITH RECURSIVE {record_sql('finance', 'person')}, {REFS_SQL}, w(uid, hop) AS (SELECT 'card-finance-' || o_orderkey, 0 FROM orders WHERE o_orderkey % 40 = 3 UNION SELECT target_uid, hop + 1 FROM w JOIN links ON source_uid = uid WHERE hop < 2) SELECT DISTINCT uid FROM w")
def _(spark, d):
    chosen = table(spark, d, "orders").filter("o_orderkey % 40 = 3").select(F.concat(F.lit("card-finance-"), "o_orderkey").alias("uid"))
    return graph.with_dangling(chosen, _refs(spark, d), 2)


@register("slice_seeds")
def _(spark, d):
    return graph.stratified_seeds(records(spark, d), 5.0, table(spark, d, "orders").filter("o_orderkey = 1").select(F.lit("card-finance-1").alias("uid")))


@register("orphan_refs", f"WITH {record_sql('finance', 'person')}, r AS (SELECT DISTINCT uid, trim(unnest(regexp_extract_all(body, '\\[\\[([^\\]|]+)', 1))) AS ref FROM finance) SELECT ref, count(*) AS n FROM r WHERE ref NOT IN (SELECT slug FROM finance UNION SELECT slug FROM person) GROUP BY ref")
def _(spark, d):
    cards = records(spark, d, "finance", "person")
    refs = cards.filter("type = 'finance'").select("uid", F.explode(F.array_distinct(wikilinks(F.col("body")))).alias("ref"))
    return refs.join(cards.select(F.col("slug").alias("ref")), "ref", "left_anti").groupBy("ref").agg(F.count("*").alias("n"))


# incremental

@register("incremental_apply", f"WITH {EDGES_SQL}, rebuilt AS (SELECT 'card-person-' || c_custkey AS uid FROM customer WHERE c_custkey % 3 = 0), deleted AS (SELECT 'card-person-' || c_custkey AS uid FROM customer WHERE c_custkey % 3 = 1) SELECT source_uid, target_uid FROM edges WHERE source_uid NOT IN (SELECT uid FROM rebuilt UNION SELECT uid FROM deleted) AND target_uid NOT IN (SELECT uid FROM deleted)")
def _(spark, d):
    of = lambda k: table(spark, d, "customer").filter(f"c_custkey % 3 = {k}").select(F.concat(F.lit("card-person-"), "c_custkey").alias("uid"))
    return incremental.purged_edges(bridge.edges(spark, d), of(0), of(1)).select("source_uid", "target_uid")


@register("rebuild_mode", "SELECT count(*) FILTER (doc_id % 5 = 0) AS changed, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_custkey % 10 = 0) AS touched, 'person_triggered' AS mode FROM documents")
def _(spark, d):
    delta = table(spark, d, "documents").select(F.when(F.col("doc_id") % 5 == 0, "changed").otherwise("unchanged").alias("state"))
    return incremental.rebuild_mode(delta, table(spark, d, "orders").filter("o_custkey % 10 = 0").select("o_orderkey"), 1_000_000)


@register("adapter_cursors", "WITH c AS (SELECT event_type AS source, max(event_id) FILTER (event_id % 2 = 0) AS position FROM events GROUP BY event_type) SELECT e.event_type AS source, count(*) AS n, max(event_id) AS position FROM events e LEFT JOIN c ON c.source = e.event_type AND c.source <> 'click' WHERE c.position IS NULL OR e.event_id > c.position GROUP BY e.event_type")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("position"))
    start = e.filter("1 = 0")
    cursors = incremental.advanced_cursors(start, e.filter("position % 2 = 0 and source <> 'click'"))
    return incremental.unseen(e, cursors).groupBy("source").agg(F.count("*").alias("n"), F.max("position").alias("position"))


@register("windows_tumbling", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return incremental.tumbling(table(spark, d, "events"), "ts", "1 hour", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@register("windows_sliding", "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY ALL")
def _(spark, d):
    return incremental.tumbling(table(spark, d, "events"), "ts", "2 hours", "event_type", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@register("windows_session", "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, d):
    return incremental.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# checks

@register("health_structural", f"""WITH {CARDS_SQL} SELECT 'duplicate_uids' AS "check", 0 AS n, true AS ok UNION ALL SELECT 'orphaned_wikilinks', (SELECT count(*) FROM lineitem WHERE l_partkey % 2 = 0 AND l_partkey >= (SELECT count(*) FROM customer)), (SELECT count(*) FROM lineitem WHERE l_partkey % 2 = 0 AND l_partkey >= (SELECT count(*) FROM customer)) = 0
 UNION ALL SELECT 'orphaned_person_refs', (SELECT count(*) FROM orders WHERE o_custkey % 3 = 0), false UNION ALL SELECT 'cards_missing_summary', (SELECT count(*) FROM cards WHERE coalesce(trim(summary), '') = ''), (SELECT count(*) FROM cards WHERE coalesce(trim(summary), '') = '') = 0
 UNION ALL SELECT 'cards_missing_activity_at', (SELECT count(*) FROM cards WHERE activity_at IS NULL), true UNION ALL SELECT 'chunks_without_embedding', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)), true
 UNION ALL SELECT 'card_count:person', greatest(1000000 - (SELECT count(*) FROM customer), 0), false""")
def _(spark, d):
    number = F.regexp_extract("uid", r"(\d+)$", 1)
    cards = bridge.cards(spark, d).withColumn("slug", F.concat(F.col("type"), F.lit("-"), number))
    edges = table(spark, d, "lineitem").select(F.lit("wikilink").alias("edge_type"), F.when(F.col("l_partkey") % 2 == 0, "").otherwise("x").alias("target_uid"), F.concat(F.lit("person-"), "l_partkey").alias("target_slug"))
    value = F.expr("case o_custkey % 3 when 0 then 'nobody' when 1 then concat('card-person-', o_custkey) else concat('[[person-', o_custkey, ']]') end")
    people = table(spark, d, "orders").select(F.col("o_orderkey").alias("card_uid"), value.alias("value"))
    return health.structural(cards, edges, people, table(spark, d, "documents").select(F.col("doc_id").alias("chunk_key")), table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_key")), {"person": 1_000_000})


@register("health_edge_rules", "SELECT 'finance' AS card_type, 'finance_from_email' AS edge_type UNION ALL SELECT 'calendar_event', e FROM (VALUES ('event_has_message'), ('event_has_thread'), ('event_has_transcript')) t(e)")
def _(spark, d):
    edges = spark.range(1).select(F.explode(F.array(*map(F.lit, ("transaction_with_person", "event_has_person", "person_reports_to")))).alias("edge_type"))
    return health.silent_rules(bridge.cards(spark, d).filter("type <> 'organization' and type <> 'document'"), edges, features.RULES)


@register("health_behaviour", """WITH w AS (SELECT DISTINCT o_orderpriority AS query_id, o_custkey AS uid FROM orders), r AS (SELECT DISTINCT o_orderpriority AS query_id, o_custkey AS uid, o_orderstatus AS type FROM orders WHERE o_custkey % 2 = 0 AND o_orderpriority <> '1-URGENT'),
 h AS (SELECT query_id, count(*) AS returned FROM r GROUP BY query_id), t AS (SELECT query_id, string_agg(type, ',' ORDER BY n DESC, type) AS top_types FROM (SELECT query_id, type, count(*) AS n FROM r GROUP BY ALL) GROUP BY query_id)
 SELECT a.query_id, CASE WHEN h.returned IS NULL THEN 0 ELSE 1 END::DOUBLE AS precision, round(coalesce(h.returned, 0) / a.asked, 6)::DOUBLE AS recall, coalesce(top_types, '') AS top_types FROM (SELECT query_id, count(DISTINCT uid) AS asked FROM w GROUP BY query_id) a LEFT JOIN h USING (query_id) LEFT JOIN t USING (query_id)""")
def _(spark, d):
    o = table(spark, d, "orders")
    got = o.filter("o_custkey % 2 = 0 and o_orderpriority <> '1-URGENT'").select(F.col("o_orderpriority").alias("query_id"), F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("type")).distinct()
    return health.behaviour(got, o.select(F.col("o_orderpriority").alias("query_id"), F.col("o_custkey").alias("uid")).distinct())


@register("seed_link_benchmark", f"WITH {CARDS_SQL}, a AS (SELECT type, count(*) AS n FROM cards WHERE type <> 'document' GROUP BY type), b AS (SELECT type, count(*) AS n FROM cards WHERE type <> 'person' GROUP BY type) SELECT coalesce(a.type, b.type) AS type, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL OUTER JOIN b ON a.type = b.type")
def _(spark, d):
    c = bridge.cards(spark, d)
    return health.population(c.filter("type <> 'document'"), c.filter("type <> 'person'"))
