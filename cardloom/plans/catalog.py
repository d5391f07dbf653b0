"""The archive queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import graph, incremental, linkers, query, retrieval, vectors
from cardloom.sources import bridge
from cardloom.sources.bridge import CARDS_SQL, EDGES_SQL, ORGS_SQL, PEOPLE_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AT = "date_format(activity_at, 'yyyy-MM-dd HH:mm:ss')"
AT_SQL = "strftime(activity_at, '%Y-%m-%d %H:%M:%S')"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("activity_at", F.expr(AT))


# structured queries

@register("query_cards_type_source", f"WITH {CARDS_SQL} SELECT DISTINCT rel_path, summary, type, {AT_SQL} AS activity_at FROM cards WHERE type = 'finance' AND source = 'orders' ORDER BY activity_at DESC NULLS FIRST, rel_path LIMIT 50")
def _(spark, d):
    return _shown(query.query_cards(bridge.cards(spark, d), 50, type="finance", source="orders"))


@register("query_cards_people_org", f"WITH {CARDS_SQL}, {PEOPLE_SQL}, {ORGS_SQL} SELECT DISTINCT rel_path, summary, type, {AT_SQL} AS activity_at FROM cards WHERE uid IN (SELECT uid FROM card_people WHERE person = 'card-person-1') AND uid IN (SELECT uid FROM card_orgs WHERE org = (SELECT lower(c_mktsegment) FROM customer WHERE c_custkey = 1)) ORDER BY activity_at DESC NULLS FIRST, rel_path LIMIT 50")
def _(spark, d):
    one = table(spark, d, "customer").filter("c_custkey = 1").select(F.lower("c_mktsegment").alias("org"))
    orgs = bridge.card_orgs(spark, d).join(one, "org", "left_semi").withColumn("org", F.lit("own"))
    return _shown(query.query_cards(bridge.cards(spark, d), 50, people=bridge.card_people(spark, d), person="card-person-1", orgs=orgs, org="own"))


@register("timeline_range", f"WITH {CARDS_SQL} SELECT rel_path, type, {AT_SQL} AS activity_at FROM cards WHERE activity_at >= TIMESTAMP '1996-01-01 00:00:00' AND activity_at <= TIMESTAMP '1996-06-30 23:59:59.999999' ORDER BY cards.activity_at, rel_path LIMIT 100")
def _(spark, d):
    return _shown(query.timeline(bridge.cards(spark, d), "1996-01-01", "1996-06-30", 100))


MOMENT = "2024-01-10 00:00:00"


def _neighbors_sql(direction: str) -> str:
    legs = {
        "forward": f"SELECT uid, activity_at, 'forward' AS leg, 0 AS n FROM cards WHERE activity_at >= TIMESTAMP '{MOMENT}' ORDER BY activity_at, uid LIMIT 20",
        "backward": f"SELECT uid, activity_at, 'backward' AS leg, 1 AS n FROM cards WHERE activity_at <= TIMESTAMP '{MOMENT}' ORDER BY activity_at DESC, uid LIMIT 20",
        "during": f"SELECT uid, activity_at, 'during' AS leg, 2 AS n FROM cards WHERE activity_at <= TIMESTAMP '{MOMENT}' AND (activity_end_at IS NULL OR activity_end_at >= TIMESTAMP '{MOMENT}') ORDER BY activity_at, uid LIMIT 20",
    }
    chosen = [legs[x] for x in ("forward", "backward", "during") if x == "during" or direction in (x, "both")]
    union = " UNION ALL ".join(f"(SELECT * FROM ({x}))" for x in chosen)
    return f"WITH {CARDS_SQL}, u AS ({union}), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n) AS r FROM u) SELECT uid, {AT_SQL} AS activity_at, leg FROM r WHERE r = 1 ORDER BY r.activity_at, uid LIMIT 20"


for _direction in ("forward", "backward", "both"):
    register(f"temporal_neighbors_{_direction}", _neighbors_sql(_direction))(
        lambda spark, d, direction=_direction: _shown(query.temporal_neighbors(bridge.cards(spark, d), MOMENT, 20, direction))
    )


@register("stats_by_type", f"WITH {CARDS_SQL} SELECT type, count(*) AS n FROM cards GROUP BY type")
def _(spark, d):
    return query.stats(bridge.cards(spark, d), "type")


@register("stats_by_source", f"WITH {CARDS_SQL} SELECT source, count(*) AS n FROM cards GROUP BY source")
def _(spark, d):
    return query.stats(bridge.cards(spark, d), "source")


@register("projection_status", f"WITH {CARDS_SQL} SELECT type, count(*) AS n, round(avg(CASE WHEN activity_at IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS ready FROM cards GROUP BY type")
def _(spark, d):
    return bridge.cards(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("activity_at").isNotNull(), 1.0).otherwise(0.0)), 6).alias("ready"))


@register("external_ids_by_provider", "WITH e AS (SELECT 'crm' AS provider, c_custkey AS id FROM customer UNION ALL SELECT 'erp', s_suppkey FROM supplier UNION ALL SELECT 'web', user_id FROM events) SELECT provider, count(*) AS n, count(DISTINCT id) AS ids FROM e GROUP BY provider")
def _(spark, d):
    ids = lambda name, key, provider: table(spark, d, name).select(F.lit(provider).alias("provider"), F.col(key).alias("id"))
    all_ids = ids("customer", "c_custkey", "crm").unionByName(ids("supplier", "s_suppkey", "erp")).unionByName(ids("events", "user_id", "web"))
    return all_ids.groupBy("provider").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@register("retrieval_confidence", "SELECT event_type, count(*) AS n, CASE WHEN event_type = 'view' OR count(*) > 10 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM events WHERE user_id = 7 GROUP BY event_type")
def _(spark, d):
    n = table(spark, d, "events").filter("user_id = 7").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("confidence", query.confidence(F.col("event_type") == "view", F.col("n")))


STAMP = "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '1996-01-02' WHEN 2 THEN '1996-01-02T03:04:05Z' WHEN 3 THEN '1996-01-02T03:04:05+02:00' ELSE '1996-01-02 03:04' END"


@register("timestamp_classify", "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'date_only' WHEN 2 THEN 'utc_z' WHEN 3 THEN 'offset' ELSE 'naive' END AS kind, count(*) AS n FROM orders GROUP BY kind")
def _(spark, d):
    return table(spark, d, "orders").select(query.classify_timestamp(F.expr(STAMP)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# graph

@register("graph_neighbor_trust", f"WITH {EDGES_SQL}, a AS (SELECT 'card-person-' || c_custkey AS uid FROM customer WHERE c_custkey <= 20), n AS (SELECT target_uid AS uid, confidence FROM edges WHERE source_uid IN (SELECT uid FROM a) UNION ALL SELECT source_uid, confidence FROM edges WHERE target_uid IN (SELECT uid FROM a)) SELECT uid, max(confidence) AS trust FROM n WHERE uid NOT IN (SELECT uid FROM a) GROUP BY uid")
def _(spark, d):
    anchors = table(spark, d, "customer").filter("c_custkey <= 20").select(F.concat(F.lit("card-person-"), "c_custkey").alias("uid"))
    return graph.neighbor_trust(bridge.edges(spark, d), anchors)


@register("graph_khop", f"WITH RECURSIVE {EDGES_SQL}, w(uid, hop) AS (SELECT 'card-finance-' || o_orderkey, 0 FROM orders WHERE o_orderkey <= 50 UNION SELECT target_uid, hop + 1 FROM w JOIN edges ON source_uid = uid WHERE hop < 3) SELECT uid, min(hop) AS hop FROM w GROUP BY uid")
def _(spark, d):
    start = table(spark, d, "orders").filter("o_orderkey <= 50").select(F.concat(F.lit("card-finance-"), "o_orderkey").alias("uid"))
    return graph.k_hop(bridge.edges(spark, d), start, 3)


@register("degree_dead_ends", f"WITH {CARDS_SQL}, {EDGES_SQL}, e AS (SELECT source_uid AS uid FROM edges UNION ALL SELECT target_uid FROM edges), g AS (SELECT uid, count(*) AS degree FROM e GROUP BY uid) SELECT cards.uid, coalesce(degree, 0) AS degree FROM cards LEFT JOIN g ON g.uid = cards.uid WHERE coalesce(degree, 0) <= 1")
def _(spark, d):
    return graph.dead_ends(bridge.cards(spark, d), bridge.edges(spark, d))


@register("orphan_edges", f"WITH {CARDS_SQL}, {EDGES_SQL} SELECT edge_type, count(*) AS n, count(DISTINCT target_uid) AS targets FROM edges WHERE target_uid NOT IN (SELECT uid FROM cards) GROUP BY edge_type")
def _(spark, d):
    return graph.orphan_targets(bridge.edges(spark, d), bridge.cards(spark, d))


# chunks and vectors

@register("chunk_tokens_key", "SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(regexp_replace(text, '^ +', ''), ' +$', ''), '\\s+')) END AS tokens, sha256('card-document-' || doc_id || ':body:0:' || sha256(text)) AS chunk_key FROM documents")
def _(spark, d):
    uid = F.concat(F.lit("card-document-"), "doc_id")
    return table(spark, d, "documents").select("doc_id", vectors.token_count(F.col("text")).alias("tokens"), vectors.chunk_key(uid, F.lit("body"), F.lit(0), F.sha2("text", 256)).alias("chunk_key"))


@register("embedding_backlog", "SELECT doc_id AS chunk_key FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, d):
    return vectors.backlog(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_key")), table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_key")))


@register("embed_gc", "SELECT vec_id AS chunk_key FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def _(spark, d):
    live = table(spark, d, "documents").filter("doc_id % 3 <> 0")
    return vectors.garbage(live.select(F.col("doc_id").alias("chunk_key")), table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_key")))


@register("embedding_status", "SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS embedded, greatest((SELECT count(*) FROM documents) - (SELECT count(*) FROM embeddings), 0) AS pending")
def _(spark, d):
    n = lambda name, alias: table(spark, d, name).agg(F.count("*").alias(alias))
    return n("documents", "chunks").join(n("embeddings", "embedded")).withColumn("pending", F.greatest(F.col("chunks") - F.col("embedded"), F.lit(0)))


@register("embed_context", f"WITH {CARDS_SQL}, {PEOPLE_SQL}, {ORGS_SQL}, p AS (SELECT uid, string_agg(person, '|' ORDER BY person) AS people FROM card_people GROUP BY uid), o AS (SELECT uid, string_agg(org, '|' ORDER BY org) AS orgs FROM card_orgs GROUP BY uid) SELECT cards.uid, coalesce(people, '') AS people, coalesce(orgs, '') AS orgs FROM cards LEFT JOIN p ON p.uid = cards.uid LEFT JOIN o ON o.uid = cards.uid")
def _(spark, d):
    return vectors.embed_context(bridge.cards(spark, d), {"people": (bridge.card_people(spark, d), "person"), "orgs": (bridge.card_orgs(spark, d), "org")})


QUERY_VECTOR = [((7 * i) % 13 - 6) / 6 for i in range(64)]
_Q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in QUERY_VECTOR) + "]"
KNN_SQL = f"SELECT vec_id, label, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q}), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 80"


@register("vector_knn", KNN_SQL)
def _(spark, d):
    return vectors.knn(table(spark, d, "embeddings"), QUERY_VECTOR, 80).select("vec_id", "label", "similarity")


@register("vector_card_collapse", f"WITH h AS ({KNN_SQL}) SELECT label, count(*) AS matched, max(similarity) AS best, arg_min(vec_id, -similarity * 1e9 + vec_id * 1e-6) AS best_chunk FROM h GROUP BY label")
def _(spark, d):
    return vectors.collapse_to_cards(vectors.knn(table(spark, d, "embeddings"), QUERY_VECTOR, 80), "label")


@register("card_centroid", "SELECT label, (i - 1)::INT AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def _(spark, d):
    return vectors.centroids(table(spark, d, "embeddings"), "label")


# retrieval

TERMS = ["the", "with", "this"]


@register("lexical_and_match", "WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) SELECT doc_id, count(*) AS hits FROM w WHERE w IN ('the', 'with', 'this') GROUP BY doc_id HAVING count(DISTINCT w) = 3")
def _(spark, d):
    return retrieval.and_match(table(spark, d, "documents"), "doc_id", "text", TERMS)


@register("rerank_heuristic", """WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) > 1)) AS t, ['the', 'that', 'idiot', 'zz'] AS q FROM documents),
b AS (SELECT doc_id, len(list_intersect(q, t)) AS n_both, len(q) AS nq, len(t) AS nt FROM t) SELECT doc_id, round(least(1.0, 0.5 * n_both / nq + 0.5 * n_both / (nq + nt - n_both)), 6)::DOUBLE AS score FROM b""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieval.rerank_score(F.lit("the that idiot zz a"), F.col("text")).alias("score"))


# links

@register("identity_pairs", "WITH i AS (SELECT c_custkey AS uid, 'balance' AS kind, round(c_acctbal)::BIGINT::VARCHAR AS value FROM customer UNION ALL SELECT c_custkey, 'place', c_nationkey || '/' || c_mktsegment || '/' || (c_custkey % 97) FROM customer), g AS (SELECT kind, value, min(uid) AS leader, count(*) AS n FROM i GROUP BY ALL HAVING count(*) > 1) SELECT uid, kind, leader, (n - 1)::BIGINT AS links FROM i JOIN g USING (kind, value)")
def _(spark, d):
    c = table(spark, d, "customer")
    ids = c.select(F.col("c_custkey").alias("uid"), F.lit("balance").alias("kind"), F.round("c_acctbal").cast("long").cast("string").alias("value")).unionByName(
        c.select(F.col("c_custkey").alias("uid"), F.lit("place").alias("kind"), F.concat_ws("/", "c_nationkey", "c_mktsegment", (F.col("c_custkey") % 97)).alias("value")))
    return linkers.shared_identifiers(ids)


@register("finance_tiers", """WITH c AS (SELECT event_id AS charge, format('{:.2f}', value) AS k, ts, user_id % 5 AS m FROM events WHERE event_type = 'purchase'),
t AS (SELECT event_id AS target, format('{:.2f}', value) AS k, ts, user_id % 5 AS m FROM events WHERE event_type <> 'purchase'),
p AS (SELECT target, charge, abs(date_diff('day', c.ts::DATE, t.ts::DATE)) AS apart, c.m = t.m AS same FROM t JOIN c ON c.k = t.k AND abs(date_diff('day', c.ts::DATE, t.ts::DATE)) <= 3),
q AS (SELECT *, CASE WHEN same AND apart <= 2 THEN 'HIGH' ELSE 'LOW' END AS tier FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tier, apart, charge) AS r FROM q)
SELECT target, charge, tier, apart FROM r WHERE r = 1""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.col("value").alias("amount"), F.col("ts").alias("at"), (F.col("user_id") % 5).alias("merchant"))
    return linkers.finance_tiers(e.filter("event_type = 'purchase'").withColumnRenamed("event_id", "charge"), e.filter("event_type <> 'purchase'").withColumnRenamed("event_id", "target"))


_FEATURES = "(c_custkey % 3) / 2.0 AS det, (c_custkey % 5) / 4.0 AS lex, (c_custkey % 7) / 6.0 AS graph, (c_custkey % 11) / 10.0 AS llm, (c_custkey % 2) / 1.0 AS emb, (c_custkey % 4) / 10.0 AS risk"


@register("decide_candidates", f"""WITH f AS (SELECT c_custkey, {_FEATURES} FROM customer),
s AS (SELECT c_custkey, det, risk, greatest(0.0, least(1.0, 0.45 * det + 0.12 * lex + 0.13 * graph + 0.18 * llm + 0.12 * emb - risk)) AS s FROM f),
c AS (SELECT c_custkey, risk, round(CASE WHEN det >= 1 AND risk < 0.2 THEN greatest(s, 0.92) ELSE s END, 6) AS confidence FROM s)
SELECT c_custkey, confidence::DOUBLE AS confidence, CASE WHEN confidence >= 0.92 THEN 'canonical_safe' WHEN confidence >= 0.80 AND risk < 0.25 THEN 'auto_promote' WHEN confidence >= 0.45 THEN 'review' ELSE 'discard' END AS decision FROM c""")
def _(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", *[x.strip().replace(" / ", " / double(") .replace(" AS", ") AS") for x in _FEATURES.split(", ")])
    return linkers.decide(rows).select("c_custkey", "confidence", "decision")


@register("latest_review_action", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS action FROM events GROUP BY user_id")
def _(spark, d):
    actions = table(spark, d, "events").select("user_id", F.col("event_type").alias("action"), "ts", F.col("event_id").alias("action_id"))
    return linkers.latest_actions(actions, "user_id", "ts")


def _band_sql() -> str:
    label = lambda b: f"'{b[0]:.2f}-{b[1]:.2f}'"
    return "CASE " + " ".join(f"WHEN s BETWEEN {b[0]} AND {b[1]} THEN {label(b)}" for b in linkers.BANDS) + f" ELSE {label(linkers.BANDS[-1])} END"


@register("review_bands", f"WITH s AS (SELECT l_linestatus AS module, (l_orderkey % 1001)::DOUBLE / 1000 AS s FROM lineitem) SELECT module, {_band_sql()} AS band, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("module"), linkers.score_band((F.col("l_orderkey") % 1001).cast("double") / 1000).alias("band"))
    return s.groupBy("module", "band").agg(F.count("*").alias("n"))


@register("dedup_natural_key", "SELECT l_orderkey, l_linenumber, copies FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_quantity) AS copies FROM lineitem) WHERE copies > 1")
def _(spark, d):
    return linkers.natural_key_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "copies")


@register("org_domains", "WITH h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages), s AS (SELECT string_split(h, '.') AS p FROM h) SELECT array_to_string(p[-2:], '.') AS domain, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    host = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("h"))
    return host.select(F.substring_index("h", ".", -2).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@register("sender_census_shape", "SELECT regexp_replace(regexp_replace(url, '[0-9]{3,}', '[#]', 'g'), '[0-9]', '#', 'g') AS shape, count(*) AS n FROM pages GROUP BY 1")
def _(spark, d):
    shape = F.regexp_replace(F.regexp_replace("url", "[0-9]{3,}", "[#]"), "[0-9]", "#")
    return table(spark, d, "pages").select(shape.alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


# incremental and reports

@register("manifest_delta", """WITH o AS (SELECT 'd/' || doc_id AS p, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT 'd/' || doc_id AS p, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.p, n.p) AS rel_path, CASE WHEN o.p IS NULL THEN 'new' WHEN n.p IS NULL THEN 'deleted' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL OUTER JOIN n ON n.p = o.p""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("rel_path"), F.sha2("text", 256).alias("content_hash"))
    new = rows.filter("doc_id % 11 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("content_hash")))
    return incremental.manifest_delta(rows.filter("doc_id % 7 <> 0"), new)


@register("person_escalation", f"WITH {PEOPLE_SQL} SELECT DISTINCT uid FROM card_people WHERE person IN (SELECT 'card-person-' || c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, d):
    changed = table(spark, d, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("card-person-"), "c_custkey").alias("person"))
    return incremental.referencing(changed, bridge.card_people(spark, d))


@register("ingestion_tail", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'")
def _(spark, d):
    return incremental.log_tail(table(spark, d, "events"), "ts", MOMENT).select("event_id", "event_type")


@register("knowledge_stale", "WITH k AS (SELECT user_id AS id, max(ts) AS w, CASE WHEN user_id % 3 = 0 THEN [] ELSE ['purchase', 'none'] END AS d FROM events GROUP BY user_id), l AS (SELECT event_type AS kind, max(ts) AS last FROM events GROUP BY event_type), n AS (SELECT id, w, unnest(d) AS kind FROM k), s AS (SELECT id, bool_or(coalesce(last > w, false)) AS s FROM n LEFT JOIN l ON l.kind = n.kind GROUP BY id) SELECT k.id, coalesce(s, false) AS stale FROM k LEFT JOIN s ON s.id = k.id")
def _(spark, d):
    e = table(spark, d, "events")
    k = e.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("watermark"))
    k = k.withColumn("depends_on", F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("purchase"), F.lit("none"))))
    return incremental.stale(k, e.select(F.col("event_type").alias("kind"), F.col("ts").alias("at")))


@register("benchmark_sample_topk", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha1(o_orderkey::VARCHAR), o_orderkey) AS r FROM orders) WHERE r <= 25")
def _(spark, d):
    return incremental.smallest_by_hash(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 25)


@register("thread_assembly", "SELECT conv_id, count(*) AS n_messages, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, sha256(string_agg(sha256(role || ': ' || coalesce(text, '')), chr(10) ORDER BY turn, role, sha256(role || ': ' || coalesce(text, '')))) AS thread_sha FROM conversations GROUP BY conv_id")
def _(spark, d):
    return incremental.assemble_threads(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
