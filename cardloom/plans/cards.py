"""Archive queries on raw cards: typed tables, identifiers, relations, quality, slugs, lookups, edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import features, projections, query
from cardloom.plans.catalog import register
from cardloom.sources.bridge import table
from cardloom.sources.records import KINDS, record_sql, records

FORMAT = "yyyy-MM-dd HH:mm:ss"


def text_of(kind: str, field: str, prefix: str = "") -> str:
    return f'{prefix}"{field}"' if field in KINDS[kind].fields else "''"


def items_sql(v: str) -> str:
    """The members of a raw list value, as DuckDB has them."""
    flow = f"list_filter(list_transform(string_split(trim({v}, '[]'), ','), lambda x: trim(x)), lambda x: x <> '')"
    return f"CASE WHEN trim({v}) IN ('', '[]') THEN []::VARCHAR[] WHEN {v} LIKE '[%' AND {v} NOT LIKE '[[%' THEN {flow} ELSE [trim({v})] END"


def ref_sql(v: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim({v}), '^\\[\\[|\\]\\]$', '', 'g'), '\\|.*$', ''))"


def slug_sql(v: str) -> str:
    return f"lower(replace(trim(regexp_replace({v}, '\\s+', ' ', 'g')), ' ', '-'))"


def missing_sql(v: str) -> str:
    return f"trim({v}) IN ('', '[]')"


def activity_sql(kind: str) -> str:
    filled = ", ".join(f"nullif(trim({text_of(kind, n)}), '')" for n in projections.DATED_BY if n in KINDS[kind].fields)
    return f"try_cast(coalesce({filled}) AS TIMESTAMP)"


def _typed_sql(kind: str) -> str:
    out, needed = [], sorted({f.name for f in projections.TABLES[kind].fields if f.needed} | set(projections.SHARED_NEEDED))
    for f in projections.TABLES[kind].fields:
        v = text_of(kind, f.name)
        out.append({
            "text": f'{v} AS "{f.name}"', "dbl": f'coalesce(try_cast(trim({v}) AS DOUBLE), 0) AS "{f.name}"', "int": f'coalesce(try_cast(trim({v}) AS INTEGER), 0) AS "{f.name}"',
            "bool": f"lower(trim({v})) NOT IN ('', 'false', 'no', 'off', '0', 'null', '[]') AS \"{f.name}\"", "json": f'to_json({items_sql(v)})::VARCHAR AS "{f.name}_json"',
        }[f.mode])
    notes = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {missing_sql(text_of(kind, n))} THEN '{n}' END" for n in needed) + "], lambda x: x IS NOT NULL), ', ')"
    return (f"WITH {record_sql(kind)} SELECT uid AS card_uid, rel_path, summary, created, updated, ({items_sql('\"source\"')})[1] AS primary_source, source_id, "
            f"strftime({activity_sql(kind)}, '%Y-%m-%d %H:%M:%S') AS activity_at, coalesce({notes}, '') = '' AS canonical_ready, coalesce({notes}, '') AS migration_notes, {', '.join(out)} FROM {kind}")


for _kind in KINDS:
    @register(f"typed_{projections.TABLES[_kind].name}", _typed_sql(_kind))
    def _(spark, d, kind=_kind):
        out = projections.project(records(spark, d, kind), kind)
        return out.drop("card_type", "external_ids_json", "relationships_json", "typed_projection_version").withColumn("activity_at", F.date_format("activity_at", FORMAT))


def _ids_sql(kinds) -> str:
    parts = []
    for k in kinds:
        for n, (p, names) in enumerate(features.PROVIDERS.items()):
            parts += [f"SELECT uid AS card_uid, '{f}' AS field_name, '{p}' AS provider, trim({text_of(k, f)}) AS external_id FROM {k} WHERE trim({text_of(k, f)}) <> ''" for f in names if f in KINDS[k].fields]
    return " UNION ALL ".join(parts)


@register("external_ids_unpivot", f"WITH {record_sql()} {_ids_sql(KINDS)}")
def _(spark, d):
    return features.external_ids(records(spark, d))


@register("external_ids_grouped", f"WITH {record_sql()}, e AS ({_ids_sql(KINDS)}) SELECT card_uid, provider, string_agg(DISTINCT external_id, '|' ORDER BY external_id) AS ids FROM e GROUP BY card_uid, provider")
def _(spark, d):
    return records(spark, d).select(F.col("uid").alias("card_uid"), F.explode(features.external_ids_map(F.col("fields"))).alias("provider", "v")).select("card_uid", "provider", F.array_join(F.array_sort("v"), "|").alias("ids"))


_RELATED = " UNION ALL ".join(f"SELECT uid, '{n}' AS field, {items_sql(text_of(k, n))} AS v FROM {k}" for k in KINDS for n in features.RELATIONS if n in KINDS[k].fields)


@register("relationships", f"WITH {record_sql()}, r AS ({_RELATED}) SELECT uid, field, array_to_string(v, '|') AS members FROM r WHERE len(v) > 0")
def _(spark, d):
    return records(spark, d).select("uid", F.explode(features.relationships_map(F.col("fields"))).alias("field", "v")).select("uid", "field", F.array_join("v", "|").alias("members"))


def _score_sql(k: str) -> str:
    names = projections.CRITICAL.get(k, ())
    flags = "list_filter([" + ", ".join(f"CASE WHEN {missing_sql(text_of(k, n))} THEN 'missing:{n}' END" for n in names) + "], lambda x: x IS NOT NULL)" if names else "[]::VARCHAR[]"
    base = f"({len(names)} - len({flags})) / {len(names)}.0::DOUBLE" if names else "0.5::DOUBLE"
    more = "CASE WHEN length(trim(body)) > 80 THEN 0.08 WHEN length(trim(body)) > 20 THEN 0.04 ELSE 0 END::DOUBLE + CASE WHEN trim(summary) <> '' THEN 0.04 ELSE 0 END::DOUBLE"
    return f"SELECT uid, '{k}' AS \"type\", {flags} AS flags, round(least(1.0::DOUBLE, {base} + {more}), 4) AS quality_score FROM {k}"


SCORES_SQL = f"WITH {record_sql()}, s AS ({' UNION ALL '.join(map(_score_sql, KINDS))}) "


def _scored(spark, d):
    cards = records(spark, d)
    return cards.select("uid", "type", projections.quality(F.col("type"), F.col("fields"), F.col("body")).alias("q")).select("uid", "type", "q.*")


@register("quality_score", SCORES_SQL + "SELECT uid, coalesce(array_to_string(flags, ','), '') AS flags, quality_score FROM s")
def _(spark, d):
    return _scored(spark, d).select("uid", F.array_join("quality_flags", ",").alias("flags"), "quality_score")


@register("quality_report_percentiles", SCORES_SQL + "SELECT type, count(*) AS n, round(avg(quality_score), 6) AS avg_quality, round(quantile_cont(quality_score, 0.1), 6) AS p10, round(quantile_cont(quality_score, 0.5), 6) AS p50, round(quantile_cont(quality_score, 0.9), 6) AS p90 FROM s GROUP BY type")
def _(spark, d):
    return query.quality_report(_scored(spark, d))


@register("quality_flags_top5", SCORES_SQL + "SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM s) GROUP BY flag ORDER BY n DESC, flag LIMIT 5")
def _(spark, d):
    return query.top_flags(_scored(spark, d))


_COPIES = "SELECT 'u-' || (o_custkey % 500) AS uid, 'Finance/' || CASE o_orderkey % 3 WHEN 0 THEN 'note-' || substr(sha256(o_orderkey::VARCHAR), 1, 8) WHEN 1 THEN 'n' || o_orderkey ELSE 'order ' || o_orderkey END || '.md' AS rel_path FROM orders"


@register("duplicate_uid_election", f"""WITH r AS ({_COPIES}), g AS (SELECT *, count(*) OVER (PARTITION BY uid) AS group_size,
 first_value(rel_path) OVER (PARTITION BY uid ORDER BY regexp_matches(rel_path, '-[0-9a-f]{{8}}\\.md$'), length(rel_path), rel_path) AS kept_path FROM r)
 SELECT uid, rel_path AS duplicate_path, kept_path, group_size FROM g WHERE group_size > 1 AND rel_path <> kept_path""")
def _(spark, d):
    path = F.expr("concat('Finance/', case o_orderkey % 3 when 0 then concat('note-', substr(sha2(cast(o_orderkey as string), 256), 1, 8)) when 1 then concat('n', o_orderkey) else concat('order ', o_orderkey) end, '.md')")
    return query.duplicate_uids(table(spark, d, "orders").select(F.concat(F.lit("u-"), F.col("o_custkey") % 500).alias("uid"), path.alias("rel_path")))


@register("duplicate_uid_rows", f"""WITH r AS ({_COPIES}), g AS (SELECT *, count(*) OVER (PARTITION BY uid) AS group_size,
 first_value(rel_path) OVER (PARTITION BY uid ORDER BY regexp_matches(rel_path, '-[0-9a-f]{{8}}\\.md$'), length(rel_path), rel_path) AS kept_path FROM r)
 SELECT uid, rel_path AS duplicate_path, group_size FROM g WHERE group_size > 1 AND rel_path <> kept_path ORDER BY group_size DESC, uid, duplicate_path LIMIT 40""")
def _(spark, d):
    from cardloom.plans.catalog import QUERIES

    return QUERIES["duplicate_uid_election"](spark, d).select("uid", "duplicate_path", "group_size").orderBy(F.desc("group_size"), "uid", "duplicate_path").limit(40)


def _each(sql, kinds=None) -> str:
    return " UNION ALL ".join(sql(k) for k in (kinds or KINDS))


@register("activity_cascade", f"WITH {record_sql()} {_each(lambda k: f'''SELECT uid, strftime({activity_sql(k)}, '%Y-%m-%d %H:%M:%S') AS activity_at FROM {k}''')}")
def _(spark, d):
    return records(spark, d).select("uid", F.date_format(projections.activity_at(F.col("fields")), FORMAT).alias("activity_at"))


@register("activity_end_map", f"WITH {record_sql()} {_each(lambda k: f'''SELECT uid, strftime(try_cast({text_of(k, projections.ENDED_BY[k]) if k in projections.ENDED_BY else 'NULL'} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS activity_end_at FROM {k}''')}")
def _(spark, d):
    return records(spark, d).select("uid", F.date_format(projections.activity_end_at(F.col("type"), F.col("fields")), FORMAT).alias("activity_end_at"))


def _search_text_sql(k: str) -> str:
    values = [f"list_transform({items_sql(text_of(k, n))}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))" for n in KINDS[k].fields]
    return f"SELECT uid, sha256(array_to_string(list_filter(flatten([{', '.join(values)}, [trim(body)]]), lambda x: x <> ''), chr(10))) AS text_sha FROM {k}"


@register("search_text_build", f"WITH {record_sql('finance', 'shipment', 'email_thread')} {_each(_search_text_sql, ('finance', 'shipment', 'email_thread'))}")
def _(spark, d):
    cards = records(spark, d, "finance", "shipment", "email_thread")
    return cards.select("uid", F.sha2(projections.search_text(F.col("fields"), F.col("body")), 256).alias("text_sha"))


@register("cards_projection", f"WITH {record_sql()}, q AS ({' UNION ALL '.join(map(_score_sql, KINDS))}), c AS ({_each(lambda k: f'''SELECT uid, rel_path, slug, type, summary, ({items_sql('source')})[1] AS primary_source, source_id, created, updated, strftime({activity_sql(k)}, '%Y-%m-%d %H:%M:%S') AS activity_at, length(body)::BIGINT AS body_chars FROM {k}''')}) SELECT c.*, q.quality_score, 0 AS enrichment_version, 'none' AS enrichment_status FROM c JOIN q ON q.uid = c.uid")
def _(spark, d):
    rows = features.card_rows(records(spark, d))
    return rows.select("uid", "rel_path", "slug", "type", "summary", "primary_source", "source_id", "created", "updated", F.date_format("activity_at", FORMAT).alias("activity_at"),
                       F.col("body_chars").cast("long").alias("body_chars"), "quality_score", "enrichment_version", "enrichment_status")


@register("card_hashes")
def _(spark, d):
    f = F.col("fields")
    return records(spark, d, "finance", "person", "document").select("uid", features.frontmatter_hash(f).alias("frontmatter_hash"), features.content_hash(f, F.col("body")).alias("content_hash"))


_SOURCES = " UNION ALL ".join(f"SELECT uid AS card_uid, unnest({items_sql('source')}) AS value FROM {k}" for k in KINDS)


@register("card_sources", f"WITH {record_sql()}, s AS ({_SOURCES}) SELECT DISTINCT card_uid, value FROM s")
def _(spark, d):
    return features.bridge_rows(records(spark, d), "source")


# slugs, people, edges

SLUGS_SQL = f"cards AS ({_each(lambda k: f'SELECT uid, rel_path, slug, type, summary FROM {k}')}), slugs AS (SELECT slug, arg_min(rel_path, (CASE WHEN rel_path LIKE 'People/%' THEN 0 ELSE 1 END, rel_path)) AS rel_path FROM cards GROUP BY slug)"
LOOKUP_SQL = f"""keys AS (SELECT rel_path, uid, unnest(list_distinct(flatten([[slug, {slug_sql('summary')}], list_transform({items_sql('aliases')}, lambda x: {slug_sql('x')}),
 list_transform({items_sql('emails')}, lambda x: lower(trim(x))), [lower(trim(linkedin))]]))) AS key FROM person),
 people AS (SELECT key, max(rel_path) AS rel_path FROM keys WHERE key <> '' GROUP BY key)"""


@register("slug_registration", f"WITH {record_sql()}, {SLUGS_SQL} SELECT slug, rel_path FROM slugs")
def _(spark, d):
    return features.register_slugs(records(spark, d)).select("slug", "rel_path")


@register("person_lookup", f"WITH {record_sql('person')}, {LOOKUP_SQL} SELECT key, rel_path FROM people")
def _(spark, d):
    return features.person_lookup(records(spark, d, "person")).select("key", "rel_path")


@register("target_field_index", f"WITH {record_sql('purchase')} SELECT lower(order_number) AS value, min(rel_path) AS rel_path FROM purchase GROUP BY 1")
def _(spark, d):
    return features.field_index(records(spark, d, "purchase"), "purchase", "order_number").select("value", "rel_path")


@register("card_people_resolved", f"WITH {record_sql('finance', 'person')}, {LOOKUP_SQL}, v AS (SELECT uid AS card_uid, unnest({items_sql('people')}) AS value FROM finance), u AS (SELECT rel_path, min(uid) AS uid FROM person GROUP BY rel_path) SELECT DISTINCT v.card_uid, coalesce(u.uid, v.value) AS value FROM v LEFT JOIN people a ON a.key = lower({ref_sql('v.value')}) LEFT JOIN people b ON b.key = {slug_sql(ref_sql('v.value'))} LEFT JOIN u ON u.rel_path = coalesce(a.rel_path, b.rel_path)")
def _(spark, d):
    return features.bridge_rows(records(spark, d, "finance"), "people", features.person_lookup(records(spark, d, "person")))


def _rules_sql() -> str:
    refs = " UNION ALL ".join(
        f"SELECT uid AS source_uid, '{r.edge_type}' AS edge_type, '{n}' AS field_name, '{r.target}' AS kind, {int(r.lookup is not None)} AS looked, unnest({items_sql(text_of(r.card_type, n))}) AS v FROM {r.card_type}"
        for r in features.RULES if r.card_type in KINDS for n in r.fields if n in KINDS[r.card_type].fields)
    return f"""WITH {record_sql()}, {SLUGS_SQL}, {LOOKUP_SQL}, loose AS (SELECT {slug_sql('slug')} AS slug, min(rel_path) AS rel_path FROM slugs GROUP BY 1),
 numbers AS (SELECT lower(order_number) AS value, min(rel_path) AS rel_path FROM purchase GROUP BY 1), refs AS ({refs}), r AS (SELECT *, {ref_sql('v')} AS slug FROM refs),
 t AS (SELECT source_uid, edge_type, field_name, CASE WHEN kind = 'person' THEN coalesce(pa.rel_path, pb.rel_path) ELSE coalesce(CASE WHEN looked = 1 THEN numbers.rel_path END, e.rel_path, l.rel_path) END AS target_path
 FROM r LEFT JOIN slugs e ON e.slug = r.slug LEFT JOIN loose l ON l.slug = {slug_sql('r.slug')} LEFT JOIN people pa ON pa.key = lower(r.slug) LEFT JOIN people pb ON pb.key = {slug_sql('r.slug')} LEFT JOIN numbers ON numbers.value = lower(r.slug))
 SELECT DISTINCT source_uid, edge_type, field_name, target_path FROM t WHERE target_path IS NOT NULL"""


@register("edges_declarative", _rules_sql())
def _(spark, d):
    return features.rule_edges(records(spark, d)).select("source_uid", "edge_type", "field_name", "target_path")


@register("edges_universal", f"""WITH {record_sql()}, {SLUGS_SQL}, {LOOKUP_SQL}, loose AS (SELECT {slug_sql('slug')} AS slug, min(rel_path) AS rel_path FROM slugs GROUP BY 1),
 texts AS ({_each(lambda k: "SELECT uid, " + " || chr(10) || ".join([text_of(k, n) for n in KINDS[k].fields] + ["body"]) + f" AS t FROM {k}")}),
 links AS (SELECT DISTINCT uid, trim(unnest(regexp_extract_all(t, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1))) AS slug FROM texts),
 named AS ({_each(lambda k: f"SELECT uid, '{features.PERSON_EDGES.get(k, 'mentions_person')}' AS edge_type, unnest({items_sql(text_of(k, 'people'))}) AS v FROM {k}")}), ids AS ({_ids_sql(KINDS)})
 SELECT DISTINCT uid AS source_uid, 'wikilink' AS edge_type, coalesce(e.rel_path, l.rel_path, links.slug) AS target_path FROM links LEFT JOIN slugs e ON e.slug = links.slug LEFT JOIN loose l ON l.slug = {slug_sql('links.slug')}
 UNION ALL SELECT DISTINCT uid, edge_type, coalesce(pa.rel_path, pb.rel_path) FROM named LEFT JOIN people pa ON pa.key = lower({ref_sql('v')}) LEFT JOIN people pb ON pb.key = {slug_sql(ref_sql('v'))} WHERE coalesce(pa.rel_path, pb.rel_path) IS NOT NULL
 UNION ALL SELECT card_uid, 'entity_has_external_id', 'external-id://' || provider || '/' || external_id FROM (SELECT DISTINCT card_uid, field_name, provider, external_id FROM ids)""")
def _(spark, d):
    return features.universal_edges(records(spark, d)).select("source_uid", "edge_type", "target_path")
