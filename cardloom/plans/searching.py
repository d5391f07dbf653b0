"""Archive queries for search: plans, lexical and exact candidates, composite scores, fusion, order, reranking, explanations, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions.stems import LIGHT, LIGHT_STOP, STOP
from cardloom.operators import features, query, search, textindex, vectors
from cardloom.plans.cards import items_sql
from cardloom.plans.catalog import KNN_SQL, QUERY_VECTOR, register
from cardloom.sources.bridge import table
from cardloom.sources.records import record_sql, records

# what a user might ask: the benchmark's texts and some with hints
ASKED = """(SELECT item_id, CASE item_id % 5 WHEN 0 THEN text WHEN 1 THEN '"' || substr(text, 1, 12) || '" gmail and github in ' || (1998 + item_id) WHEN 2 THEN 'meeting with C' || item_id || '@example.org on 2024-01-1' || (item_id % 10)
 WHEN 3 THEN 'pull request or commit "' || item_id || '" "two words" from b@x.org a@x.org' ELSE '  ' END AS text FROM benchmark)"""


def _asked(spark, d):
    table(spark, d, "benchmark").createOrReplaceTempView("asked_benchmark")
    return spark.sql(f"SELECT * FROM {ASKED.replace('FROM benchmark', 'FROM asked_benchmark')}")


def _hint_sql(words) -> str:
    return "array_to_string(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(lower(q), '{w}') THEN '{v}' END" for w, v in words) + "], lambda x: x IS NOT NULL)), ',')"


def _ordered_hints(words) -> str:
    """The first three distinct values in the order of the words."""
    first = {}
    for w, v in words:
        first.setdefault(v, []).append(w)
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(q), '{w}')" for w in ws) + f" THEN '{v}' END" for v, ws in first.items())
    return f"(list_filter([{cases}], lambda x: x IS NOT NULL))[1:3]"


PLAN_SQL = f"""WITH a AS (SELECT item_id, trim(text) AS q FROM {ASKED}), p AS (SELECT *, list_filter(list_transform(regexp_extract_all(q, '"([^"]+)"', 1), lambda x: trim(x)), lambda x: x <> '') AS phrases,
 list_sort(list_distinct(regexp_extract_all(q, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))) AS emails, regexp_extract(q, '\\b(19[0-9]{{2}}|20[0-9]{{2}})\\b') AS year, regexp_extract(q, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b') AS day FROM a),
 h AS (SELECT *, {_ordered_hints(search.SOURCE_WORDS)} AS sources, {_ordered_hints(search.TYPE_WORDS)} AS types, CASE WHEN day <> '' THEN day WHEN year <> '' THEN year || '-01-01' ELSE '' END AS start_hint,
 CASE WHEN day <> '' THEN day WHEN year <> '' THEN year || '-12-31' ELSE '' END AS end_hint FROM p) """


@register("query_plan_batch", PLAN_SQL + "SELECT item_id, array_to_string(phrases, '|') AS phrases, array_to_string(emails, '|') AS emails, array_to_string(sources, ',') AS source_hints, array_to_string(types, ',') AS type_hints, start_hint, end_hint, (1 + least(len(phrases), 2) + least(len(emails), 2))::BIGINT AS subqueries FROM h")
def _(spark, d):
    p = search.plan(_asked(spark, d))
    joined = lambda c, s: F.array_join(c, s).alias(c)
    return p.select("item_id", joined("phrases", "|"), joined("emails", "|"), joined("source_hints", ","), joined("type_hints", ","), "start_hint", "end_hint", F.size("subqueries").cast("long").alias("subqueries"))


@register("effective_filters", PLAN_SQL + "SELECT item_id, CASE WHEN item_id % 4 = 1 THEN 'finance' ELSE coalesce(types[1], '') END AS type, CASE WHEN item_id % 3 = 0 THEN 'crm' ELSE coalesce(sources[1], '') END AS source, start_hint AS start, CASE WHEN item_id % 2 = 0 THEN '2030-01-01' ELSE end_hint END AS \"end\" FROM h")
def _(spark, d):
    given = search.plan(_asked(spark, d)).withColumns({
        "type_filter": F.when(F.col("item_id") % 4 == 1, "finance").otherwise(" "), "source_filter": F.when(F.col("item_id") % 3 == 0, "crm"), "start_filter": F.lit(""), "end_filter": F.when(F.col("item_id") % 2 == 0, "2030-01-01"),
    })
    return search.effective_filters(given).select("item_id", "type", "source", "start", "end")


# lexical

# Words of the tables whose published stem is the key; the SQL has no stemmer of its own.
FORMS = {
    "anen": "anen aneneable aneneation anened anenedly anener anenerly anenes anening anenly anenlyed anenment anens".split(), "ther": "ther therly therlyed therlying thers".split(),
    "custom": "custom customer customers customs".split(), "7": ["7"],
}
WORDS_SQL = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
_INDEXES: dict[tuple, textindex.TextIndex] = {}


def indexed(spark, d: str, name: str, texts) -> textindex.TextIndex:
    """The index of ``texts()``, built once in a session for each folder of tables."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _INDEXES:
        _INDEXES[key] = textindex.build(texts())
    return _INDEXES[key]


def document_index(spark, d):
    return indexed(spark, d, "documents", lambda: table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"))


def rank_sql(words: list[str], source: str, key: str, text: str) -> str:
    """Named subqueries that end in ranks(key, rank): covers by last places, as in the method's definition."""
    case = "CASE " + " ".join(f"WHEN w IN ({', '.join(map(repr, FORMS[w]))}) THEN '{w}'" for w in words) + " END"
    lasts = ", ".join(f"last_value(CASE WHEN w = '{w}' THEN i END IGNORE NULLS) OVER o AS l{k}" for k, w in enumerate(words))
    known = " AND ".join(f"l{k} IS NOT NULL" for k in range(len(words)))
    least = "least(" + ", ".join(f"l{k}" for k in range(len(words))) + ")" if len(words) > 1 else "l0"
    return f"""words AS (SELECT {key}, unnest(lx) AS w, generate_subscripts(lx, 1) - 1 AS p FROM (SELECT {key}, {WORDS_SQL.format(text)} AS lx FROM {source})),
 hits AS (SELECT {key}, w, p, row_number() OVER (PARTITION BY {key} ORDER BY p) - 1 AS i FROM (SELECT {key}, p, {case} AS w FROM words) WHERE w IS NOT NULL),
 spans AS (SELECT *, {lasts} FROM hits WINDOW o AS (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING)), starts AS (SELECT {key}, i, p, {least} AS s FROM spans WHERE {known}),
 firsts AS (SELECT *, lag(s) OVER (PARTITION BY {key} ORDER BY i) AS before FROM starts),
 ranks AS (SELECT f.{key}, round(sum(0.1::DOUBLE / (1 + (f.p - h.p) - (f.i - f.s))), 6) AS rank FROM firsts f JOIN hits h ON h.{key} = f.{key} AND h.i = f.s WHERE before IS NULL OR s > before GROUP BY f.{key})"""


@register("lexical_rank", f"WITH {rank_sql(['ther', 'anen'], 'documents', 'doc_id', 'text')} SELECT doc_id, rank FROM ranks")
def _(spark, d):
    return search.ranked_matches(document_index(spark, d), "thers anen the").select(F.col("key").cast("long").alias("doc_id"), "rank")


LIGHT_SQL = "w"
for _ending, _left in LIGHT:
    LIGHT_SQL = f"regexp_replace({LIGHT_SQL}, '{_ending}', '{_left}')"
_LIGHT_STOP_SQL = ", ".join(f"'{w}'" for w in LIGHT_STOP)
_TOLD_SQL = f"list_transform(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({_LIGHT_STOP_SQL})), lambda w: {LIGHT_SQL})"


@register("lexical_tokens", f"SELECT doc_id::VARCHAR AS key, coalesce(len(ws), 0)::BIGINT AS places, coalesce(len(list_distinct(ws)), 0)::BIGINT AS words, coalesce(len(lx), 0)::BIGINT AS lexemes, coalesce(len(list_distinct(lx)), 0)::BIGINT AS distinct_lexemes FROM (SELECT doc_id, list_filter({WORDS_SQL.format('text')}, lambda w: w NOT IN ({_STOP_SQL})) AS ws, list_filter({_TOLD_SQL}, lambda w: w <> '') AS lx FROM documents)")
def _(spark, d):
    return textindex.token_counts(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"))


@register("text_index_batch")
def _(spark, d):
    """Every benchmark item's first words, asked of all documents at once."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("text"))
    return document_index(spark, d).lookup(asked).select("query_id", F.col("key").cast("long").alias("doc_id"), "rank")


@register("text_index_update")
def _(spark, d):
    """The lexicon after documents divisible by three were replaced by their pages' addresses and those divisible by seven removed."""
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    index = textindex.build(docs.select(F.col("doc_id").alias("key"), "text"))
    changed = pages.filter("page_id % 3 = 0").select(F.col("page_id").alias("key"), F.col("url").alias("text"))
    index = index.updated(1, changed, docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("key")))
    return index.compacted().lexicon()


EXACT = "customer-7"
_FLAG_CARDS = ("person", "finance", "document")
FLAGS_SQL = f"""cards AS (SELECT uid, rel_path, slug, type, summary, body, NULL::TIMESTAMP AS activity_at FROM person UNION ALL SELECT uid, rel_path, slug, type, summary, body, try_cast(created AS TIMESTAMP) FROM finance UNION ALL SELECT uid, rel_path, slug, type, summary, body, NULL FROM document),
 named AS (SELECT DISTINCT uid FROM (SELECT uid, unnest({items_sql('people')}) AS v FROM finance UNION ALL SELECT uid, unnest({items_sql('authors')}) FROM document) WHERE lower(v) = '{EXACT}'),
 identified AS (SELECT uid FROM person WHERE lower(source_id) = '{EXACT}' UNION SELECT uid FROM finance WHERE lower(source_id) = '{EXACT}' UNION SELECT uid FROM document WHERE lower(source_id) = '{EXACT}'),
 flagged AS (SELECT *, (lower(slug) = '{EXACT}')::INT AS slug_exact, (lower(trim(summary)) = '{EXACT}')::INT AS summary_exact, (uid IN (SELECT uid FROM identified))::INT AS external_id_exact, (uid IN (SELECT uid FROM named))::INT AS person_exact FROM cards)"""


def _flagged(spark, d):
    cards = records(spark, d, *_FLAG_CARDS)
    at = F.when(F.col("type") == "finance", F.try_element_at("fields", F.lit("created")).try_cast("timestamp_ntz"))
    rows = cards.select("uid", "rel_path", "slug", "type", F.col("fields")["summary"].alias("summary"), at.alias("activity_at"))
    people = features.bridge_rows(cards, "people").unionByName(features.bridge_rows(cards, "authors"))
    return search.exact_flags(rows, EXACT, features.external_ids(cards), people)


@register("lexical_exact_flags", f"WITH {record_sql(*_FLAG_CARDS)}, {FLAGS_SQL} SELECT uid, slug_exact, summary_exact, external_id_exact, person_exact FROM flagged WHERE slug_exact + summary_exact + external_id_exact + person_exact > 0")
def _(spark, d):
    return _flagged(spark, d).filter("exact = 1").select("uid", *search.FLAGS)


LEXICAL_SQL = f"""WITH {record_sql(*_FLAG_CARDS)}, {FLAGS_SQL}, {rank_sql(['custom', '7'], 'cards', 'uid', "summary || ' ' || body")},
 by_text AS (SELECT flagged.*, rank AS lexical_score FROM flagged JOIN ranks USING (uid) ORDER BY rank DESC, activity_at DESC NULLS LAST, rel_path LIMIT 40),
 direct AS (SELECT *, 0.0::DOUBLE AS lexical_score FROM flagged WHERE slug_exact = 1 OR external_id_exact = 1 OR person_exact = 1 ORDER BY slug_exact + summary_exact + external_id_exact + person_exact DESC, activity_at DESC NULLS LAST, rel_path LIMIT 40),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY lexical_score DESC) AS r FROM (SELECT * FROM by_text UNION ALL SELECT * FROM direct)) WHERE r = 1),
 lexical AS (SELECT * FROM best ORDER BY slug_exact + summary_exact + external_id_exact + person_exact DESC, lexical_score DESC, activity_at ASC NULLS FIRST, rel_path LIMIT 40)"""


def card_index(spark, d):
    texts = lambda: records(spark, d, *_FLAG_CARDS).select(F.col("uid").alias("key"), F.concat_ws(" ", F.col("fields")["summary"], F.col("body")).alias("text"))
    return indexed(spark, d, "cards", texts)


def _lexical(spark, d):
    return search.lexical_candidates(_flagged(spark, d), search.ranked_matches(card_index(spark, d), "customer 7").withColumnRenamed("key", "uid"), 20)


@register("lexical_merge", LEXICAL_SQL + " SELECT uid, lexical_score, slug_exact, person_exact FROM lexical")
def _(spark, d):
    return _lexical(spark, d).select("uid", "lexical_score", "slug_exact", "person_exact")


# vectors

SURE = ("uid", "source", "created")
_CHUNKS = """SELECT CASE label % 3 WHEN 0 THEN 'card-person-7' WHEN 1 THEN 'card-document-' || label ELSE 'card-finance-' || label END AS uid, CASE label % 3 WHEN 0 THEN 'People/customer-7.md' WHEN 1 THEN 'Documents/document-' || label || '.md' ELSE 'Finance/order-' || label || '.md' END AS rel_path,
 CASE label % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'document' ELSE 'other' END AS type, 'Label ' || (label % 3) AS summary, CASE WHEN label % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * label END AS activity_at, 'body' AS chunk_type, vec_id % 4 AS chunk_index, vec_id, similarity"""
_FIELDS_SQL = "CASE vec_id % 5 WHEN 0 THEN ['body', 'x'] WHEN 1 THEN ['uid', 'created'] WHEN 2 THEN ['summary', 'uid'] WHEN 3 THEN ['title'] ELSE ['']::VARCHAR[] END"
VECTOR_SQL = f"""chunks AS ({_CHUNKS}, {_FIELDS_SQL} AS f FROM ({KNN_SQL})),
 cards_v AS (SELECT uid, count(*) AS matched_chunks, max(similarity) AS similarity, arg_max(struct_pack(chunk_type := chunk_type, chunk_index := chunk_index, f := f), (similarity, -chunk_index)) AS b, first(rel_path) AS rel_path, first(type) AS type, first(summary) AS summary, first(activity_at) AS activity_at FROM chunks GROUP BY uid),
 kept AS (SELECT * FROM cards_v ORDER BY similarity DESC, rel_path LIMIT 20),
 told AS (SELECT *, CASE WHEN activity_at IS NULL THEN 0.0 ELSE round((1 - (row_number() OVER (PARTITION BY activity_at IS NULL ORDER BY activity_at DESC, rel_path DESC) - 1) / greatest(count(*) OVER (PARTITION BY activity_at IS NULL) - 1, 1)::DOUBLE) * 0.06, 6) END AS recency,
 CASE WHEN len(list_filter(b.f, lambda x: x <> '')) = 0 THEN 'unknown' WHEN list_contains(b.f, 'body') OR list_has_all(['uid', 'source', 'created'], list_filter(b.f, lambda x: x <> '')) THEN 'deterministic'
 WHEN list_has_any(b.f, ['description', 'relationship_type', 'tags', 'summary', 'thread_summary']) THEN 'llm_derived' ELSE 'mixed' END AS provenance FROM kept)"""


def prior_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {p}" for p, kinds in search.PRIORS.items() for k in kinds) + f" ELSE {search.OTHER_PRIOR} END"


def bonus_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in search.BONUS.items()) + " ELSE 0 END"


def _vector(spark, d):
    vectors.knn(table(spark, d, "embeddings"), QUERY_VECTOR, 80).createOrReplaceTempView("nearest_chunks")
    fields = _FIELDS_SQL.replace("['']::VARCHAR[]", "array('')").replace("['body', 'x']", "array('body', 'x')").replace("['uid', 'created']", "array('uid', 'created')").replace("['summary', 'uid']", "array('summary', 'uid')").replace("['title']", "array('title')")
    chunks = spark.sql(f"{_CHUNKS.replace('TIMESTAMP ', 'TIMESTAMP_NTZ ')}, {fields} AS source_fields, 'text of a chunk' AS content FROM nearest_chunks")
    return search.vector_candidates(chunks, 20, SURE)


@register("vector_composite", f"WITH {VECTOR_SQL} SELECT uid, matched_chunks, similarity, recency::DOUBLE AS recency, provenance, round(similarity * 1.35 + {prior_sql('type')} + recency + {bonus_sql('provenance')} + least(greatest(matched_chunks - 1, 0) * 0.025, 0.1), 6)::DOUBLE AS score FROM told")
def _(spark, d):
    return _vector(spark, d).select("uid", "matched_chunks", "similarity", "recency", "provenance", "score")


# fusion

FUSED_SQL = f"""{LEXICAL_SQL}, {VECTOR_SQL}, trust AS (SELECT 'card-finance-' || o_orderkey AS uid, 0.5 AS trust FROM orders WHERE o_orderkey % 4 = 0),
 lex AS (SELECT uid, rel_path, type, activity_at, lexical_score, greatest(slug_exact, summary_exact, external_id_exact, person_exact) AS exact FROM lexical),
 j AS (SELECT coalesce(lex.uid, told.uid) AS uid, coalesce(lex.rel_path, told.rel_path) AS rel_path, coalesce(lex.type, told.type) AS type, coalesce(lex.activity_at, told.activity_at) AS activity_at, coalesce(exact, 0) AS exact, coalesce(lexical_score, 0)::DOUBLE AS lexical_score, coalesce(similarity, 0)::DOUBLE AS similarity,
 told.provenance AS label, (told.b).chunk_index AS chunk_index, CASE WHEN lex.uid IS NOT NULL AND told.uid IS NOT NULL THEN 'hybrid' WHEN lex.uid IS NOT NULL THEN 'lexical' ELSE 'vector' END AS matched_by FROM lex FULL OUTER JOIN told ON told.uid = lex.uid),
 r AS (SELECT j.*, CASE WHEN exact = 1 THEN 0 ELSE coalesce(trust, 0) END AS trust, CASE WHEN activity_at IS NULL THEN 0.0 ELSE round((1 - (row_number() OVER (PARTITION BY activity_at IS NULL ORDER BY activity_at DESC, rel_path DESC) - 1) / greatest(count(*) OVER (PARTITION BY activity_at IS NULL) - 1, 1)::DOUBLE) * 0.06, 6) END AS recency FROM j LEFT JOIN trust ON trust.uid = j.uid),
 parts AS (SELECT *, CASE WHEN exact = 1 THEN 3.0 ELSE 0 END::DOUBLE AS exact_boost, round(least(lexical_score, 1.5) * CASE WHEN exact = 1 THEN 1.4 ELSE 1.2 END, 6)::DOUBLE AS lexical_component, round(similarity * 1.2, 6)::DOUBLE AS vector_component, CASE WHEN matched_by = 'hybrid' THEN 0.2 ELSE 0 END::DOUBLE AS multi_signal_boost,
 round(0.22 * trust, 6)::DOUBLE AS graph_boost, ({prior_sql('type')})::DOUBLE AS type_prior, CASE WHEN label IS NOT NULL THEN {bonus_sql('label')} WHEN exact = 1 THEN 0.08 ELSE 0.04 END::DOUBLE AS provenance FROM r),
 fused AS (SELECT *, round(exact_boost + lexical_component + vector_component + multi_signal_boost + graph_boost + type_prior + recency + provenance, 6)::DOUBLE AS score FROM parts)"""


def _fused(spark, d):
    trust = table(spark, d, "orders").filter("o_orderkey % 4 = 0").select(F.concat(F.lit("card-finance-"), "o_orderkey").alias("uid"), F.lit(0.5).alias("trust"))
    return search.fuse(_lexical(spark, d), _vector(spark, d), trust)


@register("hybrid_fusion", FUSED_SQL + " SELECT uid, matched_by, score FROM fused")
def _(spark, d):
    return _fused(spark, d).select("uid", "matched_by", "score")


@register("hybrid_explain_components", FUSED_SQL + f""", w AS (SELECT *, [{', '.join(search.COMPONENTS)}] AS v FROM fused)
 SELECT uid, {', '.join(f'{c}::DOUBLE AS {c}' for c in search.COMPONENTS)}, [{', '.join(f"'{c}'" for c in search.COMPONENTS)}][list_position(list_transform(v, lambda x: abs(x)), list_max(list_transform(v, lambda x: abs(x))))] AS why_ranked, CASE WHEN chunk_index > 0 THEN 'body:' || chunk_index END AS winning_chunk FROM w""")
def _(spark, d):
    return search.explain(_fused(spark, d)).select("uid", *search.COMPONENTS, "why_ranked", "winning_chunk")


@register("hybrid_final_rank", FUSED_SQL + " SELECT uid, score, row_number() OVER (ORDER BY score DESC, exact DESC, similarity DESC, lexical_score DESC, rel_path)::INT AS rank FROM fused ORDER BY rank LIMIT 15")
def _(spark, d):
    from pyspark.sql import Window

    top = search.final_rank(_fused(spark, d), 15)
    return top.select("uid", "score", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("exact"), F.desc("similarity"), F.desc("lexical_score"), "rel_path")).alias("rank"))


@register("hybrid_anchors", LEXICAL_SQL + " SELECT uid FROM lexical WHERE greatest(slug_exact, summary_exact, external_id_exact, person_exact) = 1")
def _(spark, d):
    return search.anchors(_lexical(spark, d))


@register("subquery_merge", "WITH q AS (SELECT conv_id % 3 AS sub, 'card-' || conv_id AS uid, conv_id || '.md' AS rel_path, max(length(text))::DOUBLE AS score FROM conversations GROUP BY ALL UNION ALL SELECT 4, 'card-' || conv_id, conv_id || '.md', 50.0 + conv_id % 7 FROM conversations) SELECT uid, max(score) AS score FROM q GROUP BY uid")
def _(spark, d):
    c = table(spark, d, "conversations").withColumns({"uid": F.concat(F.lit("card-"), "conv_id"), "rel_path": F.concat("conv_id", F.lit(".md"))})
    one = c.groupBy("uid", "rel_path").agg(F.max(F.length("text")).cast("double").alias("score"))
    return search.merge_best(one.unionByName(c.select("uid", "rel_path", (50.0 + F.col("conv_id") % 7).alias("score"))), "score").select("uid", "score")


@register("rerank_blend", FUSED_SQL + """, k AS (SELECT *, (length(uid) % 5) / 5.0::DOUBLE AS rerank_score, row_number() OVER (ORDER BY score DESC, exact DESC, similarity DESC, lexical_score DESC, rel_path) AS r FROM fused),
 m AS (SELECT *, CASE WHEN r <= 3 THEN 0.75 WHEN r <= 10 THEN 0.60 ELSE 0.40 END AS w FROM k), b AS (SELECT *, w * score + (1 - w) * rerank_score * 4 AS mixed FROM m),
 n AS (SELECT *, CASE WHEN r > 12 THEN score ELSE round(CASE WHEN exact = 1 THEN greatest(mixed, score) ELSE mixed END, 6) END AS blended FROM b)
 SELECT uid, blended::DOUBLE AS score, round(blended - score, 6)::DOUBLE AS rerank_contribution, row_number() OVER (ORDER BY r > 12, CASE WHEN r > 12 THEN r END, blended DESC, exact DESC, similarity DESC, lexical_score DESC, rel_path)::INT AS rank FROM n""")
def _(spark, d):
    rows = _fused(spark, d).withColumn("rerank_score", (F.length("uid") % 5) / 5.0)
    return search.blend(rows, 12).select("uid", "score", "rerank_contribution", "rank")


@register("context_text", f"WITH {record_sql('person')} SELECT uid, concat_ws(chr(10), 'type: person', 'summary: ' || summary, 'sources: crm, seed', 'orgs: ' || company || ', Everyone', 'time: ' || created || CASE WHEN updated = '' THEN '' ELSE ' — ' || updated END, 'projections: people') || chr(10) || '---' || chr(10) AS context FROM person")
def _(spark, d):
    from cardloom.sources.notes import items

    f = F.col("fields")
    of = lambda n: items(F.coalesce(F.try_element_at(f, F.lit(n)), F.lit("")))
    text = search.context_text(F.col("type"), f["summary"], of("source"), of("people"), of("orgs"), F.array(f["created"], f["updated"]), F.array(F.lit("people")))
    return records(spark, d, "person").select("uid", search.context_prefix(text).alias("context"))


@register("retrieval_gaps", """WITH a AS (SELECT item_id AS query_id, item_id % 6 AS n, CASE WHEN item_id % 2 = 0 THEN ['person'] ELSE ['finance', 'document'] END AS found FROM benchmark)
 SELECT query_id, 'no_results' AS gap, '' AS detail FROM a WHERE n = 0 UNION ALL SELECT query_id, 'sparse_results', n::VARCHAR FROM a WHERE n BETWEEN 1 AND 2
 UNION ALL SELECT query_id, 'type_mismatch', CASE WHEN list_contains(found, 'person') THEN 'finance' ELSE 'person' END FROM a WHERE n > 0""")
def _(spark, d):
    found = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("person"))).otherwise(F.array(F.lit("finance"), F.lit("document")))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 6).alias("n"), found.alias("found_types"))
    return search.gaps(rows, F.array(F.lit("person"), F.lit("finance")))


@register("archive_status", f"WITH {record_sql('person', 'finance')} SELECT 'cards' AS key, (SELECT count(*) FROM person) + (SELECT count(*) FROM finance) AS value UNION ALL SELECT 'chunks', (SELECT count(*) FROM documents) UNION ALL SELECT 'duplicate_uids', 0 UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings)")
def _(spark, d):
    cards = records(spark, d, "person", "finance")
    return query.status({"cards": cards, "chunks": table(spark, d, "documents"), "embeddings": table(spark, d, "embeddings"),
                         "duplicate_uids": query.duplicate_uids(cards.select("uid", "rel_path"))})
