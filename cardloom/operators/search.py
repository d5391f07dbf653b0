"""Search: query plans, lexical and exact candidates, vector scores, fusion, final order, reranking and explanations.

A query's candidates are tables with a row a card; only the last steps sort,
and they sort candidates, not cards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.normalize import email
from cardloom.operators.textindex import TextIndex

# What a query's words say about sources and types; a needle's trailing blank counts.
SOURCE_WORDS = (
    ("gmail", "gmail"), ("google mail", "gmail"), ("otter", "otter"), ("google calendar", "calendar"), ("ical ", "calendar"), ("photos", "photos"), ("github", "github"), ("git ", "github"),
    ("notion", "notion"), ("imessage", "imessage"), ("slack", "slack"),
)
TYPE_WORDS = (
    ("meeting transcript", "meeting_transcript"), ("transcript", "meeting_transcript"), ("meeting", "meeting_transcript"), ("email thread", "email_thread"), ("thread", "email_thread"),
    ("person", "person"), ("contact", "person"), ("document", "document"), ("medical", "medical_record"), ("commit", "git_commit"), ("pull request", "git_thread"), ("pr ", "git_thread"),
)
# How much a card's type counts; others count OTHER_PRIOR.
PRIORS = {
    0.14: ("person",), 0.12: ("calendar_event",), 0.11: ("meeting_transcript",), 0.10: ("email_thread", "git_repository"), 0.09: ("git_thread",),
    0.08: ("email_message", "imessage_thread", "git_commit", "place", "organization"), 0.07: ("document", "beeper_thread", "flight", "accommodation", "event_ticket"),
    0.06: ("imessage_message", "git_message", "meal_order", "grocery_order", "ride", "car_rental", "purchase", "subscription"),
    0.05: ("medical_record", "vaccination", "beeper_message", "shipment", "payroll"), 0.04: ("finance", "media_asset"),
    0.03: ("email_attachment", "imessage_attachment", "beeper_attachment", "knowledge", "observation"),
}
OTHER_PRIOR = 0.02
# Fields that a model may have written.
MODEL_FIELDS = ("description", "relationship_type", "tags", "summary", "thread_summary")
BONUS = {"deterministic": 0.08, "mixed": 0.04, "llm_derived": 0.01, "unknown": 0.0}



def _hints(low: Column, words: tuple[tuple[str, str], ...], most: int = 3) -> Column:
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(v)) for w, v in words)))
    return F.slice(F.array_distinct(found), 1, most)


def plan(queries: DataFrame, text: str = "text", variants: int = 2) -> DataFrame:
    """``queries`` with phrases, emails, source_hints, type_hints, start_hint, end_hint and subqueries (text, role, weight).

    Phrases are quoted; a year is from its first to its last day, an ISO date
    goes before it. Subqueries: the text itself, up to ``variants`` other
    phrases, up to ``variants`` addresses. A blank text asks for nothing.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    phrases = F.filter(F.transform(F.regexp_extract_all(t, F.lit('"([^"]+)"'), F.lit(1)), lambda x: F.trim(x)), lambda p: p != "")
    emails = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))))
    year, day = F.regexp_extract(t, r"\b(19\d{2}|20\d{2})\b", 0), F.regexp_extract(t, r"\b\d{4}-\d{2}-\d{2}\b", 0)
    hint = lambda tail: F.when(day != "", day).when(year != "", F.concat(year, F.lit(tail))).otherwise("")
    part = lambda v, role, w: F.struct(v.alias("text"), F.lit(role).alias("role"), F.lit(w).alias("weight"))
    out = queries.withColumns({"phrases": phrases, "emails": emails}).withColumns({
        "source_hints": _hints(F.lower(t), SOURCE_WORDS), "type_hints": _hints(F.lower(t), TYPE_WORDS), "start_hint": hint("-01-01"), "end_hint": hint("-12-31"),
    })
    more = F.filter(F.array_distinct(F.slice("phrases", 1, variants)), lambda p: (F.lower(p) != F.lower(t)) & (p != t))
    asked = F.concat(F.array(part(t, "primary", 1.0)), F.transform(more, lambda p: part(p, "phrase_variant", 0.85)),
                     F.transform(F.filter(F.slice("emails", 1, variants), lambda e: (e != t) & ~F.array_contains(more, e)), lambda e: part(e, "email_anchor", 0.9)))
    return out.withColumn("subqueries", asked)


def effective_filters(planned: DataFrame) -> DataFrame:
    """type, source, start and end of each planned query: the given one (columns type_filter, source_filter, start_filter, end_filter), else the first hint."""
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    given = lambda c, hint: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c)).otherwise(hint)
    return planned.withColumns({
        "type": given("type_filter", first("type_hints")), "source": given("source_filter", first("source_hints")), "start": given("start_filter", F.col("start_hint")), "end": given("end_filter", F.col("end_hint")),
    })


def ranked_matches(index: TextIndex, query: str) -> DataFrame:
    """key and rank of the indexed texts that hold every lexeme of ``query``; stop words ask for nothing."""
    asked = index.spark.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("text"))
    return index.lookup(asked).select("key", "rank")


def exact_flags(cards: DataFrame, query: str, ids: DataFrame, people: DataFrame) -> DataFrame:
    """``cards`` with slug_exact, summary_exact, external_id_exact, person_exact (0 or 1) and exact (any).

    ``ids`` (card_uid, external_id) and ``people`` (card_uid, value) are semi
    joins of the rows that equal the query, so a hot value stays a row a card.
    """
    q = email(F.lit(query))
    of = lambda df, c, name: df.filter(F.lower(c) == q).select(F.col("card_uid").alias("uid")).distinct().withColumn(name, F.lit(1))
    out = cards.join(of(ids, "external_id", "external_id_exact"), "uid", "left").join(of(people, "value", "person_exact"), "uid", "left")
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    out = out.withColumns({
        "slug_exact": flag(F.lower("slug") == q), "summary_exact": flag(email(F.col("summary")) == q), "external_id_exact": F.coalesce("external_id_exact", F.lit(0)), "person_exact": F.coalesce("person_exact", F.lit(0)),
    })
    return out.withColumn("exact", F.greatest("slug_exact", "summary_exact", "external_id_exact", "person_exact"))


FLAGS = ("slug_exact", "summary_exact", "external_id_exact", "person_exact")


def lexical_candidates(flagged: DataFrame, ranks: DataFrame, limit: int) -> DataFrame:
    """Up to 2 * ``limit`` cards: found by rank (uid, rank) or exactly by slug, identifier or person.

    Each branch gives 2 * ``limit`` at most; a card of both keeps its rank.
    Order: more flags, higher rank, earlier activity, path.
    """
    flags = reduce(lambda a, b: a + b, map(F.col, FLAGS))
    by_text = flagged.join(ranks.select("uid", F.col("rank").alias("lexical_score")), "uid")
    by_text = by_text.orderBy(F.desc("lexical_score"), F.col("activity_at").desc_nulls_last(), "rel_path").limit(2 * limit)
    direct = flagged.filter("slug_exact = 1 or external_id_exact = 1 or person_exact = 1").withColumn("lexical_score", F.lit(0.0))
    direct = direct.orderBy(flags.desc(), F.col("activity_at").desc_nulls_last(), "rel_path").limit(2 * limit)
    best = merge_best(by_text.unionByName(direct), "lexical_score")
    return best.orderBy(flags.desc(), F.desc("lexical_score"), F.col("activity_at").asc_nulls_first(), "rel_path").limit(2 * limit)


def merge_best(rows: DataFrame, score: str) -> DataFrame:
    """The row of the highest ``score`` for each uid, over all subqueries (ties: the smaller path)."""
    rest = [c for c in rows.columns if c != "uid"]
    return rows.groupBy("uid").agg(F.max_by(F.struct(*rest), F.struct(score, F.col("rel_path"))).alias("m")).select("uid", "m.*")


def type_prior(card_type: Column) -> Column:
    return F.coalesce(*(F.when(card_type.isin(*kinds), F.lit(p)) for p, kinds in PRIORS.items()), F.lit(OTHER_PRIOR))


def provenance(source_fields: Column, deterministic: tuple[str, ...]) -> Column:
    """unknown, deterministic (the body, or only fields that no model writes), llm_derived or mixed."""
    held = F.filter(source_fields, lambda f: f != "")
    sure = F.size(F.array_except(held, F.array(*map(F.lit, deterministic)))) == 0
    return (
        F.when(F.coalesce(F.size(held), F.lit(0)) <= 0, "unknown").when(F.array_contains(held, "body") | sure, "deterministic")
        .when(F.arrays_overlap(held, F.array(*map(F.lit, MODEL_FIELDS))), "llm_derived").otherwise("mixed")
    )


def provenance_bonus(label: Column) -> Column:
    return F.coalesce(*(F.when(label == k, F.lit(v)) for k, v in BONUS.items()), F.lit(0.0))


def recency(rows: DataFrame, at: str = "activity_at", path: str = "rel_path", most: float = 0.06) -> DataFrame:
    """``rows`` (one query's candidates) with recency: by rank among the dated ones, newest first; 0 for the others."""
    dated = F.col(at).isNull()
    order = Window.partitionBy(dated).orderBy(F.col(at).desc(), F.col(path).desc())
    n = F.count("*").over(Window.partitionBy(dated))
    return rows.withColumn("recency", F.when(dated, 0.0).otherwise(F.round((1 - (F.row_number().over(order) - 1) / F.greatest(n - 1, F.lit(1))) * most, 6)))


def vector_candidates(chunks: DataFrame, limit: int, deterministic: tuple[str, ...]) -> DataFrame:
    """The ``limit`` cards of the best chunks, with their composite score.

    ``chunks`` (uid, rel_path, type, summary, activity_at, chunk_type,
    chunk_index, source_fields, content, similarity) are the nearest ones. A
    card's best chunk speaks for it; the score is 1.35 times its similarity
    plus prior, recency, provenance and 0.025 for each further chunk (0.1 at
    most), and orders the cards that the similarity has chosen.
    """
    best = F.max_by(F.struct("chunk_type", "chunk_index", "source_fields", F.left("content", F.lit(160)).alias("preview")), F.struct(F.col("similarity"), -F.col("chunk_index")))
    cards = chunks.groupBy("uid").agg(
        F.count("*").alias("matched_chunks"), F.max("similarity").alias("similarity"), best.alias("b"), F.first("rel_path").alias("rel_path"), F.first("type").alias("type"),
        F.first("summary").alias("summary"), F.first("activity_at").alias("activity_at"),
    ).orderBy(F.desc("similarity"), "rel_path").limit(limit)
    told = recency(cards.select("*", "b.*").drop("b")).withColumn("provenance", provenance(F.col("source_fields"), deterministic))
    more = F.least(F.greatest(F.col("matched_chunks") - 1, F.lit(0)) * 0.025, F.lit(0.1))
    score = F.col("similarity") * 1.35 + type_prior(F.col("type")) + F.col("recency") + provenance_bonus(F.col("provenance")) + more
    return told.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "rel_path")


def anchors(lexical: DataFrame) -> DataFrame:
    return lexical.filter("exact = 1").select("uid")


COMPONENTS = ("exact_boost", "lexical_component", "vector_component", "multi_signal_boost", "graph_boost", "type_prior", "recency", "provenance")


def fuse(lexical: DataFrame, vector: DataFrame, trust: DataFrame) -> DataFrame:
    """The union of both sides' cards with each component of the score, and the score.

    ``lexical`` (uid, rel_path, type, summary, activity_at, lexical_score,
    exact), ``vector`` (uid, rel_path, type, summary, activity_at, similarity,
    provenance label, chunk_type, chunk_index), ``trust`` (uid, trust) of
    neighbours. Provenance is the chunk's where there is one, else that of an
    exact (0.08) or other lexical hit (0.04). Trust counts only for cards that
    aren't exact; neighbours that neither side found aren't added.
    """
    shared = ("rel_path", "type", "summary", "activity_at")
    a = lexical.select("uid", "lexical_score", "exact", *(F.col(c).alias(f"_a{c}") for c in shared))
    b = vector.select("uid", "similarity", F.col("provenance").alias("label"), "chunk_type", "chunk_index", *(F.col(c).alias(f"_b{c}") for c in shared))
    j = a.join(b, "uid", "full_outer").join(trust, "uid", "left")
    both = F.col("lexical_score").isNotNull() & F.col("similarity").isNotNull()
    how = F.when(both, "hybrid").when(F.col("lexical_score").isNotNull(), "lexical").otherwise("vector")
    exact, lex, sim = F.coalesce("exact", F.lit(0)), F.coalesce("lexical_score", F.lit(0.0)), F.coalesce("similarity", F.lit(0.0))
    rows = j.select("uid", *(F.coalesce(f"_a{c}", f"_b{c}").alias(c) for c in shared), how.alias("matched_by"), exact.alias("exact"), lex.alias("lexical_score"), sim.alias("similarity"),
                    "label", "chunk_type", "chunk_index", F.when(exact == 1, 0.0).otherwise(F.coalesce("trust", F.lit(0.0))).alias("trust"))
    hit = F.when(F.col("exact") == 1, 0.08).otherwise(0.04)
    parts = recency(rows).withColumns({
        "exact_boost": F.when(F.col("exact") == 1, 3.0).otherwise(0.0),
        "lexical_component": F.round(F.least("lexical_score", F.lit(1.5)) * F.when(F.col("exact") == 1, 1.4).otherwise(1.2), 6),
        "vector_component": F.round(F.col("similarity") * 1.2, 6), "multi_signal_boost": F.when(F.col("matched_by") == "hybrid", 0.2).otherwise(0.0),
        "graph_boost": F.round(0.22 * F.col("trust"), 6), "type_prior": type_prior(F.col("type")), "provenance": F.when(F.col("label").isNotNull(), provenance_bonus(F.col("label"))).otherwise(hit),
    })
    return parts.withColumn("score", F.round(reduce(lambda x, y: x + y, map(F.col, COMPONENTS)), 6))


RANK = (F.desc, "score"), (F.desc, "exact"), (F.desc, "similarity"), (F.desc, "lexical_score"), (F.asc, "rel_path")


def _rank() -> list[Column]:
    return [order(c) for order, c in RANK]


def final_rank(fused: DataFrame, limit: int) -> DataFrame:
    """The best ``limit``: by score, exactness, similarity, lexical score, path."""
    return fused.orderBy(*_rank()).limit(limit)


def explain(fused: DataFrame) -> DataFrame:
    """``fused`` with why_ranked, the component of the largest size, and winning_chunk (null for the chunk of index 0, as for none)."""
    each = F.array(*(F.struct(F.abs(F.col(c)).alias("size"), F.lit(-i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(COMPONENTS)))
    chunk = F.when(F.coalesce("chunk_index", F.lit(0)) > 0, F.concat_ws(":", "chunk_type", "chunk_index"))
    return fused.withColumns({"why_ranked": F.array_max(each)["name"], "winning_chunk": chunk})


def blend(rows: DataFrame, top_k: int) -> DataFrame:
    """Candidates in final order after reranking: rank, score, rerank_score, rerank_contribution.

    Of the first ``top_k`` rows by score the new score is a mean of the old
    one and four times rerank_score, the old one weighing 0.75 for the first
    three, 0.60 up to the tenth, then 0.40; exact ones never lose. They are
    sorted anew; the others follow as they were.
    """
    at = F.row_number().over(Window.orderBy(*_rank()))  # one query's candidates
    w = F.when(F.col("r") <= 3, 0.75).when(F.col("r") <= 10, 0.60).otherwise(0.40)
    mixed = w * F.col("score") + (1 - w) * F.col("rerank_score") * 4
    mixed = F.when(F.col("exact") == 1, F.greatest(mixed, F.col("score"))).otherwise(mixed)
    told = rows.withColumn("r", at).withColumn("tail", F.col("r") > top_k)
    new = F.when(F.col("tail"), F.col("score")).otherwise(F.round(mixed, 6))
    told = told.withColumns({"rerank_contribution": F.round(new - F.col("score"), 6), "score": new})
    order = Window.orderBy("tail", F.when(F.col("tail"), F.col("r")), *_rank())
    return told.withColumn("rank", F.row_number().over(order)).drop("r", "tail")


def context_text(card_type: Column, summary: Column, sources: Column, people: Column, orgs: Column, times: Column, tables: Column) -> Column:
    """What an embedding or a reranker is told of a card, a line for each part that isn't empty."""
    line = lambda name, text: F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.concat(F.lit(f"{name}: "), text))
    some = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    span = F.left(F.array_join(F.filter(times, lambda t: t != ""), " — "), F.lit(120))
    return F.concat_ws("\n", line("type", F.trim(card_type)), line("summary", F.left(F.trim(summary), F.lit(400))), line("sources", some(sources, 12)), line("people", some(people, 12)), line("orgs", some(orgs, 12)),
                       line("time", span), line("projections", some(tables, 8)))


def context_prefix(text: Column) -> Column:
    return F.when(text != "", F.concat(text, F.lit("\n---\n"))).otherwise("")


def gaps(results: DataFrame, asked_types: Column, query: str = "query_id") -> DataFrame:
    """query_id, gap and detail of each query whose answers leave a gap: no_results, sparse_results (fewer than 3), type_mismatch (asked types, sorted, that no answer has).

    ``results`` has a row a query: query_id, n, found_types and asked types.
    """
    lost = F.array_sort(F.array_except(asked_types, F.coalesce("found_types", F.array().cast("array<string>"))))
    n = F.coalesce("n", F.lit(0))
    gap = lambda test, name, detail: F.when(test, F.struct(F.lit(name).alias("gap"), detail.alias("detail")))
    each = F.array_compact(F.array(gap(n == 0, "no_results", F.lit("")), gap((n > 0) & (n < 3), "sparse_results", n.cast("string")), gap((n > 0) & (F.size(lost) > 0), "type_mismatch", F.array_join(lost, ","))))
    return results.select(query, F.explode(each).alias("g")).select(query, "g.*")
