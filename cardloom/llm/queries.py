"""One query for each numbered operator, over its whole table, and DuckDB SQL where that can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import bpe, codebooks, decontam, licenses, lm, omh, quality, simhash, toxicity, trie, urlfilter, vptree, warc
from cardloom.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(by))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs)).select("doc_id", "quality", "keep")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.edited_likeness(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.flatten(F.transform("places", lambda p: p["starts"]))
    base = F.transform(F.filter("places", lambda p: F.size(p["starts"]) > 0), lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(best).alias("score"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=4).select("doc_id", "fingerprint", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(remainder("doc_id", 4) != 2)
    model = toxicity.fit(toxicity.labelled(docs, labels))
    return toxicity.score(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 5) == 1)
    fitted = lm.fit(docs.filter("not held_out"))
    return lm.score(docs, fitted).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), "overlap")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered(table(spark, sf_dir, "conversations"))
    return trie.build(*trie.grafted(turns, base=F.col("conv_id") - F.col("conv_id") % 5, heads=remainder("conv_id", 9), most=8))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = codebooks.fit(vectors)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return codebooks.with_label_error(codebooks.encode(vectors, books)).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = vptree.build(table(spark, sf_dir, "embeddings"))
    return vptree.search(index, F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_byte_bpe, op3_quality, op4_order_minhash, op5_license_scan, op6_url_filter, op7_simhash, op8_toxicity,
    op9_lm_score, op10_decontaminate, op11_prefix_trie, op12_vector_codes, op13_vp_tree,
)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_sql, values)) + "]"


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS sha FROM p),
b AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(sha, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to,
  CASE WHEN first = page_id THEN true END AS digest_ok
FROM b
"""


def license_sql(phrases=licenses.PHRASES, notices=licenses.NOTICES) -> str:
    step = max(len(t.words) for t in (*phrases, *notices))
    places = ",\n".join(
        f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f'w[i + {j + 1}] = {_sql(x)}' for j, x in enumerate(t.words))}) AS p{k}"
        for k, t in enumerate(phrases)
    )
    shares = ",\n".join(
        f"coalesce(list_max(list_transform(range(0, greatest(((len(w) + {step - 1}) // {step}), 1)), lambda b: "
        f"len(list_intersect(list_distinct(w[b * {step} + 1 : b * {step} + {2 * step}]), {_list(sorted(set(t.words)))})))), 0) / {len(set(t.words))}.0::DOUBLE AS s{k}"
        for k, t in enumerate(notices)
    )
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN {_sql(t.label)} END" for k, t in enumerate(phrases))
    own = ", ".join(f"CASE WHEN s{k} >= {t.needed}.0 / {len(set(t.words))} - 1e-9 THEN {_sql(t.label)} END" for k, t in enumerate(notices))
    best = ", ".join(f"CASE WHEN s{k} >= {t.needed}.0 / {len(set(t.words))} - 1e-9 THEN s{k} ELSE 0.0 END" for k, t in enumerate(notices))
    starts = "flatten([" + ", ".join(f"p{k}" for k in range(len(phrases))) + "])"
    kept = lambda labels: f"coalesce(list_aggregate(list_sort(list_distinct(list_filter([{labels}], lambda x: x IS NOT NULL))), 'string_agg', ','), '')"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n_words, {places}, {shares} FROM t)
SELECT doc_id, n_words::BIGINT AS n_words, len({starts})::BIGINT AS n_base, list_min({starts})::BIGINT AS first_word, list_max({starts})::BIGINT AS last_word,
  {kept(base)} AS base_labels, {kept(base + ', ' + own)} AS labels,
  CASE WHEN len({starts}) > 0 THEN 1.0 ELSE greatest({best}) END::DOUBLE AS score
FROM f
"""


def url_sql(places=urlfilter.PLACES, patterns=urlfilter.PATTERNS, default: str = "allow") -> str:
    fits = "\n".join(
        f"UNION ALL SELECT page_id, {_sql(r.name)} AS name, {_sql(r.verdict)} AS verdict, {str(r.base).lower()} AS base "
        f"FROM u WHERE regexp_matches({'host || path' if r.base else 'host || lower_rest'}, {_sql(r.pattern)})"
        for r in (*places, *patterns)
    ).removeprefix("UNION ALL ")
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(.*)$', 1), ''), '{UPPER}', '{LOWER}') AS lower_rest FROM pages),
f AS ({fits}),
g AS (SELECT page_id, base, name, verdict, row_number() OVER (PARTITION BY page_id, base ORDER BY length(name) DESC, name) AS r FROM f)
SELECT u.page_id, u.host, u.path, a.name AS rule, coalesce(a.verdict, b.verdict, {_sql(default)}) AS verdict
FROM u LEFT JOIN g a ON a.page_id = u.page_id AND a.base AND a.r = 1 LEFT JOIN g b ON b.page_id = u.page_id AND NOT b.base AND b.r = 1
"""


TRIE_SQL = """
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place, digest, n_bytes
  FROM (SELECT conv_id, turn, sha256(length(r)::VARCHAR || ':' || r || x) AS digest, strlen(x) AS n_bytes
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL))),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
  (xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda acc, x: xor((xor(acc, x) >> 1), (3988292384 * (xor(acc, x) & 1))), 4294967295::BIGINT), 4294967295::BIGINT) % 9)::BIGINT AS h FROM o GROUP BY conv_id),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
g AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS lent FROM c LEFT JOIN n b ON b.conv_id = c.base),
w AS (SELECT g.conv_id, o.place - g.h + g.lent AS depth, o.digest, o.n_bytes FROM o JOIN g ON o.conv_id = g.conv_id WHERE o.place > g.h
  UNION ALL SELECT g.conv_id, o.place, o.digest, o.n_bytes FROM o JOIN g ON o.conv_id = g.base WHERE o.place <= g.h),
k AS (SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS key, n_bytes,
  count(*) OVER (PARTITION BY conv_id) AS last FROM w
  UNION ALL SELECT g.conv_id, 0, '', 0, (SELECT count(*) FROM w WHERE w.conv_id = g.conv_id) FROM g),
m AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '') AS ends FROM k GROUP BY depth, key),
p AS (SELECT m.*, (SELECT count(*) FROM m x WHERE x.depth = m.depth + 1 AND starts_with(x.key, m.key)) AS n_children FROM m)
SELECT a.conv_id, a.depth::BIGINT AS depth, any_value(q.conv_id) AS parent_conv_id, a.n_convs, a.n_children,
  count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.n_bytes)::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM p a JOIN p b ON b.depth >= a.depth AND starts_with(b.key, a.key)
LEFT JOIN m q ON q.depth = a.depth - 1 AND q.key = substr(a.key, 1, 64 * (a.depth - 1)::BIGINT)
GROUP BY a.key, a.conv_id, a.depth, a.n_convs, a.n_children, a.ends
"""


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    nearest = lambda books: (
        "SELECT vec_id, label, part, x, min(struct_pack(d := d, entry := entry)) AS best FROM (SELECT v.*, b.entry, "
        f"list_sum(list_transform(range(1, len(x) + 1), lambda i: (v.x[i] - b.c[i]) * (v.x[i] - b.c[i])))::BIGINT AS d FROM v JOIN {books} b USING (part)) GROUP BY ALL"
    )
    steps = "".join(
        f"""a{k} AS MATERIALIZED ({nearest(f'b{k}')}),
m{k} AS (SELECT part, best.entry AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, (SELECT max(len(x)) + 1 FROM v)) t(i) GROUP BY ALL),
n{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN n{k} USING (part, entry)),
""" for k in range(rounds))
    return f"""
WITH t AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, part, w[part * len(w) // {parts} + 1 : (part + 1) * len(w) // {parts}] AS x FROM t, range({parts}) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM v QUALIFY entry < {entries}),
{steps}f AS ({nearest(f'b{rounds}')}),
e AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM f GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(list_aggregate(c::VARCHAR[], 'string_agg', ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM e
"""


ORACLE = {"op1_warc": OP1_SQL, "op5_license_scan": license_sql(), "op6_url_filter": url_sql(), "op11_prefix_trie": TRIE_SQL, "op12_vector_codes": codes_sql()}
