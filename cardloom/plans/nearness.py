"""Archive queries for vector cells, batch links between cards that are alike, and names that are alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import cells
from cardloom.plans.catalog import register
from cardloom.sources.bridge import table

_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_VECTORS = "v AS (SELECT vec_id, 'card-' || vec_id % 100 AS uid, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"


def _rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.concat(F.lit("card-"), F.col("vec_id") % 100).alias("owner"), F.col("embedding").alias("vector"))


def _asked(spark, d):
    return _rows(spark, d).filter("key % 20 = 0").withColumnRenamed("key", "query_id")


@register("vector_cells_exact", f"""WITH {_VECTORS}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS key, round({_COSINE}, 12) AS s FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM s) SELECT query_id, key, rank, round(s, 6) AS similarity FROM r WHERE rank <= 10""")
def _(spark, d):
    found = cells.build(_rows(spark, d)).search(_asked(spark, d), 10)
    return found.select("query_id", "key", "rank", F.round("similarity", 6).alias("similarity"))


@register("vector_cells_recall")
def _(spark, d):
    """Of each query's ten exact neighbours, how many eight of every ten cells hold: these vectors have no clusters, so few cells would lose many."""
    index = cells.build(_rows(spark, d))
    return cells.recall(index.search(_asked(spark, d), 10, max(1, -(-8 * len(index.centres) // 10))), index.search(_asked(spark, d), 10))


_CARDS = "SELECT DISTINCT vec_id % 100 AS i FROM embeddings"
_TYPE = "CASE i % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'email_thread' WHEN 2 THEN 'person' ELSE 'meeting_transcript' END"
_GATES = cells.Gates(types=("document", "email_thread", "meeting_transcript"), same_type=("document",), noise="^Monthly ", skipped=("marketing",))


@register("semantic_links", f"""WITH {_VECTORS}, c AS (SELECT 'card-' || i AS uid, {_TYPE} AS type FROM ({_CARDS}) WHERE i % 9 <> 0 AND i % 11 <> 3 AND i % 4 <> 2),
 m AS (SELECT uid, list(x ORDER BY i) AS v FROM (SELECT uid, i, avg(v[i]) AS x FROM v, range(1, 65) t(i) GROUP BY uid, i) GROUP BY uid),
 s AS (SELECT a.uid, b.uid AS target_uid, b.vec_id, round({_COSINE}, 12) AS s FROM m a JOIN v b ON a.uid <> b.uid WHERE a.uid IN (SELECT uid FROM c)),
 f AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY s DESC, vec_id) AS r FROM s), p AS (SELECT uid, target_uid, max(s) AS s FROM f WHERE r <= 90 GROUP BY ALL HAVING max(s) >= 0.1),
 n AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY s DESC, target_uid) AS r FROM p),
 e AS (SELECT 'card-' || i AS a, 'card-' || (i * 7) % 100 AS b FROM ({_CARDS}) UNION ALL SELECT 'card-' || (i * 3) % 100, 'card-' || i FROM ({_CARDS})), k AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 o AS (SELECT n.*, row_number() OVER (PARTITION BY n.uid ORDER BY n.s DESC, n.target_uid) AS q FROM n JOIN c x ON x.uid = n.uid JOIN c y ON y.uid = n.target_uid
  WHERE n.r <= 9 AND (x.type <> y.type OR x.type = 'document') AND NOT EXISTS (SELECT 1 FROM k WHERE k.a = n.uid AND k.b = n.target_uid)) SELECT uid, target_uid, round(s, 6) AS similarity FROM o WHERE q <= 3""")
def _(spark, d):
    ids = table(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("i")).distinct()
    card = lambda e: F.concat(F.lit("card-"), F.expr(e).cast("string"))
    told = ids.select(card("i").alias("uid"), F.expr(_TYPE).alias("type"), F.when(F.col("i") % 9 == 0, "Monthly report").otherwise("Notes").alias("summary"))
    classes = ids.select(card("i").alias("uid"), F.when(F.col("i") % 11 == 3, " Marketing").otherwise("personal").alias("category"))
    edges, prior = ids.select(card("i").alias("source_uid"), card("(i * 7) % 100").alias("target_uid")), ids.select(card("(i * 3) % 100").alias("source_uid"), card("i").alias("target_uid"))
    chunks = _rows(spark, d).withColumnRenamed("owner", "uid")
    return cells.semantic_links(chunks, told, edges, prior, _GATES, classes, k=3, threshold=0.1)
