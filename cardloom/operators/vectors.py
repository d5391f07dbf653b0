"""Chunks, embeddings and exact vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def knn(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """The ``limit`` vectors nearest to a query by cosine, exactly; top-k by partition, then of all."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("*", F.round(cosine(F.col(col), q), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(limit)


def collapse_to_cards(hits: DataFrame, card: str) -> DataFrame:
    """Per card: matched chunks and the best one (ties: the smaller chunk)."""
    return hits.groupBy(card).agg(F.count("*").alias("matched"), F.max("similarity").alias("best"), F.min_by("vec_id", F.struct(-F.col("similarity"), "vec_id")).alias("best_chunk"))


def token_count(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def chunk_key(uid: Column, kind: Column, index: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws(":", uid, kind, index.cast("string"), digest), 256)


def backlog(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_key") -> DataFrame:
    return chunks.join(embeddings.select(key).distinct(), key, "left_anti")


def garbage(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_key") -> DataFrame:
    return embeddings.join(chunks.select(key).distinct(), key, "left_anti")


def embed_context(cards: DataFrame, bridges: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per card and bridge the sorted values, joined by ``|``; empty without any."""
    out = cards.select("uid")
    for name, (bridge, value) in bridges.items():
        held = bridge.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_list(value)), "|").alias(name))
        out = out.join(held, "uid", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def centroids(vectors: DataFrame, by: str, col: str = "embedding") -> DataFrame:
    """Mean vector per ``by``, a row per dimension."""
    return vectors.select(by, F.posexplode(col).alias("dim", "x")).groupBy(by, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def hash_embedding(text: Column, dimension: int) -> Column:
    """A vector that depends on the text's bytes alone: pairs of bytes of SHA-256(text, counter) on a scale from -1 to 1.

    Null counts as empty.
    """
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")

    def values(counter: Column) -> Column:
        digest = F.sha2(F.concat(data, F.unhex(F.lpad(F.hex(counter), 8, "0"))), 256)
        pairs = F.regexp_extract_all(digest, F.lit("(.{4})"), F.lit(1))
        return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("double") / 65535.0 * 2.0 - 1.0)

    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.lit((dimension - 1) // 16).cast("long")), values)
    return F.slice(F.flatten(blocks), 1, dimension)
