"""Vector search through coarse cells, exact search by the same plan, and links between cards that are alike."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.sources.shared import shared_folder, written

#: Vectors that the cells are fitted on for each cell, at most; rows and queries that one task compares at once; memory of all centres.
SAMPLE, ROWS, QUERIES, CENTRE_BYTES = 64, 8_192, 256, 64 << 20


def lists(rows: int) -> int | None:
    """How many cells a table of ``rows`` vectors gets: a thousandth up to a million rows, the square root beyond, ten at least; none for an empty one."""
    if rows <= 0:
        return None
    return max(rows // 1_000 if rows <= 1_000_000 else math.isqrt(rows), 10)


def _unit(vectors: pa.Array, length: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass(frozen=True)
class CellIndex:
    """``folder`` holds (key, owner, vector), a directory a cell; ``centres``: unit vectors."""

    spark: SparkSession
    folder: str
    centres: np.ndarray
    key: T.DataType

    def rows(self) -> DataFrame:
        kind = T.StructType([T.StructField("key", self.key), T.StructField("owner", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])
        return self.spark.read.schema(kind).parquet(self.folder)

    def _placed(self, rows: DataFrame, probes: int) -> DataFrame:
        """``rows`` once for each of their ``probes`` nearest cells."""
        sent, length = self.spark.sparkContext.broadcast(self.centres), self.centres.shape[1] if len(self.centres) else 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(-(_unit(batch.column("vector"), length) @ sent.value.T), axis=1, kind="stable")[:, :probes]
                    repeated = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
                    yield pa.RecordBatch.from_arrays([*repeated.columns, pa.array(near.ravel().astype(np.int32))], [*batch.schema.names, "cell"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, key, owner, similarity): the ``k`` rows nearest by cosine among those of each query's ``probes`` nearest cells (all cells: exact).

        ``queries``: query_id, owner, vector; a row of the query's own owner
        (null has none) isn't found. Ties go to the smaller key. A cell is cut
        into blocks of about :data:`ROWS` rows and :data:`QUERIES` queries, so
        a cell of a third of all rows is many tasks; each block gives its
        ``k`` best by one product of matrices.
        """
        usable_queries = usable(queries.select("query_id", F.col("owner").cast("string").alias("owner"), F.col("vector").cast("array<double>").alias("vector")), self.centres.shape[1] if len(self.centres) else 0)
        asked = self._placed(usable_queries, probes or len(self.centres))
        held = self.rows()
        blocks = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count("*") / most).alias(name))
        sizes = written(blocks(held, ROWS, "row_blocks").join(blocks(asked, QUERIES, "query_blocks"), "cell"), "cells")  # a row a cell
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        a = held.join(sizes, "cell").withColumn("r", deal("key", "row_blocks")).withColumn("q", every("query_blocks")).drop("row_blocks", "query_blocks")
        b = asked.join(sizes, "cell").withColumn("q", deal("query_id", "query_blocks")).withColumn("r", every("row_blocks")).drop("row_blocks", "query_blocks")
        kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("key", self.key), T.StructField("owner", T.StringType()), T.StructField("similarity", T.DoubleType())])
        length = self.centres.shape[1] if len(self.centres) else 0

        def nearest(rows: pa.Table, asked: pa.Table) -> pa.Table:
            rows, asked = rows.combine_chunks(), asked.combine_chunks()
            if rows.num_rows and asked.num_rows:
                like = np.round(_unit(asked.column("vector").combine_chunks(), length) @ _unit(rows.column("vector").combine_chunks(), length).T, 12)
                own = {o: i for i, o in enumerate({*rows.column("owner").to_pylist(), *asked.column("owner").to_pylist()} - {None})}
                code = lambda t, none: np.array([own.get(o, none) for o in t.column("owner").to_pylist()])
                like[code(asked, -1)[:, None] == code(rows, -2)[None, :]] = -np.inf
                order = np.argsort(np.array(rows.column("key").to_pylist()), kind="stable")
                best = order[np.argsort(-like[:, order], axis=1, kind="stable")[:, :k]]
                query, row = np.repeat(np.arange(len(best)), best.shape[1]), best.ravel()
                kept = np.isfinite(like[query, row])
                query, row = query[kept], row[kept]
                at = pa.array(row)
                return pa.table({"query_id": asked.column("query_id").take(pa.array(query)), "key": rows.column("key").take(at), "owner": rows.column("owner").take(at), "similarity": like[query, row]})
            return pa.table({"query_id": asked.column("query_id").slice(0, 0), "key": rows.column("key").slice(0, 0), "owner": rows.column("owner").slice(0, 0), "similarity": pa.array([], pa.float64())})

        found = a.groupBy("cell", "r", "q").cogroup(b.groupBy("cell", "r", "q")).applyInArrow(nearest, kinds)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "key", "owner", "similarity")


def usable(rows: DataFrame, length: int) -> DataFrame:
    """Rows whose ``vector`` has ``length`` finite components, not all zero."""
    return rows.filter((F.size("vector") == length) & F.coalesce(F.forall("vector", lambda x: x - x == 0), F.lit(False)) & F.exists("vector", lambda x: x != 0))


def build(vectors: DataFrame, folder: str | None = None, cells: int | None = None, seed: int = 42) -> CellIndex:
    """Index every usable row of ``vectors`` (key, owner, vector) by cells, :func:`lists` of them unless ``cells`` says otherwise.

    k-means by cosine is fitted on a sample of at most :data:`SAMPLE` rows a
    cell, those of the smallest key hashes; all rows are then assigned and
    written by cell. Centres are broadcast, so there are at most as many as
    :data:`CENTRE_BYTES` hold. Vectors of the commonest length count; null,
    zero and non-finite ones are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select("key", F.col("owner").cast("string").alias("owner"), F.col("vector").cast("array<double>").alias("vector")).filter("key is not null and vector is not null")
    commonest = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    length = commonest["n"] if commonest else 0
    rows = usable(rows, length)
    total = rows.count()
    many = min(cells or lists(total) or 0, total, max(1, CENTRE_BYTES // (8 * max(length, 1))))
    centres = np.zeros((0, length))
    if many:
        share = min(1.0, 1.5 * SAMPLE * many / total)  # by hash, a little above what is kept
        some = rows.filter(F.xxhash64("key") < int(-(2**63) + share * 2**64)) if share < 1 else rows
        sample = some.orderBy(F.xxhash64("key"), "key").limit(SAMPLE * many).select(array_to_vector("vector").alias("features"))
        fitted = KMeans(k=many, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample).clusterCenters() if many > 1 else [np.eye(1, length)[0]]
        centres = np.array(fitted, np.float64)
        centres /= np.sqrt((centres * centres).sum(1, keepdims=True))
    index = CellIndex(spark, folder or f"{shared_folder(spark)}/vector-cells-{uuid.uuid4().hex}", centres, rows.schema["key"].dataType)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = index._placed(rows, 1) if many else rows.withColumn("cell", F.lit(0)).filter(F.lit(False))
    placed.repartitionByRange(n, "cell", "key").write.partitionBy("cell").parquet(index.folder)
    return index


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n, hits): how many of each query's exact neighbours were found."""
    hit = found.select("query_id", "key", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "key"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))


@dataclass(frozen=True)
class Gates:
    """Which cards may be linked for likeness: ``types`` that take part, ``same_type`` those that may link among themselves, ``noise`` a pattern of summaries, ``skipped`` classifications; all parameters."""

    types: tuple[str, ...]
    same_type: tuple[str, ...] = ()
    noise: str = ""
    skipped: tuple[str, ...] = ()

    def passes(self, cards: DataFrame, classes: DataFrame | None) -> DataFrame:
        kept = cards.filter(F.col("type").isin(*self.types))
        kept = kept.filter(~F.coalesce("summary", F.lit("")).rlike(self.noise)) if self.noise else kept
        junk = classes.filter(F.lower(F.trim("category")).isin(*self.skipped)).select("uid").distinct() if classes is not None and self.skipped else None
        return kept.join(junk, "uid", "left_anti") if junk is not None else kept


def semantic_links(
    chunks: DataFrame, cards: DataFrame, edges: DataFrame, prior: DataFrame, gates: Gates, classes: DataFrame | None = None, k: int = 10, threshold: float = 0.7, over: int = 3, fan_out: int = 10,
    index: CellIndex | None = None, probes: int | None = None,
) -> DataFrame:
    """(uid, target_uid, similarity): up to ``k`` cards nearest to each card's mean chunk, for all cards at once.

    ``chunks`` (key, uid, vector), ``cards`` (uid, type, summary), ``edges``
    and ``prior`` candidates (source_uid, target_uid; known in either direction), ``classes``
    (uid, category). For each card ``k * over * fan_out`` chunks of other
    cards are fetched, each card's nearest chunk speaks for it, and of the
    ``k * over`` nearest at or above ``threshold`` those that have an edge or
    are candidates, that the ``gates`` stop, or of one type that may not link
    to itself are left out. Ties go to the smaller uid.
    """
    index = index or build(chunks.select("key", F.col("uid").alias("owner"), "vector"))
    able = gates.passes(cards, classes).select("uid", "type")
    means = chunks.filter("vector is not null").select("uid", F.posexplode("vector").alias("i", "x")).groupBy("uid", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = means.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))  # as long as a vector
    sources = written(centre.join(able.select("uid"), "uid", "left_semi").select(F.col("uid").alias("query_id"), F.col("uid").alias("owner"), "vector"), "sources")
    fetched = index.search(sources, k * over * fan_out, probes)
    best = fetched.groupBy("query_id", "owner").agg(F.max("similarity").alias("similarity")).filter(F.col("similarity") >= threshold)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "owner")
    near = best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k * over).select(F.col("query_id").alias("uid"), F.col("owner").alias("target_uid"), "similarity")
    both = lambda df: df.select(F.col("source_uid").alias("uid"), "target_uid").unionByName(df.select(F.col("target_uid").alias("uid"), F.col("source_uid").alias("target_uid")))
    known = both(edges).unionByName(both(prior)).distinct()
    open_ = near.join(known, ["uid", "target_uid"], "left_anti").join(able, "uid").join(able.select(F.col("uid").alias("target_uid"), F.col("type").alias("target_type")), "target_uid")
    open_ = open_.filter((F.col("type") != F.col("target_type")) | F.col("type").isin(*gates.same_type)) if gates.same_type else open_.filter("type <> target_type")
    last = Window.partitionBy("uid").orderBy(F.desc("similarity"), "target_uid")
    return open_.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= k).select("uid", "target_uid", F.round("similarity", 6).alias("similarity"))
