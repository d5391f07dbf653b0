"""Nearest neighbours by cosine: vantage-point trees per shard, pruned by the triangle inequality times a factor."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import finite, materialize, smallest_by_hash, vector_length

#: Rows of a shard (about: rows are dealt by hash), most cells, rows of a leaf, queries searched together.
SHARD_ROWS, CELLS, LEAF, QUERIES = 8_192, 1_024, 128, 512

#: Rounding that a distance between unit vectors may carry.
SLACK = 1e-6

FOUND = "query bigint, query_id bigint, id bigint, score double"


@dataclass(frozen=True)
class Index:
    """``rows``: (row, id, vector, cell, away) of every indexed row; ``trees``: (cell, part, tree) a row for each shard; pivots and bounds by cell."""

    rows: DataFrame
    trees: DataFrame
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray
    length: int


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision times a power of two each, which changes no cosine, so that squares neither vanish nor overflow."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one."""
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``a`` with rows of ``b``, each pair computed alike wherever it stands, so equal vectors score equally."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def apart(cosine: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, in which the triangle inequality holds."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def matrix(vectors: pa.Array, length: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


class Tree:
    """A vantage-point tree over some rows as plain arrays.

    A node holds a vantage point and halves its rows by their rank of distance
    to it, with the least and largest distance of each half; ties in distance
    are halved like others, so copies of one vector don't deepen it.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        units, order, nodes = unit(vectors), np.arange(len(vectors)), []
        rng = np.random.default_rng(len(vectors))
        stack = [(0, len(order), -1, 0)]
        while stack:
            start, stop, parent, side = stack.pop()
            if parent >= 0:
                nodes[parent][7 + side] = len(nodes)
            if stop - start <= leaf:
                nodes.append([start, stop, -1, 0, 0, 0, 0, -1, -1])
                continue
            own = order[start:stop]
            tried = rng.choice(own, 8, replace=False)
            spread = apart(np.clip(units[rng.choice(own, min(len(own), 256), replace=False)] @ units[tried].T, -1, 1)).std(0)
            vantage = tried[int(spread.argmax())]
            away = apart(np.clip(units[own] @ units[vantage], -1, 1))
            rank, middle = np.argsort(away, kind="stable"), (stop - start) // 2
            order[start:stop], away = own[rank], away[rank]
            nodes.append([start, stop, vantage, away[0], away[middle - 1], away[middle], away[-1], -1, -1])
            stack += [(start, start + middle, len(nodes) - 1, 0), (start + middle, stop, len(nodes) - 1, 1)]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.nodes = np.array([[n[0], n[1], place[n[2]] if n[2] >= 0 else -1, *n[3:]] for n in nodes], np.float64)
        self.vectors, self.ids, self.rows = vectors[order], ids[order], rows[order]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, nodes=self.nodes, vectors=self.vectors, ids=self.ids, rows=self.rows)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree, held = object.__new__(cls), np.load(io.BytesIO(data))
        for name in ("nodes", "vectors", "ids", "rows"):
            setattr(tree, name, held[name])
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's ``k`` nearest rows but ``own``, among those nearer than ``limit`` (distance) or as near."""
        self.units, self.queries, self.asked, self.own, self.k, self.factor = unit(self.vectors), queries, unit(queries), own, k, factor
        self.limit = limit.astype(np.float64).copy()
        self.score, self.found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        if len(self.vectors):
            self._visit(0, np.arange(len(queries)))
        query, slot = np.nonzero(self.found >= 0)
        return query, self.ids[self.found[query, slot]], self.score[query, slot]

    def _visit(self, at: int, asked: np.ndarray) -> None:
        start, stop, vantage, *bounds, left, right = self.nodes[at]
        if not len(asked):
            return
        if left < 0:
            return self._scan(int(start), int(stop), asked)
        away = apart(np.clip(self.asked[asked] @ self.units[int(vantage)], -1, 1))
        inner, outer = (np.maximum(np.maximum(bounds[i] - away, away - bounds[i + 1]), 0) for i in (0, 2))
        near = inner <= outer  # each query's nearer half first, then what its bound still allows
        self._visit(int(left), asked[near & self._open(asked, inner)])
        self._visit(int(right), asked[self._open(asked, outer)])
        self._visit(int(left), asked[~near & self._open(asked, inner)])

    def _open(self, asked: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return bound <= self.factor * self.limit[asked] + SLACK

    def _scan(self, start: int, stop: int, asked: np.ndarray) -> None:
        """Products of unit vectors choose the pairs that may enter; their scores come from the vectors as given."""
        like = self.asked[asked] @ self.units[start:stop].T
        like[self.own[asked][:, None] == self.rows[None, start:stop]] = -np.inf
        least = self.score[asked, -1]
        if stop - start > self.k:
            least = np.maximum(least, np.partition(like, -self.k, 1)[:, -self.k])
        with np.errstate(invalid="ignore"):
            query, hit = np.nonzero((like >= least[:, None] - 1e-9) & np.isfinite(like))
        if not len(query):
            return
        query, hit = asked[query], hit + start
        score = np.concatenate([cosines(self.queries[query[i : i + 8_192]], self.vectors[hit[i : i + 8_192]]) for i in range(0, len(query), 8_192)])
        query = np.concatenate([query, np.repeat(asked, self.k)])
        score = np.concatenate([score, self.score[asked].ravel()])
        hit = np.concatenate([hit, self.found[asked].ravel()])
        order = np.lexsort((np.where(hit < 0, np.iinfo(np.int64).max, self.ids[hit]), -score, query))
        query, score, hit = query[order], score[order], hit[order]
        first = np.searchsorted(query, query, "left")
        rank = np.arange(len(query)) - first
        best = rank < self.k
        self.score[query[best], rank[best]], self.found[query[best], rank[best]] = score[best], hit[best]
        full = asked[self.found[asked, -1] >= 0]
        self.limit[full] = np.minimum(self.limit[full], apart(np.clip(self.score[full, -1], -1, 1)))


def build(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD_ROWS, cells: int = CELLS) -> Index:
    """Index every usable row of ``vectors``; ids are whole numbers, the other columns stay out.

    Null, zero and non-finite vectors, those of other than the commonest
    length and rows without an id take no part. Rows go to the nearest of at
    most ``cells`` pivots, the one thing fitted on a sample: as many distinct
    vectors, of the smallest hashes, as the rows need shards. A cell of more
    than ``shard_rows`` is dealt by hash into as many shards as it needs, so
    that a third of all rows in one cell, or equal, spreads like any other.
    A task holds a shard at a time and leaves its tree as one row; all lie in
    the shared folder. Repeated ids and vectors stay as many rows.
    """
    spark = vectors.sparkSession
    value = F.col(column)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), value.alias("vector"))
    rows = rows.filter("id is not null").filter(finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    length = vector_length(rows, "vector")
    rows = rows.filter(F.size("vector") == length).withColumn("row", F.monotonically_increasing_id())
    total = rows.count()
    sample = smallest_by_hash(rows.select("vector"), min(cells, max(1, math.ceil(total / shard_rows))))
    pivots = np.array([r[0] for r in sample.orderBy("vector").collect()], np.float64).reshape(-1, max(length, 1))
    pivots = unit(pivots) if len(pivots) else pivots
    sent = spark.sparkContext.broadcast(pivots)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = unit(matrix(batch.column("vector"), length)) @ sent.value.T if batch.num_rows else np.zeros((0, 1))
            cell = like.argmax(1)
            away = apart(np.clip(like[np.arange(len(like)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    shape = rows.select("row", "id", "vector").schema.add("cell", T.LongType()).add("away", T.DoubleType())
    rows = materialize(rows.select("row", "id", "vector").mapInArrow(assigned, shape), "vectors")
    bounds = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}
    held = lambda f, empty: np.array([f(bounds[c]) if c in bounds else empty for c in range(len(pivots))])
    parts = held(lambda r: math.ceil(r["n"] / shard_rows), 0)
    part = F.pmod(F.xxhash64("row"), _by_cell(parts)[F.col("cell").cast("int")])

    def grown(key: tuple, shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        vector = shard.column("vector").chunk(0) if shard.num_rows else pa.array([], pa.list_(pa.float32()))
        flat = vector.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
        tree = Tree(flat, shard.column("id").to_numpy(), shard.column("row").to_numpy())
        return pa.table({"cell": [key[0].as_py()], "part": [key[1].as_py()], "tree": pa.array([tree.dump()], pa.binary())})

    trees = rows.withColumn("part", part).groupBy("cell", "part").applyInArrow(grown, "cell long, part long, tree binary")
    return Index(rows, materialize(trees, "trees"), pivots, held(lambda r: r["low"], np.inf), held(lambda r: r["high"], -np.inf), parts, length)


def _by_cell(values: np.ndarray) -> Column:
    """``values`` as an array literal; there are no more than cells."""
    return F.from_json(F.lit(str(values.tolist() or [1])), "array<bigint>")


def _searched(index: Index, visits: DataFrame, k: int, factor: float) -> DataFrame:
    """The ``k`` nearest found by each visit (query, query_id, vector, limit, cell, part): a task takes a shard's tree and at most about :data:`QUERIES` queries at a time."""
    counts = visits.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    blocked = visits.join(F.broadcast(counts) if int(index.parts.sum()) <= 100_000 else counts, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks"))).drop("blocks")
    trees = index.trees.join(counts, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    length = index.length

    def found(key: tuple, tree: pa.Table, asked: pa.Table) -> pa.Table:
        if not tree.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("query", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()))})
        rows, ids = asked.column("query").to_numpy(), asked.column("query_id").to_numpy()
        vectors = matrix(asked.column("vector").combine_chunks(), length)
        query, hit, score = Tree.load(tree.column("tree")[0].as_py()).search(vectors, rows, k, factor, asked.column("limit").to_numpy())
        return pa.table({"query": rows[query], "query_id": ids[query], "id": hit, "score": score})

    keys = ("cell", "part", "block")
    return trees.groupBy(*keys).cogroup(blocked.groupBy(*keys)).applyInArrow(found, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: Column, k: int = 5, factor: float = 0.25) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` indexed rows nearest to each row of the index that ``queries`` (a condition on ``id``) chooses, but itself.

    A query first searches the cell of its own pivot, then each other cell
    whose least possible distance is at most ``factor`` times that of the
    ``k``-th row found so far; within a tree likewise. That least distance
    follows from the triangle inequality, so factor 1 finds the exact
    neighbours; a smaller one leaves out more and is faster (0.25: recall above
    0.99 on unclustered vectors of 64 components). Scores are
    cosines in double precision of the vectors as given; ties go to the
    smaller id. With fewer rows than ``k``, all are returned.
    """
    part = lambda column: F.explode(F.sequence(F.lit(0).cast("long"), _by_cell(index.parts)[column.cast("int")] - 1)).alias("part")
    asked = index.rows.filter(queries).select(F.col("row").alias("query"), F.col("id").alias("query_id"), "vector", "cell")
    home = asked.withColumn("limit", F.lit(math.inf)).select("*", part(F.col("cell")))
    near = materialize(_best(_searched(index, home, k, factor), k), "nearest")
    reached = near.filter(F.col("rank") == k).select("query", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("limit"))
    pivots, low, high, length = index.pivots, index.low, index.high, index.length
    sent = asked.sparkSession.sparkContext.broadcast((pivots, low, high))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, low, high = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, limit = batch.column("cell").to_numpy(), batch.column("limit").to_numpy()
            away = apart(np.clip(unit(matrix(batch.column("vector"), length)) @ pivots.T, -1, 1))
            bound = np.maximum(np.maximum(low - away, away - high), (away - away.min(1, keepdims=True)) / 2)
            go = (bound <= factor * limit[:, None] + SLACK) & (low <= high)
            go[np.arange(len(cell)), cell] = False
            query, to = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(query)) for c in ("query", "query_id", "vector", "limit")] + [pa.array(to)], ["query", "query_id", "vector", "limit", "cell"])

    far = asked.join(reached, "query", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf))).select("query", "query_id", "vector", "limit", "cell")
    visits = far.mapInArrow(others, far.schema).select("*", part(F.col("cell")))
    more = _searched(index, visits, k, factor)
    best = _best(near.drop("rank").unionByName(more), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
