"""Product quantisation of vectors in whole numbers: a codebook for each part of a vector, exact and the same on every machine."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import finite, fresh, materialize, vector_length

#: Vectors whose distances to all entries are held at once.
ROWS = 2_048

#: Whole components below this in absolute value keep all sums of squares and products exact in 64 bits.
MOST = 1 << 28


@dataclass(frozen=True)
class Codebooks:
    """``entries``: int64 array of (parts, entries, width); ``scale``: a component becomes floor(scale * x)."""

    entries: np.ndarray
    scale: int

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_parts(vectors: pa.Array, parts: int, scale: int) -> np.ndarray:
    """(parts, rows, width) of whole numbers from equally long vectors."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale)
    if len(whole) and np.abs(whole).max() >= MOST:
        raise ValueError(f"components of {MOST // scale} or more can't be coded exactly")
    return np.ascontiguousarray(whole.astype(np.int64).reshape(len(vectors), parts, -1).swapaxes(0, 1))


def nearest(whole: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By part and row the nearest entry (ties: the first) and its squared distance: |x|^2 - 2 x.c + |c|^2 in int64."""
    away = whole @ entries.swapaxes(1, 2)
    away *= -2
    away += (entries * entries).sum(2)[:, None, :]
    codes = away.argmin(2)
    return codes, np.take_along_axis(away, codes[:, :, None], 2)[:, :, 0] + (whole * whole).sum(2)


def codable(vectors: DataFrame, column: str, parts: int) -> tuple[DataFrame, int]:
    """Rows of ``vectors`` that can be coded, and their vectors' length.

    Null vectors and those with null or non-finite components go. So do
    lengths that ``parts`` doesn't divide or other than the commonest left:
    codebooks are of one length.
    """
    kept = vectors.filter(finite(F.col(column)))
    length = vector_length(kept, column, parts)
    return kept.filter(F.size(column) == length), length


def fit(vectors: DataFrame, column: str = "embedding", order: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of ``parts`` parts, started from the ``entries`` rows of smallest ``order`` (nulls last, ties by vector; fewer rows: fewer entries).

    Each round assigns every part of every row and replaces each entry by the
    componentwise floor of its parts' mean; unused entries stay. The
    codebooks (bounded by the parameters) are broadcast; a task sums its rows
    by entry, a grouped shuffle merges the sums, and the driver gets a row
    for each entry. A table without codable rows gives empty codebooks.
    """
    kept, length = codable(vectors.select(F.col(order).alias("order"), F.col(column).alias("vector")), "vector", parts)
    width = length // parts
    first = kept.orderBy(F.asc_nulls_last("order"), "vector").limit(entries).select("vector").collect() if length else []
    books = whole_parts(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), parts, scale) if first else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if first else 0):
        books = _moved(kept, books, scale)
    return Codebooks(books, scale)


def _moved(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    parts, many, width = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sent.value
        sums, counts, part = np.zeros_like(entries), np.zeros((parts, many), np.int64), np.arange(parts)[:, None]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                whole = whole_parts(batch.column(0).slice(start, ROWS), parts, scale)
                codes, _ = nearest(whole, entries)
                np.add.at(sums, (part, codes), whole)
                np.add.at(counts, (part, codes), 1)
        used = np.nonzero(counts)
        columns = [pa.array(used[0]), pa.array(used[1]), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    held = kept.select("vector").mapInArrow(summed, "part long, entry long, n long, sums array<long>")
    merged = held.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    moved = books.copy()
    for r in merged.collect():  # a row an entry at most
        moved[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    sent.unpersist()
    return moved


def encode(vectors: DataFrame, books: Codebooks, column: str = "embedding") -> DataFrame:
    """Codable rows of ``vectors`` with their columns, ``codes`` (an entry for each part) and ``error`` (squared distances summed over parts) in place of the vector.

    A column of ``vectors`` with an output's name gives way.
    """
    kept = vectors.filter(finite(F.col(column)) & (F.size(column) == books.length) & F.lit(books.length > 0))
    rest = [c for c in kept.columns if c.lower() not in (column.lower(), "codes", "error")]
    vector = fresh(kept, "vector")
    sent, scale, parts = kept.sparkSession.sparkContext.broadcast(books.entries), books.scale, books.entries.shape[0]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                codes, error = nearest(whole_parts(piece.column(vector), parts, scale), sent.value)
                told = pa.FixedSizeListArray.from_arrays(pa.array(codes.T.ravel().astype(np.int32)), parts).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), told, pa.array(error.sum(0))], [*rest, "codes", "error"])

    shape = kept.select(*(F.col(f"`{c}`") for c in rest)).schema.add("codes", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    return kept.select(*(F.col(f"`{c}`") for c in rest), F.col(column).alias(vector)).mapInArrow(coded, shape)


def decode(coded: DataFrame, books: Codebooks, codes: str = "codes") -> DataFrame:
    """``coded`` with ``decoded``: the whole-number vector that its codes name."""
    tables = F.from_json(F.lit(json.dumps(books.entries.tolist())), "array<array<array<bigint>>>")
    return coded.withColumn("decoded", F.flatten(F.transform(codes, lambda c, i: F.get(F.get(tables, i), c))))


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """``coded`` with ``label_error``: ``error`` summed over rows of equal ``label``, nulls together.

    Sums are pre-aggregated, then joined on, not taken in a window: a label
    may hold a third of all rows.
    """
    coded = materialize(coded.drop("label_error"), "coded")
    key = fresh(coded, "summed_label")
    sums = coded.groupBy(F.col(label).alias(key)).agg(F.sum(error).alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col(key)), "left").drop(key)
