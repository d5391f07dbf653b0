"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the hashed character n-grams that a text holds at least once. In
training, Spark counts over all labelled texts how many toxic and clean ones
hold each bucket; the log ratio of the smoothed shares scales the bucket's
feature. The model's features are the ``max_features`` buckets of the largest
chi-square; a logistic regression on them is fitted on a bounded sample of
labelled texts. Scoring is a broadcast of one weight per bucket (4 MB,
whatever the corpus).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import give_back, materialize, released, small_batches, smallest_by_hash

BUCKET_BITS = 20
#: Code points hashed at once.
SLICE = 1 << 18
#: Entries of the sample's sparse rows that a step of the fit takes at once.
ENTRIES = 1 << 19
#: Labels (an id and a flag each, 16 MB in all) that are broadcast.
BROADCAST_LABELS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # by bucket: coefficient times log-count ratio
    bias: float
    ngrams: tuple[int, ...]


def _normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point."""
    h = codes[: len(codes) - n + 1].astype(np.uint64)
    for j in range(1, n):
        h *= MULTIPLIER
        h += codes[j : len(codes) - n + 1 + j]
    h ^= h >> np.uint64(29)
    h *= MULTIPLIER
    h += np.uint64(n)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Code points and text numbers of some texts at a time, each closed by a 0; a very long text is one slice."""
    codes, owner, size = [], [], 0
    for i, text in enumerate(texts):
        c = np.frombuffer(f" {_normal(text)} \0".encode("utf-32-le", "replace"), np.uint32)
        codes.append(c), owner.append(i)
        size += len(c)
        if size >= SLICE or i == len(texts) - 1:
            yield np.concatenate(codes).astype(np.uint64), np.repeat(owner, [len(c) for c in codes]), size
            codes, owner, size = [], [], 0


def features(codes: np.ndarray, owner: np.ndarray, ngrams: tuple[int, ...], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of n-grams within a text; ``wanted``: a mask of buckets."""
    ends = np.flatnonzero(codes == 0)
    own_end = ends[np.searchsorted(ends, np.arange(len(codes)))]
    keys = []
    for n in ngrams:
        if len(codes) < n:
            continue
        b = buckets(codes, n)
        inside = np.flatnonzero(wanted[b]) if wanted is not None else np.arange(len(b))
        inside = inside[inside + n <= own_end[inside]]
        keys.append((owner[inside].astype(np.int64) << BUCKET_BITS) | b[inside])
    pairs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return pairs >> BUCKET_BITS, (pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32)


def _counts(ngrams: tuple[int, ...]):
    """Rows (bucket, toxic, clean): how many of a task's texts of either label hold the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), np.int64)
            for codes, owner, _ in slices(batch.column(0).to_pylist()):
                who, b = features(codes, owner, ngrams, None)
                for label in (0, 1):
                    held[label] += np.bincount(b[labels[who] == label], minlength=1 << BUCKET_BITS)
        some = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[1, some]), pa.array(held[0, some])], names=["bucket", "toxic", "clean"])

    return released(run)


def _rows(ngrams: tuple[int, ...], chosen):
    """(label, features) of each text: the numbers of the chosen buckets that it holds, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(1 << BUCKET_BITS, np.uint16)
        number[chosen.value] = np.arange(len(chosen.value))
        wanted = np.zeros(1 << BUCKET_BITS, bool)
        wanted[chosen.value] = True
        for batch in batches:
            found = [b""] * batch.num_rows
            for codes, owner, _ in slices(batch.column(0).to_pylist()):
                who, b = features(codes, owner, ngrams, wanted)
                for i, part in zip(np.unique(who), np.split(b, np.flatnonzero(np.diff(who)) + 1)):
                    found[i] = number[part].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(found, pa.binary())], names=["label", "features"])

    return released(run)


def logistic(sizes: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2 logistic regression on sparse rows, by accelerated gradient descent.

    ``sizes``: how many of ``columns`` each row holds; ``values``: a feature's
    value, the same in all rows that hold it. Rows are taken in blocks, so
    that what a step needs besides ``columns`` doesn't grow with their number.
    """
    n, width = max(len(labels), 1), len(values)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    edges = np.unique(np.concatenate([np.searchsorted(offsets, np.arange(0, offsets[-1], ENTRIES)), [0, len(sizes)]]))
    blocks = list(zip(edges[:-1], edges[1:]))

    def by_row(weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(labels))
        for i, j in blocks:
            owner = np.repeat(np.arange(j - i), sizes[i:j])
            out[i:j] = np.bincount(owner, weights[columns[offsets[i] : offsets[j]]], minlength=j - i)
        return out

    def by_column(weights: np.ndarray) -> np.ndarray:
        out = np.zeros(width)
        for i, j in blocks:
            out += np.bincount(columns[offsets[i] : offsets[j]], np.repeat(weights[i:j], sizes[i:j]), minlength=width)
        return out

    square = by_row(values**2).max(initial=1.0) + 1
    rate = 4.0 / (square + 4 * l2)
    w, b = np.zeros(width), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    wv, bv, momentum = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(by_row(values * wv) + bv, -30, 30)))
        g = (p - labels) / n
        w2 = wv - rate * n / 8 * (values * by_column(g) + l2 / n * wv)
        b2 = bv - rate * n / 8 * g.sum()
        # start anew where the step goes against the momentum
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2 if ((wv - w2) * (w2 - w)).sum() + (bv - b2) * (b2 - b) <= 0 else 1.0
        wv, bv = (w2 + (momentum - 1) / grown * (w2 - w), b2 + (momentum - 1) / grown * (b2 - b)) if grown > 1 else (w2, b2)
        w, b, momentum = w2, b2, grown
    return w, b


def fit(
    labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = 12_000,
    max_features: int = 8_192, ngrams: tuple[int, ...] = (4, 5), alpha: float = 0.5, l2: float = 0.2, steps: int = 300,
) -> ToxicityModel:
    """Count over all rows of ``labelled``; fit on at most ``max_rows`` of them, those of the smallest hashes of id, text and label.

    Rows with a null label are left out, null texts are empty, repeated rows
    count once in the fit. Without rows of both labels every score is the
    share of the labels (one half without any). ``max_features`` is the
    model's size, the same for every corpus. Spark counts; the driver gets as
    many rows as there are buckets, and ``max_features`` of two bytes a row of
    the sample at most.
    """
    if max_features > 1 << 16:
        raise ValueError("features are numbered in two bytes")
    spark = labelled.sparkSession
    small_batches(spark)
    rows = materialize(labelled.filter(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label")
    ), "toxic-labelled")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log((n1 + 1) / (n0 + 1))), ngrams)
    sample = smallest_by_hash(rows, max_rows).select("text", "label").repartition(max(1, spark.sparkContext.defaultParallelism))
    counts = rows.select("text", "label").mapInArrow(_counts(ngrams), "bucket int, toxic long, clean long").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    ).toArrow()  # as many rows as buckets at most
    b, c1, c0 = (counts.column(k).to_numpy() for k in ("bucket", "toxic", "clean"))
    del counts
    ratio = np.log(alpha + c1) - np.log((alpha + c1).sum()) - (np.log(alpha + c0) - np.log((alpha + c0).sum()))
    chi2 = (c1 * (n0 - c0) - c0 * (n1 - c1)).astype(float) ** 2 / np.maximum(1, (c1 + c0) * (n1 + n0 - c1 - c0))
    best = np.lexsort((b, -chi2))[:max_features]
    best = best[c1[best] + c0[best] >= 3]
    b, r = b[best].copy(), ratio[best]
    del c1, c0, chi2, ratio, best
    chosen = spark.sparkContext.broadcast(b)
    got = sample.mapInArrow(_rows(ngrams, chosen), "label int, features binary").toArrow()
    held, labels = got.column("features"), got.column("label").to_numpy().astype(float)
    sizes = np.concatenate([pc.binary_length(x).to_numpy(zero_copy_only=False) for x in held.chunks] or [np.zeros(0)]).astype(np.int64) // 2
    columns = np.frombuffer(b"".join(x.as_py() for x in held), np.uint16)
    del got, held
    give_back()
    w, bias = logistic(sizes, columns, r, labels, l2, steps)
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    weights[b] = w * r
    del columns, sizes
    give_back()
    return ToxicityModel(weights, bias, ngrams)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with their rows of ``labels``. Up to BROADCAST_LABELS labels go to the documents; more are joined by shuffle."""
    return docs.join(F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels, id_col)


def _scores(text_col: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        wanted = m.weights != 0
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            total = np.full(batch.num_rows, m.bias)
            for codes, owner, _ in slices(batch.column(at).to_pylist()):
                who, b = features(codes, owner, m.ngrams, wanted)
                total += np.bincount(who, m.weights[b], minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "toxicity"])

    return released(run)


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``df`` with toxicity (0 to 1); null and empty texts get the bias' score; a column of that name gives way."""
    small_batches(df.sparkSession)
    df = df.drop("toxicity")
    schema = T.StructType([*df.schema.fields, T.StructField("toxicity", T.DoubleType())])
    return df.mapInArrow(_scores(text_col, df.sparkSession.sparkContext.broadcast(model)), schema)
