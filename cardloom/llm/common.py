"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import json
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a folder is chosen and set, so that later
    calls find the same one: a temporary one if driver and executors are one
    process, else one in the warehouse, which a cluster shares.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        alone = spark.conf.get("spark.master", "").startswith("local") and "cluster" not in spark.conf.get("spark.master", "")
        known = tempfile.mkdtemp(prefix="spark-shared-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", known)
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: executors lost later cost no recomputation, and branches
    that read the result see the same rows.
    """
    path = new_folder(df.sparkSession, label)
    with short_plans(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete ``folders`` that :func:`materialize` wrote and nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folders(table: DataFrame) -> set[str]:
    """Where the files of ``table`` lie that :func:`materialize` wrote."""
    return {f.rpartition("/")[0] for f in table.inputFiles()}


def finite(vector: Column) -> Column:
    """True for a vector that isn't null and holds neither nulls nor NaN or infinite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x - x == 0), F.lit(False))


def vector_length(vectors: DataFrame, column: str, by: int = 1) -> int:
    """The commonest length among the vectors of ``column``, of those above zero that ``by`` divides (ties: the longer); 0 if there is none."""
    counts = vectors.groupBy(F.size(column).alias("length")).agg(F.count("*").alias("n")).filter((F.col("length") > 0) & (F.col("length") % by == 0))
    found = counts.orderBy(F.desc("n"), F.desc("length")).first()
    return found["length"] if found else 0


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of ``rows`` (tuples), given as one literal, so that no Python worker starts for it."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    told = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(told), f"array<struct<{schema}>>", {"mode": "FAILFAST"})))


def smallest_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct rows of ``rows``: those of the smallest hashes over all columns.

    The choice depends on the rows alone, not on their order or partitions;
    rows that repeat count once. Only hashes are sorted, of about twice as
    many rows as are wanted.
    """
    h = fresh(rows, "row_hash")
    hashed = rows.withColumn(h, F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)))
    total = rows.count()
    if total > most:
        low = lambda share: int(-(2**63) + share * 2**64)
        some = hashed.filter(F.col(h) < low(min(2 * most / total, 0.999)))
        for part in (some, hashed):  # the second only if many rows repeat
            held = part.select(h).distinct().orderBy(h).limit(most).agg(F.count("*"), F.max(h)).first()
            if held[0] == most:
                break
        hashed = hashed.filter(F.col(h) <= held[1])
    return hashed.dropDuplicates([h]).drop(h)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names are compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_outputs(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """``df`` with ``outputs``; a column of ``df`` with an output's name gives way."""
    return df.withColumns(outputs)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def nonempty(words: Column) -> Column:
    return F.filter(words, lambda w: w != F.lit(""))


#: Rows of an Arrow batch between Spark and its Python workers.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches hold no more than :data:`BATCH_ROWS` rows, so that less is held at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Characters of a plan's description that Spark keeps for each table that is written on the way.
PLAN_CHARS = 4_096


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Have the driver keep no more than :data:`PLAN_CHARS` of the description of plans that run inside; the session's own length holds again afterwards."""
    name = "spark.sql.maxPlanStringLength"
    own = spark.conf.get(name)
    spark.conf.set(name, str(PLAN_CHARS))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows (from, to) of about ``most`` in all by ``sizes``, one at least."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def give_back() -> None:
    """Have Arrow and the C library return memory that this process no longer uses; they keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def released(run):
    """A function for mapInArrow that gives unused memory back when a task ends."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
