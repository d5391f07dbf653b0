"""Tables of SQLite files as a Spark data source: partitions by ranges of row ids, cursors become bounds of the ranges."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Rows of one batch, and row ids that a partition spans at least.
BATCH, SPAN = 4_096, 50_000
INT64 = 2**63 - 1


def _kind(declared: str) -> T.DataType:
    """Spark's type for a column, by SQLite's rules of affinity."""
    d = declared.upper()
    return T.LongType() if "INT" in d else T.StringType() if any(w in d for w in ("CHAR", "CLOB", "TEXT")) else T.BinaryType() if "BLOB" in d or not d else T.DoubleType() if any(w in d for w in ("REAL", "FLOA", "DOUB")) else T.StringType()


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{os.path.abspath(path)}?mode=ro", uri=True)


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Span(InputPartition):
    first: int
    last: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.fields = options["path"], options["table"], schema.fields
        self.most, self.low, self.high = int(options.get("partitions", "8")), int(options.get("after", -INT64 - 1)), INT64
        if "after" in options:
            self.low += 1

    def partitions(self) -> list[Span]:
        """Equal ranges of the row ids that the bounds leave; the ends come from the table's own order, without a scan."""
        with _open(self.path) as db:
            ask = f"SELECT min(rowid), max(rowid) FROM (SELECT rowid FROM {_name(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid {{}} LIMIT 1)"
            first, last = db.execute(ask.format("ASC"), (self.low, self.high)).fetchone()[0], db.execute(ask.format("DESC"), (self.low, self.high)).fetchone()[0]
        if first is None:
            return [Span(1, 0)]
        many = max(1, min(self.most, -(-(last - first + 1) // SPAN)))
        step = -(-(last - first + 1) // many)
        return [Span(low, min(low + step - 1, last)) for low in range(first, last + 1, step)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(f.name, {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary()}.get(type(f.dataType), pa.string())) for f in self.fields])
        with _open(self.path) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            rows = db.execute(f"SELECT {', '.join(map(_name, shape.names))} FROM {_name(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (span.first, span.last))
            while some := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array([_as(v, f.type) for v in c], f.type) for c, f in zip(zip(*some), shape)], schema=shape)


class PushingReader(SqliteReader):
    """The reader of a session that pushes filters into Python data sources: those on rowid narrow the ranges."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            bound = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("rowid",) or not isinstance(bound, int):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, bound), min(self.high, bound)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, bound + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, bound)
            elif isinstance(f, LessThan):
                self.high = min(self.high, bound - 1)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, bound)
            else:
                yield f


def _as(v, kind: pa.DataType):
    """A value as its column's type; SQLite lets any value stand in any column, what doesn't fit becomes null."""
    if v is None:
        return None
    if pa.types.is_string(kind):
        return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
    if pa.types.is_binary(kind):
        return v if isinstance(v, bytes) else str(v).encode()
    try:
        return int(v) if pa.types.is_int64(kind) else float(v)
    except ValueError:
        return None


class SqliteSource(DataSource):
    """``format("sqlite_rows")`` with options ``path`` (that driver and executors share), ``table``, ``partitions`` and ``after``, the row id of a cursor.

    Columns are those of the table and ``rowid``. Rows up to ``after`` are never read. With ``pushdown`` filters on
    rowid narrow the ranges as well; Spark wants ``spark.sql.python.filterPushdown.enabled`` for that.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as db:
            told = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not told:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField("rowid", T.LongType()), *(T.StructField(c[1], _kind(c[2])) for c in told if c[1].lower() != "rowid")])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return (PushingReader if self.options.get("pushdown") == "true" else SqliteReader)(dict(self.options), schema)


def read_table(spark: SparkSession, path: str, table: str, after: int | None = None, partitions: int = 8) -> DataFrame:
    """The rows of a SQLite table, with ``rowid``; only those after a cursor where one is given."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_rows").options(path=path, table=table, partitions=str(partitions), pushdown=spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    return (reader if after is None else reader.option("after", str(after))).load()


def imessage_tables(spark: SparkSession, path: str, since: int = 0) -> dict[str, DataFrame]:
    """What :func:`cardloom.sources.adapters.imessage` takes, from a chat database: messages after ``since``, joined with their chats, in one key each."""
    table = lambda name, **more: read_table(spark, path, name, **more)
    inside = table("chat_message_join").groupBy(F.col("message_id").alias("rowid")).agg(F.min("chat_id").alias("chat_id"))
    messages = table("message", after=since).join(inside, "rowid", "left").select("rowid", "guid", "text", apple_time(F.col("date")).alias("date"), "is_from_me", "handle_id", "chat_id")
    return {
        "messages": messages, "chats": table("chat").select(F.col("rowid").alias("chat_id"), "guid", "display_name", F.col("service_name").alias("service")),
        "membership": table("chat_handle_join").select("chat_id", "handle_id"), "handles": table("handle").select(F.col("rowid").alias("handle_id"), F.col("id").alias("address")),
    }


def apple_time(stamp: Column) -> Column:
    """Nano- or whole seconds since 2001 as ISO text in UTC; null for none."""
    seconds = F.when(F.abs(stamp) > 10**11, F.floor(stamp / 10**9)).otherwise(stamp)
    return F.when(stamp.isNotNull() & (stamp != 0), F.date_format(F.timestamp_seconds(seconds + 978307200), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def beeper_tables(spark: SparkSession, path: str, since: int = 0) -> dict[str, DataFrame]:
    """What :func:`cardloom.sources.adapters.beeper` takes, from tables events, rooms and participants of those columns, events after ``since``."""
    events = read_table(spark, path, "events", after=since)
    return {"events": (events if "order_id" in events.columns else events.withColumnRenamed("rowid", "order_id")), "rooms": read_table(spark, path, "rooms"), "participants": read_table(spark, path, "participants")}
