"""A positional inverted index of texts: built once, kept up by segments, asked without a scan of the texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions.stems import LIGHT, LIGHT_STOP, STOP, porter2, stem, words
from cardloom.sources.shared import shared_folder, written

#: Texts whose words are grouped at once.
ROWS = 256

#: Stems of the words that a worker met last.
_stem = lru_cache(maxsize=1 << 17)(porter2)

POSTINGS = "lexeme string, key string, positions array<int>, segment int, bucket int"


@dataclass(frozen=True)
class TextIndex:
    """``folder`` holds postings by segment and bucket, each segment's lexicon, and the keys that each segment replaces.

    A posting is (lexeme, key, positions). Its bucket is the lexeme's hash, a
    directory, and files are sorted by lexeme, so a lookup reads its lexemes'
    buckets and, of those, the row groups that may hold them.
    """

    spark: SparkSession
    folder: str
    buckets: int = 64

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def bucket(self, lexeme: Column) -> Column:
        return F.pmod(F.xxhash64(lexeme), F.lit(self.buckets)).cast("int")

    def _postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def _gone(self) -> DataFrame:
        return self._read("gone", "key string, segment int").groupBy("key").agg(F.max("segment").alias("since"))

    def _lexicon(self) -> DataFrame:
        return self._read("lexicon", "lexeme string, texts long, places long, segment int")

    def postings(self) -> DataFrame:
        """Postings that hold: those of texts replaced by a later segment are left out."""
        return self._postings().join(self._gone(), "key", "left").filter("since is null or segment >= since").drop("since")

    def lexicon(self) -> DataFrame:
        """(lexeme, texts, places) of all segments; texts that a later one replaced still count, until :meth:`compacted`."""
        return self._lexicon().groupBy("lexeme").agg(F.sum("texts").alias("texts"), F.sum("places").alias("places"))

    def _write(self, held: DataFrame, segment: int) -> None:
        """``held`` (lexeme, key, positions), each bucket dealt by key to several tasks, so that a lexeme of a third of all texts spans them.

        Ranges would need a sample, for which ``held`` would be made twice.
        """
        n = -(-2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        rows = held.select("lexeme", "key", "positions", self.bucket(F.col("lexeme")).alias("bucket"))
        dealt = rows.repartitionById(n * self.buckets, F.col("bucket") * n + F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
        dealt.sortWithinPartitions("bucket", "lexeme", "key").write.partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        own = self._read("postings", POSTINGS).filter(F.col("segment") == segment)
        own.groupBy("lexeme").agg(F.count("*").alias("texts"), F.sum(F.size("positions")).alias("places")).write.parquet(f"{self.folder}/lexicon/segment={segment}")

    def updated(self, segment: int, texts: DataFrame | None = None, removed: DataFrame | None = None) -> TextIndex:
        """The index with ``texts`` (key, text) added or put in place of their earlier versions, and the keys of ``removed`` taken out.

        ``segment`` is the delta's number, above all earlier ones; only the
        delta is read and written, the other segments stay as they are.
        """
        none = self.spark.createDataFrame([], "key string, text string")
        texts, removed = none if texts is None else texts, none if removed is None else removed
        keys = texts.select(F.col("key").cast("string")).union(removed.select(F.col("key").cast("string"))).filter("key is not null").distinct() if segment else none.select("key")
        self._write(tokens(texts), segment)
        keys.write.parquet(f"{self.folder}/gone/segment={segment}")
        return self

    def compacted(self, folder: str | None = None) -> TextIndex:
        """The same postings as one segment in a new folder, without those replaced."""
        new = TextIndex(self.spark, folder or f"{shared_folder(self.spark)}/text-index-{uuid.uuid4().hex}", self.buckets)
        new._write(self.postings(), 0)
        self.spark.createDataFrame([], "key string").write.parquet(f"{new.folder}/gone/segment=0")
        return new

    def lookup(self, queries: DataFrame) -> DataFrame:
        """(query_id, key, rank) of the texts that hold every lexeme of a query; ``queries`` has query_id and text.

        Postings are met rare lexeme first: the rarest one of a query names the
        candidates, the others are kept only for these. The rank sums 0.1 for
        each cover, a shortest stretch with all lexemes, over one plus its
        other words. Queries without a lexeme find nothing.
        """
        terms = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).filter(~F.col("word").isin(*STOP))
        terms = terms.select("query_id", stem(F.col("word")).alias("lexeme")).distinct()
        known = self._lexicon().join(terms.select("lexeme").distinct(), "lexeme", "left_semi").groupBy("lexeme").agg(F.sum("texts").alias("texts"))
        rarity = Window.partitionBy("query_id").orderBy(F.coalesce("texts", F.lit(0)), "lexeme")
        ranked = terms.join(known, "lexeme", "left").select("query_id", "lexeme", (F.row_number().over(rarity) - 1).alias("place"), F.count("*").over(Window.partitionBy("query_id")).alias("n"))
        asked = written(ranked.withColumn("bucket", self.bucket(F.col("lexeme"))), "asked")
        postings, gone = self._postings(), self._gone()
        hits = lambda part: postings.join(part, ["bucket", "lexeme"]).join(gone, "key", "left").filter("since is null or segment >= since").select(
            "query_id", "key", "n", F.transform("positions", lambda p: F.struct(p.alias("p"), F.col("place").alias("o"))).alias("hits")
        )
        rare = hits(asked.filter("place = 0"))
        rest = hits(asked.filter("place > 0")).join(rare.select("query_id", "key").distinct(), ["query_id", "key"], "left_semi")
        met = rare.unionByName(rest).groupBy("query_id", "key").agg(F.max("n").alias("n"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
        held = met.filter(F.size(F.array_distinct(F.transform("hits", lambda h: h["o"]))) == F.col("n"))
        return held.select("query_id", "key", F.round(covers(F.col("hits"), F.col("n")), 6).alias("rank"))


def covers(hits: Column, n: Column) -> Column:
    """The sum of 0.1 / (1 + other words) over the covers of ``hits``, a text's sorted (p, o): place and number of each of ``n`` lexemes."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    none = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("p"))
    start = F.struct(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda _: none).alias("last"), F.lit(-1).alias("before"), F.lit(0).alias("i"), F.lit(0.0).alias("rank"))

    def step(state, hit):
        last = F.transform(state["last"], lambda x, o: F.when(o == hit["o"], F.struct(state["i"].alias("i"), hit["p"].alias("p"))).otherwise(x))

        def cover(x):
            first = x["first"]
            noise = (hit["p"] - first["p"]) - (state["i"] - first["i"])
            new = first["i"] > state["before"]
            return F.struct(x["last"].alias("last"), F.when(new, first["i"]).otherwise(state["before"]).alias("before"), (state["i"] + 1).alias("i"), (state["rank"] + F.when(new, 0.1 / (1 + noise)).otherwise(0.0)).alias("rank"))

        return let(let(last, lambda x: F.struct(x.alias("last"), F.array_min(x).alias("first"))), cover)

    return F.aggregate(hits, start, step, lambda s: s["rank"])


def tokens(texts: DataFrame) -> DataFrame:
    """(lexeme, key, positions) of ``texts`` (key, text), a row for each of a text's words; stop words have places but no rows, rows without a key go.

    A text's words are grouped and stemmed where the text is, in columns of
    Arrow batches, so no token and no word is shuffled to meet its stem. Texts
    of one key have rows of their own.
    """
    split = texts.filter("key is not null").select(F.col("key").cast("string").alias("key"), words(F.col("text")).alias("words"))
    return split.mapInArrow(_grouped, "lexeme string, key string, positions array<int>")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stops = pa.array(STOP)
    for batch in batches:
        lists = batch.column("words")
        for start in range(0, batch.num_rows, ROWS):
            part = lists.slice(start, ROWS)
            word, sizes = part.flatten().dictionary_encode(), np.asarray(pc.list_value_length(part))
            code, row = np.asarray(word.indices), np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = ~np.asarray(pc.is_in(word.dictionary, value_set=stops))[code] if len(code) else np.zeros(0, bool)
            code, row, place = code[kept], row[kept], place[kept].astype(np.int32)
            order = np.lexsort((place, code, row))
            code, row, place = code[order], row[order], place[order]
            first = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(row) != 0)]) if len(code) else np.zeros(0, np.int64)
            positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(code)].astype(np.int32)), pa.array(place))
            own, at = np.unique(code[first], return_inverse=True)
            stems = pa.array([_stem(w) for w in word.dictionary.take(pa.array(own)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([stems.take(pa.array(at)), batch.column("key").take(pa.array(row[first] + start)), positions], ["lexeme", "key", "positions"])


def token_counts(texts: DataFrame) -> DataFrame:
    """(key, places, words, lexemes, distinct_lexemes) of every one of ``texts`` (key, text), also of those without a word.

    places and words: the words that are no stop words, and the distinct ones;
    lexemes: the same of light stems of words of a-z and 0-9.
    """
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    split = texts.select(F.col("key").cast("string").alias("key"), F.split(low, r"[^\p{L}\p{N}]+").alias("words"), F.split(low, "[^a-z0-9]+").alias("light"))
    return split.mapInArrow(_token_counts, "key string, places long, words long, lexemes long, distinct_lexemes long")


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counts(lists: pa.ListArray, stops: tuple[str, ...], endings: tuple[tuple[str, str], ...] = ()) -> list[np.ndarray]:
        """How many words that are no stop words each row has, and how many distinct ones by their stems."""
        word, n = lists.flatten().dictionary_encode(), len(lists)
        row = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lists)))
        stems = word.dictionary
        for ending, left in endings:
            stems = pc.replace_substring_regex(stems, ending, left)
        kept = ~(np.asarray(pc.is_in(word.dictionary, value_set=pa.array(stops))) | np.asarray(pc.equal(stems, ""))) if len(stems) else np.zeros(0, bool)
        stem, code = stems.dictionary_encode(), np.asarray(word.indices)
        held = kept[code] if len(code) else np.zeros(0, bool)
        code, row = np.asarray(stem.indices)[code[held]].astype(np.int64), row[held]
        pairs = np.unique(row * max(len(stem.dictionary), 1) + code)
        return [np.bincount(row, minlength=n), np.bincount(pairs // max(len(stem.dictionary), 1), minlength=n)]

    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            told = counts(part.column("words"), STOP) + counts(part.column("light"), LIGHT_STOP, LIGHT)
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c.astype(np.int64)) for c in told)], ["key", "places", "words", "lexemes", "distinct_lexemes"])


def build(texts: DataFrame, folder: str | None = None, buckets: int = 64) -> TextIndex:
    """An index of ``texts`` (key, text) in ``folder``, by default a new one in the shared folder."""
    spark = texts.sparkSession
    return TextIndex(spark, folder or f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}", buckets).updated(0, texts)
