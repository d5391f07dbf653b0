"""Benchmark decontamination by spaced seeds.

Fixed masks choose some of a window's tokens and ignore the others, so that a
replaced word spoils only the masks that look at it. The hashes of the
benchmark's windows under every mask are joined with those of the documents'
windows. Around each hit the item and the document are laid side by side, and
the tokens that agree are counted: an overlap stands if at least ``share`` of
the item's tokens agree.

A benchmark of at most ``broadcast_tokens`` tokens is broadcast, and documents
aren't shuffled. A larger one is a table of seeds in the shared folder: a
bitmap of the seeds of 64 MB at most lets through the few document windows that
may be among them, they are joined with the seeds by shuffle, and the texts
with hits are laid beside their items. Both ways find the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import fresh, materialize, nonempty, small_batches

#: Positions of a window that each mask looks at (fixed values). Six tokens each:
#: any window with up to two replaced words in a row is met by one of them.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 6, 8, 9), (0, 1, 2, 5, 7, 8))
SHORT_MASKS = ((0, 1, 2), (0, 2, 3))
FILTER_BITS = 24
#: Items of up to so many tokens are also met by the short masks.
SHORT = 2 * MASKS[-1][-1]
#: A bitmap has 64 bits for each of its hashes, and at most so many in all (64 MB).
MOST_BITS = 29
RESULT = "contaminated int, n_items int, items array<long>, overlap double"


def tokens(text: Column) -> Column:
    """Hashes of the words (letters and digits, lower-cased)."""
    words = nonempty(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def mix(flat: np.ndarray, mask: tuple[int, ...], seed: int) -> np.ndarray:
    """The hash of each window under ``mask``."""
    n = max(len(flat) - mask[-1], 0)
    h = np.full(n, seed * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for offset in mask:
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= flat[offset : offset + n]
        h ^= h >> np.uint64(32)
    return h * np.uint64(0x9E3779B97F4A7C15)


def masks_of(item: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    return list(enumerate((*MASKS, *SHORT_MASKS) if len(item) <= SHORT else MASKS))


@dataclass
class Seeds:
    """A benchmark: items' tokens, and window hashes (ascending) with item and position."""

    ids: list
    items: list[np.ndarray]
    masks: tuple[tuple[int, ...], ...]
    hashes: np.ndarray
    item: np.ndarray
    position: np.ndarray
    small: np.ndarray  # a bitmap of the hashes' top bits

    @classmethod
    def of(cls, ids: list, items: list[np.ndarray]) -> Seeds:
        masks = (*MASKS, *SHORT_MASKS) if any(len(x) <= SHORT for x in items) else MASKS
        found = []
        for i, x in enumerate(items):
            found += [(h := mix(x, m, k + 1), np.full(len(h), i, np.int32), np.arange(len(h), dtype=np.int32)) for k, m in masks_of(x)]
        hashes, item, position = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.argsort(hashes, kind="stable")
        small = np.zeros(1 << FILTER_BITS, bool)
        small[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls(ids, items, masks, hashes[order], item[order], position[order], small)

    def hits(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distinct columns (item, start of the item in ``flat``, document of the window) of the seeds met within a document; starts may lie outside it."""
        found = []
        for k, mask in enumerate(self.masks):
            h = mix(flat, mask, k + 1)
            at = np.flatnonzero(self.small[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            doc = np.searchsorted(offsets, at, "right") - 1
            whole = at + mask[-1] < offsets[doc + 1]
            at, doc = at[whole], doc[whole]
            lo, hi = (np.searchsorted(self.hashes, h[at], side) for side in ("left", "right"))
            n = hi - lo
            rows = np.repeat(np.arange(len(at)), n)
            seeds = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([self.item[seeds], at[rows] - self.position[seeds], doc[rows]]))
        return np.unique(np.concatenate(found, axis=1), axis=1)


def overlaps(flat: np.ndarray, offsets: np.ndarray, seeds: Seeds, share: float, least: int) -> dict[int, dict[int, float]]:
    """By document: the items found in it and their best overlap."""
    found: dict[int, dict[int, float]] = {}
    for i, start, d in seeds.hits(flat, offsets).T.tolist():
        item = seeds.items[i]
        a, b = max(start, offsets[d]), min(start + len(item), offsets[d + 1])
        same = int((flat[a:b] == item[a - start : b - start]).sum())
        if same >= min(least, len(item)) and same >= share * len(item):
            own = found.setdefault(d, {})
            own[i] = max(own.get(i, 0.0), same / len(item))
    return found


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' tokens, and where each row's begin (and the last one's end)."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _search(seeds: Broadcast, share: float, least: int, keep: int, out: str):
    """The rows' first ``keep`` columns and ``out``, the (item, overlap) found in the last column's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        for batch in batches:
            flat, offsets = _flat(batch.column(batch.num_columns - 1))
            found = overlaps(flat, offsets, s, share, least) if len(flat) else {}
            rows = [[(s.ids[i], v) for i, v in sorted(found.get(d, {}).items())] for d in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(rows, FOUND)], names=[*batch.schema.names[:keep], out])

    return run


FOUND = pa.list_(pa.struct([("item", pa.int64()), ("overlap", pa.float64())]))
HITS = "array<struct<item:long,overlap:double>>"


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, item, size, position) of items (id, t)."""
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = t.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for k, mask in masks_of(x):
                h = mix(x, mask, k + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.full(len(h), i)), pa.array(np.full(len(h), len(x), np.int32)), pa.array(np.arange(len(h), dtype=np.int32))],
                    names=["h", "item", "size", "position"],
                )


@dataclass
class Bitmap:
    """A set of hashes by their top bits: it may hold more than was put in, never less."""

    bits: int
    held: np.ndarray  # bytes, lowest bit first

    @classmethod
    def of(cls, hashes: DataFrame, n: int) -> Bitmap:
        """Of the only column of ``hashes``, about ``n`` rows; Spark makes stretches of 4 KB, the driver puts them side by side."""
        bits = int(np.clip(np.ceil(np.log2(max(n, 1) * 64)), 20, MOST_BITS))
        slot = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits) + 1
        parts = hashes.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("p")).toArrow()
        held = np.zeros(1 << (bits - 3), np.uint8)
        for b, p in zip(parts.column("b").to_pylist(), parts.column("p")):
            held[(b - 1) * 4096 : b * 4096] = np.frombuffer(p.as_buffer(), np.uint8)
        return cls(bits, held)

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - self.bits)
        return ((self.held[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _windows(known: Broadcast):
    """Rows (key, n, h, at) of the windows of documents (key, t: n tokens) that may be seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _flat(batch.column(1))
            for k, mask in enumerate((*MASKS, *SHORT_MASKS)):
                h = mix(flat, mask, k + 1)
                at = np.flatnonzero(known.value.has(h))
                doc = np.searchsorted(offsets, at, "right") - 1
                whole = at + mask[-1] < offsets[doc + 1]
                at, doc = at[whole], doc[whole]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array(np.diff(offsets)[doc]), pa.array(h[at].view(np.int64)), pa.array(at - offsets[doc])],
                    names=["key", "n", "h", "at"],
                )

    return run


def _held(known: Broadcast):
    """The rows (h, key, t) whose h may be in the bitmap, without h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(known.value.has(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            yield pa.RecordBatch.from_arrays(some.columns[1:], names=["key", "t"])

    return run


def joined_hits(texts: DataFrame, items: DataFrame, share: float, least: int) -> DataFrame:
    """(key, hits) of the ``texts`` (key, t) in which items (id, t) stand, by a shuffled join of seeds."""
    context = texts.sparkSession.sparkContext
    seeds = materialize(items.mapInArrow(_seeds, "h long, item long, size int, position int"), "seeds")
    known = context.broadcast(Bitmap.of(seeds.select("h"), seeds.count()))
    start = (F.col("at") - F.col("position")).alias("start")
    apart = F.least(F.col("start") + F.col("size"), F.col("n")) - F.greatest(F.col("start"), F.lit(0))
    met = texts.mapInArrow(_windows(known), "key binary, n long, h long, at long").join(seeds, "h").select("key", "item", "size", "n", start)
    enough = lambda same: (same >= F.least(F.lit(least), F.col("size"))) & (same >= share * F.col("size"))
    met = materialize(met.filter(enough(apart)).select("key", "item", "size", "start").distinct(), "seed-hits")
    known.destroy()
    h = F.xxhash64("key").alias("h")
    near = context.broadcast(Bitmap.of(met.select(h), met.count()))
    held = texts.select(h, "key", "t").mapInArrow(_held(near), "key binary, t array<long>").dropDuplicates(["key"])
    wanted = items.select(F.col("id").alias("item"), F.col("t").alias("wanted"))
    agree = F.zip_with(F.slice("t", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("size") + F.least(F.col("start"), F.lit(0))),
                       F.slice("wanted", F.greatest(-F.col("start"), F.lit(0)) + 1, F.col("size")), lambda a, b: a == b)
    same = F.size(F.filter(agree, lambda x: x))
    found = met.join(wanted, "item").join(held, "key").withColumn("same", same).filter(enough(F.col("same")))
    best = found.groupBy("key", "item").agg(F.max(F.col("same") / F.col("size")).alias("overlap"))
    return best.groupBy("key").agg(F.collect_list(F.struct("item", "overlap")).alias("hits"))  # of one text


def find_contamination(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    share: float = 0.8, least: int = 5, broadcast_tokens: int = 250_000,
) -> DataFrame:
    """``df`` with contaminated (1 or 0), n_items, items (ascending ids) and overlap (the best share, 0 without any).

    An item counts if somewhere in the whole text at least ``share`` of its
    tokens, and at least ``least``, stand at their places. Items of fewer than
    ``least`` tokens, or of a null id or text, are never found; ids should be
    unique. Null and empty texts are clean. Repeated rows stay; columns of
    ``df`` with the outputs' names give way. Of all ways to replace four words
    in 20 the masks miss 2 in 4,845.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = df.drop(*(x.split(" ")[0] for x in RESULT.split(", ")))
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), tokens(F.col(item_text_col)).alias("t"))
    items = materialize(items.filter(F.size("t") >= least), "benchmark")
    size = items.agg(F.sum(F.size("t"))).first()[0] or 0
    hits = fresh(df, "hits")
    none = F.array().cast(HITS)
    if not size:
        out = df.withColumn(hits, none)
    elif size <= broadcast_tokens:
        rows = items.collect()  # as many tokens at most
        seeds = spark.sparkContext.broadcast(Seeds.of([r["id"] for r in rows], [np.array(r["t"], np.int64).view(np.uint64) for r in rows]))
        schema = T.StructType([*df.schema.fields, T.StructField(hits, T.ArrayType(T.StructType.fromDDL("item long, overlap double")))])
        out = df.withColumn(fresh(df, "tokens"), tokens(F.col(text_col))).mapInArrow(_search(seeds, share, least, len(df.columns), hits), schema)
    else:
        key = fresh(df, "text_key")
        digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
        found = joined_hits(df.select(digest.alias("key"), tokens(F.col(text_col)).alias("t")), items, share, least)
        keyed = df.withColumn(key, digest)
        out = keyed.join(found.toDF(key, hits), key, "left").select(*(keyed[f"`{c}`"] for c in df.columns), F.coalesce(hits, none).alias(hits))
    found = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item"])))
    return out.select(
        *(F.col(f"`{c}`") for c in df.columns), (F.size(hits) > 0).cast("int").alias("contaminated"), F.size(found).alias("n_items"),
        found.alias("items"), F.coalesce(F.array_max(F.transform(hits, lambda h: h["overlap"])), F.lit(0.0)).alias("overlap"),
    )
