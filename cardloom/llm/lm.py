"""Language-model scoring with a log-frequency Bloom filter.

The model's n-grams are words and pairs of neighbouring words (with a start
before and an end after each text). Tasks count the 64-bit hashes of their
rows' n-grams and send them on by range of hash; a range's counts are
quantised on a log scale, ``q = 1 + floor(log2(count))``, and (n-gram, 1) to
(n-gram, q) are set in the range's own blocks of the filter, so no two tasks
share a block. Scoring probes (n-gram, 1), (n-gram, 2), ... until one is
missing; the last one present gives the count, and counts of pairs and words
are interpolated.

The filter grows with the corpus and lies in the shared folder, by range. It
is broadcast in slices of at most 64 MB, one after the other: a filter of more
than one slice takes a pass over the texts for each, which notes the levels of
those n-grams whose ranges the slice holds. A pass writes texts and levels
anew, and the table of the pass before is deleted, so passes take no disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import ascii_lower, discard, folders, fresh, materialize, nonempty, released, small_batches, stretches

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
BLOCK_BITS = 12
MAX_BITS = 29
PROBES = 4
#: Tokens that a worker counts, and scores, at once.
COUNTED, SCORED = 1 << 18, 1 << 16
LOW = (1 << 40) - 1
#: Words whose counts are broadcast, the most frequent ones; the others' are joined.
MAX_HEAD = 1 << 19


def tokens(text: Column) -> Column:
    """Hashes of the words, A-Z lower-cased; the end isn't among them."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def words(text: Column) -> Column:
    return nonempty(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"))


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngrams(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows' tokens, ends included: the token, the word before it (or start), its pair's hash; and rows' ends."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    stops = np.cumsum(sizes + 1)
    token = np.empty(int(stops[-1]) if len(stops) else 0, np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[stops - 1] = True
    token[~is_end], token[is_end] = flat, END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.concatenate([[0], stops[:-1]]) if len(stops) else []] = START
    pair = scramble(before * np.uint64(0x9E3779B97F4A7C15) + token)
    return scramble(token), scramble(before), pair, stops


def _blocks(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in stretches of about ``most`` tokens of the lists in column ``at``."""
    for a, b in stretches(batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) + 1, most):
        yield batch.slice(a, b - a)


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Hashes (their low 40 bits) and counts; those of count 1 without it."""
    one = counts == 1
    low = lambda h: h.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return int(one.sum()).to_bytes(4, "little") + low(hashes[one]) + low(hashes[~one]) + counts[~one].astype(np.uint32).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ones = int.from_bytes(data[:4], "little")
    more = (len(data) - 4 - 5 * ones) // 9
    raw = np.zeros((ones + more, 8), np.uint8)
    raw[:, :5] = np.frombuffer(data, np.uint8, 5 * (ones + more), 4).reshape(-1, 5)
    counts = np.ones(ones + more, np.int64)
    counts[ones:] = np.frombuffer(data, np.uint32, more, 4 + 5 * (ones + more))
    return raw.reshape(-1).view(np.uint64), counts


def _count(range_bits: int):
    """Rows (range, packed): a batch's distinct n-grams and their counts, by range of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (x for b in batches for x in _blocks(b, 0, COUNTED)):
            token, _, pair, _ = ngrams(block.column(0))
            hashes, counts = np.unique(np.concatenate([token, pair]), return_counts=True)
            edges = np.searchsorted(hashes >> np.uint64(64 - range_bits), np.arange((1 << range_bits) + 1))
            some = np.flatnonzero(np.diff(edges))
            packed = [pack(hashes[edges[r] : edges[r + 1]], counts[edges[r] : edges[r + 1]]) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], names=["range", "packed"])

    return released(run)


def _merge(table: pa.Table) -> pa.Table:
    """A range's rows as one: the counts of equal n-grams are added up, in 64 bits, and packed as their levels."""
    parts = [unpack(x.as_py()) for x in table.column("packed")]
    hashes, where = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([c for _, c in parts]), minlength=len(hashes)).astype(np.int64)
    levels = np.floor(np.log2(counts)).astype(np.int64) + 1
    held = np.bincount(np.minimum(levels, 40), minlength=41)
    return pa.table({
        "range": pa.array([table.column("range")[0].as_py()], pa.int32()),
        "packed": pa.array([pack(hashes, levels)], pa.binary()), "levels": pa.array([held.tolist()], pa.list_(pa.int64())),
    })


def positions(hashes: np.ndarray, level: int | np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of (n-gram, level): the hash's top bits say the block, the low 40 bits the places in it."""
    block = (hashes >> np.uint64(64 - (bits - BLOCK_BITS))) << np.uint64(BLOCK_BITS)
    mixed = scramble((hashes & np.uint64(LOW)) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(level, np.uint64))
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    return [block | ((mixed >> np.uint64(BLOCK_BITS * i)) & mask) for i in range(PROBES)]


def _fill(range_bits: int, bits: int):
    """Rows (range, part): the range's stretch of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, levels = unpack(packed)
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([stretch(r, low, levels, range_bits, bits)], pa.binary())], names=["range", "part"])

    return released(run)


def stretch(r: int, low: np.ndarray, levels: np.ndarray, range_bits: int, bits: int) -> bytes:
    size = 1 << (bits - range_bits)
    part = np.zeros(size, bool)
    # between the range's bits and the low 40 ones, blocks are told by a hash of the low ones
    hashes = spread(np.uint64(r), low, range_bits)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = hashes[levels >= level]
        for p in positions(own, level, bits):
            part[(p & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(part, bitorder="little").tobytes()


def spread(r: np.ndarray | np.uint64, low: np.ndarray, range_bits: int) -> np.ndarray:
    """An n-gram's identity, by its range and low 40 bits, as a 64-bit hash with the range on top."""
    middle = scramble(low) >> np.uint64(range_bits + 40) if range_bits < 24 else np.zeros_like(low)
    return (np.asarray(r, np.uint64) << np.uint64(64 - range_bits)) | (middle << np.uint64(40)) | (low & np.uint64(LOW))


@dataclass(frozen=True)
class LanguageModel:
    bits: int
    slice_bits: int
    range_bits: int
    train_tokens: int
    train_rows: int
    distinct: int
    head_hashes: np.ndarray  # ascending
    head_counts: np.ndarray
    weight: float

    @property
    def slices(self) -> int:
        return 1 << (self.bits - self.slice_bits)


@dataclass(frozen=True)
class Slice:
    """A stretch of the filter: that of the hashes whose top bits are ``number``."""

    filter: np.ndarray  # bytes, lowest bit first
    number: int
    model: LanguageModel

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The levels of counts, by probing one after the other; 0 for n-grams that the slice doesn't hold."""
        m = self.model
        hashes = spread(hashes >> np.uint64(64 - m.range_bits), hashes & np.uint64(LOW), m.range_bits)
        level = np.zeros(len(hashes), np.uint8)
        alive = np.flatnonzero((hashes >> np.uint64(1)) >> np.uint64(63 - (m.bits - m.slice_bits)) == np.uint64(self.number))
        inside = np.uint64((1 << m.slice_bits) - 1)
        while len(alive):
            ok = np.ones(len(alive), bool)
            for p in positions(hashes[alive], int(level[alive[0]]) + 1, m.bits):
                i = np.flatnonzero(ok)
                p = p[i] & inside
                held = (self.filter[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
                ok[i[held == 0]] = False
            alive = alive[ok]
            level[alive] += 1
        return level


def middle(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level, 0 for level 0."""
    return np.where(levels > 0, (3 * 2.0 ** (levels.astype(np.int64) - 1) - 1) / 2, 0.0)


@dataclass(frozen=True)
class FittedModel:
    model: LanguageModel
    parts: DataFrame  # range, part: the filter
    vocabulary: DataFrame  # h, c: the words' hashes and counts, the end included


def fit(train: DataFrame, text_col: str = "text", weight: float = 0.7, bits_per_key: int = 8, max_bits: int = MAX_BITS, max_head: int = MAX_HEAD) -> FittedModel:
    """Count all rows of ``train`` (null texts are empty) and build the filter, in slices of at most ``2 ** max_bits`` bits.

    Words are told apart by 64-bit hashes. An empty table gives a model that
    knows nothing.
    """
    spark = train.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    vocabulary = train.select(F.explode(words(text)).alias("w")).groupBy("w").agg(F.count("*").alias("c")).select(F.xxhash64("w").alias("h"), "c")
    vocabulary = materialize(vocabulary, "vocabulary")
    rows = train.count()
    # counts by quarter octave: a few hundred rows
    octaves = vocabulary.groupBy(F.floor(4 * F.log2("c")).alias("o")).agg(F.count("*").alias("n"), F.sum("c").alias("s")).collect()
    distinct, total = sum(o["n"] for o in octaves), sum(o["s"] for o in octaves)
    at_most, held = None, 0
    for o in sorted(octaves, key=lambda o: -o["o"]):
        if held + o["n"] > max_head:
            break
        at_most, held = o["o"], held + o["n"]
    head = vocabulary.filter(F.floor(4 * F.log2("c")) >= (at_most if at_most is not None else 1 << 30)).toArrow()  # max_head rows at most
    head_hashes, head_counts = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy()
    order = np.argsort(head_hashes)

    # a range takes about 400,000 n-grams before they are merged; ranges share no block of the filter
    range_bits = int(np.clip(np.ceil(np.log2(max(2 * (total + rows), 1) / 400_000)), 4, 24))
    counted = train.select(tokens(F.col(text_col)).alias("t")).mapInArrow(_count(range_bits), "range int, packed binary")
    merged = counted.groupBy("range").applyInArrow(_merge, "range int, packed binary, levels array<long>")
    merged = materialize(merged, "ngrams")
    levels = [0] * 41
    for row in merged.select(F.posexplode("levels").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect():
        levels[row["level"]] = row["n"]
    keys = sum(q * n for q, n in enumerate(levels))
    bits = max(int(np.ceil(np.log2(max(keys * bits_per_key, 1)))), range_bits + BLOCK_BITS)
    slice_bits = max(min(bits, max_bits), bits - range_bits)  # a slice holds whole ranges
    parts = materialize(merged.select("range", "packed").mapInArrow(_fill(range_bits, bits), "range int, part binary"), "filter")
    discard(spark, *folders(merged))
    end = spark.range(1 if rows else 0).select(F.lit(int(END)).alias("h"), F.lit(rows).cast("long").alias("c"))
    model = LanguageModel(
        bits, slice_bits, range_bits, int(total + rows), int(rows), int(distinct + bool(rows)),
        head_hashes[order], head_counts[order], weight,
    )
    return FittedModel(model, parts, vocabulary.unionByName(end))


def _log_unit(model: LanguageModel, counts: np.ndarray) -> np.ndarray:
    return np.log10((counts + 0.5) / (model.train_tokens + 0.5 * (model.distinct + 1)))


def _slice(fitted: FittedModel, number: int) -> Slice:
    m = fitted.model
    bits = m.range_bits - (m.bits - m.slice_bits)  # of a range's number within its slice
    table, size = np.zeros(1 << (m.slice_bits - 3), np.uint8), 1 << (m.bits - m.range_bits - 3)
    for batch in fitted.parts.filter(F.shiftright("range", bits) == number).toArrow().to_batches():  # a slice, 64 MB at most
        for r, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            r &= (1 << bits) - 1
            table[r * size : (r + 1) * size] = np.frombuffer(part.as_buffer(), np.uint8)
    return Slice(table, number, m)


def _note(at: int, shared):
    """Adds a slice's levels to those in the column after the tokens, which are in column ``at`` and go: a byte for each word of a row, and one for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for whole in batches:
            for batch in _blocks(whole, at, SCORED):
                token, _, pair, stops = ngrams(batch.column(at))
                both = s.levels(token), s.levels(pair)
                noted = []
                for a, b, old in zip([0, *stops[:-1].tolist()], stops.tolist(), batch.column(at + 1)):
                    new = np.concatenate([x[a:b] for x in both])
                    noted.append((new | np.frombuffer(old.as_py(), np.uint8) if len(old.as_buffer()) else new).tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(noted, pa.binary())], names=[*batch.schema.names[:at], batch.schema.names[at + 1]])

    return released(run)


def _noted(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    rows = [np.frombuffer(x.as_buffer(), np.uint8).reshape(2, -1) for x in column]
    both = np.concatenate(rows, axis=1) if rows else np.zeros((2, 0), np.uint8)
    return both[0], both[1]


def _score(at: int, shared, rest_col: str):
    """``shared``: the filter's only slice; if there are more, the model, and the column after ``at`` has the levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        m = s.model if isinstance(s, Slice) else s
        for whole in batches:
            for batch in _blocks(whole, at, SCORED):
                lists = batch.column(at)
                token, before, pair, stops = ngrams(lists)
                starts = np.concatenate([[0], stops[:-1]])
                # the model
                uni, pairs = map(middle, (s.levels(token), s.levels(pair)) if isinstance(s, Slice) else _noted(batch.column(at + 1)))
                context = np.concatenate([[m.train_rows], uni[:-1]]).astype(float)
                context[starts] = m.train_rows
                smooth = (uni + 0.5) / (m.train_tokens + 0.5 * (m.distinct + 1))
                share = np.minimum(pairs, context) / np.maximum(context, 1)
                p = np.where(context > 0, m.weight * share + (1 - m.weight) * smooth, smooth)
                score = np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)
                # the base, for the words whose counts are at hand; the others go on
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                i = np.minimum(np.searchsorted(m.head_hashes, flat), max(len(m.head_hashes) - 1, 0))
                known = m.head_hashes[i] == flat if len(m.head_hashes) else np.zeros(len(flat), bool)
                c = np.full(len(token), m.train_rows, np.int64)
                is_end = np.zeros(len(token), bool)
                is_end[stops - 1] = True
                words_at = np.flatnonzero(~is_end)
                c[words_at] = np.where(known, m.head_counts[i] if len(m.head_hashes) else 0, 0)
                base = np.add.reduceat(_log_unit(m, c), starts)
                n_known = np.add.reduceat((c > 0).astype(np.int64), starts)
                owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                rest = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=batch.num_rows))]).astype(np.int32)), pa.array(flat[~known].view(np.int64))
                )
                columns = [pa.array(np.diff(np.concatenate([[0], stops]))), pa.array(n_known), pa.array(base), pa.array(score), rest]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:at], *columns],
                    names=[*batch.schema.names[:at], "n_tokens", "n_known", "base_score", "score", rest_col],
                )

    return released(run)


def score(df: DataFrame, fitted: FittedModel, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with n_tokens, n_known, train_tokens, base_score and score.

    Null and empty texts hold the end alone. Repeated rows stay; columns of
    ``df`` with the outputs' names give way. Counts of the most frequent
    words are broadcast; other words are joined with the vocabulary, a row
    each, and summed by row.
    """
    m = fitted.model
    small_batches(df.sparkSession)
    outputs = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    kept = df.drop(text_col, "train_tokens", *(n for n, _ in outputs))
    tokens_col = fresh(kept, "tokens_of_text")
    listed = df.select(*(df[c] for c in kept.columns), tokens(F.col(text_col)).alias(tokens_col))
    rest_col, row_col = fresh(kept, "rest"), fresh(kept, "row")
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in outputs), T.StructField(rest_col, T.ArrayType(T.LongType()))])
    context = df.sparkSession.sparkContext
    if m.slices == 1:
        shared = context.broadcast(_slice(fitted, 0))
    else:
        # texts go along, not their tokens, which take several times the room; a pass's table goes when the next one is written
        own, levels_col = fresh(kept, "text_itself"), fresh(kept, "levels_of_text")
        noted = df.select(*(df[c] for c in kept.columns), F.col(text_col).cast("string").alias(own), F.lit(b"").alias(levels_col))
        told = lambda rows: rows.select(*(f"`{c}`" for c in (*kept.columns, own)), tokens(F.col(own)).alias(tokens_col), levels_col)
        for number in range(m.slices):
            held, before = context.broadcast(_slice(fitted, number)), noted
            noted = materialize(told(before).mapInArrow(_note(len(kept.columns) + 1, held), before.schema), "levels")
            held.destroy()
            if number:
                discard(df.sparkSession, *folders(before))
        listed = told(noted).drop(own)
        shared = context.broadcast(m)
    first = listed.mapInArrow(_score(len(kept.columns), shared, rest_col), schema).withColumn(row_col, F.monotonically_increasing_id())
    first = materialize(first, "scores")  # row numbers hold from here on
    rest = first.filter(F.size(rest_col) > 0).select(F.col(row_col).alias("row"), F.explode(rest_col).alias("h"))
    more = F.log10((F.col("c") + 0.5) / 0.5)
    added = rest.join(fitted.vocabulary, "h").groupBy("row").agg(F.sum(more).alias("more"), F.count("*").alias("found"))
    both = first.drop(rest_col).join(added, first[row_col] == added["row"], "left")
    return both.select(
        *(first[f"`{c}`"] for c in kept.columns), first["n_tokens"], (first["n_known"] + F.coalesce(added["found"], F.lit(0))).alias("n_known"),
        F.lit(m.train_tokens).cast("long").alias("train_tokens"), (first["base_score"] + F.coalesce(added["more"], F.lit(0.0))).alias("base_score"), first["score"],
    )
