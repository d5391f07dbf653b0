"""SimHash near-duplicates, linked by anchor-point covering.

A fingerprint of 64 bits is taken in two halves. If two fingerprints differ in
at most ``t`` bits, one of their halves differs in at most ``t // 2``. In each
half, 30 bits are covered by the anchors of a linear code: the perfect Golay
code of length 23 (covering radius 3) beside the perfect Hamming code of
length 7 (radius 1). A fingerprint's home is its nearest anchor. Every
fingerprint is copied to each anchor that may be the home of one within
``t // 2`` bits, all of them within covering radius plus threshold, and homes
meet copies anchor by anchor. No pair within the threshold is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import fresh, materialize, released, small_batches
from cardloom.llm.components import connected_components
from cardloom.llm.lm import scramble
from cardloom.llm.prefix import Texts, all_pairs, first_pairs, prefix_keys

SEED = 42
#: Generator polynomials of the two codes (fixed values).
GOLAY_BITS, GOLAY_CHECK, GOLAY_POLYNOMIAL = 23, 11, 0b101011100011
HAMMING_BITS, HAMMING_CHECK, HAMMING_POLYNOMIAL = 7, 3, 0b1011


def fingerprint(text: str | None, words: int) -> int:
    """SimHash over the XXH64 of shingles of ``words`` words; 0 without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(parts) - words + 1)
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[:n], stops)])
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 << 16):  # a very long text in slices
        bits = np.unpackbits(np.frombuffer(hashes[at : at + (8 << 16)], np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(text_col: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(batch.columns) if i != at), pa.array(fps.view(np.int64))],
                names=[*(n for i, n in enumerate(batch.schema.names) if i != at), "fp"],
            )

    return released(run)


def remainder(values: np.ndarray, bits: int, check: int, polynomial: int) -> np.ndarray:
    """Syndromes: the remainder of each value by the code's polynomial over GF(2)."""
    out = values.astype(np.int64)
    for i in range(bits - 1, check - 1, -1):
        out ^= ((out >> i) & 1) * (polynomial << (i - check))
    return out


@lru_cache(maxsize=2)
def leaders(bits: int, check: int, polynomial: int) -> np.ndarray:
    """By syndrome, the lightest error pattern: the way from a word to its nearest codeword."""
    table, radius = np.full(1 << check, -1, np.int64), 0
    while (table < 0).any():
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], np.int64)
        found = remainder(errors, bits, check, polynomial)
        empty = table[found] < 0
        table[found[empty]] = errors[empty]
        radius += 1
    return table


def home(words30: np.ndarray) -> np.ndarray:
    """The nearest anchor's number (16 bits) of each 30-bit word."""
    golay, hamming = words30 & ((1 << GOLAY_BITS) - 1), words30 >> GOLAY_BITS
    g = golay ^ leaders(GOLAY_BITS, GOLAY_CHECK, GOLAY_POLYNOMIAL)[remainder(golay, GOLAY_BITS, GOLAY_CHECK, GOLAY_POLYNOMIAL)]
    h = hamming ^ leaders(HAMMING_BITS, HAMMING_CHECK, HAMMING_POLYNOMIAL)[remainder(hamming, HAMMING_BITS, HAMMING_CHECK, HAMMING_POLYNOMIAL)]
    return (g >> GOLAY_CHECK) | ((h >> HAMMING_CHECK) << (GOLAY_BITS - GOLAY_CHECK))


@lru_cache(maxsize=4)
def ways(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome pair: how a word's home differs from the homes of all words within ``threshold`` bits.

    Linear codes: that depends on the syndromes alone. Returns the flat list
    of differences and the offsets of each syndrome pair's stretch.
    """
    bits = GOLAY_BITS + HAMMING_BITS
    errors = np.array([sum(1 << i for i in c) for w in range(threshold + 1) for c in combinations(range(bits), w)], np.int64)
    lists = []
    g_lead, h_lead = leaders(GOLAY_BITS, GOLAY_CHECK, GOLAY_POLYNOMIAL), leaders(HAMMING_BITS, HAMMING_CHECK, HAMMING_POLYNOMIAL)
    for s in range(1 << (GOLAY_CHECK + HAMMING_CHECK)):
        word = g_lead[s & ((1 << GOLAY_CHECK) - 1)] | (h_lead[s >> GOLAY_CHECK] << GOLAY_BITS)
        lists.append(np.unique(home(word ^ errors) ^ home(np.array([word]))))
    return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])


def _anchors(threshold: int | None):
    """The rows, fp first, with their anchor: at each half's home (threshold None) or at every anchor to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, offsets = ways(threshold // 2) if threshold is not None else (None, None)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for half in (0, 1):
                word = ((fps >> np.uint64(32 * half)) & np.uint64((1 << 30) - 1)).astype(np.int64)
                anchors, rows = home(word), np.arange(len(fps))
                if threshold is not None:
                    golay, hamming = word & ((1 << GOLAY_BITS) - 1), word >> GOLAY_BITS
                    s = remainder(golay, GOLAY_BITS, GOLAY_CHECK, GOLAY_POLYNOMIAL)
                    s |= remainder(hamming, HAMMING_BITS, HAMMING_CHECK, HAMMING_POLYNOMIAL) << GOLAY_CHECK
                    counts = offsets[s + 1] - offsets[s]
                    rows = np.repeat(rows, counts)
                    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    anchors = anchors[rows] ^ flat[offsets[s][rows] + step]
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array((anchors | (half << 16)).astype(np.int32)), *taken.columns], names=["anchor", *batch.schema.names])

    return released(run)


def _at_anchors(nodes: DataFrame, threshold: int | None, suffix: str) -> DataFrame:
    rows = nodes.mapInArrow(_anchors(threshold), T.StructType([T.StructField("anchor", T.IntegerType()), *nodes.schema.fields]))
    return rows.select("anchor", *(F.col(c).alias(f"{c}_{suffix}") for c in nodes.columns))


def _wanted(nodes: DataFrame, threshold: int, total: int | None):
    """Fingerprints within ``threshold`` bits, classes differ, and all of fp0, fp1, ... within ``total`` bits together."""
    apart = lambda c: F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y")))
    close = (apart("fp") <= threshold) & (F.col("class_x") != F.col("class_y"))
    more = [apart(c) for c in nodes.columns if c not in ("fp", "id", "class")]
    return close & (reduce(lambda a, b: a + b, more) <= total) if more else close


def near_pairs(nodes: DataFrame, threshold: int = 4, total: int | None = None) -> DataFrame:
    """Distinct pairs (x, y), x < y, of the ids of ``nodes`` (fp, id, class, further fingerprints: long) within ``threshold`` bits.

    Pairs of one class are left out, and those whose further fingerprints
    differ in more than ``total`` bits together. Neither side is broadcast:
    Spark takes a fingerprint's copies at its anchors, dozens, for one row.
    """
    if threshold // 2 > 3:
        raise ValueError("thresholds of 0 to 7 bits are covered")
    homes, search = _at_anchors(nodes, None, "x"), _at_anchors(nodes, threshold, "y")
    wanted = _wanted(nodes, threshold, total) & (F.col("id_x") < F.col("id_y"))
    return homes.join(search.hint("shuffle_merge"), (homes["anchor"] == search["anchor"]) & wanted).select(F.col("id_x").alias("x"), F.col("id_y").alias("y")).distinct()


def leader_pairs(nodes: DataFrame, fps: list[str], threshold: int, total: int | None = None) -> DataFrame:
    """Pairs of each of ``nodes`` (id, class and ``fps``) with two at each of its home anchors, the first by id and by its hash, if near as in :func:`near_pairs`.

    The anchors of all ``fps`` go through one join: a plan for each would leave
    the driver with many times the stages and tasks to keep.
    """
    each = F.explode(F.array(*(F.struct(F.col(f).alias("fp"), F.lit(k).alias("which")) for k, f in enumerate(fps)))).alias("e")
    rows = nodes.select("id", "class", *fps, each).select("e.fp", "id", "class", *fps, "e.which")
    rows = rows.mapInArrow(_anchors(None), T.StructType([T.StructField("anchor", T.IntegerType()), *rows.schema.fields]))
    rows = rows.withColumn("anchor", F.col("anchor").bitwiseOR(F.shiftleft("which", 17))).drop("which")
    own = [c for c in rows.columns if c != "anchor"]
    homes = rows.select("anchor", *(F.col(c).alias(f"{c}_y") for c in own))
    one = F.struct(*(F.col(c).alias(f"{c}_x") for c in own))
    leaders = rows.groupBy("anchor").agg(*(F.min_by(one, by).alias(a) for a, by in (("l", F.col("id")), ("h", F.xxhash64("id")))))
    leaders = leaders.select(F.col("anchor").alias("at"), F.inline(F.array("l", "h")))
    pairs = homes.join(leaders.hint("shuffle_merge"), (homes["anchor"] == leaders["at"]) & _wanted(rows.drop("anchor"), threshold, total))
    return pairs.select(F.least("id_x", "id_y").alias("x"), F.greatest("id_x", "id_y").alias("y")).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 4,
) -> DataFrame:
    """A row per row of ``df``: id, fp (the 64 bits as a signed long), fingerprint (hex), component_id.

    Documents link if their fingerprints differ in at most ``threshold`` bits;
    component_id is the smallest id that links reach, the own one included.
    Null and empty texts have the fingerprint zero and link like any other;
    null ids are never a component's id (one of null ids alone has a null id);
    repeated rows get a row each; only the two columns are read.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(rows.mapInArrow(_fingerprints("text", words), schema), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    links = near_pairs(nodes.select("fp", F.col("fp").alias("id"), F.col("fp").alias("class")), threshold)
    roots = connected_components(links.toDF("a", "b")).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _distinct_words(seeds: tuple[int, ...]):
    """Rows (id, same, fp0, fp1, ...): a digest of the words in order, and a SimHash of the distinct words by each seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fps = [], np.zeros((len(seeds), batch.num_rows), np.uint64)
            for i, text in enumerate(batch.column(1)):
                parts = (text.as_py() or "").encode().lower().split()
                same.append(xxhash.xxh3_128_digest(b" ".join(parts)))
                own = set(parts)
                for k, seed in enumerate(seeds if own else ()):
                    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w, seed) for w in own]), np.uint8)
                    ones = np.unpackbits(hashes).reshape(-1, 64).sum(axis=0, dtype=np.int32)
                    fps[k, i] = int.from_bytes(np.packbits(ones * 2 > len(own)).tobytes(), "big")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same, pa.binary()), *(pa.array(f.view(np.int64)) for f in fps)],
                names=["id", "same", *(f"fp{k}" for k in range(len(seeds)))],
            )

    return released(run)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes, ascending, of the distinct runs of ``words`` words; a shorter text is one run."""
    parts = (text or "").encode().lower().split()
    own = {w: xxhash.xxh64_intdigest(w) for w in set(parts)}
    flat = np.array([own[w] for w in parts], np.uint64)
    words = min(words, len(parts))
    h = np.full(max(len(parts) - words + 1, 1), words, np.uint64)
    for k in range(words):
        h = scramble(h * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(h)])
    return np.unique(h)


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return released(run)


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both >= similarity * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(good))

    return released(run)


def verified(pairs: DataFrame, texts: Texts, words: int, similarity: float) -> DataFrame:
    """The pairs (x, y) of ids of ``texts`` whose sets of shingles are alike to ``similarity``; only their sets leave the scan."""
    wanted = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    sets = texts.among(wanted, _shingle_sets(words), "id long, shingles binary")
    sets = materialize(sets.dropDuplicates(["id"]), "shingles")
    a = sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx"))
    b = sets.select(F.col("id").alias("y"), F.col("shingles").alias("sy"))
    return pairs.join(a, "x").join(b, "y").select("x", "y", "sx", "sy").mapInArrow(_similar(similarity), "x long, y long")


def similar_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8,
    threshold: int = 3, seeds: tuple[int, ...] = (42, 43, 44, 45), total: int = 24,
) -> DataFrame:
    """A row per row of ``df``: id and component_id, linked by likeness of their shingles.

    Rows with the same words in order are one text. Texts link if the Jaccard
    index of their ``words``-word shingles is at least ``similarity``;
    component_id is the smallest id that links reach. First candidates are
    texts and leaders whose SimHashes of distinct words differ in at most
    ``threshold`` bits under any of ``seeds``, and in ``total`` over all: they
    gather large groups at a pair a text. A prefix-filter join then meets
    every other pair that can reach ``similarity`` (see :mod:`prefix`). All
    candidates are compared exactly.

    Null texts are empty, empty texts are all one text; rows with a null id
    get a null component_id. Ids should be unique.
    """
    kind = df.schema[id_col].dataType
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    fps = [f"fp{k}" for k in range(len(seeds))]
    schema = T.StructType([T.StructField("id", kind), T.StructField("same", T.BinaryType()), *(T.StructField(f, T.LongType()) for f in fps)])
    marked = materialize(rows.mapInArrow(_distinct_words(seeds), schema), "distinct-words")
    texts = marked.groupBy("same", *fps).agg(F.min("id").alias("first"))
    texts = materialize(texts.select("same", *fps, F.col("first").cast("long").alias("id"), F.col("first").cast("long").alias("class")), "texts")
    copies = materialize(marked.select(F.col("id").cast("long").alias("id")).join(texts, "id", "left_anti").distinct(), "copies")
    by_id = Texts.without(rows.select(F.col("id").cast("long").alias("id"), "text"), copies)
    met = prefix_keys(by_id, shingles, words, similarity)
    by_simhash = lambda texts: leader_pairs(texts, fps, threshold, total)
    by_prefix = lambda pairs: lambda texts: pairs(met.join(texts.select("id", "class"), "id"), similarity)
    links = None
    # members of a large group link to a leader first, a pair each; then only pairs of different classes are left
    for candidates in (by_simhash, by_prefix(first_pairs), by_prefix(all_pairs)):
        pairs = materialize(candidates(texts).distinct(), "candidates")
        new = verified(pairs, by_id, words, similarity)
        links = materialize(new if links is None else links.unionByName(new), "similar")
        roots = connected_components(links.toDF("a", "b"))
        named = texts.drop("class").join(roots, texts["id"] == roots["node"], "left")
        texts = materialize(named.select("same", *fps, "id", F.coalesce("root", "id").alias("class")), "texts")
    named = texts.select("same", F.col("class").alias("component_id"))
    out = marked.join(named, "same").select(F.col("id").alias(id_col), "component_id")
    return out.unionByName(df.filter(F.col(id_col).isNull()).select(id_col, F.lit(None).cast("long").alias("component_id")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One document of each component by :func:`similar_documents`: that of the smallest id, one without an id only where no other has one.

    Rows of one id and text are one document, all of whose rows stay or go.
    Rows of one id and different texts, and each row without an id, are
    documents of their own: where there are any, all rows are written once
    with a number, by which they are linked.
    """
    odd = df.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if odd.isEmpty():
        classes = similar_documents(df, id_col, text_col, **parameters)
        gone = fresh(df, "gone_id")
        dropped = classes.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct()
        return df.join(dropped, df[id_col] == dropped[gone], "left_anti")
    own = fresh(df, "row_number")
    rows = materialize(df.withColumn(own, F.monotonically_increasing_id()), "numbered")
    classes = similar_documents(rows.select(own, text_col), own, text_col, **parameters)
    told = rows.select(F.col(own).alias("node"), F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("told")).alias("document"))
    told = told.join(classes.select(F.col(own).alias("node"), "component_id"), "node")
    best = told.groupBy("component_id").agg(F.min(F.struct("document", "node")).alias("best"))
    stays = (F.col("node") == F.col("best.node")) | (~F.col("document.nameless") & (F.col("document") == F.col("best.document")))
    dropped = told.join(best, "component_id").filter(~stays).select(F.col("node").alias(own))
    return rows.join(dropped, own, "left_anti").drop(own)
