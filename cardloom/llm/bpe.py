"""Byte-level BPE encoding and decoding of whole texts.

A text of up to ``chunk_chars`` code points is encoded at once. A longer one
is cut into overlapping chunks that are pre-tokenised in parallel, each from
its own start. Where a pre-token boundary of one chunk's end coincides with
one of the next chunk's start, both go on alike from there, so that place is a
true boundary of the whole text; the text is cut there, and the pieces are
encoded in parallel. If any two neighbours never meet within the overlap, the
whole text stays one piece, which is exact too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import fresh, partitions, small_batches

#: Code points past a match that the pattern may look at to decide it.
LOOK_AHEAD = 4


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _ids_array(encoded: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(x) for x in encoded], out=offsets[1:])
    flat = np.fromiter((i for x in encoded for i in x), np.int32, offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode_batches(path: str, pattern: str, text_col: str, out: str, drop_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = _ids_array([enc.encode_ordinary(t or "") for t in part.column(at).to_pylist()])
                names, columns = list(part.schema.names), list(part.columns)
                if drop_text:
                    names.pop(at), columns.pop(at)
                yield pa.RecordBatch.from_arrays([*columns, ids], names=[*names, out])

    return run


def _split(chunk: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["key"], frame["text"]):
                starts = range(0, len(text), chunk)
                yield pd.DataFrame({
                    "key": key, "i": range(len(starts)), "start": starts,
                    "last": [s + chunk + overlap >= len(text) for s in starts],
                    "part": [text[s : s + chunk + overlap] for s in starts],
                })

    return run


def boundaries(part: str, pattern: regex.Pattern, last: bool) -> np.ndarray:
    """Ends of the matches in ``part`` that more text after it couldn't change.

    Ends after white space are left out: there a piece that ends might split
    its last run of spaces otherwise than the whole text does.
    """
    sure = len(part) if last else len(part) - LOOK_AHEAD
    ends = []
    for m in pattern.finditer(part):
        if m.end() > sure:
            break
        if not part[m.end() - 1].isspace():
            ends.append(m.end())
    return np.array(ends, np.int64)


def _pretokenise(pattern: str, chunk: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = regex.compile(pattern)
        for frame in frames:
            heads, tails = [], []
            for start, last, part in zip(frame["start"], frame["last"], frame["part"]):
                ends = boundaries(part, compiled, bool(last))
                heads.append((ends[ends < overlap] + start).tolist())
                tails.append((ends[ends >= chunk] + start).tolist())
            yield pd.DataFrame({"key": frame["key"], "i": frame["i"], "heads": heads, "tails": tails})

    return run


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for key, text, cuts in zip(frame["key"], frame["text"], frame["cuts"]):
            at = [0, *(() if cuts is None else cuts), len(text)]
            yield pd.DataFrame({"key": key, "i": range(len(at) - 1), "piece": [text[a:b] for a, b in zip(at, at[1:])]})


def encode_long(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) of distinct (key, text) rows: chunks, stitching, pieces."""
    n = partitions(texts.sparkSession)
    chunks = texts.mapInPandas(_split(chunk, overlap), "key binary, i int, start long, last boolean, part string")
    ends = chunks.repartition(n, "key", "i").mapInPandas(
        _pretokenise(pattern, chunk, overlap), "key binary, i int, heads array<long>, tails array<long>"
    )
    following = F.lead("heads").over(Window.partitionBy("key").orderBy("i"))
    cuts = (
        ends.withColumn("next", following).filter(F.col("next").isNotNull())
        .select("key", F.array_min(F.array_intersect("tails", "next")).alias("cut"))
        .groupBy("key").agg(F.sort_array(F.collect_list("cut")).alias("cuts"), (F.count("*") == F.count("cut")).alias("whole"))
        .filter("whole").drop("whole")
    )
    pieces = texts.join(cuts, "key", "left").mapInPandas(_pieces, "key binary, i int, piece string")
    encoded = pieces.repartition(n, "key", "i").mapInArrow(
        _encode_batches(path, pattern, "piece", "ids", drop_text=True), "key binary, i int, ids array<int>"
    )
    in_order = F.array_sort(F.collect_list(F.struct("i", "ids")))
    return encoded.groupBy("key").agg(F.flatten(F.transform(in_order, lambda p: p["ids"])).alias("ids"))


def encode(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids",
    chunk_chars: int = 32_768, overlap_chars: int = 1_024,
) -> DataFrame:
    """``df`` with ``out``, the token ids of each whole text by the ranks in ``path``.

    Null and empty texts get no ids. Repeated rows stay; a long text that many
    rows share is encoded once. Other columns are kept, but for one named
    ``out``, which gives way. The ranks file must exist on every machine.
    """
    small_batches(df.sparkSession)
    df = df.drop(out)
    long_text = F.coalesce(F.char_length(text_col) > chunk_chars, F.lit(False))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    short = df.filter(~long_text).mapInArrow(_encode_batches(path, pattern, text_col, out), schema)
    key = fresh(df, "text_key")
    hashed = df.filter(long_text).withColumn(key, F.unhex(F.sha2(F.col(text_col), 256)))
    texts = hashed.select(F.col(key).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    encoded = encode_long(texts, path, pattern, chunk_chars, overlap_chars).select(
        F.col("key").alias(key), F.col("ids").alias(out)
    )
    return short.unionByName(hashed.join(encoded, key).drop(key))


def _decode_batches(path: str, ids_col: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = part.column(at)
                flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()
                ends = np.cumsum(np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)).tolist()
                texts = [b"".join(map(table.__getitem__, flat[a:b])) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, out])

    return run


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the concatenated raw bytes of each row's ids; null or no ids: no bytes."""
    small_batches(df.sparkSession)
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])
    return df.mapInArrow(_decode_batches(path, ids_col, out), schema)


def ids_sha256(ids: Column) -> Column:
    return F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), " "), 256)
