"""Texts cut into chunks, windows, sections and speaker turns, of built-in functions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.operators.vectors import chunk_key, token_count

#: The version that chunk hashes are made with (a fixed value).
CHUNK_VERSION = 5
EDGES = r"(?U)\A\s+|\s+\z"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def _without_nul(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(""))


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, _bare), lambda p: p != "")


def paragraphs(text: Column) -> Column:
    """The parts between blank lines, trimmed; none for null or blank texts."""
    return _filled(F.split(_without_nul(text), "\n\n"))


def split_chunks(text: Column, limit: int = 1200) -> Column:
    """Chunks of at most ``limit`` code points: whole paragraphs as far as they fit, longer ones cut at their last space before the limit.

    A text within the limit is one chunk; null and blank texts have none. A
    word longer than the limit is cut.
    """
    # each match is one piece: the rest, or up to the last space, or a hard cut
    piece = rf"(?sU)\s*+(.{{1,{limit}}}\z|.{{1,{limit - 1}}}(?= )|.{{{limit}}})"
    entry = lambda value, joins: F.struct(value.alias("text"), F.lit(joins).alias("joins"))

    def pieces(p: Column) -> Column:
        cut = F.filter(F.transform(F.regexp_extract_all(p, F.lit(piece), F.lit(1)), _bare), lambda x: x != "")
        return F.when(F.char_length(p) <= limit, F.array(entry(p, True))).otherwise(F.transform(cut, lambda x: entry(x, False)))

    def add(state: Column, x: Column) -> Column:
        last = F.element_at(state, -1)
        fits = (F.size(state) > 0) & x["joins"] & (F.char_length(F.try_element_at(state, F.lit(-1))) + 2 + F.char_length(x["text"]) <= limit)
        joined = F.concat(F.slice(state, 1, F.size(state) - 1), F.array(F.concat(last, F.lit("\n\n"), x["text"])))
        return F.when(fits, joined).otherwise(F.concat(state, F.array(x["text"])))

    bare = _bare(_without_nul(text))
    packed = F.aggregate(F.flatten(F.transform(paragraphs(text), pieces)), F.array().cast("array<string>"), add)
    return F.when(bare == "", F.array().cast("array<string>")).when(F.char_length(bare) <= limit, F.array(bare)).otherwise(packed)


def rolling_windows(text: Column, limit: int = 1200, size: int = 2) -> Column:
    """Each run of ``size`` paragraphs (fewer at the end), cut to the limit, without repeats."""

    def runs(parts: Column) -> Column:
        window = lambda i: split_chunks(F.array_join(F.slice(parts, i + 1, size), "\n\n"), limit)
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), window)))

    # within a transform, so that the paragraphs are found once
    of_parts = lambda p: F.when(F.size(p) > 1, runs(p)).otherwise(split_chunks(F.try_element_at(p, F.lit(1)), limit))
    return F.transform(F.array(paragraphs(text)), of_parts)[0]


def heading_sections(text: Column) -> Column:
    """The text from each ATX heading to the next; what comes before the first goes. None of fewer than two headings."""
    heading = r"#{1,6}\s+[^\n]+"
    sections = F.filter(F.split(_bare(_without_nul(text)), rf"(?m)(?=^{heading}$)"), lambda s: s.rlike(rf"\A{heading}"))
    return F.when(F.size(sections) > 1, _filled(sections)).otherwise(F.array().cast("array<string>"))


def pipe_turns(text: Column) -> Column:
    """"Speaker: text" of each line "speaker | text" with both sides; lines that start with # aren't turns."""
    lines = F.filter(_filled(F.split(_without_nul(text), r"\r\n|\r|\n")), lambda x: x.rlike(r"(?U)\A(?!#)\s*[^|\s][^|]*\|(?s).*\S"))
    sides = F.transform(lines, lambda x: F.split(x, r"\|", 2))
    told = F.filter(sides, lambda s: (_bare(s[0]) != "") & (_bare(s[1]) != ""))
    return F.transform(told, lambda s: F.concat(_bare(s[0]), F.lit(": "), _bare(s[1])))


def colon_turns(text: Column) -> Column:
    """Blocks that start at a line "Name: text" (a name of 100 characters at most) and go on to the next such line."""
    start = r"(?m)(?=^[^\S\n]*[^:\s][^:\n]{0,99}: \S)"
    return _filled(F.split(F.regexp_replace(_without_nul(text), r"\r\n?", "\n"), start))


@F.pandas_udf(T.StringType())
def content_hash(kind: pd.Series, content: pd.Series, fields: pd.Series) -> pd.Series:
    """SHA-256 of the chunk's JSON with sorted keys and escaped non-ASCII characters, which Spark's own JSON doesn't write."""

    def one(k, c, f):
        told = {"chunk_schema_version": CHUNK_VERSION, "chunk_type": k, "source_fields": list(f), "content": c}
        return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()

    return pd.Series([one(*x) for x in zip(kind, content, fields)], dtype=object)


def chunk_rows(cards: DataFrame, uid: str, contents: dict[str, Column], limit: int = 1200) -> DataFrame:
    """uid, chunk_type, chunk_index, content, token_count, content_hash, chunk_key: a row per distinct chunk of a type.

    ``contents``: text by chunk type, which is also the source field's name.
    Of equal chunks of one type the first stays, and keeps its index, so
    indexes may have gaps. All is done within a card's row: nothing is shuffled.
    """
    first = lambda parts: F.filter(
        F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("content"))), lambda e: F.array_position(parts, e["content"]) == e["i"] + 1)
    lists = cards.select(F.col(uid).alias("uid"), *(split_chunks(text, limit).alias(f"c{n}") for n, text in enumerate(contents.values())))
    tag = lambda kind: lambda e: F.struct(F.lit(kind).alias("chunk_type"), e["i"].alias("chunk_index"), e["content"].alias("content"))
    tagged = F.concat(*(F.transform(first(F.col(f"c{n}")), tag(k)) for n, k in enumerate(contents)))
    rows = lists.select("uid", F.inline(tagged))
    hashed = rows.withColumn("content_hash", content_hash("chunk_type", "content", F.array("chunk_type")))
    return hashed.withColumns({
        "token_count": token_count(F.col("content")), "chunk_key": chunk_key(F.col("uid"), F.col("chunk_type"), F.col("chunk_index"), F.col("content_hash")),
    })
