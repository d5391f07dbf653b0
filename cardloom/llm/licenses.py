"""License scans as an exact set-similarity join, with built-in functions only.

Templates (phrases and notices) are token sets. Tokens are ordered by their
frequency in the whole corpus, rare ones first. A text's words are taken in
overlapping blocks, long enough that any stretch as long as the longest
template lies inside one. A block matches a template if it holds at least the
template's threshold share of its tokens; it must then hold one of the
template's prefix, the ``size - needed + 1`` rarest tokens. So blocks are
joined token by token with the templates' prefixes. A pair counts where it
meets first, in the global order; it must have enough tokens (length) and
enough of them after the meeting (position) before the tokens are compared.
Phrases must also stand word by word.

The templates are a table, broadcast up to ``BROADCAST_TOKENS`` tokens and
shuffled beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import ascii_lower, fresh, let, literal_rows, nonempty

#: Everything between words (after lower-casing A-Z): ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tokens of a template table that is broadcast.
BROADCAST_TOKENS = 1_000_000
#: Tokens that are looked up within a row before the join; where there are more, the join alone decides.
LOOKED_UP = 20_000


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool = False  # its words must stand consecutively
    threshold: float = 0.8

    @classmethod
    def of(cls, label: str, text: str, **more) -> Template:
        lowered = "".join(c.lower() if c.isascii() else c for c in text)
        return cls(label, tuple("".join(c if c.isalnum() or not c.isascii() else " " for c in lowered).split()), **more)

    @property
    def needed(self) -> int:
        n = len(set(self.words))
        return n if self.exact else max(1, -int(-self.threshold * n // 1))


PHRASES = (
    Template.of("cc-by", "cc by", exact=True),
    Template.of("gpl", "general public license", exact=True),
    Template.of("reserved", "all rights reserved", exact=True),
)
#: Short notices by which the scan adds labels of its own.
NOTICES = (
    Template.of("apache-2.0", "licensed under the apache license version 2.0"),
    Template.of("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template.of("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template.of("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    Template.of("cc-by-nc", "licensed under cc by nc 4.0"),
    Template.of("gpl-notice", "this work is licensed under the gnu general public license version 3"),
)


def words_of(text: Column) -> Column:
    return nonempty(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN))


def _sized(rows: DataFrame, tokens: int) -> DataFrame:
    return F.broadcast(rows) if tokens <= BROADCAST_TOKENS else rows


def token_order(df: DataFrame, text_col: str, templates: tuple[Template, ...]) -> list[str]:
    """The templates' tokens, rare ones first, by their counts in all of ``df`` (ties by token)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    known = _sized(literal_rows(df.sparkSession, [(w,) for w in vocabulary], "token string"), len(vocabulary))
    words = df.select(F.explode(words_of(F.col(text_col))).alias("token"))
    counts = {r["token"]: r["n"] for r in words.join(known, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _postings(df: DataFrame, templates: tuple[Template, ...], order: list[str]) -> tuple[DataFrame, list[str]]:
    """A row per prefix token of each template: token, its place, the template; and all prefix tokens."""
    rank, rows = {w: i for i, w in enumerate(order)}, []
    for i, t in enumerate(templates):
        ranked = sorted(set(t.words), key=rank.__getitem__)
        rows += [(w, k, i, t.needed, ranked, list(t.words) if t.exact else None) for k, w in enumerate(ranked[: len(ranked) - t.needed + 1])]
    table = literal_rows(df.sparkSession, rows, "token string, place int, template int, needed int, ranked array<string>, phrase array<string>")
    return _sized(table, sum(len(r[4]) for r in rows)), sorted({r[0] for r in rows})


def matching_blocks(texts: DataFrame, templates: tuple[Template, ...], order: list[str], step: int) -> DataFrame:
    """(key, template, block, share, starts) of the ``texts`` (key, words): each block that holds enough of a template.

    ``starts``: where a phrase's words stand, each start in one block; empty
    for other templates.
    """
    postings, prefix = _postings(texts, templates, order)
    among = lambda tokens, known: F.filter(tokens, lambda w: w.isin(known)) if len(known) <= LOOKED_UP else tokens
    if len(prefix) <= LOOKED_UP:
        texts = texts.filter(F.exists("words", lambda w: w.isin(prefix)))
    last = F.greatest(F.ceil(F.size("words") / step).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("words", b * step + 1, F.lit(2 * step)))
    blocks = texts.select("key", F.posexplode(parts).alias("block", "part")).withColumn("tokens", F.array_distinct("part"))
    met = blocks.select("*", F.explode(among(F.col("tokens"), prefix)).alias("token")).join(postings, "token")
    enough = F.size("tokens") >= F.col("needed")
    if len(order) <= LOOKED_UP:  # the block's known tokens in global order, and what is left of them from the meeting on
        ranked = F.array_intersect(F.array(*map(F.lit, order)), F.col("tokens"))
        enough = enough & let(ranked, lambda own: F.size(own) - F.array_position(own, F.col("token")) + 1 >= F.col("needed"))
    enough = enough & (F.size("ranked") - F.col("place") >= F.col("needed"))
    shared = F.array_intersect("ranked", "tokens")
    held = met.filter(enough).withColumn("shared", shared).filter((F.size("shared") >= F.col("needed")) & (F.get("shared", F.lit(0)) == F.col("token")))
    first = F.sequence(F.lit(0), F.least(F.lit(step), F.size("part")) - 1)
    stands = F.filter(first, lambda p: F.slice("part", p + 1, F.size("phrase")) == F.col("phrase"))
    starts = F.when(F.col("phrase").isNotNull(), F.transform(stands, lambda p: p + F.col("block") * step)).otherwise(F.array().cast("array<int>"))
    return held.select("key", "template", "block", (F.size("shared") / F.size("ranked")).alias("share"), starts.alias("starts"))


def scan(
    df: DataFrame, text_col: str = "text", phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES,
) -> DataFrame:
    """``df`` with n_words, places (per phrase: label, starts), matches (label, block start, share).

    Null and empty texts have no words and no matches. Repeated rows and rows
    of any id stay as they are: texts are told apart by their digest, by which
    the matches are joined back. Columns of ``df`` with the outputs' names
    give way. Three scans; a text is shuffled only if the caller keeps it.
    """
    templates = (*phrases, *notices)
    step = max((len(t.words) for t in templates), default=1)
    df = df.drop("n_words", "places", "matches")
    key, n_words, found = fresh(df, "text_key"), fresh(df, "n_words"), fresh(df, "found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest, words = F.unhex(F.sha2(text, 256)), words_of(text)
    order = token_order(df, text_col, templates)
    blocks = matching_blocks(df.select(digest.alias("key"), words.alias("words")), templates, order, step)
    each = F.struct("template", "block", "share", "starts")
    by_text = blocks.groupBy("key").agg(F.array_sort(F.collect_set(each)).alias("found")).toDF(key, found)  # of one text
    names = [t.label for t in templates]
    label = lambda i: F.get(F.array(*map(F.lit, names)), i)
    none = F.array().cast("array<struct<template:int,block:int,share:double,starts:array<int>>>")

    def place(i: Column) -> Column:
        own = F.flatten(F.transform(F.filter(F.col(found), lambda m: m["template"] == i), lambda m: m["starts"]))
        return F.struct(label(i).alias("label"), own.alias("starts"))

    loose = F.filter(F.col(found), lambda m: m["template"] >= len(phrases))
    matches = F.transform(loose, lambda m: F.struct(label(m["template"]).alias("label"), (m["block"] * step).alias("start"), m["share"].alias("share")))
    places = F.transform(F.array(*map(F.lit, range(len(phrases)))).cast("array<int>"), place)
    counted = df.withColumns({key: digest, n_words: F.size(words).cast("long")})
    joined = counted.join(by_text, key, "left").withColumn(found, F.coalesce(found, none))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), F.col(n_words).alias("n_words"), places.alias("places"), matches.alias("matches"))
