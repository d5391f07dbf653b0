"""Markdown notes with frontmatter, read by Spark's text source and parsed with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.normalize import wikilinks

HEAD = r"(?s)\A---\r?\n(.*?)\r?\n?---[ \t]*(?:\r?\n|\z)"
FIELD = r"(?m)^([A-Za-z_][A-Za-z0-9_]*):[ \t]*((?:[^\r\n]*)(?:\r?\n(?:[ \t]+|- ?)[^\r\n]*)*)"


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"^(['\"])(.*)\1$", "$2")


def items(value: Column) -> Column:
    """The members of a list field, of the form [a, b] or of lines "- a"; one member for a scalar, none for null or empty."""
    v = F.regexp_replace(F.coalesce(value, F.lit("")), r"\A\s+|\s+\z", "")
    flow = F.split(F.regexp_replace(v, r"^\[|\]$", ""), r"\s*,\s*")
    block = F.split(F.regexp_replace(v, r"^-\s+", ""), r"\r?\n\s*-\s+")
    parts = F.when(v.startswith("[") & ~v.startswith("[["), flow).when(v.startswith("- "), block).otherwise(F.array(v))
    return F.filter(F.transform(parts, _bare), lambda x: x != "")


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime, fields (map of raw values, the first of repeated ones), body, type and uid of all ``*.md`` below ``root``.

    A note without frontmatter has no fields and is all body. Nested mappings
    stay raw text. Whole files are read, one row each.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    head = F.regexp_extract("value", HEAD, 1)
    entries = F.arrays_zip(F.regexp_extract_all("head", F.lit(FIELD), F.lit(1)).alias("k"), F.regexp_extract_all("head", F.lit(FIELD), F.lit(2)).alias("v"))
    first = F.filter("entries", lambda e, i: F.array_position(F.col("entries.k"), e["k"]) == i + 1)
    fields = F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"], _bare(e["v"]))))
    return (
        files.withColumn("head", head).withColumn("entries", entries).withColumn("fields", fields)
        .select("path", "size", "mtime", "fields", F.regexp_replace("value", HEAD, "").alias("body"), F.try_element_at("fields", F.lit("type")).alias("type"), F.try_element_at("fields", F.lit("uid")).alias("uid"))
    )


def fingerprint(notes: DataFrame) -> DataFrame:
    """One row: n, and the sum of 64-bit hashes of (path, mtime, size). It doesn't depend on order, so no task holds all lines."""
    return notes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("path", "mtime", "size").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def link_edges(notes: DataFrame) -> DataFrame:
    """source_uid and slug of each distinct wikilink in a note's body and fields."""
    text = F.concat_ws("\n", F.map_values("fields"), F.array("body"))
    return notes.select(F.col("uid").alias("source_uid"), F.explode(F.array_distinct(wikilinks(text))).alias("slug")).filter("source_uid is not null")
