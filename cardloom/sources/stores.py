"""Card and embedding stores: strict writes, patches, exports, copies between schemas; JSON lines and lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.operators.identity import missing_provenance

EXEMPT = ("uid", "type", "created", "updated")


def invalid_reasons(cards: DataFrame) -> Column:
    """Why a card (uid, rel_path, type, fields, provenance) may not be written; empty if it may."""
    reason = lambda test, name: F.when(test, F.lit(name))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.array_compact(F.array(
        reason(blank(F.col("uid")), "no uid"), reason(blank(F.col("type")), "no type"), reason(~F.coalesce(F.col("rel_path").rlike(r"\.md$"), F.lit(False)), "no note path"),
        reason(F.col("rel_path").rlike(r"(^|/)\.\.(/|$)|^/"), "path outside the vault"), reason(F.size(missing_provenance(F.col("fields"), F.col("provenance"), list(EXEMPT))) > 0, "fields without provenance"),
    ))


def write_cards(cards: DataFrame, path: str) -> DataFrame:
    """Append the valid cards, in a folder for each type; returns the others with their reasons.

    A job's files count only when it commits, so a task that is run twice
    writes its cards once.
    """
    told = cards.withColumn("reasons", invalid_reasons(cards))
    told.filter(F.size("reasons") == 0).drop("reasons").write.mode("append").partitionBy("type").parquet(path)
    return told.filter(F.size("reasons") > 0)


def patched(cards: DataFrame, patches: DataFrame) -> DataFrame:
    """``cards`` with the fields of ``patches`` (uid, fields) written over theirs; null values take a field away. Later patches of a uid must be merged before."""
    new = patches.select("uid", F.col("fields").alias("_patch"))
    both = F.when(F.col("_patch").isNull(), F.col("fields")).otherwise(F.map_filter(F.map_zip_with("fields", "_patch", lambda k, a, b: F.when(F.map_contains_key(F.col("_patch"), k), b).otherwise(a)), lambda k, v: v.isNotNull()))
    return cards.join(new, "uid", "left").withColumn("fields", both).select(*cards.columns)


def export_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.write.mode("overwrite").parquet(path)


def import_embeddings(spark: SparkSession, path: str, held: DataFrame, keys: tuple[str, ...] = ("chunk_key", "model")) -> DataFrame:
    """The exported rows whose keys are not ``held`` yet, each key once."""
    return spark.read.parquet(path).dropDuplicates(list(keys)).join(held.select(*keys), list(keys), "left_anti")


def copied(source: DataFrame, live: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows of another schema whose key is live here and not held yet (embeddings by chunk_key, classifications by uid)."""
    return source.join(live.select(key).distinct(), key, "left_semi").join(held.select(key).distinct(), key, "left_anti")


def preservation(before: DataFrame, after: DataFrame, chunks: DataFrame, key: str = "chunk_key") -> DataFrame:
    """One row: embeddings before and after a rebuild, how many still have a chunk, how many don't."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    valid = after.join(chunks.select(key).distinct(), key, "left_semi")
    return n(before, "pre").join(n(after, "post")).join(n(valid, "valid")).withColumn("orphan", F.col("post") - F.col("valid"))  # a row each


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value) of a CSV table with a header: keys trimmed and upper case, one row each."""
    rows = spark.read.option("header", True).csv(path).select(F.upper(F.trim(key)).alias("key"), F.trim(value).alias("value")).filter("key <> ''")
    return rows.groupBy("key").agg(F.min("value").alias("value"))


def looked_up(rows: DataFrame, code: str, lookup: DataFrame, out: str) -> DataFrame:
    """``rows`` with the lookup's value for a code, whatever its case; empty where it has none. AQE broadcasts a small table."""
    told = lookup.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    return rows.join(told, F.upper(F.trim(code)) == F.col("_key"), "left").withColumn(out, F.coalesce("_value", F.lit(""))).drop("_key", "_value")


def promoted_paths(staged: DataFrame) -> DataFrame:
    """``staged`` (uid, type, fields) with the path that a staged card gets: its type's folder, its month, its uid."""
    day = F.coalesce(*(F.try_element_at("fields", F.lit(n)) for n in ("created", "sent_at", "start_at")), F.lit(""))
    month = F.when(day.rlike(r"^\d{4}-\d{2}"), F.left(day, F.lit(7))).otherwise("undated")
    folder = F.initcap(F.replace("type", F.lit("_"), F.lit(" ")))
    return staged.withColumn("rel_path", F.concat(F.replace(folder, F.lit(" "), F.lit("")), F.lit("/"), month, F.lit("/"), "uid", F.lit(".md")))


def staging_report(staged: DataFrame, most: int = 3) -> DataFrame:
    """Per type: how many staged cards, and the ``most`` smallest uids, of which a partial sort keeps no more for each task."""
    counts = staged.groupBy("type").agg(F.count("*").alias("n"))
    first = staged.select("type", "uid").withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("uid"))).filter(F.col("r") <= most)
    return counts.join(first.groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("uid")), ",").alias("samples")), "type")
