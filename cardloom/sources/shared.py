"""The folder that driver and executors share, and results written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a temporary folder on a single machine, else one in the warehouse."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.conf.get("spark.master", "")
        alone = master.startswith("local") and "cluster" not in master
        known = tempfile.mkdtemp(prefix="spark-shared-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
