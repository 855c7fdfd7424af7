"""Reading tables, and cutting lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the context's checkpoint folder; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-cut-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(spark: SparkSession, df: DataFrame, apart: bool = False) -> DataFrame:
    """The table as written to the shared folder and read back: lineage ends there, each row is made once, and a lost executor costs tasks only.
    `apart`: joins with it broadcast nothing. Tokens pack so well that the size of their files, from which Spark judges, is a small part of what a broadcast would hold."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.hint("merge") if apart else back
