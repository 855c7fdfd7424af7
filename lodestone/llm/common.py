"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import lodestone
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition used by every operator here: [\x20\x09-\x0D].
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


#: Settings of Arrow batches: Spark's default and ours.
ARROW_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and keep Arrow batches of long texts small where the session
    has Spark's defaults for them."""
    for key, usual, ours in ARROW_BATCHES:
        if spark.conf.get(key) == usual:
            spark.conf.set(key, ours)
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(lodestone.__file__))
    target = os.path.join(tempfile.mkdtemp(), "lodestone_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lodestone", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._lodestone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


class Scratch:
    """Tables written between steps, in the shared folder. They cut lineage and survive lost executors.

    `write` returns the table as read back; `drop` deletes one that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(self.path(t))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def settle(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps before the next one writes its own."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that further ones with clashing names can't interfere."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def with_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def same(left: DataFrame, right: DataFrame, keys: list[str] | tuple[str, ...], how: str) -> DataFrame:
    """A join on equal keys where nulls equal each other; the keys are those of `left`."""
    other = right.select(*(F.col(k).alias(f"_same_{k}") if k in keys else F.col(k) for k in right.columns))
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys], how).drop(*(f"_same_{k}" for k in keys))


#: Rows up to which a list of documents to drop is broadcast; beyond, Spark shuffles both sides.
BROADCAST_DROPS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `docs` that aren't listed, where nulls equal each other; texts are shuffled only where the list is long."""
    listed = dropped.select(*keys).distinct()
    return same(docs, F.broadcast(listed) if listed.count() <= BROADCAST_DROPS else listed, keys, "left_anti").select(*docs.columns)
