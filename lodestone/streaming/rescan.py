"""Scans that follow changes: findings by file as state, and what each change adds or takes away.

A stream of file versions (path, version, content; null content: removed) is scanned by line in the JVM, then meets the state of its path:
the last version, the content's hash and its findings. An older or equal version is stale and dropped; an equal hash changes nothing; else
findings that are gone are dropped and new ones added. A removed file keeps a tombstone (its version), so that a late older version doesn't bring it back. Sums of what was added less
what was dropped are the findings of one scan over the last versions, however the changes were split into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.text import split_lines
from lodestone.operators.scan import Rule

CHANGES = "path string, version long, action string, rule_id string, line_no int"
STATE = "version long, hash long, findings string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def line_findings(content: Column, rules: list[Rule]) -> Column:
    """`rule_id:line` of all findings of a text, without a shuffle; null content has none."""

    def on_line(t: Column, i: Column) -> Column:
        arms = []
        for r in rules:
            ok = t.rlike(r.pattern) & ~t.rlike(r.exclude) if r.exclude else t.rlike(r.pattern)
            arms.append(F.when(ok, F.concat(F.lit(f"{r.id}:"), (i + 1).cast("string"))))
        return F.array_compact(F.array(*arms))

    return F.coalesce(F.flatten(F.transform(split_lines(content), on_line)), F.array().cast("array<string>"))


def _followed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """CHANGES of one path, with its last version, hash and findings as state. States come and go with the rows of many paths, so none is asked for by itself."""
    came = sorted(((int(v), int(h), f) for x in frames for v, h, f in zip(x["version"], x["hash"], x["findings"], strict=True)), key=lambda r: r[:2])
    version, hash_, old = state.get if state.exists else (None, None, "")
    out = []
    for v, h, f in came:
        if version is not None and v <= version:
            continue
        version = v
        if h == hash_:
            continue
        before, now = set(filter(None, old.split("\n"))), set(filter(None, f.split("\n")))
        out += [(key[0], v, action, *x.rsplit(":", 1)) for action, part in (("drop", before - now), ("add", now - before)) for x in sorted(part)]
        hash_, old = h, f
    if version is not None:
        state.update((version, hash_, old))
    if out:
        # Columns with their types: a frame for each path is most of what a path costs.
        path, v, action, rule, line = zip(*out, strict=True)
        yield pd.DataFrame({"path": path, "version": np.array(v, np.int64), "action": action, "rule_id": rule, "line_no": np.array(line).astype(np.int32)})


def follow(changes: DataFrame, rules: list[Rule]) -> DataFrame:
    """CHANGES of a stream of (path, version, content). Rows with a null path or version are left out; a version given twice is stale the second time (of one batch, the content
    with the smaller hash counts)."""
    known = changes.where("path is not null and version is not null")
    rows = known.select(F.col("path").cast("string").alias("path"), F.col("version").cast("long").alias("version"), F.when(F.col("content").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("content")).alias("hash"), F.array_join(line_findings(F.col("content"), rules), "\n").alias("findings"))
    return rows.groupBy("path").applyInPandasWithState(_followed, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def net(changes: DataFrame) -> DataFrame:
    """path, rule_id, line_no: the findings that stand after all CHANGES."""
    return changes.groupBy("path", "rule_id", "line_no").agg(F.sum(F.when(F.col("action") == "add", 1).otherwise(-1)).alias("n")).where("n > 0").drop("n")


def run_to_end(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Write a stream's rows below `folder` until its source has no more, and read them: checkpoint and state lie there, too, so a run that is broken off goes on where it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
