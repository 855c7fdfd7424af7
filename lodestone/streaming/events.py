"""Event streams: the same transformations work on a batch table and on a stream of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "events*.parquet", files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and give what it wrote."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total: tumbling, or sliding with `slide`; events later than `late` are dropped by streams."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ts.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_windows(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """key, start, last_end, n: events of a key no further apart than the gap; a stream drops what is later than `late`."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    return ts.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("last_end"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else ts.dropDuplicates([key])


def rate_limited(events: DataFrame, key: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """key, ts, allowed: windows start with a key's first event and last `seconds`; the first `limit` events in one are
    allowed. Each key is folded in time order (windows depend on what came before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, n = (), None, 0  # the key at hand and its window, carried from batch to batch
        for b in batches:
            ok = []
            for k, us in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (k,) != last or us is not None and us >= start + seconds * 1_000_000:
                    last, start, n = (k,), us, 0
                n += 1
                ok.append(n <= limit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["key", "us", "allowed"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.repartition("key").sortWithinPartitions("key", F.col("us").asc_nulls_last()).mapInArrow(run, "key string, us long, allowed boolean")


def rate_limited_stream(events: DataFrame, key: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """key, allowed, refused for each batch of a stream, with the window kept as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        allowed = refused = 0
        for us in sorted(u for f in frames for u in f["us"]):
            if start is None or us >= start + seconds * 1_000_000:
                start, n = us, 0
            n += 1
            allowed, refused = allowed + (n <= limit), refused + (n > limit)
        state.update((start, n))
        yield pd.DataFrame({"key": [k[0]], "allowed": [allowed], "refused": [refused]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, allowed long, refused long", "start long, n long", "update", GroupStateTimeout.NoTimeout)
