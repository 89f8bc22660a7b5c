"""Structured streaming: windows under a watermark, delivery-once, keyed runs with state, and incremental work by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, path: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark; state older than that is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, ts: str, by: str, value: str, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts, sums and maxima by tumbling or sliding window and key."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stream.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("high"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total", "high")


def sessions(stream: DataFrame, ts: str, by: str, late: str, gap: str) -> DataFrame:
    """Activity sessions that end after a gap."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return s.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_totals(stream: DataFrame, by: str, value: str, by_type: str) -> DataFrame:
    """Total and count a key since the start, kept as state of two numbers a key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = state.get if state.exists else (0.0, 0)
        for b in batches:
            total, n = total + float(b[value].sum()), n + len(b)
        state.update((total, n))
        yield pd.DataFrame({by: [key[0]], "total": [total], "n": [n]})

    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {by_type}, total double, n bigint", "total double, n bigint", "update", GroupStateTimeout.NoTimeout)


def incremental(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str]) -> None:
    """Work only on what is new: each batch's keys that have no output yet are worked on and appended; then it stops.

    A batch that is repeated after a failure finds its keys done, so the output holds each key once.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        jvm = spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(out)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            new = new.join(spark.read.parquet(out).select(*keys), keys, "left_anti")
        work(new).write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
