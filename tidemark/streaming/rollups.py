"""Rollups, sessions and deduplication of streams; the same functions serve batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(df: DataFrame, ts: str, interval: str, aggs: dict[str, Column], keys: list[str] = (), late: str | None = None, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; `late` is the watermark of a stream."""
    rows = df.withWatermark(ts, late) if late else df
    at = F.window(ts, interval, slide) if slide else F.window(ts, interval)
    out = rows.groupBy(*keys, at.alias("w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


def sessions(df: DataFrame, ts: str, gap: str, aggs: dict[str, Column], keys: list[str], late: str | None = None) -> DataFrame:
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


def distinct_stream(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def feed(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A change feed: each micro-batch goes to `sink(batch, number)`."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
