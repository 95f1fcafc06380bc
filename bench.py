"""Runs the headline queries and prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINES = ["sample_by_hour", "sample_by_keys", "sample_by_fill_prev", "latest_on", "asof_join", "window_join", "band_join", "downsample_ohlcv", "filter_pushdown", "pricing_summary", "having", "top_k", "window_rows", "indicators_averages", "join_using_multi"]


#: Queries over `events` that are timed on ten copies of it as well: what a row costs beyond a job's own cost.
SCALED = ["sample_by_hour", "sample_by_keys", "latest_on", "asof_join", "window_rows", "indicators_averages"]


def tenfold(spark, folder: str, out: str) -> str:
    """Ten copies of `events`, each with ids of its own."""
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{folder}/events.parquet")
    copies = events.crossJoin(spark.range(10).withColumnRenamed("id", "_copy"))
    copies = copies.withColumn("event_id", F.col("event_id") + F.col("_copy") * 10_000_000).withColumn("user_id", F.col("user_id") + F.col("_copy") * 1_000_000)
    copies.drop("_copy").repartition(8).write.parquet(f"{out}/events.parquet")
    return out


def timed(query, spark, folder: str) -> float:
    query(spark, folder).write.format("noop").mode("overwrite").save()
    took = []
    for _ in range(2):
        began = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return round(min(took), 4)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.queries import QUERIES

    took = {name: timed(QUERIES[name], spark, folder) for name in HEADLINES}
    with tempfile.TemporaryDirectory() as scratch:
        large = tenfold(spark, folder, scratch)
        ten = {name: timed(QUERIES[name], spark, large) for name in SCALED}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "events_tenfold": ten}))


if __name__ == "__main__":
    main()
