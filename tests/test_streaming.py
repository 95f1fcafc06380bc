"""Streams over files: watermarks, late rows, restarts from a checkpoint, and that batches give the same."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.sources import line_protocol
from tidemark.streaming import rollups

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, v double"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, tmp_path, name):
    """What is new since the last run, appended to a table; a query that starts again goes on from its checkpoint."""
    query = df.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    return query


def rows(spark, tmp_path, name, *columns):
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).select(*columns).collect())


def test_rollup_drops_late_rows_and_restarts(spark, tmp_path):
    source = tmp_path / "in"
    make = lambda: rollups.rollup(spark.readStream.schema(SCHEMA).parquet(str(source)), "ts", "1 hour", {"s": F.sum("v")}, ["k"], late="30 minutes").withColumn("start", F.col("start").cast("string"))
    put(spark, source, [("a", at(0.1), 1.0), ("a", at(0.6), 2.0), ("b", at(0.2), 5.0)])
    run(make(), tmp_path, "out")
    put(spark, source, [("a", at(5), 7.0)])
    run(make(), tmp_path, "out")  # the watermark passes the first hour: its windows are done
    put(spark, source, [("a", at(0.3), 100.0), ("a", at(4.8), 1.0)])
    run(make(), tmp_path, "out")  # the first row is late and goes, the second is in time
    put(spark, source, [("c", at(9), 0.0)])
    run(make(), tmp_path, "out")
    got = rows(spark, tmp_path, "out", "k", "start", "s")
    assert got == [("a", "2024-01-01 00:00:00", 3.0), ("a", "2024-01-01 04:00:00", 1.0), ("a", "2024-01-01 05:00:00", 7.0), ("b", "2024-01-01 00:00:00", 5.0)]
    batch = rollups.rollup(spark.read.parquet(str(source)).where("v < 100"), "ts", "1 hour", {"s": F.sum("v")}, ["k"])
    assert set(got) <= {(r.k, str(r.start), r.s) for r in batch.collect()}


def test_sessions_over_restarts(spark, tmp_path):
    source = tmp_path / "in"
    make = lambda: rollups.sessions(spark.readStream.schema(SCHEMA).parquet(str(source)), "ts", "20 minutes", {"n": F.count(F.lit(1))}, ["k"], late="10 minutes")
    put(spark, source, [("a", at(0), 1.0), ("a", at(0.2), 1.0)])
    run(make(), tmp_path, "out")
    put(spark, source, [("a", at(0.4), 1.0), ("a", at(2), 1.0)])  # goes on with the open session, then a new one
    run(make(), tmp_path, "out")
    put(spark, source, [("z", at(9), 1.0)])
    run(make(), tmp_path, "out")
    put(spark, source, [("z", at(30), 1.0)])
    run(make(), tmp_path, "out")
    assert rows(spark, tmp_path, "out", "k", "n")[:2] == [("a", 1), ("a", 3)]


def test_distinct_stream(spark, tmp_path):
    source = tmp_path / "in"
    make = lambda: rollups.distinct_stream(spark.readStream.schema(SCHEMA).parquet(str(source)), "ts", ["k"], "1 hour")
    put(spark, source, [("a", at(0), 1.0), ("a", at(0.1), 2.0), ("b", at(0.2), 3.0)])
    run(make(), tmp_path, "out")
    put(spark, source, [("a", at(0.5), 4.0), ("c", at(0.6), 5.0)])
    run(make(), tmp_path, "out")
    assert [k for (k,) in rows(spark, tmp_path, "out", "k")] == ["a", "b", "c"]


def test_feed_and_line_protocol(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text("cpu,h=a v=1.5 1000000000\nbad\n# note\ncpu,h=b v=2i 2000000000\n")
    seen = []
    stream = line_protocol.stream(spark, str(tmp_path / "lines"))
    make = lambda: rollups.feed(stream, lambda batch, number: seen.append((number, sorted(r.tags["h"] for r in batch.collect()))), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert make().awaitTermination(60)
    (tmp_path / "lines" / "b.txt").write_text("cpu,h=c v=3 3000000000\n")
    assert make().awaitTermination(60)
    assert [x for _, x in seen if x] == [["a", "b"], ["c"]] and len({n for n, _ in seen}) == len(seen)


def test_sliding_windows_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    put(spark, source, [("a", at(0.1), 1.0), ("a", at(0.7), 2.0), ("a", at(8), 0.0)])
    out = rollups.rollup(spark.readStream.schema(SCHEMA).parquet(str(source)), "ts", "1 hour", {"n": F.count(F.lit(1))}, late="0 minutes", slide="30 minutes")
    query = out.writeStream.outputMode("complete").format("memory").queryName("slid").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(r.n for r in spark.table("slid").collect()) == [1, 1, 1, 1, 2]
