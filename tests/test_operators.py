"""Hand-computed cases of operators."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions.library import call, find
from tidemark.operators import dml, indicators, timeseries
from tidemark.plans import dialect
from tidemark.sources import line_protocol

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_fills_carry_null_aggregates(spark):
    df = frame(spark, [(at(0), 1.0), (at(1), None), (at(3), 4.0)], "ts timestamp_ntz, v double")
    out = {f: [r.v for r in timeseries.sample_by(df, "ts", "1h", {"v": F.sum("v")}, fill=f).orderBy("bucket").collect()] for f in (None, "null", "prev", 7)}
    assert out[None] == [1.0, None, 4.0]
    assert out["null"] == [1.0, None, None, 4.0]
    assert out["prev"] == [1.0, None, None, 4.0]
    assert out[7] == [1.0, None, 7.0, 4.0]


def test_linear_fill_per_key(spark):
    df = frame(spark, [("a", at(0), 0.0), ("a", at(4), 8.0), ("b", at(1), 3.0)], "k string, ts timestamp_ntz, v double")
    rows = timeseries.sample_by(df, "ts", "1h", {"v": F.max("v")}, ["k"], fill="linear").orderBy("k", "bucket").collect()
    assert [(r.k, r.v) for r in rows] == [("a", 0.0), ("a", 2.0), ("a", 4.0), ("a", 6.0), ("a", 8.0), ("b", 3.0)]


def test_empty_and_negative_times(spark):
    empty = frame(spark, [], "ts timestamp_ntz, v double")
    assert timeseries.sample_by(empty, "ts", "1h", {"v": F.sum("v")}, fill="prev").count() == 0
    old = frame(spark, [(dt.datetime(1969, 12, 31, 23, 30), 1.0)], "ts timestamp_ntz, v double")
    assert timeseries.sample_by(old, "ts", "1h", {"v": F.sum("v")}).first().bucket == dt.datetime(1969, 12, 31, 23)


def test_asof_ties_nulls_and_tolerance(spark):
    left = frame(spark, [(1, "a", at(2)), (2, "a", at(0)), (3, None, at(9)), (4, "a", at(8))], "i int, k string, ts timestamp_ntz")
    right = frame(spark, [("a", at(2), 1, 10.0), ("a", at(2), 2, None), (None, at(1), 3, 5.0)], "k string, ts timestamp_ntz, id int, v double")
    go = lambda **o: {r.i: (r.id, r.v) for r in timeseries.asof_join(left, right, "ts", "ts", [("k", "k")], ["id", "v"], ["id"], **o).collect()}
    assert go() == {1: (2, None), 2: (None, None), 3: (None, None), 4: (2, None)}
    assert go(tolerance="1h")[4] == (None, None)


def test_asof_equals_brute_force(spark):
    import random

    rnd = random.Random(5)
    left = [(i, rnd.randrange(5), at(rnd.randrange(200))) for i in range(300)]
    right = [(rnd.randrange(5), at(rnd.randrange(200)), i) for i in range(300)]
    out = timeseries.asof_join(frame(spark, left, "i int, k int, ts timestamp_ntz"), frame(spark, right, "k int, ts timestamp_ntz, id int"), "ts", "ts", [("k", "k")], ["id"], ["id"])
    for r in out.collect():
        fits = [(t, i) for k, t, i in right if k == r.k and t <= r.ts]
        assert r.id == (max(fits)[1] if fits else None)


def test_latest_on_null_key_and_tie(spark):
    df = frame(spark, [("a", at(1), 1), ("a", at(1), 2), (None, at(0), 3)], "k string, ts timestamp_ntz, id int")
    assert {(r.k, r.id) for r in timeseries.latest_on(df, "ts", ["k"], ["id"]).collect()} == {("a", 2), (None, 3)}


def test_indicators(spark):
    xs = [float(x) for x in [10, 12, 11, 15, 9]]
    df = frame(spark, [(i, x) for i, x in enumerate(xs)] + [(99, None)], "i int, x double").agg(indicators.ordered(F.col("x"), F.col("i")).alias("xs"))
    row = df.select(indicators.drawdown(F.col("xs")).alias("dd"), indicators.ema(F.col("xs"), 3).alias("ema"), indicators.atr(F.col("xs")).alias("atr"), indicators.macd_signal(F.col("xs")).alias("macd")).first()
    want = xs[0]
    for x in xs[1:]:
        want = want * 0.5 + x * 0.5
    assert row.dd == pytest.approx(0.4) and row.ema == pytest.approx(want) and row.atr == pytest.approx((2 + 1 + 4 + 6) / 4) and row.macd is None


def test_merge_and_conflicts(spark):
    t = frame(spark, [(1, 10), (2, 20), (3, 30)], "k int, v int")
    s = frame(spark, [(2, 5), (3, 6), (4, 7)], "k int, v int")
    merged = dml.merge(t, s, ["k"], {"v": F.col("t.v") + F.col("s.v")}, F.col("t.k") == 3)
    assert sorted(map(tuple, merged.collect())) == [(1, 10), (2, 25), (4, 7)]
    assert sorted(map(tuple, dml.insert_ignore(t, s, ["k"]).collect())) == [(1, 10), (2, 20), (3, 30), (4, 7)]
    assert sorted(map(tuple, dml.upsert(t, s, ["k"]).collect())) == [(1, 10), (2, 5), (3, 6), (4, 7)]


def test_line_protocol(spark):
    lines = ["trades,symbol=BTC/USD,side=buy price=65000.0,volume=2i 1700000000000001999", "# comment", "", "bad line", 'm t="a b"']
    rows = line_protocol.parse(frame(spark, [(x,) for x in lines], "value string")).collect()
    assert [r.measurement for r in rows] == ["trades", "m"]
    assert rows[0].tags == {"symbol": "BTC/USD", "side": "buy"} and rows[0].fields == {"price": "65000.0", "volume": "2i"}
    assert rows[0].ts == dt.datetime(2023, 11, 14, 22, 13, 20, 1) and rows[1].fields == {"t": "a b"}


def test_line_protocol_escapes_and_kinds(spark):
    lines = [
        r"my\ table\,x,tag\,one=a\ b\=c,t=1 field\ x=1.5,s=\"say \\\"hi\\\", ok\\\\\",b=T,n=-3i,u=7u 5".replace('\\"', '"').replace("QQ", ""),
        'cpu,h=a v=1,v=2',
        "no_fields 123",
        "cpu v=",
        "  # comment",
        "",
    ]
    lines[0] = 'my\\ table\\,x,tag\\,one=a\\ b\\=c,t=1 field\\ x=1.5,s="say \\"hi\\", ok\\\\",b=T,n=-3i,u=7u 5'
    df = frame(spark, [(x,) for x in lines], "value string")
    rows = line_protocol.parse(df).collect()
    assert [r.measurement for r in rows] == ["my table,x", "cpu"]
    assert rows[0].tags == {"tag,one": "a b=c", "t": "1"} and rows[0].ns == 5
    assert rows[0].fields == {"field x": "1.5", "s": 'say "hi", ok\\', "b": "T", "n": "-3i", "u": "7u"}
    assert rows[1].fields == {"v": "2"} and rows[1].ts is None
    assert [r.value for r in line_protocol.rejected(df).collect()] == ["no_fields 123", "cpu v="]
    kinds = line_protocol.parse(df).select(F.explode("fields")).select("key", line_protocol.kind(F.col("value")).alias("k")).collect()
    assert {(r.key, r.k) for r in kinds} >= {("field x", "float"), ("b", "boolean"), ("n", "integer"), ("u", "integer"), ("s", "text")}


def test_merge_errors_and_orders(spark):
    t = frame(spark, [(1, 10), (None, 5)], "k int, v int")
    twice = frame(spark, [(1, 1), (1, 2), (9, 3), (9, 4)], "k int, v int")
    with pytest.raises(Exception, match="several source rows"):
        dml.merge(t, twice, ["k"], {"v": F.col("s.v")}).collect()
    assert sorted(map(tuple, dml.merge(t, twice.where("k = 9"), ["k"]).collect()), key=str) == [(1, 10), (9, 3), (9, 4), (None, 5)]
    with pytest.raises(Exception, match="several changes"):
        dml.upsert(t, twice, ["k"]).collect()
    assert sorted(map(tuple, dml.upsert(t, twice, ["k"], ["v"]).collect()), key=str) == [(1, 2), (9, 4), (None, 5)]
    nulls = frame(spark, [(None, 6)], "k int, v int")
    assert sorted(map(tuple, dml.upsert(t, nulls, ["k"]).collect()), key=str) == [(1, 10), (None, 6)]
    new = frame(spark, [(1, 3), (2, 4)], "k int, v int")
    assert sorted(map(tuple, dml.insert_update(t, new, ["k"], {"v": F.col("t.v") + F.col("excluded.v")}).collect()), key=str) == [(1, 13), (2, 4), (None, 5)]


def test_fills_and_asof_over_many_chunks(spark, monkeypatch):
    """Chunks of time give what one window over all rows gives."""
    import random

    monkeypatch.setattr(timeseries, "CHUNK", 3)
    rnd = random.Random(2)
    rows = sorted({rnd.randrange(60) for _ in range(20)})
    df = frame(spark, [(at(h), float(i), i % 3) for i, h in enumerate(rows)], "ts timestamp_ntz, v double, p int")
    out = timeseries.sample_by(df, "ts", "1h", {"v": F.max("v")}, fill="prev", firsts=["p"]).orderBy("bucket").collect()
    before = lambda h: max(i for i, x in enumerate(rows) if x <= h)
    assert [(r.bucket, r.v, r.p) for r in out] == [(at(h), float(before(h)), before(h) % 3) for h in range(rows[0], rows[-1] + 1)]
    line = timeseries.sample_by(df, "ts", "1h", {"v": F.max("v")}, fill="linear", firsts=["p"]).orderBy("bucket").collect()
    for r, h in zip(line, range(rows[0], rows[-1] + 1), strict=True):
        i = before(h)
        want = float(i) if rows[i] == h else i + (h - rows[i]) / (rows[i + 1] - rows[i])
        assert r.v == pytest.approx(want) and r.p == (i % 3 if rows[i] == h else None)
    left = [(i, at(rnd.randrange(-5, 70))) for i in range(50)]
    l, r = frame(spark, left, "i int, ts timestamp_ntz"), frame(spark, [(at(h), h) for h in rows], "ts timestamp_ntz, id int")
    for chunk in (None, "3h", "1d"):
        found = timeseries.asof_join(l, r, "ts", "ts", [], ["id"], chunk=chunk).collect()
        assert {(x.i, x.id) for x in found} == {(i, max((h for h in rows if at(h) <= t), default=None)) for i, t in left}
    keyed = timeseries.asof_join(l.withColumn("k", F.lit(1)), r.withColumn("k", F.lit(1)), "ts", "ts", [("k", "k")], ["id"], chunk="2h").collect()
    assert {(x.i, x.id) for x in keyed} == {(i, max((h for h in rows if at(h) <= t), default=None)) for i, t in left}


def test_buckets_ignore_the_zone(spark):
    df = frame(spark, [(dt.datetime(2024, 7, 1, 23, 30),)], "ts timestamp_ntz")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(timeseries.bucket(F.col("ts"), "1d").alias("b")).first().b == dt.datetime(2024, 7, 1)
        assert df.select(call("time_bucket", 86_400_000_000, F.col("ts")).alias("b")).first().b == dt.datetime(2024, 7, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_series_indicators_equal_whole_arrays(spark):
    import random

    rnd = random.Random(6)
    rows = [(k, at(i * 0.37), 50 + rnd.gauss(0, 9)) for k in ("a", "b") for i in range(1 if k == "b" else 300)]
    df = frame(spark, rows, "k string, ts timestamp_ntz, v double")
    got = {r.k: r for r in indicators.series(df, ["k"], "v", "ts", chunk=3 * 3_600_000_000).collect()}
    xs = F.col("xs")
    up, low = indicators.bollinger(xs)
    whole = df.groupBy("k").agg(indicators.ordered(F.col("v"), F.col("ts")).alias("xs"))
    want = whole.select("k", indicators.sma(xs).alias("sma"), indicators.wma(xs).alias("wma"), up.alias("bollinger_upper"), low.alias("bollinger_lower"), indicators.rsi(xs).alias("rsi"), indicators.atr(xs).alias("atr"), indicators.drawdown(xs).alias("drawdown"), indicators.ema(xs).alias("ema"), indicators.macd_signal(xs).alias("macd_signal"), indicators.realized_vol(xs).alias("realized_vol"), indicators.sharpe(xs).alias("sharpe"))
    for r in want.collect():
        for c in want.columns[1:]:
            assert (got[r.k][c] is None) == (r[c] is None) and (r[c] is None or got[r.k][c] == pytest.approx(r[c], rel=1e-9)), (r.k, c)


def test_risk_of_a_series_with_zeros(spark, tmp_path):
    """As in SQL, returns to or from a zero leave no finite volatility and ratio, within a chunk and across chunks."""
    values = {"in": [1.0, 2.0, 0.0, 4.0, 5.0, 6.0], "across": [1.0, 2.0, 3.0, 0.0, 5.0, 6.0], "end": [1.0, 2.0, 3.0, 4.0, 5.0, 0.0], "none": [1.0, 2.0, 4.0, 3.0, 5.0, 6.0], "one": [0.0, 2.0]}
    rows = [(8 * i + j, at(j), k, v) for i, (k, x) in enumerate(values.items()) for j, v in enumerate(x)]
    frame(spark, rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    events = spark.read.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {k: (repr(vol), repr(ratio)) for k, vol, ratio in con.execute(queries.ORACLES["indicators_risk"]).fetchall()}
    for chunk in (3 * 3_600_000_000, 86_400_000_000):
        out = indicators.series(events, ["event_type"], "value", "ts", ["event_id"], chunk=chunk).select("event_type", F.round("realized_vol", 4), F.round("sharpe", 4))
        assert {k: (repr(vol), repr(ratio)) for k, vol, ratio in out.collect()} == want
    assert want["in"] == want["across"] == ("nan", "nan") and want["end"][0] == "nan" and want["none"][0] != "nan"


def test_skew_join_broadcasts_no_copies(spark, tmp_path):
    """The right side's copies are not in its size, so a small file's would all be broadcast."""
    spark.range(3000).select(F.col("id").alias("j")).write.parquet(str(tmp_path / "r"))
    joined = timeseries.skew_join(spark.range(50).select((F.col("id") % 7).alias("k")), spark.read.parquet(str(tmp_path / "r")), [("k", "j")])
    assert joined.count() == 50
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_band_join_deals_many_pairs(spark):
    """Few small rows with many pairs are dealt out by pairs, one hot group too, and give the rows of a plain join."""
    l = spark.range(300).select(F.col("id").alias("a"), (F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 > 0, 7.5).alias("x"))
    r = spark.range(400).select(F.col("id").alias("b"), (F.col("id") % 4).alias("j"), (F.col("id") % 20).cast("double").alias("y"))
    found = timeseries.band_join(l, r, "x", "y", 2.0, [("k", "j")], most=50)
    plain = l.join(r, (F.abs(F.col("x") - F.col("y")) <= 2.0) & (F.col("k") == F.col("j")))
    rows = lambda df: sorted(map(tuple, df.select("a", "b").collect()))
    assert found.columns == plain.columns and rows(found) == rows(plain) and len(rows(plain)) > 1000
    assert found.rdd.getNumPartitions() > 100


def test_theta_and_skew_joins(spark):
    l, r = spark.range(50).withColumn("k", F.col("id") % 2), spark.range(4).select((F.col("id") % 3).alias("j"), F.col("id").alias("w"))
    assert timeseries.theta_join(l, r, F.col("id") < F.col("w")).count() == 0 + 1 + 2 + 3
    with pytest.raises(ValueError):
        timeseries.theta_join(l, r, F.col("id") < F.col("w"), most=3)
    assert timeseries.skew_join(l, r, [("k", "j")], 4).count() == l.join(r, F.col("k") == F.col("j")).count()


def test_dialect(spark):
    frame(spark, [("a", at(0), 1.0), ("a", at(2), 3.0)], "k string, ts timestamp_ntz, v double").createOrReplaceTempView("trades")
    frame(spark, [("a", at(1), 9.0)], "k string, ts timestamp_ntz, v double").createOrReplaceTempView("quotes")
    out = dialect.run(spark, "SELECT k, sum(v) AS s FROM trades SAMPLE BY 1h FILL(LINEAR) ALIGN TO CALENDAR").orderBy("ts").collect()
    assert [r.s for r in out] == [1.0, 2.0, 3.0]
    joined = dialect.run(spark, "SELECT trades.v, quotes.v AS q FROM trades ASOF JOIN quotes ON (trades.k = quotes.k) WHERE trades.v > 0")
    assert sorted(map(tuple, joined.collect()), key=str) == [(1.0, None), (3.0, 9.0)]


@pytest.mark.parametrize("name, args, want", [("initcap", ["hello WORLD-x"], "Hello World-X"), ("snake_case", ["fooBar"], "foo_bar"), ("gcd", [12, 18], 6), ("lcm", [4, 6], 12), ("trailing_zeros", [8], 3), ("next_power_of_two", [5], 8), ("word_count", [" a b  c "], 3), ("slug", ["Hello, World!"], "hello-world"), ("make_geohash_str", [57.64911, 10.40744, 6], "u4pruy"), ("inet_aton", ["10.0.0.1"], 167772161), ("round", [2.5], 3.0), ("cast_str_to_int", ["x"], None), ("glob", ["abc", "a*c"], True), ("round_up", [1.2], 2.0), ("sub_int_int", [5, 3], 2), ("url_encode", ["a b"], "a%20b"), ("is_empty", [None], True)])
def test_functions(spark, name, args, want):
    columns = args[:2] + [args[2]] if name == "make_geohash_str" else args
    value = find(name)(*[F.lit(a) for a in columns[:2]], columns[2]) if name == "make_geohash_str" else call(name, *columns)
    assert spark.range(1).select(value.alias("x")).first().x == want


def test_streaming_rollup(spark, tmp_path):
    from tidemark.streaming import rollups

    frame(spark, [(at(0), 1.0), (at(0.5), 2.0), (at(3), 5.0)], "ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    out = rollups.rollup(stream, "ts", "1 hour", {"s": F.sum("v")}, late="1 hour")
    run = out.writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r.s for r in spark.table("rolled").collect()) == [3.0, 5.0]


def test_own_functions(spark):
    import pandas as pd

    from tidemark.functions import registry

    df = frame(spark, [(1, 2.0), (1, 4.0), (2, 9.0)], "k int, v double")
    df.createOrReplaceTempView("own_rows")
    registry.register("twice_plus", lambda x, n: x * 2 + n, plain=(1,))
    registry.register("spread_of", lambda x: F.max(x) - F.min(x))

    def middle(v: pd.Series) -> float:
        return float(v.median())

    class Countdown:
        def eval(self, n: int):
            for i in range(n, 0, -1):
                yield (i,)

    try:
        assert [r.x for r in df.select(call("twice_plus", F.col("v"), 1).alias("x")).collect()] == [5.0, 9.0, 19.0]
        assert sorted(map(tuple, dialect.run(spark, "SELECT k, spread_of(twice_plus(v, 3)) AS s FROM own_rows GROUP BY k").collect())) == [(1, 4.0), (2, 0.0)]
        with pytest.raises(ValueError):
            registry.register("fnv1a", F.length)
        registry.register_vectorised(spark, "middle_of", middle, "double")
        assert sorted(map(tuple, dialect.run(spark, "SELECT k, middle_of(v) AS m FROM own_rows GROUP BY k").collect())) == [(1, 3.0), (2, 9.0)]
        registry.register_table_function(spark, "countdown", Countdown, "n int")
        assert [r.n for r in dialect.run(spark, "SELECT n FROM countdown(3)").collect()] == [3, 2, 1]
    finally:
        for name in ("twice_plus", "spread_of", "middle_of"):
            registry.unregister(name)


def test_outputs(spark, tmp_path):
    import json

    from tidemark.sources import files

    df = frame(spark, [(1, "a", None), (2, None, 1.5)], "k int, s string, v double")
    assert [json.loads(r.line) for r in files.json_lines(df).collect()] == [{"k": 1, "s": "a", "v": None}, {"k": 2, "s": None, "v": 1.5}]
    assert json.loads(files.answer(df)) == {"columns": [{"name": "k", "type": "int"}, {"name": "s", "type": "string"}, {"name": "v", "type": "double"}], "count": 2, "dataset": [[1, "a", None], [2, None, 1.5]]}
    with pytest.raises(ValueError):
        files.answer(df, 1)
    for kind, options in (("json", {}), ("csv", {"header": True}), ("tsv", {"header": True}), ("parquet", {})):
        files.copy_to(df, str(tmp_path / kind), kind, **options)
    assert spark.read.json(str(tmp_path / "json")).count() == files.read_csv(spark, str(tmp_path / "tsv"), sep="\t").count() == files.read_parquet(spark, str(tmp_path / "parquet")).count() == 2
    with pytest.raises(ValueError):
        files.copy_to(df, str(tmp_path / "x"), "xml")


def test_analytics(spark):
    from tidemark.operators import analytics

    df = frame(spark, [("a", 1, 5.0), ("a", 2, 5.0), ("b", 3, None), (None, 4, 1.0), (None, 5, 3.0)], "k string, i int, v double")
    assert {r.i: r.normalised for r in analytics.normalise(df, "v", ["k"]).collect()} == {1: 0.0, 2: 0.0, 3: None, 4: 0.0, 5: 1.0}
    assert {r.i: r.zscore for r in analytics.zscore(df, "v", ["k"]).collect()} == {1: 0.0, 2: 0.0, 3: None, 4: -1.0, 5: 1.0}
    assert [r.i for r in analytics.drop_repeats(df, [], ["i"], ["k", "v"]).orderBy("i").collect()] == [1, 3, 4, 5]
    assert sorted((r.n, r.i) for r in analytics.numbered(df.repartition(4), ["i"], "n").collect()) == [(i, i) for i in range(1, 6)]
    assert analytics.table_hash(df).first() == analytics.table_hash(df.repartition(3)).first() != analytics.table_hash(df.where("i > 1")).first()
    assert [r.rows for r in analytics.table_hash(df.where("false")).collect()] == [0]
    assert len({r.row_id for r in analytics.row_ids(df).collect()}) == 5
    text = frame(spark, [(1, "a,b"), (2, None), (3, "")], "i int, s string")
    assert sorted(map(tuple, analytics.split_rows(text, "s").collect()), key=str) == [(1, "a"), (1, "b"), (2, None), (3, "")]
    with pytest.raises(Exception, match="several rows"):
        analytics.lookup(text, frame(spark, [(1, 2), (1, 3)], "j int, w int"), [("i", "j")], ["w"]).collect()


def test_book_snapshots(spark):
    from tidemark.operators import market

    deltas = frame(spark, [("x", "bid", 10.0, 1.0, 1, "add"), ("x", "bid", 10.0, 5.0, 3, "modify"), ("x", "bid", 9.0, 2.0, 2, "add"), ("x", "bid", 9.0, 0.0, 4, "delete"), ("x", "ask", 11.0, 7.0, 2, "Add")], "sym string, side string, price double, qty double, seq int, act string")
    asked = frame(spark, [(0,), (2,), (9,), (9,)], "t int")
    out = market.snapshots(deltas, "sym", "side", "price", "qty", "seq", "act", asked, "t").collect()
    assert sorted((r.at, r.side, r.price, r.qty) for r in out) == [(2, "ask", 11.0, 7.0), (2, "bid", 9.0, 2.0), (2, "bid", 10.0, 1.0), (9, "ask", 11.0, 7.0), (9, "bid", 10.0, 5.0)]
    best = market.depth(market.book_at(deltas, "sym", "side", "price", "qty", "seq", "act", until=2), "sym", "side", "price", "qty", 1).collect()
    assert sorted((r.side, r.price) for r in best) == [("ask", 11.0), ("bid", 10.0)]
    assert market.book_at(deltas, "sym", "side", "price", "qty", "seq", "act").count() == 2


def test_ticks(spark):
    from tidemark.operators import market

    df = frame(spark, [(1, [1.25, 1.5, 1.0]), (2, []), (3, None)], "i int, p array<double>")
    out = {r.i: (r.d, r.p) for r in df.select("i", market.delta_encode(F.col("p"), 0.25).alias("d"), market.delta_decode(market.delta_encode(F.col("p"), 0.25), 0.25).alias("p")).collect()}
    assert out == {1: ([5, 1, -2], [1.25, 1.5, 1.0]), 2: ([], []), 3: (None, None)}
