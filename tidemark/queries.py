"""Queries of the engine's operators over the test tables, and their SQL twins.

`sampled` style queries take a registry entry each: a name, a function (spark, folder) and, where SQL can say it,
the twin that must return the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .database import Database
from .functions.library import call
from .operators import analytics, dml, indicators, market, timeseries
from .plans import dialect
from .session import load
from .sources import files, line_protocol
from .streaming import rollups

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HOUR = "date_trunc('hour', ts)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def spark_sql(name: str, sql: str, twin: str | None = None):
    """A query that both engines read; its tables become temporary views."""

    def run(spark, sf_dir):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
            if t in sql:
                load(spark, sf_dir, t).createOrReplaceTempView(t)
        return dialect.run(spark, sql, tie=["event_id"])

    QUERIES[name] = run
    ORACLES[name] = twin or sql


def r6(c, name):
    return F.round(c, 6).alias(name)


# sampling -------------------------------------------------------------------------------------------------


@query("sample_by_hour", f"SELECT {HOUR} AS bucket, round(avg(value), 6) AS avg_value, count(*) AS n FROM events GROUP BY 1")
def sample_by_hour(spark, sf_dir):
    return timeseries.sample_by(load(spark, sf_dir, "events"), "ts", "1h", {"avg_value": F.round(F.avg("value"), 6), "n": F.count(F.lit(1))})


@query("sample_by_keys", f"SELECT event_type, {HOUR} AS bucket, round(sum(value), 6) AS total, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2")
def sample_by_keys(spark, sf_dir):
    return timeseries.sample_by(load(spark, sf_dir, "events"), "ts", "1h", {"total": F.round(F.sum("value"), 6), "lo": F.min("value"), "hi": F.max("value")}, ["event_type"])


@query("sample_by_first_observation", "WITH o AS (SELECT min(epoch_us(ts)) % 3600000000 AS o FROM events) SELECT make_timestamp((epoch_us(ts) - o) // 3600000000 * 3600000000 + o) AS bucket, count(*) AS n FROM events, o GROUP BY 1")
def sample_by_first(spark, sf_dir):
    return timeseries.sample_by(load(spark, sf_dir, "events"), "ts", "1h", {"n": F.count(F.lit(1))}, align="first")


EACH_TYPE = "WITH e AS (SELECT event_type, user_id % 20 AS g, date_trunc('hour', ts) AS b, count(*) AS n, round(sum(value), 6) AS s FROM events GROUP BY 1, 2, 3), l AS (SELECT event_type, g, min(b) AS lo, max(b) AS hi FROM e GROUP BY 1, 2), g AS (SELECT event_type, g, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS bucket FROM l)"


def _by_type(spark, sf_dir, fill):
    rows = load(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 20)
    return timeseries.sample_by(rows, "ts", "1h", {"n": F.count(F.lit(1)), "s": F.round(F.sum("value"), 6)}, ["event_type", "g"], fill=fill)


@query("sample_by_fill_null", EACH_TYPE + " SELECT g.event_type, g.g, bucket, n, s FROM g LEFT JOIN e ON g.event_type = e.event_type AND g.g = e.g AND b = bucket")
def fill_null(spark, sf_dir):
    return _by_type(spark, sf_dir, "null")


@query("sample_by_fill_prev", EACH_TYPE + " SELECT g.event_type, g.g, bucket, n, s FROM g ASOF LEFT JOIN e ON g.event_type = e.event_type AND g.g = e.g AND bucket >= b")
def fill_prev(spark, sf_dir):
    return _by_type(spark, sf_dir, "prev")


@query("sample_by_fill_const", EACH_TYPE + " SELECT g.event_type, g.g, bucket, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM g LEFT JOIN e ON g.event_type = e.event_type AND g.g = e.g AND b = bucket")
def fill_const(spark, sf_dir):
    return _by_type(spark, sf_dir, 0)


@query("sample_by_fill_linear", EACH_TYPE + ", p AS (SELECT g.event_type, g.g, bucket, p.b AS pb, p.s AS ps, q.b AS qb, q.s AS qs FROM g ASOF LEFT JOIN e p ON g.event_type = p.event_type AND g.g = p.g AND bucket >= p.b ASOF LEFT JOIN e q ON g.event_type = q.event_type AND g.g = q.g AND bucket <= q.b) SELECT event_type, g, bucket, round(CASE WHEN pb = bucket THEN ps ELSE ps + (qs - ps) * ((epoch_us(bucket) - epoch_us(pb)) / (epoch_us(qb) - epoch_us(pb))) END + 1e-9, 4) AS s FROM p")
def fill_linear(spark, sf_dir):
    return _by_type(spark, sf_dir, "linear").select("event_type", "g", "bucket", F.round(F.col("s") + 1e-9, 4).alias("s"))


@query("sample_by_fill_prev_keyless", "WITH e AS (SELECT date_trunc('minute', ts) AS b, count(*) AS n FROM events GROUP BY 1), g AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 MINUTE)) AS bucket FROM e) SELECT bucket, n FROM g ASOF LEFT JOIN e ON bucket >= b")
def fill_prev_keyless(spark, sf_dir):
    return timeseries.sample_by(load(spark, sf_dir, "events"), "ts", "1m", {"n": F.count(F.lit(1))}, fill="prev")


@query("latest_on", "SELECT user_id, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest(spark, sf_dir):
    return timeseries.latest_on(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "ts", ["user_id"], ["event_id"])


@query("downsample_ohlcv", "SELECT l_partkey % 50 AS symbol, date_trunc('month', l_shipdate) AS bar, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS vwap, count(*) AS trades FROM lineitem GROUP BY 1, 2")
def downsample(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumn("symbol", F.col("l_partkey") % 50)
    bars = indicators.ohlcv(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"))
    bars["vwap"] = F.round(bars["vwap"], 4)
    return rows.groupBy("symbol", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("bar")).agg(*[c.alias(n) for n, c in bars.items()])


# joins ----------------------------------------------------------------------------------------------------


@query("asof_join", "WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT l.event_id, l.user_id, l.ts, r.value AS r_value, r.event_id AS r_event_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'")
    return timeseries.asof_join(left, right, "ts", "ts", [("user_id", "user_id")], ["value", "event_id"], ["event_id"], prefix="r_")


@query("asof_join_keyless", "WITH r AS (SELECT ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1) SELECT l.event_id, r.event_id AS r_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN r ON l.ts >= r.ts")
def asof_keyless(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    left, right = e.where("event_type = 'purchase'").select("event_id", "ts"), e.where("event_type = 'view'")
    return timeseries.asof_join(left, right, "ts", "ts", [], ["event_id"], ["event_id"], prefix="r_").select("event_id", "r_event_id")


@query("asof_join_chunked", "WITH l AS (SELECT * FROM events WHERE event_type = 'click'), r AS (SELECT user_id % 3 AS g, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT l.event_id, r.event_id AS r_event_id FROM l ASOF LEFT JOIN r ON l.user_id % 3 = r.g AND l.ts >= r.ts")
def asof_chunked(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 3)
    left, right = e.where("event_type = 'click'").select("event_id", "g", "ts"), e.where("event_type = 'view'")
    return timeseries.asof_join(left, right, "ts", "ts", [("g", "g")], ["event_id"], ["event_id"], prefix="r_", chunk="1d").select("event_id", "r_event_id")


@query("asof_join_tolerance", "WITH r AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN r.event_id END AS r_event_id FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_tolerance(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    left, right = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'")
    return timeseries.asof_join(left, right, "ts", "ts", [("user_id", "user_id")], ["event_id"], ["event_id"], tolerance="6h", prefix="r_").select("event_id", "r_event_id")


@query("theta_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey")
def theta(spark, sf_dir):
    return timeseries.theta_join(load(spark, sf_dir, "nation"), load(spark, sf_dir, "region"), F.col("n_regionkey") > F.col("r_regionkey")).select("n_name", "r_name")


@query("skew_join", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def skewed(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return timeseries.skew_join(lines, load(spark, sf_dir, "part").select("p_partkey", "p_brand"), [("l_partkey", "p_partkey")]).select("l_orderkey", "l_linenumber", "p_brand")


@query("window_join", "SELECT l.event_id AS l_id, r.event_id AS r_id FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 12 HOUR WHERE l.event_type = 'purchase' AND r.event_type = 'view'")
def window_join(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select(F.col("event_id").alias("l_id"), F.col("user_id").alias("l_user"), F.col("ts").alias("l_ts"))
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("r_id"), F.col("user_id").alias("r_user"), F.col("ts").alias("r_ts"))
    return timeseries.window_join(left, right, "l_ts", "r_ts", "12h", [("l_user", "r_user")]).select("l_id", "r_id")


@query("band_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 300 AND s_nationkey = c_nationkey")
def band(spark, sf_dir):
    return timeseries.band_join(load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer"), "s_acctbal", "c_acctbal", 300.0, [("s_nationkey", "c_nationkey")]).select("s_suppkey", "c_custkey")


@query("mark_join", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS matched FROM customer")
def mark(spark, sf_dir):
    return timeseries.mark_join(load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders").where("o_totalprice > 300000"), [("c_custkey", "o_custkey")])


spark_sql("join_inner", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
spark_sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
spark_sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 350000")
spark_sql("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k")
spark_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <> n_regionkey")
spark_sql("join_using_multi", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, customer, nation, region WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY r_name")
spark_sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
spark_sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
spark_sql("join_lateral", "SELECT c_custkey, t.m FROM customer, LATERAL (SELECT max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) t")

# relational -----------------------------------------------------------------------------------------------

spark_sql("filter_pushdown", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
spark_sql("between_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 20 AND 10", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
spark_sql("regex_operators", "SELECT p_partkey FROM part WHERE p_brand ~ '[13]$' AND p_type !~* 'zzz'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[13]$') AND NOT regexp_matches(p_type, '(?i)zzz')")
spark_sql("case_forms", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS a, CASE WHEN value > 50 THEN 'hi' WHEN value > 10 THEN 'mid' ELSE 'lo' END AS b FROM events")
spark_sql("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
spark_sql("subquery_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
spark_sql("subquery_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
spark_sql("quantified_all", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 1)", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size = 1)")
spark_sql("quantified_any", "SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size = 3) AND p_size <> ALL (SELECT p_size FROM part WHERE p_size > 30)")
spark_sql("in_lists", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
spark_sql("like_forms", "SELECT p_partkey, p_type LIKE '%A%' AS a, p_type NOT LIKE 'x%' AS b, p_type ILIKE '%a%' AS c, 'a%b' LIKE 'a!%b' ESCAPE '!' AS d FROM part WHERE p_brand LIKE 'Brand#_3'")
spark_sql("is_null", "SELECT event_id, nullif(event_type, 'click') IS NULL AS a, value IS NOT NULL AS b FROM events")
spark_sql("nested_case", "SELECT event_id, CASE WHEN value > 10 THEN CASE event_type WHEN 'click' THEN 'c' ELSE 'o' END ELSE 'small' END || '!' AS a FROM events")
spark_sql("predicate_call", "SELECT p_partkey FROM part WHERE startswith(p_brand, 'Brand#1')", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')")
spark_sql("array_subscript", "SELECT vec_id, embedding[0] AS a, embedding[1] + embedding[2] AS b FROM embeddings", "SELECT vec_id, embedding[1] AS a, embedding[2] + embedding[3] AS b FROM embeddings")
spark_sql("cast_targets", "SELECT event_id, CAST(value AS BIGINT) AS a, CAST(event_id AS DOUBLE) AS b, CAST(user_id AS STRING) AS c, CAST(ts AS DATE) AS d, TRY_CAST(event_type AS INT) AS e, CAST(event_id AS SMALLINT) % 7 AS f FROM events WHERE event_id < 30000", "SELECT event_id, trunc(value)::BIGINT AS a, event_id::DOUBLE AS b, user_id::VARCHAR AS c, ts::DATE AS d, TRY_CAST(event_type AS INT) AS e, event_id::SMALLINT % 7 AS f FROM events WHERE event_id < 30000")
spark_sql("special_syntax", "SELECT event_id, EXTRACT(YEAR FROM ts) AS a, SUBSTRING(event_type FROM 2 FOR 3) AS b, TRIM(BOTH 'c' FROM event_type) AS c, POSITION('i' IN event_type) AS d, CEIL(value) AS e, ts + INTERVAL '1' DAY AS f FROM events", "SELECT event_id, EXTRACT(YEAR FROM ts)::INT AS a, SUBSTRING(event_type, 2, 3) AS b, TRIM(event_type, 'c') AS c, POSITION('i' IN event_type)::INT AS d, CEIL(value)::BIGINT AS e, ts + INTERVAL 1 DAY AS f FROM events")
spark_sql("join_using", "SELECT o_orderkey, n FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (o_orderkey)")
spark_sql("join_natural", "SELECT c_custkey, total FROM customer NATURAL JOIN (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) t")
spark_sql("values_rows", "SELECT col1, col2 FROM VALUES (1, 'a'), (2, 'b'), (3, NULL)", "SELECT col0 AS col1, col1 AS col2 FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL))")
spark_sql("select_without_from", "SELECT 1 + 2 AS a, upper('x') AS b, CASE WHEN 1 < 2 THEN 'y' END AS c")
spark_sql("empty_result", "SELECT n_name FROM nation WHERE false")
spark_sql("union_order_limit", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region ORDER BY x LIMIT 7")
spark_sql("order_by_expression", "SELECT p_partkey, p_size * 2 AS d FROM part ORDER BY d DESC, p_partkey % 10, p_partkey LIMIT 40")
spark_sql("limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
spark_sql("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 5 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
spark_sql("window_default_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events")
spark_sql("window_named", "SELECT event_id, row_number() OVER w AS rn, first_value(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
spark_sql("window_ignore_nulls", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_click FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_click FROM events")
spark_sql("sql_generate_series", "SELECT value, value * value AS square FROM generate_series(1, 500) AS g WHERE value % 7 = 0", "SELECT value, value * value AS square FROM (SELECT unnest(generate_series(1, 500)) AS value) WHERE value % 7 = 0")
spark_sql("sql_long_sequence", "SELECT x FROM long_sequence(300)", "SELECT unnest(range(1, 301)) AS x")
spark_sql("dialect_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
spark_sql("dialect_latest_of_subquery", "SELECT user_id, event_id FROM (SELECT * FROM events WHERE value > 5 AND event_type <> 'click') AS e LATEST ON ts PARTITION BY user_id ORDER BY user_id LIMIT 50", "SELECT user_id, event_id FROM events WHERE value > 5 AND event_type <> 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY user_id LIMIT 50")
spark_sql("dialect_nested_sample", "SELECT max(n) AS most, min(n) AS least, count(*) AS buckets FROM (SELECT ts, count(*) AS n FROM events SAMPLE BY 6h ALIGN TO CALENDAR) AS s WHERE n > 1", "SELECT max(n) AS most, min(n) AS least, count(*) AS buckets FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS t, count(*) AS n FROM events GROUP BY 1) WHERE n > 1")
spark_sql("dialect_first_row", "SELECT ts, event_id, count(*) AS n FROM (SELECT * FROM events WHERE event_id % 1 = 0) e SAMPLE BY 1d ALIGN TO CALENDAR", "SELECT date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(event_id, ts) AS event_id, count(*) AS n FROM events GROUP BY 1")
spark_sql("dialect_asof_aliases", "SELECT c.event_id, v.event_id AS v_id FROM (SELECT * FROM events WHERE event_type = 'click') AS c ASOF JOIN (SELECT max(event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts) AS v ON (c.user_id = v.user_id) WHERE v.event_id IS NOT NULL", "SELECT c.event_id, v.event_id AS v_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF JOIN (SELECT max(event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON c.user_id = v.user_id AND c.ts >= v.ts")
spark_sql("distinct_rows", "SELECT DISTINCT event_type, user_id % 10 AS g FROM events")
spark_sql("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t")
spark_sql("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
spark_sql("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
spark_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
spark_sql("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
spark_sql("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT n_regionkey FROM nation")
spark_sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
spark_sql("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
spark_sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
spark_sql("having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
spark_sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
spark_sql("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
spark_sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
spark_sql("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = rows.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("r"))
    return best.select("o_custkey", "r.o_orderkey", "r.o_totalprice")


@query("pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def pivot(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).count().na.fill(0)


@query("unpivot", "SELECT p_partkey, 'size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot("p_partkey", ["size", "price"], "name", "value")


# windows --------------------------------------------------------------------------------------------------

BY_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
spark_sql("window_ranks", f"SELECT event_id, row_number() {BY_USER}) AS rn, rank() OVER (PARTITION BY event_type ORDER BY value) AS rk, dense_rank() OVER (PARTITION BY event_type ORDER BY value) AS dr FROM events")
spark_sql("window_lag_lead", f"SELECT event_id, lag(value, 1, 0.0) {BY_USER}) AS a, lead(value, 2) {BY_USER}) AS b FROM events")
spark_sql("window_rows", f"SELECT event_id, round(sum(value) {BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS s, round(avg(value) {BY_USER} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS a, count(*) {BY_USER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events")
spark_sql("window_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
spark_sql("window_values", f"SELECT event_id, first_value(value) {BY_USER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f, last_value(value) {BY_USER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l, nth_value(value, 2) {BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n, min(value) {BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo, max(value) {BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM events")
spark_sql("window_distribution", f"SELECT event_id, ntile(4) {BY_USER}) AS q, round(percent_rank() {BY_USER}), 6) AS p, round(cume_dist() {BY_USER}), 6) AS c FROM events")

# aggregates -----------------------------------------------------------------------------------------------


@query("aggregates_basic", "SELECT event_type, round(sum(value), 4) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi, count(*) AS n, count(DISTINCT user_id) AS u, round(stddev_pop(value), 6) AS sd, round(var_pop(value), 4) AS v, round(stddev_samp(value), 6) AS sds, round(var_samp(value), 4) AS vs, round(median(value), 6) AS med FROM events GROUP BY 1")
def aggregates_basic(spark, sf_dir):
    c = lambda n: call(n, F.col("value"))
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(c("sum"), 4).alias("s"), r6(c("avg"), "a"), c("min").alias("lo"), c("max").alias("hi"), F.count(F.lit(1)).alias("n"), call("count_distinct", F.col("user_id")).alias("u"), r6(c("stddev"), "sd"), F.round(c("variance"), 4).alias("v"), r6(c("stddev_samp"), "sds"), F.round(c("var_samp"), 4).alias("vs"), r6(c("median"), "med"))


@query("aggregates_percentiles", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS pc, quantile_disc(value, 0.5) AS pd FROM events GROUP BY 1")
def aggregates_percentiles(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6)").alias("pc"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("pd"))


@query("aggregates_pairs", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 2) AS i FROM lineitem GROUP BY 1")
def aggregates_pairs(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r6(F.corr(q, p), "c"), F.round(F.covar_pop(q, p), 2).alias("cp"), F.round(F.regr_slope(p, q), 4).alias("sl"), F.round(F.regr_intercept(p, q), 2).alias("i"))


@query("aggregates_ordered", "SELECT user_id, arg_min(value, (ts, event_id)) AS f, arg_max(value, (ts, event_id)) AS l, string_agg(event_type, ',' ORDER BY ts, event_id) AS types, bool_and(value > 1) AS every, bool_or(value > 99) AS some FROM events GROUP BY 1")
def aggregates_ordered(spark, sf_dir):
    v, t, i = F.col("value"), F.col("ts"), F.col("event_id")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(indicators.first(v, t, i).alias("f"), indicators.last(v, t, i).alias("l"), F.expr("listagg(event_type, ',') WITHIN GROUP (ORDER BY ts, event_id)").alias("types"), F.bool_and(v > 1).alias("every"), F.bool_or(v > 99).alias("some"))


@query("aggregates_filter", "SELECT user_id % 20 AS g, count(*) FILTER (value > 50) AS n, round(sum(value) FILTER (event_type = 'click'), 4) AS s FROM events GROUP BY 1")
def aggregates_filter(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("g")).agg(F.count_if(F.col("value") > 50).alias("n"), F.round(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), 4).alias("s"))


@query("count_distinct_exact", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem")
def count_distinct_exact(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("supps"))


# indicators -----------------------------------------------------------------------------------------------


SERIES = "WITH x AS (SELECT event_type, value, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS m, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events)"


def _series(spark, sf_dir):
    return indicators.series(load(spark, sf_dir, "events"), ["event_type"], "value", "ts", ["event_id"], chunk=86_400_000_000)


@query("indicators_averages", SERIES + " SELECT event_type, round(avg(value) FILTER (back <= 20), 6) AS sma, round(sum(value * (21 - back)) FILTER (back <= 20) / 210, 6) AS wma, round(avg(value) FILTER (back <= 20) + 2 * stddev_pop(value) FILTER (back <= 20), 4) AS upper, round(avg(value) FILTER (back <= 20) - 2 * stddev_pop(value) FILTER (back <= 20), 4) AS lower FROM x GROUP BY 1")
def indicators_averages(spark, sf_dir):
    xs = F.col("xs")
    upper, lower = indicators.bollinger(xs)
    last = indicators.last_values(load(spark, sf_dir, "events"), ["event_type"], "value", "ts", ["event_id"])
    return last.select("event_type", r6(indicators.sma(xs), "sma"), r6(indicators.wma(xs), "wma"), F.round(upper, 4).alias("upper"), F.round(lower, 4).alias("lower"))


@query("indicators_moves", SERIES + " SELECT event_type, round(avg(abs(value - prev)) FILTER (back <= 14), 6) AS atr, round(100 - 100 / (1 + sum(greatest(value - prev, 0)) FILTER (back <= 14) / sum(greatest(prev - value, 0)) FILTER (back <= 14)), 6) AS rsi, round(max((peak - value) / peak), 6) AS drawdown FROM x GROUP BY 1")
def indicators_moves(spark, sf_dir):
    return _series(spark, sf_dir).select("event_type", r6("atr", "atr"), r6("rsi", "rsi"), r6("drawdown", "drawdown"))


@query("indicators_risk", SERIES + " SELECT event_type, round(stddev_samp(ln(value / prev)) * sqrt(252), 4) AS vol, round(avg(value / prev - 1) / stddev_samp(value / prev - 1) * sqrt(252), 4) AS sharpe FROM x GROUP BY 1")
def indicators_risk(spark, sf_dir):
    return _series(spark, sf_dir).select("event_type", F.round("realized_vol", 4).alias("vol"), F.round("sharpe", 4).alias("sharpe"))


SMOOTH = "CASE WHEN j.rn = 1 THEN pow(1 - {a}, i.rn - 1) ELSE {a} * pow(1 - {a}, i.rn - j.rn) END"


@query("indicators_smoothed", SERIES + f", y AS (SELECT i.event_type, i.rn, i.m, sum(j.value * {SMOOTH.format(a='(2.0 / 13)')}) AS f, sum(j.value * {SMOOTH.format(a='(2.0 / 27)')}) AS s, sum(j.value * {SMOOTH.format(a='(2.0 / 21)')}) AS e FROM x i JOIN x j ON i.event_type = j.event_type AND j.rn <= i.rn AND j.rn > i.rn - 600 WHERE i.rn > i.m - 200 GROUP BY 1, 2, 3) SELECT event_type, round(max(e) FILTER (rn = m), 6) AS ema, round(sum((f - s) * CASE WHEN rn = 1 THEN pow(0.8, m - 1) ELSE 0.2 * pow(0.8, m - rn) END), 6) AS macd FROM y GROUP BY 1")
def indicators_smoothed(spark, sf_dir):
    return _series(spark, sf_dir).select("event_type", r6("ema", "ema"), r6("macd_signal", "macd"))


@query("trade_statistics", "WITH t AS (SELECT l_returnflag, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END AS q, l_extendedprice AS p, l_quantity AS v, l_shipdate AS d, l_orderkey AS o, l_linenumber AS n FROM lineitem) SELECT l_returnflag, round(sum(p * v) / sum(v), 4) AS vwap, round(avg(p), 4) AS twap, round((sum(q) FILTER (q > 0) + coalesce(sum(q) FILTER (q < 0), 0)) / sum(abs(q)), 6) AS imbalance, round(sum(q) FILTER (q > 0) / sum(abs(q)), 6) AS flow, round((arg_max(p, (d, o, n)) - arg_min(p, (d, o, n))) / arg_min(p, (d, o, n)), 6) AS impact FROM t GROUP BY 1")
def trade_statistics(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem")
    p, v = F.col("l_extendedprice"), F.col("l_quantity")
    q = F.when(F.col("l_linestatus") == "O", v).otherwise(-v)
    return t.groupBy("l_returnflag").agg(F.round(indicators.vwap(p, v), 4).alias("vwap"), F.round(F.avg(p), 4).alias("twap"), r6(indicators.order_imbalance(q), "imbalance"), r6(indicators.trade_flow(q), "flow"), r6(indicators.price_impact(p, F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")), "impact"))


# scalar functions -----------------------------------------------------------------------------------------


def scalars(name: str, table: str, key: str, columns: dict[str, tuple], twin: str):
    """A query with a column per function call."""

    def run(spark, sf_dir):
        rows = load(spark, sf_dir, table)
        return rows.select(key, *[call(f, *[F.col(a[1:]) if isinstance(a, str) and a.startswith("$") else a for a in args]).alias(c) for c, (f, *args) in columns.items()])

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {key}, {twin} FROM {table}"


N = "$p_name"
scalars("scalar_strings_1", "part", "p_partkey", {"a": ("length", N), "b": ("upper", N), "c": ("lower", "$p_brand"), "d": ("substring", N, 2, 4), "e": ("concat", N, "-", "$p_brand"), "f": ("replace", N, "a", "zz"), "g": ("starts_with", N, "p"), "h": ("contains", "$p_type", "A"), "i": ("reverse", N), "j": ("left", N, 3), "k": ("right", N, 3), "l": ("lpad", N, 30, "*"), "m": ("rpad", N, 30, "*"), "n": ("position", "a", N)},
        "length(p_name) AS a, upper(p_name) AS b, lower(p_brand) AS c, substr(p_name, 2, 4) AS d, p_name || '-' || p_brand AS e, replace(p_name, 'a', 'zz') AS f, starts_with(p_name, 'p') AS g, contains(p_type, 'A') AS h, reverse(p_name) AS i, left(p_name, 3) AS j, right(p_name, 3) AS k, lpad(p_name, 30, '*') AS l, rpad(p_name, 30, '*') AS m, instr(p_name, 'a') AS n")
scalars("scalar_strings_2", "part", "p_partkey", {"a": ("md5", N), "b": ("sha256", N), "c": ("split_part", "$p_brand", "#", 1), "d": ("repeat", "$p_brand", 2), "e": ("translate", N, "abc", "xyz"), "f": ("regexp_match", N, "[0-9]+"), "g": ("ascii", N), "h": ("octet_length", N), "i": ("count_char", N, "a"), "j": ("is_upper", "$p_brand"), "k": ("encode", N), "l": ("quote_literal", N), "m": ("strcmp", N, "$p_brand"), "o": ("char_at", N, 2)},
        "md5(p_name) AS a, sha256(p_name) AS b, split_part(p_brand, '#', 1) AS c, repeat(p_brand, 2) AS d, translate(p_name, 'abc', 'xyz') AS e, regexp_matches(p_name, '[0-9]+') AS f, ascii(p_name) AS g, strlen(p_name)::INT AS h, (length(p_name) - length(replace(p_name, 'a', '')))::INT AS i, p_brand = upper(p_brand) AS j, base64(p_name::BLOB) AS k, '''' || p_name || '''' AS l, CASE WHEN p_name < p_brand THEN -1 WHEN p_name = p_brand THEN 0 ELSE 1 END AS m, substr(p_name, 2, 1) AS o")
X = "$l_extendedprice"
scalars("scalar_math", "lineitem", "l_orderkey", {"a": ("floor", X), "b": ("ceil", X), "c": ("sign", X), "d": ("trunc", X), "e": ("clamp", X, 10000.0, 20000.0), "f": ("square", "$l_quantity"), "g": ("is_even", "$l_linenumber"), "h": ("safe_divide", X, "$l_tax"), "i": ("abs_diff", "$l_linenumber", "$l_orderkey"), "j": ("width_bucket", X, 0.0, 100000.0, 10), "k": ("gcd", "$l_orderkey", "$l_partkey"), "l": ("bit_xor", "$l_orderkey", "$l_partkey"), "m": ("mod", "$l_orderkey", 7), "n": ("bit_count", "$l_orderkey")},
        "floor(l_extendedprice) AS a, ceil(l_extendedprice) AS b, sign(l_extendedprice)::BIGINT AS c, trunc(l_extendedprice) AS d, least(greatest(l_extendedprice, 10000), 20000) AS e, l_quantity * l_quantity AS f, l_linenumber % 2 = 0 AS g, CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END AS h, abs(l_linenumber - l_orderkey) AS i, least(greatest(floor(l_extendedprice / 10000) + 1, 0), 11)::BIGINT AS j, gcd(l_orderkey, l_partkey) AS k, xor(l_orderkey, l_partkey) AS l, l_orderkey % 7 AS m, bit_count(l_orderkey)::INT AS n")
D = "$ts"
scalars("scalar_dates", "events", "event_id", {"a": ("extract_year", D), "b": ("extract_month", D), "c": ("extract_day", D), "d": ("extract_hour", D), "e": ("extract_minute", D), "f": ("extract_quarter", D), "g": ("extract_day_of_week", D), "h": ("extract_day_of_year", D), "i": ("start_of_week", D), "j": ("first_of_month", D), "k": ("epoch_micros", D), "l": ("is_weekend", D), "m": ("days_in_month_fn", D), "n": ("time_bucket", 900000000, D)},
        "year(ts)::INT AS a, month(ts)::INT AS b, day(ts)::INT AS c, hour(ts)::INT AS d, minute(ts)::INT AS e, quarter(ts)::INT AS f, dayofweek(ts)::INT AS g, dayofyear(ts)::INT AS h, date_trunc('week', ts)::TIMESTAMP AS i, date_trunc('month', ts)::TIMESTAMP AS j, epoch_us(ts) AS k, dayofweek(ts) IN (0, 6) AS l, day(last_day(ts))::INT AS m, time_bucket(INTERVAL 15 MINUTE, ts) AS n")
scalars("scalar_logic_json", "events", "event_id", {"a": ("coalesce", "$event_type", "x"), "b": ("nullif", "$event_type", "click"), "c": ("greatest", "$value", 50.0), "d": ("least", "$value", 50.0), "e": ("is_null", "$value"), "f": ("cast_int_to_str", "$user_id"), "g": ("eq_str_str", "$event_type", "view"), "h": ("add_long_long", "$event_id", "$user_id"), "i": ("to_number", "$event_type")},
        "coalesce(event_type, 'x') AS a, nullif(event_type, 'click') AS b, greatest(value, 50) AS c, least(value, 50) AS d, value IS NULL AS e, user_id::VARCHAR AS f, event_type = 'view' AS g, event_id + user_id AS h, try_cast(event_type AS DOUBLE) AS i")


@query("scalar_json", "SELECT event_id, props ->> '$.k' AS k FROM events")
def scalar_json(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", call("json_extract", F.col("props"), "$.k").alias("k"))


@query("scalar_arrays", "SELECT vec_id, len(embedding)::INT AS n, list_min(embedding) AS lo, list_max(embedding) AS hi, round(list_sum(embedding), 3) AS s, embedding[1:3] AS head FROM embeddings")
def scalar_arrays(spark, sf_dir):
    a = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select("vec_id", call("array_length", a).alias("n"), call("array_min", a).alias("lo"), call("array_max", a).alias("hi"), F.round(call("array_sum", a), 3).alias("s"), call("array_slice", a, 1, 3).alias("head"))


@query("scalar_market", "SELECT o_orderkey, o_totalprice * 2 AS pv, CASE WHEN o_orderstatus = 'O' THEN (110 - o_totalprice) * 3 ELSE -((110 - o_totalprice) * 3) END AS pnl, o_totalprice * 0.001 * 5 AS fee, round(2 * 6371000 * asin(sqrt(pow(sin(radians(o_custkey % 60 - 10) / 2), 2) + cos(radians(10)) * cos(radians(o_custkey % 60)) * pow(sin(radians(30) / 2), 2))), 2) AS metres FROM orders")
def scalar_market(spark, sf_dir):
    side = F.when(F.col("o_orderstatus") == "O", "buy").otherwise("sell")
    p = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select("o_orderkey", call("position_value", p, 2).alias("pv"), call("unrealized_pnl", p, 110.0, 3, side).alias("pnl"), call("fee_amount", p, 0.001, 5).alias("fee"), F.round(call("st_distance", 10.0, 20.0, (F.col("o_custkey") % 60).cast("double"), 50.0), 2).alias("metres"))


# sources, changes, books, streams, dialect ----------------------------------------------------------------


@query("generate_series", "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 6 HOUR)) AS value")
def generate_series(spark, sf_dir):
    return files.generate_series(spark, "2024-01-01", "2024-01-03", "6 HOURS")


@query("long_sequence", "SELECT unnest(range(1, 101)) AS x")
def long_sequence(spark, sf_dir):
    return files.long_sequence(spark, 100)


@query("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT max(c_custkey) + 1, 0 FROM customer")
def upsert(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 7 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")).union(c.agg(F.max("c_custkey") + 1, F.lit(0.0)))
    return dml.upsert(c, new, ["c_custkey"])


@query("merge_into", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS v FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT s_suppkey + 1000000, 5 FROM supplier WHERE s_suppkey % 9 = 0")
def merge_into(spark, sf_dir):
    t = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    s = t.where("k % 2 = 0 OR k % 10 = 0").select("k", F.lit(1.0).alias("v")).union(t.where("k % 9 = 0").select(F.col("k") + 1000000, F.lit(5.0)))
    return dml.merge(t, s, ["k"], {"v": F.col("t.v") + F.col("s.v")}, F.col("t.k") % 10 == 0)


@query("update_delete", "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part WHERE NOT p_size < 5")
def update_delete(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return dml.delete(dml.update(p, F.col("p_size") > 40, {"p_retailprice": F.col("p_retailprice") * 2}), F.col("p_size") < 5).drop("p_size")


@query("dedup_keep_last", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1")
def dedup_keep_last(spark, sf_dir):
    return dml.dedup(load(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("order_book", "WITH d AS (SELECT user_id % 20 AS sym, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, round(value, 0) + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 200 END AS price, value + 1 AS qty, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS act, event_id FROM events), l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sym, side, price ORDER BY event_id DESC) = 1) SELECT sym, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, min(price) FILTER (side = 'ask') - max(price) FILTER (side = 'bid') AS spread FROM l WHERE act <> 'delete' GROUP BY 1")
def order_book(spark, sf_dir):
    e, even = load(spark, sf_dir, "events"), F.col("event_id") % 2 == 0
    d = e.select((F.col("user_id") % 20).alias("sym"), F.when(even, "bid").otherwise("ask").alias("side"), (F.round("value", 0) + F.when(even, 0).otherwise(200)).alias("price"), (F.col("value") + 1).alias("qty"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("act"), "event_id")
    return market.top_of_book(market.book_at(d, "sym", "side", "price", "qty", "event_id", "act"), "sym", "side", "price", "qty").select("sym", "best_bid", "best_ask", "spread")


@query("tick_round_trip", "SELECT user_id, list(round(value, 2) ORDER BY ts, event_id) AS prices FROM events GROUP BY 1")
def tick_round_trip(spark, sf_dir):
    xs = F.transform("xs", lambda x: F.round(x, 2))
    ticks = load(spark, sf_dir, "events").groupBy("user_id").agg(indicators.ordered(F.col("value"), F.col("ts"), F.col("event_id")).alias("xs"))
    coded = ticks.select("user_id", market.delta_encode(xs, 0.01).alias("d"))
    return coded.select("user_id", F.transform(market.delta_decode(F.col("d"), 0.01), lambda x: F.round(x, 2)).alias("prices"))


BOOK = "WITH d AS (SELECT user_id % 5 AS sym, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, round(value / 10, 0) + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 20 END AS price, value + 1 AS qty, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS act, event_id FROM events), m AS (SELECT max(event_id) AS top FROM events), q AS (SELECT top // 4 AS asked FROM m UNION ALL SELECT top // 2 FROM m UNION ALL SELECT top FROM m)"


def _deltas(spark, sf_dir):
    e, even = load(spark, sf_dir, "events"), F.col("event_id") % 2 == 0
    return e.select((F.col("user_id") % 5).alias("sym"), F.when(even, "bid").otherwise("ask").alias("side"), (F.round(F.col("value") / 10, 0) + F.when(even, 0).otherwise(20)).alias("price"), (F.col("value") + 1).alias("qty"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("act"), "event_id")


@query("order_book_snapshots", BOOK + ", l AS (SELECT q.asked, d.* FROM q JOIN d ON d.event_id <= q.asked QUALIFY row_number() OVER (PARTITION BY q.asked, sym, side, price ORDER BY event_id DESC) = 1) SELECT asked, sym, side, price, qty FROM l WHERE act <> 'delete' AND qty > 0")
def order_book_snapshots(spark, sf_dir):
    d = _deltas(spark, sf_dir)
    top = load(spark, sf_dir, "events").agg(F.max("event_id").alias("top"))
    asked = top.select(F.explode(F.array(F.expr("top div 4"), F.expr("top div 2"), "top")).alias("at"))
    return market.snapshots(d, "sym", "side", "price", "qty", "event_id", "act", asked, "at").withColumnRenamed("at", "asked")


@query("order_book_depth", BOOK + ", l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sym, side, price ORDER BY event_id DESC) = 1), k AS (SELECT sym, side, price, qty, row_number() OVER (PARTITION BY sym, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM l WHERE act <> 'delete' AND qty > 0) SELECT sym, side, level::INT AS level, price, qty, round(sum(qty) OVER (PARTITION BY sym, side ORDER BY level), 6) AS total FROM k WHERE level <= 3")
def order_book_depth(spark, sf_dir):
    levels = market.book_at(_deltas(spark, sf_dir), "sym", "side", "price", "qty", "event_id", "act")
    return market.depth(levels, "sym", "side", "price", "qty", 3).withColumn("total", F.round("total", 6))


def bars(name: str, interval: str, micros: int):
    """OHLCV bars of a time frame."""

    def run(spark, sf_dir):
        columns = indicators.ohlcv(F.col("value"), F.col("value"), F.col("ts"), F.col("event_id"))
        columns["vwap"], columns["volume"] = F.round(columns["vwap"] + 1e-9, 4), F.round(columns["volume"], 4)
        return timeseries.sample_by(load(spark, sf_dir, "events").withColumn("symbol", F.col("event_type")), "ts", interval, columns, ["symbol"], name="bar")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT event_type AS symbol, make_timestamp(epoch_us(ts) // {micros} * {micros}) AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, round(sum(value), 4) AS volume, round(sum(value * value) / sum(value) + 1e-9, 4) AS vwap, count(*) AS trades FROM events GROUP BY 1, 2"


for _frame, _seconds in (("1s", 1), ("1m", 60), ("5m", 300), ("15m", 900), ("1h", 3600), ("4h", 14400), ("1d", 86400), ("1w", 604800)):
    bars(f"bars_{_frame}", _frame, _seconds * 1_000_000)


@query("line_protocol", "SELECT 'events' AS measurement, event_type AS kind, value, ts FROM events")
def line_source(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    lines = e.select(F.concat(F.lit("events,kind="), "event_type", F.lit(" value="), F.col("value").cast("string"), F.lit(" "), (timeseries.to_micros(F.col("ts")) * 1000).cast("string")).alias("value"))
    return line_protocol.parse(lines).select("measurement", F.col("tags.kind").alias("kind"), line_protocol.number(F.col("fields.value")).alias("value"), "ts")


@query("rollup_sliding", "SELECT w AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1")
def rollup_sliding(spark, sf_dir):
    return rollups.rollup(load(spark, sf_dir, "events"), "ts", "1 hour", {"n": F.count(F.lit(1))}, slide="30 minutes").select("start", "n")


@query("session_windows", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    return rollups.sessions(load(spark, sf_dir, "events"), "ts", "2 hours", {"n": F.count(F.lit(1))}, ["user_id"]).select("user_id", "start", "n")


spark_sql("dialect_sample_by", "SELECT event_type, sum(event_id) AS s, count(*) AS n FROM events WHERE value > 10 SAMPLE BY 1d ALIGN TO CALENDAR GROUP BY event_type", "SELECT event_type, date_trunc('day', ts) AS ts, sum(event_id)::BIGINT AS s, count(*) AS n FROM events WHERE value > 10 GROUP BY 1, 2")
spark_sql("dialect_latest_on", "SELECT user_id, event_id FROM events WHERE value > 5 LATEST ON ts PARTITION BY user_id", "SELECT user_id, event_id FROM events WHERE value > 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")


@query("top_of_partition", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_of_partition(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey")


# functions by name in SQL ---------------------------------------------------------------------------------

spark_sql("sql_functions_text", "SELECT p_partkey, to_uppercase(p_name) AS a, to_lowercase(p_brand) AS b, string_length(p_name) AS c, str_concat(p_brand, '/', p_name) AS d, str_pos('a', p_name) AS e, word_count(p_name) AS f, count_char(p_name, 'a') AS g, snake_case(p_brand) AS h, swap_case(p_type) AS i, is_alpha(p_type) AS j, is_digit(p_brand) AS k, is_upper(p_brand) AS l, is_lower(p_name) AS m, is_blank(p_name) AS n, truncate_str(p_name, 4) AS o, pad(p_type, 12) AS p, center(p_type, 12) AS q, slug(p_brand) AS r, quote_ident(p_brand) AS s, escape_sql(p_name) AS t, title_case_ex(p_name) AS u, is_numeric(p_brand) AS v, byte_length(p_name) AS w, char_code(p_name) AS x, regexp_match(p_name, '[aeiou]{2}') AS y, glob(p_brand, 'Brand#?*') AS z FROM part",
          "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, length(p_name)::INT AS c, p_brand || '/' || p_name AS d, instr(p_name, 'a')::INT AS e, len(string_split(trim(p_name), ' '))::INT AS f, (length(p_name) - length(replace(p_name, 'a', '')))::INT AS g, lower(p_brand) AS h, translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') AS i, regexp_full_match(p_type, '[A-Za-z]+') AS j, false AS k, p_brand = upper(p_brand) AS l, p_name = lower(p_name) AS m, false AS n, left(p_name, 4) AS o, repeat(' ', greatest(ceil((12 - length(p_type)) / 2), 0)::INT) || p_type || repeat(' ', greatest(floor((12 - length(p_type)) / 2), 0)::INT) AS p, repeat(' ', greatest(floor((12 - length(p_type)) / 2), 0)::INT) || p_type || repeat(' ', greatest(ceil((12 - length(p_type)) / 2), 0)::INT) AS q, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS r, '\"' || p_brand || '\"' AS s, replace(p_name, '''', '''''') AS t, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS u, false AS v, strlen(p_name)::INT AS w, ascii(p_name) AS x, regexp_matches(p_name, '[aeiou]{2}') AS y, p_brand LIKE 'Brand#_%' AS z FROM part")
spark_sql("sql_functions_numbers", "SELECT l_orderkey, l_linenumber, abs_long(l_orderkey - 5000) AS a, floor_double(l_extendedprice) AS b, ceil_double(l_extendedprice) AS c, round_half_even(l_quantity / 2) AS d, remainder(l_orderkey, 9) AS e, lcm(l_linenumber, 6) AS f, clamp(l_quantity, 10D, 20D) AS g, lerp(0D, l_quantity, 0.5D) AS h, map_range(l_quantity, 0D, 50D, 0D, 100D) AS i, copysign(l_quantity, l_tax - 0.04D) AS j, next_power_of_two(l_linenumber) AS k, square(l_linenumber) AS l, is_odd(l_orderkey) AS m, is_positive(l_tax) AS n, is_zero(l_tax) AS o, leading_zeros(l_orderkey) AS p, trailing_zeros(l_orderkey) AS q, popcount(l_partkey) AS r, safe_subtract(l_quantity, 1D) AS s, to_bin(l_linenumber) AS t, to_oct(l_orderkey) AS u, to_hex_ex(l_orderkey) AS v, set_bit(l_linenumber, 4) AS w, max_of(l_orderkey, l_partkey) AS x, min_of(l_orderkey, l_partkey) AS y, nullif_zero(l_tax) AS z FROM lineitem",
          "SELECT l_orderkey, l_linenumber, abs(l_orderkey - 5000) AS a, floor(l_extendedprice) AS b, ceil(l_extendedprice) AS c, round_even(l_quantity / 2, 0) AS d, l_orderkey % 9 AS e, lcm(l_linenumber, 6)::BIGINT AS f, least(greatest(l_quantity, 10), 20) AS g, l_quantity * 0.5 AS h, l_quantity * 100 / 50 AS i, CASE WHEN l_tax - 0.04::DOUBLE < 0 THEN -l_quantity ELSE l_quantity END AS j, CASE WHEN l_linenumber <= 1 THEN 1 WHEN l_linenumber = 2 THEN 2 WHEN l_linenumber <= 4 THEN 4 ELSE 8 END AS k, l_linenumber * l_linenumber AS l, l_orderkey % 2 = 1 AS m, l_tax > 0 AS n, l_tax = 0 AS o, (64 - length(ltrim(bin(l_orderkey), '0')))::INT AS p, CASE WHEN l_orderkey = 0 THEN 64 ELSE length(bin(l_orderkey)) - length(rtrim(bin(l_orderkey), '0')) END::INT AS q, bit_count(l_partkey)::INT AS r, l_quantity - 1 AS s, ltrim(bin(l_linenumber), '0') AS t, printf('%o', l_orderkey) AS u, printf('%x', l_orderkey) AS v, (l_linenumber | 16)::BIGINT AS w, greatest(l_orderkey, l_partkey) AS x, least(l_orderkey, l_partkey) AS y, nullif(l_tax, 0) AS z FROM lineitem")
spark_sql("sql_functions_dates", "SELECT event_id, year_of(ts) AS a, month_of_year(ts) AS b, hour_of_day(ts) AS c, day_of_year(ts) AS d, quarter_of_year(ts) AS e, first_day_of_month(ts) AS f, last_day_of_month(ts) AS g, first_day_of_year(ts) AS h, first_day_of_quarter(ts) AS i, first_day_of_week(ts) AS j, nanos_to_millis(ts) AS k, is_business_day(ts) AS l, is_leap_year_fn(ts) AS m, timestamp_add('hour', 5, ts) AS n, timestamp_add('month', 1, ts) AS o, timestamp_ceil('day', ts) AS p, strftime(ts, '%d/%m/%Y %H') AS q, date_bin(900000000, ts, TIMESTAMP_NTZ '2024-01-01') AS r, time_bucket(21600000000, ts) AS s, years_between(ts, TIMESTAMP_NTZ '2020-05-05') AS t, extract_epoch(ts) AS u, extract_millisecond(ts) AS v, at_timezone(ts, 'Asia/Tokyo') AS w, to_pg_date(ts) AS x, ohlcv_bar_align(epoch_nanos(ts), '4h') AS y, interval_to_nanos('90m') AS z FROM events",
          "SELECT event_id, year(ts)::INT AS a, month(ts)::INT AS b, hour(ts)::INT AS c, dayofyear(ts)::INT AS d, quarter(ts)::INT AS e, date_trunc('month', ts)::TIMESTAMP AS f, last_day(ts)::TIMESTAMP AS g, date_trunc('year', ts)::TIMESTAMP AS h, date_trunc('quarter', ts)::TIMESTAMP AS i, date_trunc('week', ts)::TIMESTAMP AS j, epoch_us(ts) // 1000 AS k, dayofweek(ts) NOT IN (0, 6) AS l, dayofyear(make_date(year(ts), 12, 31)) = 366 AS m, ts + INTERVAL 5 HOUR AS n, ts + INTERVAL 1 MONTH AS o, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS p, strftime(ts, '%d/%m/%Y %H') AS q, time_bucket(INTERVAL 15 MINUTE, ts) AS r, time_bucket(INTERVAL 6 HOUR, ts) AS s, (year(ts) - 2020)::INT AS t, epoch_us(ts) / 1e6 AS u, ((epoch_us(ts) % 1000000) // 1000) AS v, ts + INTERVAL 9 HOUR AS w, date_trunc('day', ts)::TIMESTAMP AS x, epoch_us(ts) // 14400000000 * 14400000000000 AS y, 5400000000000 AS z FROM events")
spark_sql("sql_functions_logic", "SELECT event_id, ifnull_ex(nullif(event_type, 'view'), 'none') AS a, nvl2_ex(nullif(event_type, 'view'), 1, 0) AS b, case_when(value > 50, 'hi', 'lo') AS c, switch(event_type, 'click', 1, 'view', 2, 9) AS d, safe_cast_int(event_type) AS e, to_boolean('true') AS f, cast_to_int('3.9') AS g, is_null_fn(value) AS h, not_null(event_type) AS i, and_boolean_boolean(value > 1, value < 9) AS j, not_boolean(value > 50) AS k, pg_typeof(event_type) AS l, typecast(event_id) AS m, coalesce_str(NULL, event_type) AS n, nullifempty('') AS o, zeroifnull_ex(NULL) AS p, lt_double_double(value, 10D) AS q, mul_long_long(event_id, 3) AS r, cast_double_to_int(value) AS s FROM events",
          "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS a, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS b, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS c, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 9 END AS d, NULL::BIGINT AS e, true AS f, 3 AS g, value IS NULL AS h, event_type IS NOT NULL AS i, value > 1 AND value < 9 AS j, NOT value > 50 AS k, 'text' AS l, 'i64' AS m, event_type AS n, NULL::VARCHAR AS o, 0 AS p, value < 10 AS q, event_id * 3 AS r, trunc(value)::INT AS s FROM events")
spark_sql("sql_functions_market", "SELECT o_orderkey, margin_required(o_totalprice, 2D, 5D) AS a, liquidation_price(o_totalprice, 10D, CASE WHEN o_orderstatus = 'F' THEN 'long' ELSE 'short' END) AS b, funding_payment(o_totalprice, 0.5D, 2D) AS c, taker_buy_volume(o_totalprice, 'BUY') AS d, taker_sell_volume(o_totalprice, 'buy') AS e, quote_volume(o_totalprice, 2D) AS f, delta(o_totalprice, 'sell') AS g, delta_pct(o_totalprice, o_totalprice / 3) AS h, order_fill_pct(1D, 4D) AS i, is_fully_filled(2D, 2D) AS j, remaining_qty(o_totalprice, 1D) AS k, effective_price(o_totalprice, 4D) AS l, ohlcv_vwap(o_totalprice, 0D) AS m, inet_ntoa(o_orderkey) AS n, inet_aton('10.0.0.7') AS o, network('10.1.2.3/16') AS p, masklen('10.0.0.0/9') AS q FROM orders",
          "SELECT o_orderkey, o_totalprice * 2 / 5 AS a, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * (1 - 0.1::DOUBLE) ELSE o_totalprice * (1 + 0.1::DOUBLE) END AS b, o_totalprice * 0.5 * 2 AS c, o_totalprice AS d, 0 AS e, o_totalprice * 2 AS f, -o_totalprice AS g, (o_totalprice - o_totalprice / 3) / (o_totalprice + o_totalprice / 3) * 100 AS h, 25 AS i, true AS j, o_totalprice - 1 AS k, o_totalprice / 4 AS l, NULL::DOUBLE AS m, (o_orderkey >> 24 & 255) || '.' || (o_orderkey >> 16 & 255) || '.' || (o_orderkey >> 8 & 255) || '.' || (o_orderkey & 255) AS n, 167772167 AS o, '10.1.0.0/16' AS p, 9 AS q FROM orders")
spark_sql("sql_indicators", "SELECT event_type, round(sma(value), 6) AS sma, round(wma(value), 6) AS wma, round(rsi(value), 6) AS rsi, round(drawdown(value), 6) AS drawdown, round(trade_flow(value - 50), 6) AS flow FROM (SELECT event_type, value, event_id AS ts FROM events) e GROUP BY event_type",
          "WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS back, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS prev, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events) SELECT event_type, round(avg(value) FILTER (back <= 20), 6) AS sma, round(sum(value * (21 - back)) FILTER (back <= 20) / 210, 6) AS wma, round(100 - 100 / (1 + sum(greatest(value - prev, 0)) FILTER (back <= 14) / sum(greatest(prev - value, 0)) FILTER (back <= 14)), 6) AS rsi, round(max((peak - value) / peak), 6) AS drawdown, round(sum(greatest(value - 50, 0)) / sum(abs(value - 50)), 6) AS flow FROM x GROUP BY 1")
spark_sql("dialect_first_last", "SELECT ts, first(value) AS open, last(value) AS close, max(value) AS high, count(*) AS n FROM events SAMPLE BY 4h ALIGN TO CALENDAR", "SELECT time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(value, ts) AS open, arg_max(value, ts) AS close, max(value) AS high, count(*) AS n FROM events GROUP BY 1")


# analytics ------------------------------------------------------------------------------------------------


@query("normalise", "SELECT event_id, round((value - min(value) OVER (PARTITION BY event_type)) / (max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type)), 9) AS normalised FROM events")
def normalise(spark, sf_dir):
    return analytics.normalise(load(spark, sf_dir, "events"), "value", ["event_type"]).select("event_id", F.round("normalised", 9).alias("normalised"))


@query("zscore", "SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS zscore FROM events")
def zscore(spark, sf_dir):
    return analytics.zscore(load(spark, sf_dir, "events"), "value").select("event_id", r6("zscore", "zscore"))


@query("row_hash_distinct", "SELECT count(*) AS n, count(DISTINCT (event_type, user_id)) AS kinds FROM events")
def row_hash_distinct(spark, sf_dir):
    hashed = analytics.row_hash(load(spark, sf_dir, "events"), ["event_type", "user_id"])
    return hashed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_hash").alias("kinds"))


@query("table_hash_equal", "SELECT count(*) AS rows, true AS same FROM events")
def table_hash_equal(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    one, two = analytics.table_hash(e), analytics.table_hash(e.orderBy(F.desc("event_id")))
    return one.crossJoin(two.select(F.col("hash").alias("other"))).select("rows", (F.col("hash") == F.col("other")).alias("same"))


@query("numbered", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS n FROM events")
def numbered(spark, sf_dir):
    return analytics.numbered(load(spark, sf_dir, "events").select("event_id", "value"), ["value", "event_id"], "n").select("event_id", "n")


@query("every_nth", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) WHERE (n - 1) % 7 = 0")
def every_nth(spark, sf_dir):
    return analytics.every_nth(load(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 7).select("event_id")


@query("split_rows", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS p_type FROM part")
def split_rows(spark, sf_dir):
    return analytics.split_rows(load(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", " ")


@query("drop_repeats", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def drop_repeats(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return analytics.drop_repeats(rows, ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id")


@query("top_groups", "SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_groups(spark, sf_dir):
    return analytics.top_groups(load(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 20)


@query("running_totals", "SELECT event_id, round(sum(value) OVER w, 4) AS running_sum, count(value) OVER w AS running_count FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, sf_dir):
    return analytics.running(load(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value").select("event_id", F.round("running_sum", 4).alias("running_sum"), "running_count")


@query("lookup_join", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_join(spark, sf_dir):
    return analytics.lookup(load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation"), [("s_nationkey", "n_nationkey")], ["n_name"]).select("s_suppkey", "n_name")


@query("time_range", "SELECT event_id FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND ts < (SELECT min(ts) FROM events) + INTERVAL 3 DAY")
def time_range(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    low = e.agg(F.min("ts").alias("lo"))
    return analytics.in_hours(e.crossJoin(F.broadcast(low)), "ts", F.col("lo") + F.expr("INTERVAL 1 DAY"), F.col("lo") + F.expr("INTERVAL 3 DAY")).select("event_id")


@query("aggregates_more", "SELECT user_id % 10 AS g, mode(event_type) AS m, list_sort(list(event_id)) AS ids, round(sum(value), 6) AS k FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 HAVING count(*) FILTER (event_type = 'click') <> count(*) FILTER (event_type = 'view')")
def aggregates_more(spark, sf_dir):
    e = load(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    found = e.groupBy((F.col("user_id") % 10).alias("g")).agg(call("mode", F.col("event_type")).alias("m"), F.array_sort(call("array_agg", F.col("event_id"))).alias("ids"), r6(call("ksum_double", F.col("value")), "k"), F.count_if(F.col("event_type") == "click").alias("c"), F.count_if(F.col("event_type") == "view").alias("v"))
    return found.where("c <> v").select("g", "m", "ids", "k")


@query("approx_count_distinct", "SELECT event_type, true AS near FROM events GROUP BY 1")
def approx_count_distinct(spark, sf_dir):
    u = F.col("user_id")
    return load(spark, sf_dir, "events").groupBy("event_type").agg((F.abs(call("approx_count_distinct", u) / F.count_distinct(u) - 1) < 0.15).alias("near"))


# tables and statements ------------------------------------------------------------------------------------


def statements(name: str, tables: list[str], sql: list[str], last: str, twin: str):
    """A query that runs statements on copies of tables in a database of its own."""

    def run(spark, sf_dir):
        db = Database(spark, f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/db-{uuid.uuid4().hex}")
        for t in tables:
            rows = load(spark, sf_dir, t)
            db.create(t, dict(rows.dtypes), rows=rows)
        for statement in sql:
            db.execute(statement)
        return db.execute(last)

    QUERIES[name] = run
    ORACLES[name] = twin


statements("sql_insert_select", ["nation"], ["CREATE TABLE t (k LONG, name SYMBOL)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 1", "INSERT INTO t VALUES (100, 'x'), (101, NULL)"], "SELECT k, name FROM t", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey > 1 UNION ALL VALUES (100, 'x'), (101, NULL)")
statements("sql_on_conflict_update", ["customer"], ["CREATE TABLE t AS SELECT c_custkey AS k, c_acctbal AS v FROM customer", "INSERT INTO t SELECT c_custkey, 1.0 FROM customer WHERE c_custkey % 3 = 0 ON CONFLICT (k) DO UPDATE SET v = v + EXCLUDED.v"], "SELECT k, v FROM t", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer")
statements("sql_on_conflict_nothing", ["customer"], ["CREATE TABLE t AS SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0", "INSERT INTO t SELECT c_custkey, 0.0 FROM customer ON CONFLICT (k) DO NOTHING"], "SELECT k, v FROM t", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0 END AS v FROM customer")
statements("sql_merge", ["supplier"], ["CREATE TABLE t AS SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 2 = 0", "MERGE INTO t USING supplier s ON t.k = s.s_suppkey WHEN MATCHED AND t.k % 10 = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET v = t.v + s.s_acctbal WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.s_suppkey, 0.5)"], "SELECT k, v FROM t", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + s_acctbal ELSE 0.5 END AS v FROM supplier WHERE s_suppkey % 10 <> 0 OR s_suppkey % 2 <> 0")
statements("sql_update_delete", ["orders"], ["UPDATE orders SET o_totalprice = 0 WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", "DELETE FROM orders WHERE o_orderpriority = '5-LOW'"], "SELECT o_orderkey, o_totalprice FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'")
statements("sql_truncate_vacuum", ["nation"], ["CREATE TABLE t AS SELECT * FROM nation", "TRUNCATE TABLE t", "INSERT INTO t SELECT * FROM nation WHERE n_regionkey = 2", "VACUUM t"], "SELECT n_name FROM t", "SELECT n_name FROM nation WHERE n_regionkey = 2")
statements("sql_alter", ["region"], ["ALTER TABLE region ADD COLUMN extra INT", "ALTER TABLE region RENAME COLUMN r_name TO name", "ALTER TABLE region ALTER COLUMN r_regionkey TYPE DOUBLE", "ALTER TABLE region RENAME TO places"], "SELECT r_regionkey, name, extra FROM places", "SELECT r_regionkey::DOUBLE AS r_regionkey, r_name AS name, NULL::INT AS extra FROM region")
statements("sql_partitions", ["events"], ["CREATE TABLE t (event_id LONG, ts TIMESTAMP) TIMESTAMP(ts) PARTITION BY DAY", "INSERT INTO t SELECT event_id, ts FROM events"], "SHOW PARTITIONS t", "SELECT strftime(ts, '%Y-%m-%d') AS partition, count(*) AS rows FROM events GROUP BY 1")
statements("sql_views", ["events"], ["CREATE VIEW v AS SELECT event_type, count(*) AS n FROM events GROUP BY event_type", "CREATE MATERIALIZED VIEW m AS SELECT max(n) AS most FROM v", "REFRESH MATERIALIZED VIEW m"], "SELECT event_type, n, n = (SELECT most FROM m) AS top FROM v", "SELECT event_type, count(*) AS n, count(*) = max(count(*)) OVER () AS top FROM events GROUP BY 1")
statements("sql_downsampling", ["events"], ["CREATE TABLE t (event_id LONG, ts TIMESTAMP, value DOUBLE, event_type SYMBOL) TIMESTAMP(ts)", "INSERT INTO t SELECT event_id, ts, value, event_type FROM events WHERE event_id % 2 = 0 AND ts < (SELECT min(ts) + INTERVAL '3' DAY FROM events)", "CREATE DOWNSAMPLING ON t INTERVAL 1d AS d COLUMNS (min(value) AS lo, max(value) AS hi, count(*) AS n) PARTITION BY event_type", "INSERT INTO t SELECT event_id, ts, value, event_type FROM events WHERE event_id % 2 = 0 AND ts >= (SELECT min(ts) + INTERVAL '3' DAY FROM events)", "REFRESH d"], "SELECT event_type, ts, lo, hi, n FROM d", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2")
statements("sql_describe", ["nation"], [], "DESCRIBE nation", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(column_name, data_type)")
statements("sql_information_schema", ["nation", "region"], [], "SELECT table_name, count(*) AS n FROM information_schema.columns GROUP BY table_name", "SELECT 'nation' AS table_name, 3 AS n UNION ALL SELECT 'region', 2")


@query("sql_copy", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def sql_copy(spark, sf_dir):
    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/db-{uuid.uuid4().hex}"
    db = Database(spark, folder)
    nation = load(spark, sf_dir, "nation")
    db.create("nation", dict(nation.dtypes), rows=nation)
    db.execute(f"COPY nation TO '{folder}-out.csv' WITH (FORMAT csv, HEADER true)")
    db.execute(f"COPY (SELECT * FROM nation WHERE n_regionkey = 1) TO '{folder}-out.parquet'")
    db.execute("CREATE TABLE back (n_nationkey LONG, n_name STRING, n_regionkey LONG)")
    db.execute(f"COPY back FROM '{folder}-out.csv' WITH (FORMAT csv)")
    db.execute(f"COPY back FROM '{folder}-out.parquet'")
    return db.table("back")
