"""Time-series operators: sampling with fills, latest rows, as-of, band and interval joins.

Timestamps are TIMESTAMP_NTZ in microseconds; the session's zone takes no part. All operators take and return
DataFrames and plan as native Spark operators; nothing is collected.

What looks back along time (fills, as-of joins) is cut into chunks of time: each chunk is worked out by itself, its
last row is carried to the chunks after it by a window over chunks alone, so that neither one hot key nor a table
without keys ends up in one task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import from_micros, to_micros

UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def micros(interval: str) -> int:
    """The microseconds of an interval such as 15m, 1h or 2d."""
    found = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", interval.lower())
    if not found or found[2] not in UNITS or int(found[1]) < 1:
        raise ValueError(f"no interval: {interval!r}")
    return int(found[1]) * UNITS[found[2]]


def bucket(ts: Column, interval: str, offset: Column | int = 0) -> Column:
    """The start of the interval that holds a timestamp, floored before 1970 too."""
    return from_micros(bucket_micros(ts, interval, offset))


def bucket_micros(ts: Column, interval: str, offset: Column | int = 0) -> Column:
    """The same in microseconds since 1970."""
    size, shift = F.lit(micros(interval)), offset if isinstance(offset, Column) else F.lit(offset)
    us = to_micros(ts) - shift
    return us - F.pmod(us, size) + shift


def sample_by(df: DataFrame, ts: str, interval: str, aggs: dict[str, Column], keys: list[str] = (), fill: str | float | None = None, align: str = "calendar", name: str = "bucket", firsts: list[str] = ()) -> DataFrame:
    """Aggregates per interval and key, and of the columns `firsts` the values of an interval's first row.

    align: 'calendar' (epoch) or 'first' (the first timestamp's offset). fill: None (only intervals with rows),
    'null', 'prev', 'linear' (numbers, by interval) or a constant; filled intervals run from a key's first to last.
    A constant fills aggregates alone, columns of `firsts` stay null.
    """
    keys = list(keys)
    if align == "first":
        least = df.agg(F.pmod(F.min(to_micros(F.col(ts))), F.lit(micros(interval))).alias("_offset"))
        df = df.crossJoin(F.broadcast(least))  # one row
        at = bucket_micros(F.col(ts), interval, F.col("_offset"))
    else:
        at = bucket_micros(F.col(ts), interval)
    first = [F.min_by(F.struct(*firsts), F.col(ts)).alias("_first")] if firsts else []
    out = df.groupBy(*keys, at.alias("_us")).agg(*[c.alias(n) for n, c in aggs.items()], *first)
    out = out.select(*keys, from_micros(F.col("_us")).alias(name), *aggs, *[F.col(f"_first.{c}").alias(c) for c in firsts])
    return out if fill is None else fill_gaps(out, name, interval, list(aggs), keys, fill, list(firsts))


#: Intervals of a chunk of a filled series.
CHUNK = 4096


def _same(pairs: list[tuple[Column, Column]]) -> Column:
    """Equality of key columns, nulls equal too."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs], F.lit(True))


def _carried(summary: DataFrame, keys: list[str], chunk: str, value: str, back: bool = True) -> DataFrame:
    """For each chunk of each key the last value of the chunks before it (or the first one of those after it)."""
    order = Window.partitionBy(*keys).orderBy(chunk)
    if back:
        return summary.withColumn("_carry", F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return summary.withColumn("_carry", F.first(value, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))


def fill_gaps(df: DataFrame, name: str, interval: str, values: list[str], keys: list[str] = (), fill: str | float = "null", plain: list[str] = ()) -> DataFrame:
    """Adds the missing intervals of each key between its first and last one; see sample_by. `plain` columns take part in
    'prev' and stay null in all other fills."""
    keys, plain, size = list(keys), list(plain), micros(interval)
    own = [f"_k{i}" for i in range(len(keys))]
    us = to_micros(F.col(name))
    rows = df.where(F.col(name).isNotNull()).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], ((us - F.pmod(us, F.lit(size))) / size).cast("long").alias("_n"), F.pmod(us, F.lit(size)).alias("_off"), F.struct(*values, *plain).alias("_row"))
    rows = rows.withColumn("_c", F.floor(F.col("_n") / CHUNK))
    bounds = rows.groupBy(*own).agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), F.min("_off").alias("_off"))
    chunks = bounds.where("_lo is not null").withColumn("_c", F.explode(F.sequence(F.floor(F.col("_lo") / CHUNK), F.floor(F.col("_hi") / CHUNK))))
    known = rows.select(*[F.col(o).alias(f"{o}r") for o in own], F.col("_c").alias("_cr"), F.col("_n").alias("_nr"), "_row")
    if fill in ("prev", "linear"):
        ends = rows.groupBy(*own, "_c").agg(F.max_by(F.struct("_n", "_row"), "_n").alias("_last"), F.min_by(F.struct("_n", "_row"), "_n").alias("_first"))
        ends = ends.select(*[F.col(o).alias(f"{o}e") for o in own], F.col("_c").alias("_ce"), "_last", "_first")
        chunks = chunks.join(ends, _same([(F.col(o), F.col(f"{o}e")) for o in own]) & (F.col("_c") == F.col("_ce")), "left")
        chunks = _carried(chunks, own, "_c", "_last").withColumnRenamed("_carry", "_before")
        chunks = _carried(chunks, own, "_c", "_first", False).withColumnRenamed("_carry", "_after")
    here = F.sequence(F.greatest("_lo", F.col("_c") * CHUNK), F.least("_hi", F.col("_c") * CHUNK + CHUNK - 1))
    spine = chunks.withColumn("_n", F.explode(here))
    wide = spine.join(known, _same([(F.col(o), F.col(f"{o}r")) for o in own]) & (F.col("_c") == F.col("_cr")) & (F.col("_n") == F.col("_nr")), "left")
    at = from_micros(F.col("_n") * size + F.col("_off")).alias(name)
    lead = [*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], at]
    row, types = F.col("_row"), dict(df.dtypes)
    if fill not in ("null", "prev", "linear"):
        return wide.select(*lead, *[F.when(row.isNull(), F.lit(fill)).otherwise(row[v]).alias(v) for v in values], *[row[v].alias(v) for v in plain])
    if fill == "null":
        return wide.select(*lead, *[row[v].alias(v) for v in [*values, *plain]])
    order = Window.partitionBy(*own, "_c").orderBy("_n")
    tagged = wide.withColumn("_here", F.when(row.isNotNull(), F.struct("_n", "_row")))
    tagged = tagged.withColumn("_p", F.coalesce(F.last("_here", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_before"))
    if fill == "prev":
        return tagged.select(*lead, *[F.col(f"_p._row.{v}").alias(v) for v in [*values, *plain]])
    tagged = tagged.withColumn("_q", F.coalesce(F.first("_here", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)), "_after"))
    share = (F.col("_n") - F.col("_p._n")) / (F.col("_q._n") - F.col("_p._n"))

    def value(v: str) -> Column:
        a, b = F.col(f"_p._row.{v}"), F.col(f"_q._row.{v}")
        return F.when(row.isNotNull(), row[v]).otherwise((a + (b - a) * share).cast(types[v])).alias(v)

    return tagged.select(*lead, *[value(v) for v in values], *[row[v].alias(v) for v in plain])


def latest_on(df: DataFrame, ts: str, keys: list[str], tie: list[str] = ()) -> DataFrame:
    """The newest row of each key (a null key is one), ties broken by the largest `tie` columns: one partial aggregate."""
    names = df.columns
    found = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*names), F.struct(ts, *tie)).alias("_row"))
    return found.select("_row.*")


def asof_join(left: DataFrame, right: DataFrame, ts: str, right_ts: str, keys: list[tuple[str, str]], columns: list[str], tie: list[str] = (), tolerance: str | None = None, prefix: str = "", chunk: str | None = None) -> DataFrame:
    """Each left row with the last right row of its keys at or before its time; left rows without one keep nulls.

    Both sides are tagged, united and sorted once per key and chunk of time; the right columns travel in one struct, so
    their nulls count as values. Right rows of one time are ordered by `tie`; `tolerance` limits how far back one may
    lie. `chunk` is an interval: give one where single keys hold very many rows. Without keys it is chosen from the
    left side's span, a 4,096th of it.
    """
    l_row, r_row = F.struct(*left.columns), F.struct(*[F.col(c) for c in dict.fromkeys([right_ts, *tie, *columns])])
    lt = left.select(*[F.col(a).alias(f"_k{i}") for i, (a, _) in enumerate(keys)], F.col(ts).alias("_t"), F.lit(1).alias("_side"), l_row.alias("_l"))
    rt = right.select(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys)], F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), r_row.alias("_r"))
    own = [f"_k{i}" for i in range(len(keys))]
    both = lt.unionByName(rt, allowMissingColumns=True)
    size = micros(chunk) if chunk else None
    if not keys and size is None:
        span = left.agg(F.min(to_micros(F.col(ts))).alias("lo"), F.max(to_micros(F.col(ts))).alias("hi")).first()
        size = max(1, ((span["hi"] or 0) - (span["lo"] or 0)) // 4096)
    if size:
        both = both.withColumn("_c", F.floor(to_micros(F.col("_t")) / size))
    part = [*own, "_c"] if size else own
    order = Window.partitionBy(*part).orderBy("_t", "_side", *[F.col(f"_r.{c}") for c in tie]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    if size:
        ends = both.groupBy(*part).agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_t", *[F.col(f"_r.{c}") for c in tie]))).alias("_last"))
        ends = _carried(ends, own, "_c", "_last").select(*[F.col(o).alias(f"{o}e") for o in own], F.col("_c").alias("_ce"), "_carry")
        found = found.join(ends, _same([(F.col(o), F.col(f"{o}e")) for o in own]) & F.col("_c").eqNullSafe(F.col("_ce")), "left")
        found = found.withColumn("_m", F.coalesce("_m", "_carry"))
    hit = F.col("_m").isNotNull() & F.col("_t").isNotNull()
    for o in own:
        hit &= F.col(o).isNotNull()
    if tolerance:
        hit &= to_micros(F.col("_t")) - to_micros(F.col(f"_m.{right_ts}")) <= micros(tolerance)
    return found.select("_l.*", *[F.when(hit, F.col(f"_m.{c}")).alias(prefix + c) for c in columns])


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, keys: list[tuple[str, str]] = (), most: int = 1 << 24) -> DataFrame:
    """Inner join of rows whose values differ by `width` at most: an equi-join on the band's number and its neighbours.

    The pairs to try are counted first. With more than `most` of them both sides are dealt to as many partitions as give
    each about so many, a large group's right rows to several; by bytes alone a few tasks would do all the work.
    """
    number = lambda c: F.floor(F.col(c) / F.lit(width))
    l = left.withColumn("_band", F.explode(F.sequence(number(left_value) - 1, number(left_value) + 1)))
    r = right.withColumn("_of", number(right_value))
    on = (F.col("_band") == F.col("_of")) & (F.abs(F.col(left_value) - F.col(right_value)) <= F.lit(width))
    for a, b in keys:
        on &= F.col(a) == F.col(b)
    own = ["_g", *[f"_g{i}" for i in range(len(keys))]]
    counted = lambda rows, names, n: rows.groupBy(*[F.col(c).alias(g) for c, g in zip(names, own, strict=True)]).agg(F.count(F.lit(1)).alias(n))
    l_names, r_names = ["_band", *[a for a, _ in keys]], ["_of", *[b for _, b in keys]]
    pairs = F.col("_nl").cast("double") * F.col("_nr")
    groups = counted(l, l_names, "_nl").join(counted(r, r_names, "_nr"), own).select(*own, F.ceil(pairs / most).alias("_sides"), pairs.alias("_pairs"))
    total = groups.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0))).first()[0]
    if total <= most:
        return l.join(r, on).drop("_band", "_of")
    sided = lambda rows, names: rows.join(groups.select(*own, "_sides"), [F.col(c) == F.col(g) for c, g in zip(names, own, strict=True)]).drop(*own)
    partitions = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / most) + 1)
    l = sided(l, l_names).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_sides") - 1))).drop("_sides")
    r = sided(r, r_names).withColumn("_own", F.pmod(F.xxhash64(*right.columns), "_sides")).drop("_sides")
    l, r = l.repartition(partitions, *l_names, "_part"), r.repartition(partitions, *r_names, "_own")
    return l.join(r.hint("merge"), on & (F.col("_part") == F.col("_own"))).drop("_band", "_of", "_part", "_own")


def window_join(left: DataFrame, right: DataFrame, ts: str, right_ts: str, width: str, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Inner join of left rows with right rows at most `width` before them, by time buckets of that width."""
    size = micros(width)
    at = lambda c: F.floor(to_micros(F.col(c)) / F.lit(size))
    l = left.withColumn("_band", F.explode(F.array(at(ts) - 1, at(ts))))
    r = right.withColumn("_of", at(right_ts))
    gap = to_micros(F.col(ts)) - to_micros(F.col(right_ts))
    on = (F.col("_band") == F.col("_of")) & (gap >= 0) & (gap <= size)
    for a, b in keys:
        on &= F.col(a) == F.col(b)
    return l.join(r, on).drop("_band", "_of")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, most: int = 100_000) -> DataFrame:
    """Inner join by any condition. The right side is looked at row by row for each left one, so it must be small: it is
    broadcast only once it is known to have at most `most` rows."""
    if right.limit(most + 1).count() > most:
        raise ValueError(f"the right side has more than {most} rows; use a band, window or equi-join")
    return left.join(F.broadcast(right), condition)


def skew_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join with hot keys on the left: each left row draws one of `salts`, each right row is there once for each. Both
    sides are shuffled and merged: Spark sizes the right side without its copies, and would broadcast them all."""
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    r = right.withColumn("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on = F.col("_salt") == F.col("_of")
    for a, b in keys:
        on &= F.col(a) == F.col(b)
    return l.join(r.hint("merge"), on, how).drop("_salt", "_of")


def mark_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], name: str = "matched") -> DataFrame:
    """The left rows with a flag: whether the right side has their keys."""
    known = right.select(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys)]).distinct().withColumn("_hit", F.lit(True))
    on = [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(keys)]
    return left.join(known, on, "left").select(*left.columns, F.coalesce("_hit", F.lit(False)).alias(name))


def retention(df: DataFrame, ts: str, keep: str, now: Column) -> DataFrame:
    """Rows not older than `keep` before `now`."""
    return df.where(to_micros(F.col(ts)) >= to_micros(now) - micros(keep))
