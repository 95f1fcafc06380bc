"""Ordered aggregates and market indicators.

Functions of an array `xs` are column expressions over the sorted values of a group, which they need in memory.
`series` has no such bound: it folds each chunk of time of a series to a summary (its last values, peak and fall,
what it does to moving averages, moments of its returns) and then the summaries of a series to all indicators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import to_micros


def ordered(value: Column, *order: Column) -> Column:
    """The non-null values of a group in order, as an array."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.cast("double").alias("x")))))
    return F.transform(pairs, lambda s: s["x"])


def tail(xs: Column, n: int) -> Column:
    return F.slice(xs, F.greatest(F.size(xs) - n + 1, F.lit(1)), n)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def diffs(xs: Column) -> Column:
    """Differences of neighbours."""
    return F.transform(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda x, i: x - F.get(xs, i))


def sma(xs: Column, n: int = 20) -> Column:
    return mean(tail(xs, n))


def ema(xs: Column, n: int = 20) -> Column:
    alpha = 2.0 / (n + 1)
    return F.aggregate(xs, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a * (1 - alpha) + x * alpha))


def wma(xs: Column, n: int = 20) -> Column:
    last = tail(xs, n)
    m = F.size(last)
    return F.when(m > 0, F.aggregate(F.transform(last, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x) / (m * (m + 1) / 2))


def rsi(xs: Column, n: int = 14) -> Column:
    moves = diffs(tail(xs, n + 1))
    gain, loss = total(F.transform(moves, lambda d: F.greatest(d, F.lit(0.0)))), total(F.transform(moves, lambda d: F.greatest(-d, F.lit(0.0))))
    return F.when(F.size(xs) >= 2, F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / loss)))


def macd_signal(xs: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    weights = [2.0 / (n + 1) for n in (fast, slow, signal)]
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("f"), none.alias("s"), none.alias("g"))

    def step(a: Column, x: Column) -> Column:
        f = F.when(a["f"].isNull(), x).otherwise(a["f"] * (1 - weights[0]) + x * weights[0])
        s = F.when(a["s"].isNull(), x).otherwise(a["s"] * (1 - weights[1]) + x * weights[1])
        g = F.when(a["g"].isNull(), f - s).otherwise(a["g"] * (1 - weights[2]) + (f - s) * weights[2])
        return F.struct(f.alias("f"), s.alias("s"), g.alias("g"))

    return F.when(F.size(xs) >= slow, F.aggregate(xs, start, step)["g"])


def bollinger(xs: Column, n: int = 20, k: float = 2.0) -> tuple[Column, Column]:
    """Upper and lower band: mean and k population deviations of the last n."""
    last = tail(xs, n)
    m = mean(last)
    spread = F.sqrt(F.greatest(mean(F.transform(last, lambda x: x * x)) - m * m, F.lit(0.0)))
    return m + k * spread, m - k * spread


def atr(xs: Column, n: int = 14) -> Column:
    return F.when(F.size(xs) >= 2, mean(F.transform(tail(diffs(xs), n), F.abs)))


def drawdown(xs: Column) -> Column:
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(a: Column, x: Column) -> Column:
        peak = F.greatest(a["peak"], x)
        return F.struct(peak.alias("peak"), F.greatest(a["worst"], F.when(peak > 0, (peak - x) / peak).otherwise(0.0)).alias("worst"))

    return F.when(F.size(xs) > 0, F.aggregate(xs, start, step)["worst"])


def _moments(xs: Column) -> Column:
    """Count, mean and sum of squared deviations of values, as a struct, in one pass."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def step(a: Column, x: Column) -> Column:
        n, d = a["n"] + 1.0, x - a["m"]
        m = a["m"] + d / n
        return F.struct(n.alias("n"), m.alias("m"), (a["q"] + d * (x - m)).alias("q"))

    return F.aggregate(xs, start, step)


def _ratio(x: Column, before: Column) -> Column:
    """x / before; NaN after a zero, as infinite returns leave no mean and no deviation."""
    return F.coalesce(F.try_divide(x, before), F.when(x.isNotNull() & before.isNotNull(), F.lit(float("nan"))))


def _log(ratio: Column) -> Column:
    """ln of a ratio; NaN of those that have no finite one."""
    return F.when(ratio > 0, F.ln(ratio)).when(ratio.isNotNull(), F.lit(float("nan")))


def _returns(xs: Column, f) -> Column:
    """f of the ratios of neighbours."""
    ratio = F.transform(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda x, i: _ratio(x, F.get(xs, i)))
    return F.filter(F.transform(ratio, f), lambda r: r.isNotNull())


def _deviation(m: Column) -> Column:
    return F.when(m["n"] >= 2, F.sqrt(m["q"] / (m["n"] - 1)))


def realized_vol(xs: Column, periods: float = 252.0) -> Column:
    return _deviation(_moments(_returns(xs, _log))) * F.sqrt(F.lit(periods))


def sharpe(xs: Column, periods: float = 252.0) -> Column:
    m = _moments(_returns(xs, lambda r: r - 1))
    return F.when(_deviation(m) > 0, m["m"] / _deviation(m) * F.sqrt(F.lit(periods)))


def vwap(price: Column, volume: Column) -> Column:
    return F.try_divide(F.sum(price * volume), F.sum(volume))


def order_imbalance(x: Column) -> Column:
    buy, sell = F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))
    return F.try_divide(buy - sell, buy + sell)


def trade_flow(x: Column) -> Column:
    return F.try_divide(F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.abs(x)))


def first(x: Column, *order: Column) -> Column:
    """The first non-null value in order."""
    return F.min_by(x, F.when(x.isNotNull(), F.struct(*order)))


def last(x: Column, *order: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), F.struct(*order)))


def price_impact(x: Column, *order: Column) -> Column:
    return F.when(F.count(x) >= 2, F.try_divide(last(x, *order) - first(x, *order), first(x, *order)))


def ohlcv(price: Column, volume: Column, *order: Column) -> dict[str, Column]:
    """Columns of a bar, for sample_by."""
    return {"open": first(price, *order), "high": F.max(price), "low": F.min(price), "close": last(price, *order), "volume": F.sum(volume), "vwap": vwap(price, volume), "trades": F.count(price)}


#: Values that a summary keeps of a chunk's end: enough for the longest look-back.
TAIL = 26


def last_values(df: DataFrame, keys: list[str], value: str, ts: str, order: list[str] = (), n: int = TAIL) -> DataFrame:
    """The last n values of each key in order, as an array `xs`: enough for indicators that look back no further. Each
    task keeps n rows a key before rows are shuffled."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(ts), *[F.desc(o) for o in order])
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, ts, *order, F.row_number().over(newest).alias("_nth")).where(F.col("_nth") <= n)
    return rows.groupBy(*keys).agg(ordered(F.col(value), F.col(ts), *[F.col(o) for o in order]).alias("xs"))


def _smooth(xs: Column, n: int, start: Column) -> Column:
    w = 2.0 / (n + 1)
    return F.aggregate(xs, start, lambda a, x: F.when(a.isNull(), x).otherwise(a * (1 - w) + x * w))


def _signal(xs: Column, slow: int = 26, fast: int = 12, signal: int = 9) -> Column:
    """What a chunk does to (fast, slow, signal) averages: from nothing, from zeros, and the signal's answer to a fast or
    slow average of 1 before it (the averages' own answers are powers of their decay)."""
    f_w, s_w, g_w = (2.0 / (n + 1) for n in (fast, slow, signal))
    none, zero, one = F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)
    start = F.struct(none.alias("f"), none.alias("s"), none.alias("g"), zero.alias("fz"), zero.alias("sz"), zero.alias("gz"), one.alias("pf"), one.alias("ps"), one.alias("pg"), zero.alias("hf"), zero.alias("hs"))

    def step(a: Column, x: Column) -> Column:
        f = F.when(a["f"].isNull(), x).otherwise(a["f"] * (1 - f_w) + x * f_w)
        s = F.when(a["s"].isNull(), x).otherwise(a["s"] * (1 - s_w) + x * s_w)
        g = F.when(a["g"].isNull(), f - s).otherwise(a["g"] * (1 - g_w) + (f - s) * g_w)
        fz, sz = a["fz"] * (1 - f_w) + x * f_w, a["sz"] * (1 - s_w) + x * s_w
        pf, ps = a["pf"] * (1 - f_w), a["ps"] * (1 - s_w)
        return F.struct(f.alias("f"), s.alias("s"), g.alias("g"), fz.alias("fz"), sz.alias("sz"), (a["gz"] * (1 - g_w) + (fz - sz) * g_w).alias("gz"), pf.alias("pf"), ps.alias("ps"), (a["pg"] * (1 - g_w)).alias("pg"), (a["hf"] * (1 - g_w) + pf * g_w).alias("hf"), (a["hs"] * (1 - g_w) - ps * g_w).alias("hs"))

    return F.aggregate(xs, start, step)


def _joined(a: Column, b: Column) -> Column:
    """The moments of two sets of values together."""
    n = a["n"] + b["n"]
    d = b["m"] - a["m"]
    part = F.when(n > 0, b["n"] / n).otherwise(0.0)
    return F.struct(n.alias("n"), (a["m"] + d * part).alias("m"), (a["q"] + b["q"] + d * d * a["n"] * part).alias("q"))


def _single(x: Column) -> Column:
    return F.struct(F.when(x.isNull(), 0.0).otherwise(1.0).alias("n"), F.coalesce(x, F.lit(0.0)).alias("m"), F.lit(0.0).alias("q"))


def series(df: DataFrame, keys: list[str], value: str, ts: str, order: list[str] = (), chunk: int = 3_600_000_000) -> DataFrame:
    """All indicators of each key's values in order of `ts` and `order`: sma, wma, bollinger_upper, bollinger_lower, rsi,
    atr, drawdown, ema, macd_signal, realized_vol, sharpe, n. Chunks are `chunk` microseconds long."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_c", F.floor(to_micros(F.col(ts)) / chunk))
    xs = F.col("_xs")
    parts = rows.groupBy(*keys, "_c").agg(ordered(F.col(value), F.col(ts), *[F.col(o) for o in order]).alias("_xs"))
    logs, simple = _returns(xs, _log), _returns(xs, lambda r: r - 1)
    summary = F.struct(
        F.col("_c").alias("c"),
        F.size(xs).cast("long").alias("n"),
        F.get(xs, F.lit(0)).alias("first"),
        F.element_at(xs, -1).alias("last"),
        tail(xs, TAIL).alias("tail"),
        F.array_max(xs).alias("peak"),
        F.array_min(xs).alias("low"),
        drawdown(xs).alias("worst"),
        ema(xs).alias("ema"),
        _smooth(xs, 20, F.lit(0.0)).alias("ema_zero"),
        F.pow(F.lit(1 - 2.0 / 21), F.size(xs)).alias("ema_decay"),
        _signal(xs).alias("macd"),
        _moments(logs).alias("logs"),
        _moments(simple).alias("simple"),
    )
    whole = parts.select(*keys, summary.alias("_s")).groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_all"))
    none = F.lit(None).cast("double")
    nothing = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))
    start = F.struct(F.lit(0).cast("long").alias("n"), none.alias("last"), F.array().cast("array<double>").alias("tail"), none.alias("peak"), F.lit(0.0).alias("worst"), none.alias("ema"), none.alias("f"), none.alias("s"), none.alias("g"), nothing.alias("logs"), nothing.alias("simple"))

    def step(a: Column, b: Column) -> Column:
        fresh, m = a["last"].isNull(), b["macd"]
        both = F.concat(a["tail"], b["tail"])
        fall = F.when(a["peak"] > 0, (a["peak"] - b["low"]) / a["peak"]).otherwise(0.0)
        return F.struct(
            (a["n"] + b["n"]).alias("n"),
            b["last"].alias("last"),
            tail(both, TAIL).alias("tail"),
            F.greatest(a["peak"], b["peak"]).alias("peak"),
            F.greatest(a["worst"], b["worst"], fall).alias("worst"),
            F.when(fresh, b["ema"]).otherwise(a["ema"] * b["ema_decay"] + b["ema_zero"]).alias("ema"),
            F.when(fresh, m["f"]).otherwise(a["f"] * m["pf"] + m["fz"]).alias("f"),
            F.when(fresh, m["s"]).otherwise(a["s"] * m["ps"] + m["sz"]).alias("s"),
            F.when(fresh, m["g"]).otherwise(a["g"] * m["pg"] + a["f"] * m["hf"] + a["s"] * m["hs"] + m["gz"]).alias("g"),
            _joined(_joined(a["logs"], _single(_log(_ratio(b["first"], a["last"])))), b["logs"]).alias("logs"),
            _joined(_joined(a["simple"], _single(_ratio(b["first"], a["last"]) - 1)), b["simple"]).alias("simple"),
        )

    folded = whole.select(*keys, F.aggregate("_all", start, step).alias("_f"))
    end = F.col("_f.tail")
    upper, lower = bollinger(end)
    std = lambda m: F.when(F.col(f"_f.{m}.n") >= 2, F.sqrt(F.col(f"_f.{m}.q") / (F.col(f"_f.{m}.n") - 1)))
    year = F.sqrt(F.lit(252.0))
    return folded.select(
        *keys,
        sma(end).alias("sma"),
        wma(end).alias("wma"),
        upper.alias("bollinger_upper"),
        lower.alias("bollinger_lower"),
        rsi(end).alias("rsi"),
        atr(end).alias("atr"),
        F.col("_f.worst").alias("drawdown"),
        F.col("_f.ema").alias("ema"),
        F.when(F.col("_f.n") >= 26, F.col("_f.g")).alias("macd_signal"),
        (std("logs") * year).alias("realized_vol"),
        F.when(std("simple") > 0, F.col("_f.simple.m") / std("simple") * year).alias("sharpe"),
        F.col("_f.n").alias("n"),
    )
