"""Order books from sequenced deltas, and price ticks as deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def book_at(deltas: DataFrame, key: str, side: str, price: str, quantity: str, sequence: str, action: str, until: int | None = None) -> DataFrame:
    """Levels of each book after the deltas up to a sequence number: the last delta of a level, unless it deletes it."""
    rows = deltas if until is None else deltas.where(F.col(sequence) <= until)
    last = rows.groupBy(key, side, price).agg(F.max_by(F.struct(quantity, action), sequence).alias("_d"))
    return last.where((F.lower("_d." + action) != "delete") & (F.col("_d." + quantity) > 0)).select(key, side, price, F.col("_d." + quantity).alias(quantity))


def snapshots(deltas: DataFrame, key: str, side: str, price: str, quantity: str, sequence: str, action: str, at: DataFrame, at_column: str) -> DataFrame:
    """The levels of each book at each of a few asked sequence numbers (or times): rows (at, key, side, price, quantity).

    A level's state holds from its delta to the next one of that level, so levels and questions meet by a range; the
    questions are broadcast and so must be few.
    """
    from pyspark.sql import Window

    until = F.lead(sequence).over(Window.partitionBy(key, side, price).orderBy(sequence))
    states = deltas.withColumn("_until", until).where((F.lower(action) != "delete") & (F.col(quantity) > 0))
    asked = at.select(F.col(at_column).alias("at")).distinct()
    if asked.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 snapshots asked for")
    hit = (F.col(sequence) <= F.col("at")) & (F.col("_until").isNull() | (F.col("_until") > F.col("at")))
    return states.join(F.broadcast(asked), hit).select("at", key, side, price, quantity)


def depth(levels: DataFrame, key: str, side: str, price: str, quantity: str, n: int = 5) -> DataFrame:
    """The n best levels of each side, numbered from 1, with the quantity so far."""
    from pyspark.sql import Window

    best = Window.partitionBy(key, F.lower(side)).orderBy(F.when(F.lower(side) == "bid", -F.col(price)).otherwise(F.col(price)))
    ranked = levels.withColumn("level", F.row_number().over(best)).where(F.col("level") <= n)
    return ranked.withColumn("total", F.sum(quantity).over(best.rowsBetween(Window.unboundedPreceding, 0))).select(key, side, "level", price, quantity, "total")


def top_of_book(levels: DataFrame, key: str, side: str, price: str, quantity: str) -> DataFrame:
    """best_bid, best_ask, spread, mid and depth on either side."""
    bid, ask = F.lower(F.col(side)) == "bid", F.lower(F.col(side)) == "ask"
    top = levels.groupBy(key).agg(
        F.max(F.when(bid, F.col(price))).alias("best_bid"), F.min(F.when(ask, F.col(price))).alias("best_ask"),
        F.sum(F.when(bid, F.col(quantity)).otherwise(0.0)).alias("bid_depth"), F.sum(F.when(ask, F.col(quantity)).otherwise(0.0)).alias("ask_depth"))
    return top.withColumn("spread", F.col("best_ask") - F.col("best_bid")).withColumn("mid", (F.col("best_ask") + F.col("best_bid")) / 2)


def delta_encode(prices: Column, tick: float) -> Column:
    """Prices as whole ticks: the first, then differences."""
    ticks = F.transform(prices, lambda p: F.round(p / tick).cast("long"))
    return F.transform(ticks, lambda t, i: F.when(i == 0, t).otherwise(t - F.get(ticks, i - 1)))


def delta_decode(deltas: Column, tick: float) -> Column:
    """Prices from whole ticks and differences, in one pass."""
    start = F.struct(F.lit(0).cast("long").alias("now"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, d: Column) -> Column:
        now = a["now"] + d
        return F.struct(now.alias("now"), F.array_append(a["out"], now * tick).alias("out"))

    return F.when(deltas.isNotNull(), F.aggregate(deltas, start, step)["out"])


def ticks_to_text(prices: Column, digits: Column) -> Column:
    """A JSON array of prices as {"base": first, "deltas": [...]} in units of 10**-digits."""
    units = F.transform(F.from_json(prices, "array<double>"), lambda p: F.round(p * F.pow(F.lit(10.0), digits)).cast("long"))
    deltas = F.transform(F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(0))), lambda u, i: u - F.get(units, i))
    return F.when(units.isNotNull(), F.to_json(F.struct(F.coalesce(F.get(units, F.lit(0)), F.lit(0).cast("long")).alias("base"), deltas.alias("deltas"))))


def ticks_from_text(text: Column, digits: Column) -> Column:
    """The JSON array of prices that ticks_to_text() coded."""
    found = F.from_json(text, "base bigint, deltas array<bigint>")
    scale = F.pow(F.lit(10.0), digits)
    prices = F.transform(delta_decode(F.concat(F.array(found["base"]), found["deltas"]), 1.0), lambda u: u / scale)
    return F.when((found["base"] == 0) & (F.size(found["deltas"]) == 0), "[]").otherwise(F.to_json(prices))
