"""Operators over whole tables that SQL has no word for: scaling, hashes, numbering, splitting, repeats in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import to_micros


def normalise(df: DataFrame, column: str, keys: list[str] = (), out: str = "normalised") -> DataFrame:
    """Values scaled to 0..1 between the least and largest of their group; 0 where all are equal.

    Least and largest are aggregates that are joined back, so no group is sorted or held.
    """
    bounds = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    value = F.when(F.col(column).isNotNull(), F.when(span == 0, 0.0).otherwise((F.col(column) - F.col("_lo")) / span))
    return _joined(df, bounds, keys).withColumn(out, value).select(*df.columns, out)


def zscore(df: DataFrame, column: str, keys: list[str] = (), out: str = "zscore") -> DataFrame:
    """(value - mean) / population deviation of its group; 0 where all are equal."""
    bounds = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    value = F.when(F.col(column).isNotNull(), F.when(F.col("_s") == 0, 0.0).otherwise((F.col(column) - F.col("_m")) / F.col("_s")))
    return _joined(df, bounds, keys).withColumn(out, value).select(*df.columns, out)


def _joined(df: DataFrame, one_each: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return df.crossJoin(F.broadcast(one_each))  # one row
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(one_each, on, "left")


def row_hash(df: DataFrame, columns: list[str] | None = None, out: str = "row_hash") -> DataFrame:
    """A 64-bit hash of the columns' values; nulls count as values."""
    names = columns or df.columns
    return df.withColumn(out, F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in names]))


def table_hash(df: DataFrame) -> DataFrame:
    """rows and a hash of all rows that doesn't depend on their order: equal tables have equal hashes."""
    hashed = row_hash(df, out="_h").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_sum"), F.bit_xor("_h").alias("_xor"))
    return hashed.select("rows", F.xxhash64(F.coalesce(F.col("_sum").cast("string"), F.lit("")), F.coalesce("_xor", F.lit(0))).alias("hash"))


def row_ids(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Numbers that rise along each partition and are unique, without gaps from partition to partition mattering."""
    return df.select(F.monotonically_increasing_id().alias(out), "*")


def numbered(df: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """Rows numbered 1, 2, ... in order without one task for all: each range of the order counts its rows, then adds those
    of the ranges before."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    counts = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    nth = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return sorted_rows.join(F.broadcast(before), "_part").select((F.col("_before") + nth).alias(out), *df.columns)


def split_rows(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """A row for each part of a separated text; a null text keeps its row."""
    parts = F.split(F.col(column), f"\\Q{separator}\\E")
    return df.select(*[F.explode_outer(parts).alias(c) if c == column else F.col(c) for c in df.columns])


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows without those whose columns equal those of the row before, in order, of the same key."""
    names = columns or [c for c in df.columns if c not in (*keys, *order)]
    before = F.lag(F.struct(*names)).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return df.withColumn("_same", ~first & F.struct(*names).eqNullSafe(before)).where("NOT _same").drop("_same")


def every_nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first row in order and every n-th after it."""
    return numbered(df, order, "_nth").where((F.col("_nth") - 1) % n == 0).drop("_nth")


def top_groups(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k keys with the largest sums, ties by key."""
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key).limit(k)


def running(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds running_sum and running_count of a column."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_sum", F.sum(value).over(so_far)).withColumn("running_count", F.count(value).over(so_far))


def lookup(df: DataFrame, table: DataFrame, keys: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """The row of another table that a key names, null columns where there is none; several such rows are an error."""
    one = table.groupBy(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys)]).agg(F.first(F.struct(*columns)).alias("_row"), F.count(F.lit(1)).alias("_count"))
    on = [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(keys)]
    several = F.when(F.col("_count") > 1, F.raise_error(F.lit("a key names several rows")).cast("boolean")).otherwise(F.lit(True))
    return df.join(one, on, "left").where(several).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in columns])


def in_hours(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """Rows from start up to, not including, end."""
    return df.where((to_micros(F.col(ts)) >= to_micros(start)) & (to_micros(F.col(ts)) < to_micros(end)))
