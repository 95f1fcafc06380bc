"""Changes of tables as DataFrames in, DataFrames out: the caller writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by_keys(keys: list[str], left: str, right: str) -> Column:
    """Equality of the key columns of two aliased tables, nulls equal too."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _one_each(changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key; rows of one key that differ are an error."""
    row = F.struct(*changes.columns)
    found = changes.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.first(row).alias("_row"), F.count_distinct(F.xxhash64(*changes.columns)).alias("_differ"))
    several = F.raise_error(F.lit("several changes for one key")).cast(changes.schema.simpleString())
    return found.select(F.when(F.col("_differ") == 1, F.col("_row")).otherwise(several).alias("_row")).select("_row.*")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The target with the rows of `changes` in place of those with their keys, null keys equal too.

    Of changes with one key the last in `order` counts; without an order they must agree.
    """
    new = dedup(changes, keys, order) if order else _one_each(changes, keys)
    return target.alias("t").join(new.alias("s"), _by_keys(keys, "t", "s"), "left_anti").unionByName(new)


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING; of new rows with one key one goes in."""
    fresh = new.dropDuplicates(keys).alias("s").join(target.alias("t"), _by_keys(keys, "s", "t"), "left_anti")
    return target.unionByName(fresh)


def insert_update(target: DataFrame, new: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """ON CONFLICT DO UPDATE SET: expressions refer to the old row as t.<column> and to the new one as excluded.<column>."""
    return merge(target, new, keys, values, source_name="excluded")


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column] | None = None, delete: Column | None = None, insert: bool = True, source_name: str = "s", update_if: Column | None = None, inserted: dict[str, Column] | None = None) -> DataFrame:
    """MERGE INTO by a full outer join. Expressions refer to the sides as t.<column> and <source_name>.<column>.

    Matched rows that fulfil `delete` go, others that fulfil `update_if` (no condition: all) take the values of
    `update`. Rows of the source without a match go in, by `inserted` or column by column. Null keys match nothing.
    Several source rows that match one target row are an error, as in SQL.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    t = target.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.struct(*target.columns).alias("t"))
    s = source.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.struct(*source.columns).alias(source_name))
    repeated = s.groupBy(*own).count().where("count > 1").select(*own, F.lit(True).alias("_several"))
    both = t.join(s.join(repeated, own, "left"), own, "full")
    matched = F.col("t").isNotNull() & F.col(source_name).isNotNull()
    twice = F.when(matched & F.coalesce("_several", F.lit(False)), F.raise_error(F.lit("several source rows match one target row")).cast("boolean")).otherwise(F.lit(True))
    both = both.where(twice)
    if delete is not None:
        both = both.where(~(matched & F.coalesce(delete, F.lit(False))))
    if not insert:
        both = both.where(F.col("t").isNotNull())
    changed, hit = update or {}, matched if update_if is None else matched & F.coalesce(update_if, F.lit(False))

    def value(c: str) -> Column:
        old = F.col(f"t.{c}")
        new = (inserted or {}).get(c) if inserted is not None else F.col(f"{source_name}.{c}") if c in source.columns else None
        new = F.lit(None) if new is None else new
        return (F.when(hit, changed[c]) if c in changed else F.when(F.lit(False), old)).when(F.col("t").isNotNull(), old).otherwise(new).cast(target.schema[c].dataType).alias(c)

    return both.select(*[value(c) for c in target.columns])


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows for which `where` is true get the values."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Counts of rows that break each rule (CHECK constraints), one row."""
    return df.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])


def orphans(df: DataFrame, parent: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows whose foreign key has no parent."""
    known = parent.select(*[F.col(b).alias(f"_p{i}") for i, (_, b) in enumerate(keys)])
    return df.join(known, [F.col(a) == F.col(f"_p{i}") for i, (a, _) in enumerate(keys)], "left_anti")
