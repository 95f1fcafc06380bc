"""Files and generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def copy_to(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", **options) -> None:
    """COPY TO: parquet, csv, tsv or json (one object a line)."""
    if kind not in ("parquet", "csv", "tsv", "json"):
        raise ValueError(f"no kind of file: {kind}")
    writer = df.write.mode(mode).options(**options)
    if kind in ("parquet", "json"):
        getattr(writer, kind)(path)
    else:
        writer.csv(path, sep="\t" if kind == "tsv" else options.get("sep", ","), header=options.get("header", True))


def json_lines(df: DataFrame) -> DataFrame:
    """A row of JSON text for each row, nulls kept: what a streamed HTTP answer sends, by df.toLocalIterator()."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def answer(df: DataFrame, most: int = 10_000) -> str:
    """A small result as one JSON document: columns with their types, and rows. Larger ones are an error."""
    import json

    rows = json_lines(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use json_lines")
    columns = [{"name": n, "type": t} for n, t in df.dtypes]
    found = [list(json.loads(r["line"]).values()) for r in rows]
    return json.dumps({"columns": columns, "count": len(found), "dataset": found})


def long_sequence(spark: SparkSession, n: int) -> DataFrame:
    """x = 1..n."""
    return spark.range(1, n + 1).withColumnRenamed("id", "x")


def generate_series(spark: SparkSession, start, stop, step=1) -> DataFrame:
    """Whole numbers, or timestamps with an interval's text as step, both ends included."""
    if isinstance(start, int):
        return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("long"), F.lit(stop).cast("long"), F.lit(step).cast("long"))).alias("value"))
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz"), F.expr(f"INTERVAL {step}"))).alias("value"))


def partitioned(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Adds the name of the time partition of a row: HOUR, DAY, WEEK, MONTH, YEAR or NONE."""
    patterns = {"HOUR": "yyyy-MM-dd'T'HH", "DAY": "yyyy-MM-dd", "MONTH": "yyyy-MM", "YEAR": "yyyy"}
    if unit == "NONE":
        return df.withColumn("partition", F.lit("default"))
    if unit == "WEEK":
        return df.withColumn("partition", F.concat(F.expr(f"extract(YEAROFWEEK FROM {ts})").cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")))
    return df.withColumn("partition", F.date_format(ts, patterns[unit]))
