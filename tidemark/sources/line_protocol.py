"""Line protocol: `measurement,tag=value field=1.5,other=2i,text="x" 1700000000000000000`, with escapes.

A backslash keeps the next character from ending a name, a value or a part: measurements escape commas and blanks, names
and tag values also equals signs, text values quotes and backslashes. Fields are numbers, whole numbers (`i`, or `u`
without a sign), booleans (t, true, f, false in any case), text in quotes, and timestamps (`t` after digits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moments import from_micros, whole

#: One character of a part: an escaped one, or none that ends it.
NAME = r"(?:\\.|[^,=\s\\])+"
MEASUREMENT = r"(?:\\.|[^,\s\\])+"
TAG = rf"{NAME}=(?:\\.|[^,\s\\])+"
TEXT = r'"(?:\\.|[^"\\])*"'
FIELD = rf"{NAME}=(?:{TEXT}|(?:\\.|[^,\s\\\"])+)"
LINE = rf"^\s*({MEASUREMENT})((?:,{TAG})*)\s+({FIELD}(?:,{FIELD})*)(?:\s+(-?\d+))?\s*$"


def _plain(text: Column, escaped: str) -> Column:
    """A part without the backslashes before characters that need one."""
    return F.regexp_replace(text, rf"\\([{escaped}])", "$1")


def _pairs(text: Column, one: str) -> Column:
    """A map of names and values of a list of pairs; of names given twice the last counts."""
    entries = F.transform(F.regexp_extract_all(text, F.lit(rf"({one})"), F.lit(1)), lambda p: _entry(p))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def _entry(pair: Column) -> Column:
    name = F.regexp_substr(pair, F.lit(rf"^{NAME}"))
    value = F.substring(pair, F.length(name) + 2, F.length(pair))
    text = _plain(F.substring(value, F.lit(2), F.length(value) - 2), r'"\\')
    return F.struct(_plain(name, ",= ").alias("key"), F.when(value.startswith('"'), text).otherwise(_plain(value, ",= ")).alias("value"))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """measurement, tags and fields (maps of text), ts (microseconds) and ns (the timestamp as given) of well-formed lines;
    blank lines and comments go, and so do others: see `rejected`."""
    line = F.col(column)
    found = lines.where(line.rlike(LINE) & ~F.ltrim(line).startswith("#"))
    part = lambda i: F.regexp_extract(line, LINE, i)
    ns = F.nullif(part(4), F.lit("")).try_cast("long")
    return found.select(_plain(part(1), ", ").alias("measurement"), _pairs(part(2), TAG).alias("tags"), _pairs(part(3), FIELD).alias("fields"), from_micros(whole(ns - F.pmod(ns, F.lit(1000)), 1000)).alias("ts"), ns.alias("ns"))


def rejected(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are neither well-formed nor blank nor comments: to be counted or kept, never lost unseen."""
    line = F.col(column)
    return lines.where(line.isNotNull() & ~line.rlike(LINE) & (F.trim(line) != "") & ~F.ltrim(line).startswith("#"))


def number(field: Column) -> Column:
    """A field's number: whole ones end in i or u."""
    return F.regexp_replace(field, "[iu]$", "").try_cast("double")


def boolean(field: Column) -> Column:
    return F.when(F.lower(field).isin("t", "true"), True).when(F.lower(field).isin("f", "false"), False)


def kind(field: Column) -> Column:
    """integer, float, boolean, timestamp or text, by a value's form."""
    return (
        F.when(field.rlike(r"^[+-]?\d+[iu]$"), "integer")
        .when(field.rlike(r"^\d+t$"), "timestamp")
        .when(boolean(field).isNotNull(), "boolean")
        .when(field.try_cast("double").isNotNull(), "float")
        .otherwise("text")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as they come."""
    return parse(spark.readStream.text(path))


def listen(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines sent to a socket, for tests and small feeds: a socket can't be read again after a failure."""
    return parse(spark.readStream.format("socket").option("host", host).option("port", port).load())
