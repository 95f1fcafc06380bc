"""Timestamps without a zone as microseconds since 1970, whatever the session's zone, and functions of units by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
SIZES = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
#: Offsets of zone abbreviations, seconds.
OFFSETS = {"UTC": 0, "GMT": 0, "EST": -18_000, "CST": -21_600, "MST": -25_200, "PST": -28_800, "CET": 3_600, "EET": 7_200, "JST": 32_400, "IST": 19_800}
#: Bar intervals, seconds.
FRAMES = {"1s": 1, "1m": 60, "5m": 300, "15m": 900, "1h": 3_600, "4h": 14_400, "1d": 86_400, "1w": 604_800}


def to_micros(ts: Column) -> Column:
    """Microseconds between 1970 and a time as the clock shows it: no zone takes part."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    return F.expr(EPOCH) + F.expr("INTERVAL '0.000001' SECOND") * us.cast("long")


def whole(a: Column, b: int) -> Column:
    """a / b without its fraction, towards zero."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def _choose(unit: Column | str, forms: dict[str, Column]) -> Column:
    """The form of a unit, in the singular or plural and any case; another unit is an error when the row is read."""
    if isinstance(unit, str):
        name = unit.lower().rstrip("s")
        if name not in forms:
            raise ValueError(f"no unit: {unit!r}")
        return forms[name]
    name = F.rtrim(F.lower(unit), F.lit("s"))
    out = None
    for k, form in forms.items():
        out = F.when(name == k, form) if out is None else out.when(name == k, form)
    return out.otherwise(F.raise_error(F.concat(F.lit("no unit: "), unit)))


def difference(unit: Column | str, a: Column, b: Column) -> Column:
    """Whole units from a to b, towards zero."""
    us = to_micros(b) - to_micros(a)
    return F.when(a.isNotNull() & b.isNotNull(), _choose(unit, {k: whole(us, n) for k, n in SIZES.items() if n >= 1_000_000}))


def shifted(unit: Column | str, n: Column, ts: Column) -> Column:
    """A time some units later; months and years keep the day, or take the month's last."""
    ts, n = ts.cast("timestamp_ntz"), n.cast("long")
    forms = {k: ts + F.expr("INTERVAL '0.000001' SECOND") * (n * F.lit(size)) for k, size in SIZES.items()}
    months = lambda k: ts + F.make_ym_interval(F.lit(0), (n * k).cast("int"))
    return _choose(unit, forms | {"month": months(1), "quarter": months(3), "year": months(12)})


def truncated(unit: Column | str, ts: Column) -> Column:
    return F.call_function("date_trunc", F.lit(unit) if isinstance(unit, str) else unit, ts.cast("timestamp_ntz")).cast("timestamp_ntz")


def ceiling(unit: Column | str, ts: Column) -> Column:
    low = truncated(unit, ts)
    return F.when(low == ts, ts.cast("timestamp_ntz")).otherwise(shifted(unit, F.lit(1), low))


def formatted(ts: Column, pattern: Column | str | None = None) -> Column:
    """A time as text by a pattern of %Y %m %d %H %M %S %f %j %y %%; without one, %Y-%m-%d %H:%M:%S."""
    ts = ts.cast("timestamp_ntz")
    pattern = F.lit("%Y-%m-%d %H:%M:%S") if pattern is None else F.lit(pattern) if isinstance(pattern, str) else pattern
    fields = {"Y": F.lpad(F.year(ts).cast("string"), 4, "0"), "m": F.lpad(F.month(ts).cast("string"), 2, "0"), "d": F.lpad(F.dayofmonth(ts).cast("string"), 2, "0"), "H": F.lpad(F.hour(ts).cast("string"), 2, "0"), "M": F.lpad(F.minute(ts).cast("string"), 2, "0"), "S": F.lpad(F.second(ts).cast("string"), 2, "0"), "f": F.lpad(F.pmod(to_micros(ts), F.lit(1_000_000)).cast("string"), 6, "0"), "j": F.lpad(F.dayofyear(ts).cast("string"), 3, "0"), "y": F.lpad((F.year(ts) % 100).cast("string"), 2, "0")}
    out = F.replace(pattern, F.lit("%%"), F.lit("\u0000"))
    for letter, value in fields.items():
        out = F.replace(out, F.lit(f"%{letter}"), value)
    return F.replace(out, F.lit("\u0000"), F.lit("%"))


def interval_micros(text: Column) -> Column:
    """The microseconds of 500ms, 30m, 2d and the like; null for another text. Nanoseconds are cut."""
    found, pattern = F.trim(text), r"^([+-]?\d+)\s*(ns|us|ms|s|m|h|d|w)$"
    n, unit = F.regexp_extract(found, pattern, 1).try_cast("long"), F.regexp_extract(found, pattern, 2)
    sizes = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
    out = F.when(unit == "ns", whole(n, 1000))
    for k, size in sizes.items():
        out = out.when(unit == k, n * size)
    return out


def interval_nanos(text: Column) -> Column:
    n = F.regexp_extract(F.trim(text), r"^([+-]?\d+)\s*ns$", 1).try_cast("long")
    return F.coalesce(n, interval_micros(text) * 1000)


def frame_nanos(name: Column | str) -> Column:
    """The nanoseconds of a bar interval: 1s, 1m, 5m, 15m, 1h, 4h, 1d, 1w, or s1, m1 and so on."""
    known = {k: n * 1_000_000_000 for k, n in FRAMES.items()}
    known |= {k[-1] + k[:-1]: n for k, n in known.items()}
    if isinstance(name, str):
        return F.lit(known[name.lower()])
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.raise_error(F.concat(F.lit("no bar interval: "), name)).cast("long"))


def bar_start(ns: Column, name: Column | str) -> Column:
    """The start of the bar that holds a time, both in nanoseconds; all bars, those of a week too, count from 1970-01-01."""
    return ns - F.pmod(ns, frame_nanos(name))


def _parts(days: Column) -> Column:
    return F.concat(whole(days, 365).cast("string"), F.lit(" years "), whole(days % 365, 30).cast("string"), F.lit(" months "), (days % 365 % 30).cast("string"), F.lit(" days"))


DAY_NS = 86_400_000_000_000
FUNCTIONS = {
    "date_diff": difference,
    "timestamp_add": shifted,
    "date_trunc": truncated,
    "timestamp_ceil": ceiling,
    "date_format": formatted,
    "interval_to_nanos": interval_nanos,
    "ohlcv_interval_nanos": frame_nanos,
    "ohlcv_bar_align": bar_start,
    "date_trunc_tz": lambda unit, ts, zone: truncated(unit, F.convert_timezone(F.lit("UTC"), zone if isinstance(zone, Column) else F.lit(zone), ts.cast("timestamp_ntz"))),
    "at_timezone": lambda ts, zone: F.convert_timezone(F.lit("UTC"), zone if isinstance(zone, Column) else F.lit(zone), ts.cast("timestamp_ntz")),
    "to_timezone": lambda ts, zone: F.convert_timezone(F.lit("UTC"), zone if isinstance(zone, Column) else F.lit(zone), ts.cast("timestamp_ntz")),
    "to_utc": lambda ts, zone: F.convert_timezone(zone if isinstance(zone, Column) else F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz")),
    "timezone_offset": lambda zone: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in OFFSETS.items() for x in pair]), F.upper(zone if isinstance(zone, Column) else F.lit(zone))), F.lit(0)).cast("long"),
    "make_interval": lambda y, mo, d, h, mi, s: ((((y * 365 + mo * 30 + d).cast("long") * 24 + h) * 60 + mi) * 60 + s) * 1_000_000_000,
    "justify_hours": lambda ns: F.concat(whole(ns, DAY_NS).cast("string"), F.lit(" days "), whole(ns % DAY_NS, DAY_NS // 24).cast("string"), F.lit(" hours")),
    "justify_days": lambda ns: F.concat(whole(whole(ns, DAY_NS), 30).cast("string"), F.lit(" months "), (whole(ns, DAY_NS) % 30).cast("string"), F.lit(" days")),
    "age_timestamp": lambda a, b: _parts(whole(F.abs(to_micros(a) - to_micros(b)), 86_400_000_000)),
    "to_char_timestamp": lambda ts, _pattern=None: formatted(ts),
    "to_date_str": lambda s, _pattern=None: from_micros(whole(s, 1000)),
    "to_timestamp_str": lambda s, _pattern=None: from_micros(whole(s, 1000)),
    "to_date": lambda x, pattern=None: truncated("day", x) if pattern is None else F.to_date(x, "yyyy-MM-dd").cast("timestamp_ntz"),
    "timestamp_sequence": lambda start, _step=None: start,
    "rnd_timestamp": lambda lo, hi: from_micros((to_micros(lo) + F.rand() * (to_micros(hi) - to_micros(lo))).cast("long")),
}
