"""Scalar functions by name: each takes and returns columns. `call(name, *columns)` looks names up, in any case.

Names with a type at their end (`sum_long`, `eq_int_int`, `cast_int_to_str`) are made from rules in `typed`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import market
from . import constants, documents, geo, hashing, moments

Builder = Callable[..., Column]


def _long(c: Column) -> Column:
    return c.cast("long")


_us, _ntz = moments.to_micros, moments.from_micros


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _words_title(s: Column) -> Column:
    pieces = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), "")


def _wildcards(p: Column, many: str, one: str) -> Column:
    """A pattern's wildcards as a regular expression; all its other characters stand for themselves."""
    quoted = F.concat(F.lit("\\Q"), F.replace(F.replace(p, F.lit(many), F.lit("\\E.*\\Q")), F.lit(one), F.lit("\\E.\\Q")), F.lit("\\E"))
    return quoted


def _title(s: Column) -> Column:
    """A capital after white space, underscores and hyphens, small letters elsewhere."""
    pieces = F.regexp_extract_all(F.lower(s), F.lit(r"[^\s_-]+|[\s_-]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), "")


def _wrapped(s: Column, n: Column) -> Column:
    return F.when(n <= 0, s).otherwise(F.regexp_replace(s, F.concat(F.lit("(?s)(.{"), n.cast("string"), F.lit("})(?=.)")), F.lit("$1\n")))


STRINGS: dict[str, Builder] = {
    "length": F.char_length,
    "upper": F.upper,
    "lower": F.lower,
    "trim": _trim,
    "ltrim": lambda s: F.regexp_replace(s, r"^\s+", ""),
    "rtrim": lambda s: F.regexp_replace(s, r"\s+$", ""),
    "substring": lambda s, a, n: F.substring(s, F.greatest(a, F.lit(1)), n),
    "concat": lambda *c: F.concat_ws("", *c),
    "replace": F.replace,
    "starts_with": F.startswith,
    "ends_with": F.endswith,
    "contains": F.contains,
    "reverse": F.reverse,
    "repeat": F.repeat,
    "left": F.left,
    "right": F.right,
    "lpad": F.lpad,
    "rpad": F.rpad,
    "split_part": lambda s, d, i: F.when(i == 0, "").otherwise(F.split_part(s, d, F.when(i == 0, 1).otherwise(i))),
    "regexp_split_to_array": lambda s, p: F.call_function("split", s, p),
    "title_case_ex": _title,
    "wrap": _wrapped,
    "normalize": lambda s, *_: s,
    "to_tsvector": lambda s, *_: s,
    "to_tsquery": lambda s, *_: s,
    "plainto_tsquery": lambda s, *_: s,
    "phraseto_tsquery": lambda s, *_: s,
    "websearch_to_tsquery": lambda s, *_: s,
    "ts_headline": lambda s, *_: s,
    "ts_rewrite": lambda s, *_: s,
    "tsvector_concat": lambda s, *_: s,
    "ltrim_chars": lambda s, c: F.ltrim(s, c),
    "rtrim_chars": lambda s, c: F.rtrim(s, c),
    "regexp_matches": lambda s, p: F.regexp_extract_all(s, p, F.lit(0)),
    "regexp_split_to_table": lambda s, p: F.explode(F.call_function("split", s, p)),
    "string_to_table": lambda s, d: F.explode(F.call_function("split", s, F.concat(F.lit("\\Q"), d, F.lit("\\E")))),
    "sizeof": lambda x: F.coalesce(F.octet_length(x.cast("string")), F.lit(0)),
    "regexp_match": F.rlike,
    "regexp_match_ci": lambda s, p: F.rlike(s, F.concat(F.lit("(?i)"), p)),
    "regexp_replace": F.regexp_replace,
    "regexp_count": F.regexp_count,
    "regexp_extract": lambda s, p, k=None: F.regexp_substr(s, p) if k is None else F.when(F.rlike(s, p), F.call_function("regexp_extract", s, p, k)),
    "md5": F.md5,
    "sha256": lambda s: F.sha2(s, 256),
    "position": lambda sub, s: F.call_function("locate", sub, s),
    "overlay": F.overlay,
    "translate": lambda s, a, b: F.call_function("translate", s, a, b),
    "initcap": _words_title,
    "encode": lambda s, f=None: F.base64(s.cast("binary")),
    "decode": lambda s, f=None: F.decode(F.unbase64(s), "UTF-8"),
    "quote_ident": lambda s: F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')),
    "quote_literal": lambda s: F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")),
    "ascii": F.ascii,
    "chr": F.chr,
    "char_at": lambda s, i: F.when((i >= 1) & (i <= F.char_length(s)), F.substring(s, i, F.lit(1))),
    "hex": lambda x: F.lower(F.hex(x)),
    "unhex": lambda s: F.conv(s, 16, 10).cast("long"),
    "url_encode": lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")),
    "url_decode": F.url_decode,
    "strcmp": lambda a, b: F.when(a < b, -1).when(a == b, 0).when(a > b, 1),
    "soundex": F.soundex,
    "space": lambda n: F.repeat(F.lit(" "), n),
    "word_count": lambda s: F.when(_trim(s) == "", 0).otherwise(F.size(F.split(_trim(s), r"\s+"))),
    "snake_case": lambda s: F.lower(F.regexp_replace(s, r"(?<!^)([A-Z])", "_$1")),
    "camel_case": lambda s: F.array_join(F.transform(F.split(F.lower(s), r"[^A-Za-z0-9]+"), lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), ""),
    "squeeze": lambda s: F.regexp_replace(s, r"\s+", " "),
    "count_char": lambda s, c: F.char_length(s) - F.char_length(F.replace(s, c, F.lit(""))),
    "concat_ws": lambda sep, *c: F.call_function("concat_ws", sep, *c),
    "octet_length": F.octet_length,
    "bit_length": F.bit_length,
    "format": F.printf,
    "pad": lambda s, n: F.concat(F.repeat(F.lit(" "), F.ceil((n - F.length(s)) / 2).cast("int")), s, F.repeat(F.lit(" "), F.floor((n - F.length(s)) / 2).cast("int"))),
    "center": lambda s, n: F.concat(F.repeat(F.lit(" "), F.floor((n - F.length(s)) / 2).cast("int")), s, F.repeat(F.lit(" "), F.ceil((n - F.length(s)) / 2).cast("int"))),
    "truncate_str": F.left,
    "escape_html": lambda s: _chain(s, HTML),
    "unescape_html": lambda s: _chain(s, [(b, a) for a, b in reversed(HTML)]),
    "escape_json": lambda s: _chain(s, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]),
    "escape_sql": lambda s: F.replace(s, F.lit("'"), F.lit("''")),
    "slug": lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-")),
    "swap_case": lambda s: F.translate(s, UPPER + UPPER.lower(), UPPER.lower() + UPPER),
    "is_alpha": lambda s: F.rlike(s, F.lit(r"^\p{L}+$")),
    "is_digit": lambda s: F.rlike(s, F.lit("^[0-9]+$")),
    "is_alnum": lambda s: F.rlike(s, F.lit(r"^[\p{L}\p{N}]+$")),
    "is_upper": lambda s: (s != "") & (s == F.upper(s)),
    "is_lower": lambda s: (s != "") & (s == F.lower(s)),
    "is_blank": lambda s: _trim(s) == "",
    "is_empty": lambda s: F.coalesce(s, F.lit("")) == "",
    "is_numeric": lambda s: s.try_cast("double").isNotNull(),
    "is_uuid": lambda s: F.rlike(s, F.lit(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
    "is_email": lambda s: F.rlike(s, F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")),
    "mask": lambda s, c: F.regexp_replace(s, F.lit(r"[\p{L}\p{N}]"), c),
    "btrim": F.btrim,
    "similar_to": lambda s, p: F.rlike(s, F.concat(F.lit("^(?s:"), _wildcards(p, "%", "_"), F.lit(")$"))),
    "glob": lambda s, p: F.rlike(s, F.concat(F.lit("^(?s:"), _wildcards(p, "*", "?"), F.lit(")$"))),
    "like": F.like,
    "ilike": F.ilike,
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: HTML's named characters.
HTML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def _chain(s: Column, pairs) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, folded over as many as the smaller number may take (Lame: its bits over log2 of the golden ratio,
    and one to swap); those after the end pass the pair on as it is."""
    a, b = F.abs(_long(a)), F.abs(_long(b))
    most = F.ceil(F.log2(F.least(a, b).cast("double") + 1) * 1.4405) + 2
    start = F.struct(a.alias("a"), b.alias("b"))
    return F.aggregate(F.sequence(F.lit(1), most.cast("int")), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))["a"]


def _scaled(x: Column, d: Column, how: Callable[[Column], Column]) -> Column:
    return F.signum(x) * how(F.abs(x) * F.pow(F.lit(10.0), d)) / F.pow(F.lit(10.0), d)


#: Bits of whole types, and the largest numbers of the others.
WHOLE = {"byte": 8, "tinyint": 8, "short": 16, "smallint": 16, "int": 32, "integer": 32, "long": 64, "bigint": 64}
REAL = {"float": 3.4028234663852886e38, "double": 1.7976931348623157e308}


def _bound(kind: Column | str, upper: bool) -> Column:
    """The least or largest value of a type by its name, as text of a number; null for other types."""
    table = {k: str((1 << (n - 1)) - 1 if upper else -(1 << (n - 1))) for k, n in WHOLE.items()} | {k: str(x if upper else -x) for k, x in REAL.items()}
    if isinstance(kind, str):
        found = table.get(kind.lower())
        return F.lit(None).cast("long") if found is None else F.lit(float(found) if kind.lower() in REAL else int(found))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(kind)).cast("double")


NUMBERS: dict[str, Builder] = {
    "abs": F.abs,
    "round": lambda x, d=None: _scaled(x, F.lit(0) if d is None else d, lambda v: F.floor(v + 0.5)),
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "round_half_even": lambda x, d=None: F.bround(x, F.lit(0) if d is None else d),
    "pg_size_bytes": lambda s: F.round(F.regexp_extract(s, r"([0-9.]+)", 1).try_cast("double") * F.when(F.lower(s).contains("tb"), 1 << 40).when(F.lower(s).contains("gb"), 1 << 30).when(F.lower(s).contains("mb"), 1 << 20).when(F.lower(s).contains("kb"), 1 << 10).otherwise(1)).cast("long"),
    "pg_size_pretty": lambda n: n.cast("string"),
    "isfinite": lambda x: F.isnotnull(x),
    "min_value": lambda t: _bound(t, False),
    "max_value": lambda t: _bound(t, True),
    "sqrt": F.sqrt,
    "pow": F.pow,
    "log": F.ln,
    "ln": F.ln,
    "log2": F.log2,
    "log10": F.log10,
    "exp": F.exp,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "atan2": F.atan2,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "cbrt": F.cbrt,
    "degrees": F.degrees,
    "radians": F.radians,
    "mod": lambda a, b: F.try_mod(a, b),
    "sign": lambda x: _long(F.signum(x)),
    "pi": lambda: F.pi(),
    "e": lambda: F.e(),
    "tau": lambda: F.lit(2 * math.pi),
    "infinity": lambda: F.lit(float("inf")),
    "nan": lambda: F.lit(float("nan")),
    "factorial": F.factorial,
    "gcd": _gcd,
    "lcm": lambda a, b: F.when((a == 0) | (b == 0), 0).otherwise(F.abs(F.try_divide(_long(a) * _long(b), _gcd(a, b)))).cast("long"),
    "bit_and": lambda a, b: a.bitwiseAND(b),
    "bit_or": lambda a, b: a.bitwiseOR(b),
    "bit_xor": lambda a, b: a.bitwiseXOR(b),
    "bit_not": F.bitwise_not,
    "bit_shift_left": lambda a, b: F.call_function("shiftleft", a, b),
    "bit_shift_right": lambda a, b: F.call_function("shiftright", a, b),
    "trunc": lambda x, d=None: _scaled(x, F.lit(0) if d is None else d, F.floor),
    "div": lambda a, b: F.call_function("div", a, F.nullif(b, F.lit(0))),
    "width_bucket": F.width_bucket,
    "clamp": lambda x, lo, hi: F.least(F.greatest(x, lo), hi),
    "lerp": lambda a, b, t: a + (b - a) * t,
    "map_range": lambda v, a, b, c, d: c + F.try_divide((v - a) * (d - c), b - a),
    "is_finite": lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")),
    "is_nan": F.isnan,
    "is_inf": lambda x: F.abs(x) == float("inf"),
    "fma": lambda x, y, z: x * y + z,
    "hypot": F.hypot,
    "copysign": lambda x, y: F.abs(x) * F.when(y < 0, -1.0).otherwise(1.0),
    "next_power_of_two": lambda n: F.when(n <= 1, 1).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(_long(n) - 1)))),
    "log_base": lambda b, x: F.ln(x) / F.ln(b),
    "square": lambda x: x * x,
    "negate": F.negative,
    "reciprocal": lambda x: F.try_divide(F.lit(1.0), x),
    "is_positive": lambda x: x > 0,
    "is_negative": lambda x: x < 0,
    "is_zero": lambda x: x == 0,
    "is_even": lambda n: F.pmod(n, F.lit(2)) == 0,
    "is_odd": lambda n: F.pmod(n, F.lit(2)) != 0,
    "between": lambda x, a, b: x.between(a, b),
    "bit_count": F.bit_count,
    "leading_zeros": lambda n: F.when(n < 0, 0).when(n == 0, 64).otherwise(64 - F.length(F.bin(n))),
    "trailing_zeros": lambda n: F.when(n == 0, 64).otherwise(F.length(F.bin(n)) - F.length(F.rtrim(F.bin(n), F.lit("0")))),
    "abs_diff": lambda a, b: F.abs(a - b),
    "zeroifnull": F.zeroifnull,
    "nullif_zero": F.nullifzero,
    "safe_divide": F.try_divide,
    "safe_subtract": lambda a, b: F.when(F.abs(a - b) != float("inf"), a - b),
    "safe_multiply": lambda a, b: F.when(F.abs(a * b) != float("inf"), a * b),
    "safe_negate": F.negative,
    "to_oct": lambda n: F.conv(n.cast("string"), 10, 8),
    "to_bin": F.bin,
    "format_number": lambda x, d=None: F.format_number(x, 2 if d is None else d),
}


def _week(ts: Column) -> Column:
    """Week of the year from Mondays, the first week holding January 1."""
    january = F.weekday(F.make_date(F.year(ts), F.lit(1), F.lit(1))) + 1
    return F.least(F.greatest(F.floor((F.dayofyear(ts) + january - 2) / 7) + 1, F.lit(1)), F.lit(53)).cast("int")


DATES: dict[str, Builder] = {
    "to_timestamp": lambda x: _ntz(F.call_function("div", _long(x) - F.pmod(_long(x), F.lit(1000)), F.lit(1000))),
    "extract_year": F.year,
    "extract_month": F.month,
    "extract_day": F.dayofmonth,
    "extract_hour": F.hour,
    "extract_minute": F.minute,
    "extract_second": lambda t: F.second(t),
    "extract_quarter": F.quarter,
    "extract_week": _week,
    "extract_day_of_week": lambda t: F.dayofweek(t) - 1,
    "extract_day_of_year": F.dayofyear,
    "epoch_nanos": lambda t: _us(t) * 1000,
    "epoch_micros": _us,
    "epoch_millis": lambda t: F.floor(_us(t) / 1000),
    "epoch_seconds": lambda t: F.floor(_us(t) / 1_000_000),
    "age": lambda a, b: (_us(b) - _us(a)) * 1000,
    "make_timestamp": F.make_timestamp,
    "make_date": F.make_date,
    "days_in_month_fn": lambda t: F.dayofmonth(F.last_day(t)),
    "is_leap_year_fn": lambda t: F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31))) == 366,
    "first_of_month": lambda t: F.date_trunc("month", t).cast("timestamp_ntz"),
    "last_of_month": lambda t: F.last_day(t).cast("timestamp_ntz"),
    "next_day": lambda t, d: F.call_function("next_day", t, d),
    "months_between": lambda a, b: (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b),
    "years_between": lambda a, b: F.year(a) - F.year(b),
    "is_weekend": lambda t: F.dayofweek(t).isin(1, 7),
    "is_business_day": lambda t: ~F.dayofweek(t).isin(1, 7),
    "start_of_year": lambda t: F.date_trunc("year", t).cast("timestamp_ntz"),
    "end_of_year": lambda t: F.make_date(F.year(t), F.lit(12), F.lit(31)),
    "start_of_quarter": lambda t: F.date_trunc("quarter", t).cast("timestamp_ntz"),
    "start_of_week": lambda t: F.date_trunc("week", t).cast("timestamp_ntz"),
    "date_bin": lambda us, t, o: _ntz(_us(o) + F.floor((_us(t) - _us(o)) / us) * us),
    "time_bucket": lambda us, t: _ntz(F.floor(_us(t) / us) * us),
    "make_time": lambda h, m, s: (_long(h) * 3600 + m * 60 + s) * 1_000_000_000,
    "extract_epoch": lambda t: _us(t) / 1e6,
    "extract_microsecond": lambda t: F.pmod(_us(t), F.lit(1_000_000)),
    "extract_millisecond": lambda t: F.floor(F.pmod(_us(t), F.lit(1_000_000)) / 1000),
    "extract_timezone": lambda t: F.lit("UTC"),
    "overlap": lambda a, b, c, d: (a < d) & (c < b),
    "to_char": lambda t, f="yyyy-MM-dd HH:mm:ss": F.date_format(t, f),
    "date_part": lambda u, t: F.call_function("date_part", u, t),
    "now": lambda: F.current_timestamp(),
    "yesterday": lambda: F.current_timestamp() - F.expr("INTERVAL 1 DAY"),
    "tomorrow": lambda: F.current_timestamp() + F.expr("INTERVAL 1 DAY"),
    "generate_timestamp_series": F.sequence,
    "try_cast_timestamp": F.try_to_timestamp,
    "try_cast_date": lambda s: s.try_cast("date"),
}

def _kind(x: Column, names: dict[str, str]) -> Column:
    """The name of a column's type in another system, else Spark's own."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), F.typeof(x)), F.typeof(x))


def _setting(name) -> Column:
    """A session setting's value when the query is built."""
    from pyspark.sql import SparkSession

    return F.lit(SparkSession.active().conf.get(name if isinstance(name, str) else _literal_text(name), None))


def _literal_text(name: Column) -> str:
    return str(name._jc.toString())


LOGIC: dict[str, Builder] = {
    "coalesce": F.coalesce,
    "nullif": F.nullif,
    "greatest": lambda *c: F.greatest(*c) if len(c) > 1 else c[0],
    "least": lambda *c: F.least(*c) if len(c) > 1 else c[0],
    "if_null": F.ifnull,
    "nvl2": F.nvl2,
    "iif": lambda c, a, b: F.when(c, a).otherwise(b),
    "nullifempty": lambda s: F.nullif(s, F.lit("")),
    "nanvl": F.nanvl,
    "is_null": F.isnull,
    "is_not_null": F.isnotnull,
    "decode_fn": lambda *c: F.call_function("decode", *c),
    "typeof": F.typeof,
    "to_number": lambda s: s.try_cast("double"),
    "try_cast_int": lambda s: s.try_cast("long"),
    "try_cast_float": lambda s: s.try_cast("double"),
    "assert": lambda c, m: F.assert_true(c, m),
    "raise_error": F.raise_error,
    "cast_int": lambda x: x.cast("long"),
    "cast_float": lambda x: x.cast("double"),
    "cast_str": lambda x: x.cast("string"),
    "cast_bool": lambda x: x.cast("boolean"),
    "not_bool": lambda a: ~a,
    "and_bool_bool": lambda a, b: a & b,
    "or_bool_bool": lambda a, b: a | b,
    "random": lambda: F.rand(),
    "rnd_int": lambda a, b: F.floor(F.rand() * (b - a)) + a,
    "rnd_boolean": lambda: F.rand() < 0.5,
    "uuid": lambda: F.uuid(),
    "rnd_float": lambda: F.rand().cast("float"),
    "rnd_str": lambda *c: F.element_at(F.array(*c), (F.floor(F.rand() * len(c)) + 1).cast("int")) if len(c) > 1 else F.randstr(c[0] if c else F.lit(8)),
    "rnd_char": lambda: F.chr((F.floor(F.rand() * 26) + 65).cast("long")),
    "rnd_long": lambda lo=None, hi=None: F.xxhash64(F.uuid()) if lo is None else F.floor(F.rand() * (hi - lo)) + lo,
    "rnd_byte": lambda: F.floor(F.rand() * 256 - 128).cast("tinyint"),
    "rnd_short": lambda: F.floor(F.rand() * 65536 - 32768).cast("smallint"),
    "rnd_long256": lambda: F.sha2(F.uuid(), 256),
    "rnd_bin": lambda: F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))),
    "rnd_ipv4": lambda: geo.dotted(F.floor(F.rand() * float(1 << 32)).cast("long")),
    "cast_to_int": lambda x: x.cast("double").cast("long"),
    "current_setting": lambda name: _setting(name),
    "pg_typeof": lambda x: _kind(x, {"bigint": "bigint", "int": "bigint", "smallint": "bigint", "tinyint": "bigint", "double": "double precision", "float": "double precision", "string": "text", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "void": "void"}),
    "typecast": lambda x: _kind(x, {"bigint": "i64", "int": "i64", "smallint": "i64", "tinyint": "i64", "double": "f64", "float": "f64", "string": "string", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "void": "null"}),
    "version": lambda: F.lit("tidemark"),
    "current_user": lambda: F.current_user(),
    "current_schema": lambda: F.current_database(),
}

ARRAYS: dict[str, Builder] = {
    "from_text_array": lambda s: F.split(s, ","),
    "array_length": F.size,
    "array_contains": F.array_contains,
    "array_position": F.array_position,
    "array_remove": F.array_remove,
    "array_append": F.array_append,
    "array_prepend": F.array_prepend,
    "array_cat": F.concat,
    "array_unique": F.array_distinct,
    "array_sort": lambda a: F.array_sort(a),
    "array_reverse": F.reverse,
    "array_slice": lambda a, s, e: F.slice(a, s, e - s + 1),
    "array_sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x),
    "array_avg": lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a)),
    "array_min": F.array_min,
    "array_max": F.array_max,
    "array_join": lambda a, d: F.call_function("array_join", a, d),
    "array_fill": F.array_repeat,
    "array_dims": lambda a: F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")),
    "array_ndims": lambda a: F.lit(1),
    "array_upper": lambda a: F.size(a),
    "array_lower": lambda a: F.when(F.size(a) == 0, 0).otherwise(1),
    "array_intersect": lambda a, b: F.filter(a, lambda x: F.array_contains(b, x)),
    "array_except": lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x)),
    "array_overlap": F.arrays_overlap,
    "unnest": F.explode,
    "array_to_json": F.to_json,
    "string_to_array": lambda s, d: F.call_function("split", s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))),
}

def _signed(side: Column, x: Column) -> Column:
    return F.when(F.lower(side).isin("buy", "long"), x).otherwise(-x)


def _levels(book: Column) -> Column:
    return F.transform(F.from_json(book, "array<array<double>>"), lambda level: F.get(level, F.lit(0)))


MARKET: dict[str, Builder] = {
    "tick_delta_encode": market.ticks_to_text,
    "tick_delta_decode": market.ticks_from_text,
    "vwap": lambda pv, v: F.try_divide(pv, v),
    "best_bid": lambda b: F.array_max(_levels(b)),
    "best_ask": lambda a: F.array_min(_levels(a)),
    "spread": lambda b, a: F.array_min(_levels(a)) - F.array_max(_levels(b)),
    "mid_price": lambda b, a: (F.array_min(_levels(a)) + F.array_max(_levels(b))) / 2,
    "balance_available": lambda t, l: t - l,
    "margin_ratio": lambda v, m: F.try_divide(v, m),
    "liquidation_price": lambda entry, leverage, side: entry * (1 - _signed(side, F.try_divide(F.lit(1.0), leverage))),
    "unrealized_pnl": lambda entry, now, size, side: _signed(side, (now - entry) * size),
    "position_value": lambda p, s: p * s,
    "margin_required": lambda p, s, l: F.try_divide(p * s, l),
    "funding_payment": lambda s, r, m: s * r * m,
    "fee_amount": lambda p, q, r: p * q * r,
    "taker_buy_volume": lambda q, side: F.when(F.lower(side) == "buy", q).otherwise(0.0),
    "taker_sell_volume": lambda q, side: F.when(F.lower(side) == "sell", q).otherwise(0.0),
    "quote_volume": lambda p, q: p * q,
    "trade_count": lambda: F.lit(1),
    "delta": lambda q, side: _signed(side, q),
    "delta_pct": lambda b, s: F.try_divide(b - s, b + s) * 100,
    "order_fill_pct": lambda f, t: F.try_divide(f, t) * 100,
    "is_fully_filled": lambda f, t: f >= t,
    "remaining_qty": lambda t, f: t - f,
    "effective_price": lambda c, q: F.try_divide(c, q),
    "slippage": lambda a, e: F.try_divide(a - e, e) * 100,
}

ALIASES: dict[str, list[str]] = {
    "length": ["len", "string_length", "char_length"],
    "upper": ["to_uppercase"],
    "lower": ["to_lowercase"],
    "substring": ["substr"],
    "concat": ["str_concat", "string_concat"],
    "pow": ["power"],
    "ceil": ["ceiling", "round_up"],
    "floor": ["round_down"],
    "mod": ["remainder", "modulo"],
    "sign": ["signum"],
    "if_null": ["ifnull", "nvl"],
    "md5": ["digest", "hash_md5"],
    "sha256": ["hash_sha256"],
    "position": ["str_pos"],
    "initcap": ["title_case"],
    "chr": ["char"],
    "trunc": ["truncate"],
    "extract_year": ["year_of"],
    "extract_month": ["month_of_year"],
    "extract_day": ["day_of_month"],
    "extract_hour": ["hour_of_day"],
    "extract_minute": ["minute_of_hour"],
    "extract_second": ["second_of_minute"],
    "extract_week": ["week_of_year"],
    "extract_quarter": ["quarter_of_year"],
    "extract_day_of_week": ["day_of_week"],
    "extract_day_of_year": ["day_of_year"],
    "date_diff": ["datediff", "timestamp_diff"],
    "timestamp_add": ["date_add", "dateadd"],
    "epoch_seconds": ["unix_timestamp", "to_unix_timestamp", "nanos_to_secs"],
    "epoch_millis": ["nanos_to_millis"],
    "epoch_micros": ["nanos_to_micros"],
    "hex": ["to_hex"],
    "unhex": ["from_hex"],
    "iif": ["case_when"],
    "decode_fn": ["switch"],
    "bit_count": ["popcount"],
    "octet_length": ["byte_length"],
    "array_unique": ["array_distinct"],
    "cast_int": ["to_int", "to_long"],
    "cast_float": ["to_float", "to_double"],
    "cast_str": ["to_str", "to_string"],
    "encode": ["to_base64"],
    "decode": ["from_base64"],
    "is_null": ["is_null_fn"],
    "is_not_null": ["not_null"],
    "random": ["rand", "rnd_double"],
    "uuid": ["uuid4", "newid", "rnd_uuid4"],
    "now": ["current_timestamp", "systimestamp", "now_utc"],
    "ascii": ["unicode", "char_code"],
    "overlap": ["intervals_overlap"],
    "date_trunc": ["timestamp_floor"],
}
ALIASES |= {
    "hash": ["hash_code"],
    "concat": [*ALIASES["concat"], "string_agg_fn"],
    "abs": ["abs_int", "abs_long", "abs_double", "abs_float"],
    "floor": [*ALIASES["floor"], "floor_int", "floor_double"],
    "ceil": [*ALIASES["ceil"], "ceiling_fn", "ceil_int", "ceil_double"],
    "now": [*ALIASES["now"], "sysdate", "current_date", "localtime", "localtimestamp", "now_fn", "current_time", "today", "localtimestamp_ex", "now_utc_ex", "utc_timestamp"],
    "to_timestamp": ["from_unixtime", "str_to_timestamp", "parse_timestamp", "date_parse", "timestamp_parse", "cast_timestamp", "cast_to_timestamp", "timestamp_in", "timestamp_out"],
    "coalesce": ["coalesce_str"],
    "greatest": ["max_of", "greatest_fn"],
    "least": ["min_of", "least_fn"],
    "cast_int": [*ALIASES["cast_int"], "to_short", "to_byte", "int4_in", "int4_out", "int8_in", "int8_out"],
    "cast_float": [*ALIASES["cast_float"], "cast_to_float", "numeric_in", "numeric_out", "float4_in", "float4_out", "float8_in", "float8_out"],
    "cast_str": [*ALIASES["cast_str"], "to_symbol", "symbol", "cast_to_str", "text_in", "text_out", "to_char_int", "to_char_interval"],
    "cast_bool": ["to_boolean", "to_bool", "bool_in", "bool_out"],
    "to_date": ["to_pg_date"],
    "date_format": ["to_str_timestamp", "strftime", "timestamp_to_str", "format_timestamp", "date_to_str"],
    "first_of_month": ["first_day_of_month"],
    "last_of_month": ["last_day_of_month"],
    "start_of_year": ["first_day_of_year"],
    "end_of_year": ["last_day_of_year"],
    "start_of_quarter": ["first_day_of_quarter"],
    "start_of_week": ["first_day_of_week"],
    "rnd_int": ["random_int"],
    "rnd_str": ["rnd_symbol"],
    "rnd_timestamp": ["rnd_date"],
    "uuid": [*ALIASES["uuid"], "generate_uid"],
    "to_timezone": ["from_utc"],
    "array_join": ["array_to_string"],
    "pg_typeof": ["pg_type_name"],
    "try_cast_int": ["safe_cast_int", "try_cast_int_ex"],
    "try_cast_float": ["safe_cast_float", "try_cast_float_ex"],
    "string_to_array": ["string_to_array_ex"],
    "array_length": ["cardinality"],
    "time_bucket": ["time_bucket_gapfill"],
    "hex": [*ALIASES["hex"], "to_hex_ex"],
    "unhex": [*ALIASES["unhex"], "from_hex_ex"],
    "decode_fn": [*ALIASES["decode_fn"], "decode_ex"],
    "nullifempty": ["nullif_empty"],
    "zeroifnull": ["zeroifnull_ex"],
    "if_null": [*ALIASES["if_null"], "ifnull_ex", "nvl_ex"],
    "nvl2": ["nvl2_ex"],
    "raise_error": ["error"],
    "vwap": ["ohlcv_vwap"],
    "ohlcv_bar_align": ["bar_align"],
    "rnd_geohash_ex": [],
    "not_bool": ["not_boolean"],
    "and_bool_bool": ["and_boolean_boolean"],
    "or_bool_bool": ["or_boolean_boolean"],
    "format_number": ["to_char_double"],
    "to_number": ["to_number_ex"],
}
FUNCTIONS: dict[str, Builder] = {**constants.FUNCTIONS, **STRINGS, **NUMBERS, **DATES, **LOGIC, **ARRAYS, **MARKET, **geo.FUNCTIONS, **hashing.FUNCTIONS, **documents.FUNCTIONS, **moments.FUNCTIONS}
FUNCTIONS |= {alias: FUNCTIONS[name] for name, aliases in ALIASES.items() for alias in aliases}

TYPES = {"boolean": "boolean", "byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double", "str": "string", "varchar": "string", "symbol": "string", "timestamp": "timestamp_ntz", "date": "date", "uuid": "string", "ipv4": "string", "geohash": "string"}
def _exact_sum(x: Column) -> Column:
    """A sum whose rounding errors don't pile up: each value is split into a multiple of 2**-20 and a rest, which are
    summed apart as decimals, exactly and in any order. Where that overflows or a value isn't finite: a plain sum."""
    fits = F.abs(x) < float(1 << 42)
    coarse = F.floor(x * float(1 << 20)) / float(1 << 20)
    whole, rest = F.when(fits, coarse).cast("decimal(38,20)"), F.when(fits, x - coarse).cast("decimal(38,30)")
    exact = F.try_sum(whole).cast("double") + F.try_sum(rest).cast("double")
    return F.when(F.count(x) == F.count_if(fits), F.coalesce(exact, F.sum(x))).otherwise(F.sum(x))


AGGREGATES: dict[str, Builder] = {
    "sum": F.sum,
    "ksum": _exact_sum,
    "nsum": _exact_sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "count_distinct": F.count_distinct,
    "stddev_samp": F.stddev_samp,
    "stddev_pop": F.stddev_pop,
    "var_samp": F.var_samp,
    "var_pop": F.var_pop,
    "stddev": F.stddev_pop,
    "variance": F.var_pop,
    "median": F.median,
    "mode": F.mode,
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
    "string_agg": lambda x: F.listagg(x, F.lit(",")),
    "array_agg": F.array_agg,
    "approx_count_distinct": F.approx_count_distinct,
    "first": F.first,
    "last": F.last,
    "first_not_null": lambda x: F.first(x, ignorenulls=True),
    "last_not_null": lambda x: F.last(x, ignorenulls=True),
}
OPERATORS: dict[str, Builder] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "neg": lambda a: -a,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": F.try_divide,
    "mod": F.try_mod,
}


def typed(name: str) -> Builder | None:
    """cast_<a>_to_<b>, <aggregate>_<type> and <operator>_<type>[_<type>], cast as their names say."""
    if name.startswith("cast_") and "_to_" in name:
        a, _, b = name[5:].partition("_to_")
        if a in TYPES and b in TYPES:
            return lambda x: x.cast(TYPES[a]).try_cast(TYPES[b])
    head, _, kind = name.rpartition("_")
    if head in AGGREGATES and kind in TYPES:
        return lambda x: AGGREGATES[head](x.cast(TYPES[kind]))
    parts = name.split("_")
    if parts[0] in OPERATORS and len(parts) > 1 and all(p in TYPES for p in parts[1:]):
        if parts[0] == "div" and all(p in ("int", "long", "short", "byte") for p in parts[1:]):
            return lambda a, b: NUMBERS["div"](a, b)
        return lambda *c: OPERATORS[parts[0]](*[x.cast(TYPES[p]) for x, p in zip(c, parts[1:], strict=False)])
    return None


#: Names of aggregates and window functions that have no rule of their own.
WHOLE_COLUMN: dict[str, Builder] = {
    "corr": F.corr,
    "covar_pop": F.covar_pop,
    "covar_samp": F.covar_samp,
    "regr_slope": F.regr_slope,
    "regr_intercept": F.regr_intercept,
    "regr_r2": F.regr_r2,
    "regr_sxx": F.regr_sxx,
    "regr_syy": F.regr_syy,
    "regr_sxy": F.regr_sxy,
    "regr_avgx": F.regr_avgx,
    "regr_avgy": F.regr_avgy,
    "regr_count": F.regr_count,
    "string_agg_distinct": lambda s, d: F.listagg_distinct(s, d),
    "row_number": F.row_number,
    "rank": F.rank,
    "dense_rank": F.dense_rank,
    "percent_rank": F.percent_rank,
    "cume_dist": F.cume_dist,
    "ntile": lambda n: F.ntile(n),
    "lag": lambda c, n=1, d=None: F.lag(c, n, d),
    "lead": lambda c, n=1, d=None: F.lead(c, n, d),
    "first_value": F.first_value,
    "last_value": F.last_value,
    "nth_value": lambda c, n: F.nth_value(c, n),
    "localtime_ex": lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"),
}


def find(name: str) -> Builder:
    name = name.lower()
    found = FUNCTIONS.get(name) or AGGREGATES.get(name) or WHOLE_COLUMN.get(name) or typed(name)
    if found is None:
        raise KeyError(f"no function {name}")
    return found


#: Functions whose arguments of these places are plain values: a number of bits or digits, a unit, an offset.
PLAIN = {"ntile": (0,), "lag": (1, 2), "lead": (1, 2), "nth_value": (1,), "date_diff": (0,), "timestamp_add": (0,), "string_agg_distinct": (1,), "min_value": (0,), "max_value": (0,), "current_setting": (0,), "make_geohash": (2,), "make_geohash_str": (2,)}


def call(name: str, *columns) -> Column:
    """A function by name over columns; plain Python values of column arguments become literals."""
    keep = PLAIN.get(name.lower(), ())
    return find(name)(*[c if isinstance(c, Column) or i in keep else F.lit(c) for i, c in enumerate(columns)])
