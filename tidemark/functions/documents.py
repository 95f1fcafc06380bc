"""Functions over JSON text, ranges as text, and bytes of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_kind(text: Column) -> Column:
    """null, boolean, string, array, object or number, by how the text begins."""
    s = F.trim(text)
    return (
        F.when((s == "") | (s == "null"), "null")
        .when(s.isin("true", "false"), "boolean")
        .when(s.startswith('"'), "string")
        .when(s.startswith("["), "array")
        .when(s.startswith("{"), "object")
        .when(s.try_cast("double").isNotNull(), "number")
        .otherwise("string")
    )


def _quoted(x: Column) -> Column:
    return F.to_json(F.array(x.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(x.cast("string")))) - 2)


def build_object(*pairs: Column) -> Column:
    """An object of names and values, each value as text."""
    members = [F.concat(_quoted(k), F.lit(":"), F.coalesce(_quoted(v), F.lit("null"))) for k, v in zip(pairs[::2], pairs[1::2], strict=False)]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def build_array(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(_quoted(x), F.lit("null")) for x in items]), F.lit("]"))


def strip_nulls(text: Column) -> Column:
    """An object without its members that are null, deeper ones too."""
    member = r'"(?:[^"\\]|\\.)*"\s*:\s*null'
    one = F.regexp_replace(text, rf",\s*{member}(?=\s*[,}}])", "")
    return F.regexp_replace(F.regexp_replace(one, rf"\{{\s*{member}\s*,\s*", "{"), rf"\{{\s*{member}\s*\}}", "{}")


def path_of(*keys: Column) -> Column:
    """$.a[0].b from names and numbers."""
    step = lambda k: F.when(k.cast("string").rlike(r"^\d+$"), F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("['"), k.cast("string"), F.lit("']")))
    return F.concat(F.lit("$"), *[step(k) for k in keys])


def extract_path(text: Column, *keys: Column) -> Column:
    return F.call_function("get_json_object", text, path_of(*keys))


def elements(text: Column) -> Column:
    """The elements of an array as JSON text, one a row. Parsed as variants, so that elements may differ in kind."""
    return F.explode(F.transform(F.from_json(text, "array<variant>"), lambda v: F.to_json(v)))


def element_texts(text: Column) -> Column:
    return F.explode(F.from_json(text, "array<string>"))


def members(text: Column) -> Column:
    """The members of an object, one a row: a struct of key and value."""
    return F.explode(F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def set_member(text: Column, key: Column, value: Column) -> Column:
    """The object with a member set to a text."""
    old = F.map_filter(F.from_json(text, "map<string,string>"), lambda k, _: k != key)
    return F.to_json(F.map_concat(old, F.create_map(key, value.cast("string"))))


def delete_member(text: Column, key: Column) -> Column:
    return F.to_json(F.map_filter(F.from_json(text, "map<string,string>"), lambda k, _: k != key))


def merged(a: Column, b: Column) -> Column:
    """Both objects' members, those of the second first in rank."""
    right = F.from_json(b, "map<string,string>")
    left = F.map_filter(F.from_json(a, "map<string,string>"), lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.to_json(F.map_concat(left, right))


def has_key(text: Column, key: Column) -> Column:
    return F.array_contains(F.json_object_keys(text), key)


def _all_keys(text: Column, keys: Column) -> Column:
    return F.size(F.array_except(keys, F.json_object_keys(text))) == 0


def span(low: Column, high: Column) -> Column:
    return F.concat(F.lit("["), low.cast("string"), F.lit(","), high.cast("string"), F.lit(")"))


def _left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x.cast("long"), n.cast("int"))


def set_bit(x: Column, n: Column, bit: Column | None = None) -> Column:
    one = _left(F.lit(1), n)
    bit = F.lit(1) if bit is None else bit
    return F.when((n < 0) | (n > 63), x.cast("long")).when(bit != 0, x.cast("long").bitwiseOR(one)).otherwise(x.cast("long").bitwiseAND(F.bitwise_not(one)))


def get_byte(x: Column, n: Column) -> Column:
    return F.when((n < 0) | (n > 7), F.lit(0).cast("long")).otherwise(F.call_function("shiftright", x.cast("long"), (n * 8).cast("int")).bitwiseAND(F.lit(255).cast("long")))


def set_byte(x: Column, n: Column, value: Column | None = None) -> Column:
    value = F.lit(0) if value is None else value
    kept = x.cast("long").bitwiseAND(F.bitwise_not(_left(F.lit(255), n * 8)))
    return F.when((n < 0) | (n > 7), x.cast("long")).otherwise(kept.bitwiseOR(_left(value.cast("long").bitwiseAND(F.lit(255).cast("long")), n * 8)))


FUNCTIONS = {
    "json_extract": lambda s, p: F.call_function("get_json_object", s, p),
    "json_array_length": F.json_array_length,
    "json_object_keys": F.json_object_keys,
    "json_typeof": json_kind,
    "json_strip_nulls": strip_nulls,
    "json_build_object": build_object,
    "json_build_array": build_array,
    "json_object": build_object,
    "json_agg": lambda c: F.to_json(F.collect_list(c)),
    "json_extract_path": extract_path,
    "json_extract_path_text": extract_path,
    "json_array_elements": elements,
    "json_array_elements_text": element_texts,
    "json_each": members,
    "json_each_text": members,
    "json_to_array": lambda s: F.from_json(s, "array<string>"),
    "jsonb_set": set_member,
    "jsonb_insert": set_member,
    "jsonb_delete_path": delete_member,
    "jsonb_concat": merged,
    "jsonb_pretty": lambda s: F.to_json(F.parse_json(s), {"pretty": "true"}),
    "jsonb_exists": has_key,
    "jsonb_exists_any": lambda s, keys: F.arrays_overlap(F.json_object_keys(s), keys),
    "jsonb_exists_all": _all_keys,
    "to_json": F.to_json,
    "row_to_json": F.to_json,
    "to_jsonb": F.to_json,
    "int4range": span,
    "get_bit": F.getbit,
    "set_bit": set_bit,
    "get_byte": get_byte,
    "set_byte": set_byte,
}
FUNCTIONS |= {f"jsonb{name[4:]}": builder for name, builder in FUNCTIONS.items() if name.startswith("json_") and name not in ("json_extract", "json_to_array")}
FUNCTIONS |= {name: span for name in ("int8range", "numrange", "tsrange", "tstzrange", "daterange")}
