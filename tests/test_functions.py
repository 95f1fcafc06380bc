"""Every function by name: a value for each that has one, and that each of the others can be called."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import constants, moments
from tidemark.functions.library import AGGREGATES, ALIASES, FUNCTIONS, TYPES, WHOLE_COLUMN, call, find

T = dt.datetime(2024, 2, 29, 13, 45, 30, 123456)
D = dt.datetime
NOW = object()  # any value but null
#: (name, arguments, value)
CASES = [
    ("length", ["héllo"], 5), ("upper", ["aé"], "AÉ"), ("lower", ["AÉ"], "aé"), ("trim", [" \ta \n"], "a"), ("ltrim", ["  a "], "a "), ("rtrim", [" a  "], " a"),
    ("substring", ["hello", 2, 3], "ell"), ("substring", ["hello", 0, 2], "he"), ("concat", ["a", None, "b"], "ab"), ("replace", ["aXbX", "X", "-"], "a-b-"), ("starts_with", ["abc", "ab"], True), ("ends_with", ["abc", "bc"], True),
    ("contains", ["abc", "b"], True), ("reverse", ["abc"], "cba"), ("repeat", ["ab", 3], "ababab"), ("left", ["hello", 2], "he"), ("right", ["hello", 2], "lo"), ("lpad", ["7", 3, "0"], "007"), ("rpad", ["7", 3, "0"], "700"),
    ("split_part", ["a,b,c", ",", 2], "b"), ("split_part", ["a,b,c", ",", 9], ""), ("regexp_match", ["abc1", "[0-9]"], True), ("regexp_match_ci", ["ABC", "b"], True), ("regexp_replace", ["a1b2", "[0-9]", ""], "ab"), ("regexp_count", ["a1b2", "[0-9]"], 2),
    ("regexp_extract", ["ab12", "[0-9]+"], "12"), ("regexp_split_to_array", ["a1b2c", "[0-9]"], ["a", "b", "c"]), ("regexp_matches", ["a1b22", "[0-9]+"], ["1", "22"]), ("md5", ["a"], "0cc175b9c0f1b6a831c399e269772661"), ("sha256", [""], "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
    ("position", ["l", "hello"], 3), ("overlay", ["hello", "XX", 2, 2], "hXXlo"), ("translate", ["abc", "ab", "xy"], "xyc"), ("initcap", ["hello WORLD-x"], "Hello World-X"), ("encode", ["abc"], "YWJj"), ("decode", ["YWJj"], "abc"), ("quote_ident", ['a"b'], '"a""b"'), ("quote_literal", ["a'b"], "'a''b'"),
    ("ascii", ["A"], 65), ("chr", [65], "A"), ("char_at", ["hello", 1], "h"), ("char_at", ["hello", 9], None), ("hex", [255], "ff"), ("unhex", ["ff"], 255), ("url_encode", ["a b"], "a%20b"), ("url_decode", ["a%20b"], "a b"), ("strcmp", ["a", "b"], -1), ("soundex", ["Robert"], "R163"),
    ("space", [3], "   "), ("word_count", [" a b  c "], 3), ("word_count", [" "], 0), ("snake_case", ["fooBar"], "foo_bar"), ("camel_case", ["foo_bar baz"], "fooBarBaz"), ("squeeze", ["a  b\t c"], "a b c"), ("count_char", ["banana", "a"], 3), ("concat_ws", ["-", "a", "b"], "a-b"),
    ("octet_length", ["é"], 2), ("bit_length", ["a"], 8), ("format", ["%s-%d", "a", 5], "a-5"), ("pad", ["a", 4], "  a "), ("center", ["a", 4], " a  "), ("truncate_str", ["hello", 3], "hel"), ("escape_html", ["<a&'\">"], "&lt;a&amp;&#39;&quot;&gt;"), ("unescape_html", ["&lt;a&amp;&gt;"], "<a&>"),
    ("escape_json", ['a"b\n'], 'a\\"b\\n'), ("escape_sql", ["a'b"], "a''b"), ("slug", ["Hello, World!"], "hello-world"), ("swap_case", ["aBc"], "AbC"), ("is_alpha", ["abc"], True), ("is_digit", ["12a"], False), ("is_alnum", ["a1"], True), ("is_upper", ["AB"], True), ("is_lower", ["aB"], False), ("is_blank", [" "], True),
    ("is_empty", [None], True), ("is_numeric", ["1.5"], True), ("is_uuid", ["123e4567-e89b-12d3-a456-426614174000"], True), ("is_email", ["a@b.co"], True), ("mask", ["ab-1", "*"], "**-*"), ("btrim", ["  a "], "a"), ("similar_to", ["axb", "a.b"], False), ("similar_to", ["abc", "a%c"], True), ("similar_to", ["abc", "a_c"], True),
    ("glob", ["a+b", "a+b"], True), ("glob", ["abc", "a*c"], True), ("glob", ["a.c", "a?c"], True), ("glob", ["abc", "a.c"], False), ("like", ["abc", "a%"], True), ("ilike", ["ABC", "a%"], True), ("title_case_ex", ["heLLo woRLD_foo-bar"], "Hello World_Foo-Bar"), ("wrap", ["abcdef", 2], "ab\ncd\nef"), ("wrap", ["abc", 0], "abc"),
    ("normalize", ["a"], "a"), ("ltrim_chars", ["xxa", "x"], "a"), ("rtrim_chars", ["axx", "x"], "a"), ("sizeof", ["héé"], 5), ("to_tsvector", ["a"], "a"),
    ("abs", [-2.5], 2.5), ("round", [2.5], 3.0), ("round", [-2.5], -3.0), ("round", [1.25, 1], 1.3), ("round_half_even", [2.5], 2.0), ("floor", [1.7], 1.0), ("ceil", [1.2], 2.0), ("sqrt", [9.0], 3.0), ("pow", [2.0, 10.0], 1024.0), ("log", [math.e], 1.0), ("ln", [1.0], 0.0), ("log2", [8.0], 3.0), ("log10", [1000.0], 3.0), ("exp", [0.0], 1.0),
    ("sin", [0.0], 0.0), ("cos", [0.0], 1.0), ("tan", [0.0], 0.0), ("asin", [1.0], math.pi / 2), ("acos", [1.0], 0.0), ("atan", [1.0], math.pi / 4), ("atan2", [1.0, 1.0], math.pi / 4), ("sinh", [0.0], 0.0), ("cosh", [0.0], 1.0), ("tanh", [0.0], 0.0), ("cbrt", [27.0], 3.0), ("degrees", [math.pi], 180.0), ("radians", [180.0], math.pi),
    ("mod", [7, 3], 1), ("mod", [7, 0], None), ("sign", [-3.5], -1), ("pi", [], math.pi), ("e", [], math.e), ("tau", [], 2 * math.pi), ("infinity", [], math.inf), ("factorial", [5], 120), ("gcd", [12, 18], 6), ("lcm", [4, 6], 12), ("bit_and", [6, 3], 2), ("bit_or", [6, 3], 7), ("bit_xor", [6, 3], 5), ("bit_not", [0], -1),
    ("bit_shift_left", [1, 4], 16), ("bit_shift_right", [16, 4], 1), ("trunc", [-1.7], -1.0), ("div", [7, 2], 3), ("div", [7, 0], None), ("width_bucket", [5.0, 0.0, 10.0, 5], 3), ("clamp", [15, 0, 10], 10), ("lerp", [0.0, 10.0, 0.5], 5.0), ("map_range", [5.0, 0.0, 10.0, 0.0, 100.0], 50.0), ("is_finite", [1.0], True), ("is_nan", [math.nan], True),
    ("is_inf", [math.inf], True), ("fma", [2.0, 3.0, 4.0], 10.0), ("hypot", [3.0, 4.0], 5.0), ("copysign", [3.0, -1.0], -3.0), ("next_power_of_two", [5], 8), ("log_base", [2.0, 8.0], 3.0), ("square", [3], 9), ("negate", [3], -3), ("reciprocal", [4.0], 0.25), ("is_positive", [1], True), ("is_negative", [1], False), ("is_zero", [0], True),
    ("is_even", [4], True), ("is_odd", [4], False), ("between", [2, 1, 3], True), ("bit_count", [7], 3), ("leading_zeros", [1], 63), ("trailing_zeros", [8], 3), ("abs_diff", [3, 8], 5), ("zeroifnull", [None], 0), ("nullif_zero", [0], None), ("safe_divide", [1.0, 0.0], None), ("safe_subtract", [5.0, 3.0], 2.0), ("safe_multiply", [2.0, 3.0], 6.0),
    ("safe_negate", [2], -2), ("to_oct", [8], "10"), ("to_bin", [5], "101"), ("format_number", [1234.5], "1,234.50"), ("pg_size_bytes", ["2 kB"], 2048), ("pg_size_pretty", [5], "5"), ("isfinite", [1.0], True), ("min_value", ["int"], -(2**31)), ("max_value", ["long"], 2**63 - 1), ("max_value", ["text"], None), ("max_value", ["byte"], 127),
    ("to_timestamp", [1_709_214_330_123_456_789], T), ("extract_year", [T], 2024), ("extract_month", [T], 2), ("extract_day", [T], 29), ("extract_hour", [T], 13), ("extract_minute", [T], 45), ("extract_second", [T], 30), ("extract_quarter", [T], 1), ("extract_week", [T], 9), ("extract_day_of_week", [T], 4), ("extract_day_of_year", [T], 60),
    ("date_trunc", ["hour", T], D(2024, 2, 29, 13)), ("date_diff", ["day", D(2024, 1, 1), D(2024, 1, 3, 12)], 2), ("date_diff", ["hours", D(2024, 1, 2), D(2024, 1, 1)], -24), ("timestamp_add", ["month", 1, D(2024, 1, 31)], D(2024, 2, 29)), ("timestamp_add", ["hours", -1, D(2024, 1, 1)], D(2023, 12, 31, 23)), ("timestamp_add", ["year", 1, T], D(2025, 2, 28, 13, 45, 30, 123456)),
    ("epoch_nanos", [T], 1_709_214_330_123_456_000), ("epoch_micros", [T], 1_709_214_330_123_456), ("epoch_millis", [T], 1_709_214_330_123), ("epoch_seconds", [T], 1_709_214_330), ("age", [D(2024, 1, 1), D(2024, 1, 2)], 86_400_000_000_000), ("make_date", [2024, 2, 29], dt.date(2024, 2, 29)), ("days_in_month_fn", [T], 29), ("is_leap_year_fn", [T], True),
    ("first_of_month", [T], D(2024, 2, 1)), ("last_of_month", [T], D(2024, 2, 29)), ("months_between", [D(2024, 3, 1), D(2023, 1, 1)], 14), ("years_between", [D(2024, 3, 1), D(2020, 1, 1)], 4), ("is_weekend", [D(2024, 3, 2)], True), ("is_business_day", [T], True), ("start_of_year", [T], D(2024, 1, 1)), ("end_of_year", [T], dt.date(2024, 12, 31)),
    ("start_of_quarter", [T], D(2024, 1, 1)), ("start_of_week", [T], D(2024, 2, 26)), ("timestamp_ceil", ["hour", T], D(2024, 2, 29, 14)), ("timestamp_ceil", ["hour", D(2024, 1, 1)], D(2024, 1, 1)), ("date_bin", [900_000_000, T, D(2024, 1, 1)], D(2024, 2, 29, 13, 45)), ("time_bucket", [3_600_000_000, T], D(2024, 2, 29, 13)), ("make_time", [1, 2, 3], 3_723_000_000_000),
    ("extract_epoch", [D(1970, 1, 1, 0, 0, 1, 500_000)], 1.5), ("extract_microsecond", [T], 123_456), ("extract_millisecond", [T], 123), ("extract_timezone", [T], "UTC"), ("overlap", [D(2024, 1, 1), D(2024, 1, 3), D(2024, 1, 2), D(2024, 1, 4)], True), ("date_part", ["year", T], 2024), ("date_format", [T], "2024-02-29 13:45:30"), ("date_format", [T, "%d/%m/%y %j %f 100%%"], "29/02/24 060 123456 100%"),
    ("to_timezone", [T, "Asia/Tokyo"], D(2024, 2, 29, 22, 45, 30, 123456)), ("to_utc", [T, "Asia/Tokyo"], D(2024, 2, 29, 4, 45, 30, 123456)), ("date_trunc_tz", ["day", T, "Asia/Tokyo"], D(2024, 2, 29)), ("at_timezone", [T, "UTC"], T), ("timezone_offset", ["jst"], 32_400), ("interval_to_nanos", ["500ms"], 500_000_000), ("interval_to_nanos", ["7ns"], 7), ("interval_to_nanos", ["2h"], 7_200_000_000_000),
    ("ohlcv_interval_nanos", ["5M"], 300_000_000_000), ("ohlcv_interval_nanos", ["m5"], 300_000_000_000), ("ohlcv_bar_align", [1_709_214_330_123_456_789, "1h"], 1_709_211_600_000_000_000), ("bar_align", [-1, "1d"], -86_400_000_000_000), ("make_interval", [0, 1, 1, 1, 1, 1], ((31 * 24 + 1) * 3600 + 61) * 10**9), ("justify_hours", [90_000_000_000_000], "1 days 1 hours"), ("justify_days", [86_400_000_000_000 * 65], "2 months 5 days"),
    ("age_timestamp", [D(2024, 1, 1), D(2022, 11, 1)], "1 years 2 months 1 days"), ("to_char_timestamp", [T, "x"], "2024-02-29 13:45:30"), ("to_date_str", ["1709214330123456789", ""], T), ("to_date", [T], D(2024, 2, 29)), ("to_date", ["2024-02-29", "yyyy-mm-dd"], D(2024, 2, 29)), ("timestamp_sequence", [T, 5], T), ("try_cast_timestamp", ["2024-01-01 00:00:00"], NOW), ("try_cast_date", ["x"], None),
    ("next_day", [D(2024, 2, 29), "Mon"], dt.date(2024, 3, 4)), ("make_timestamp", [2024, 1, 2, 3, 4, 5], NOW), ("coalesce", [None, 2], 2), ("nullif", [1, 1], None), ("greatest", [1, None, 3], 3), ("least", [1, None, 3], 1), ("if_null", [None, 5], 5), ("nvl2", [None, 1, 2], 2), ("iif", [True, 1, 2], 1), ("nullifempty", [""], None), ("nanvl", [math.nan, 1.0], 1.0), ("is_null", [None], True),
    ("is_not_null", [1], True), ("decode_fn", [2, 1, "a", 2, "b"], "b"), ("typeof", ["a"], "string"), ("to_number", ["1.5"], 1.5), ("to_number", ["x"], None), ("try_cast_int", ["x"], None), ("try_cast_float", ["1.5"], 1.5), ("cast_int", ["5"], 5), ("cast_to_int", ["1.9"], 1), ("cast_float", ["1.5"], 1.5), ("cast_str", [5], "5"), ("cast_bool", ["true"], True), ("not_bool", [True], False),
    ("and_bool_bool", [True, False], False), ("or_bool_bool", [True, False], True), ("pg_typeof", ["a"], "text"), ("pg_typeof", [1.5], "double precision"), ("typecast", [1], "i64"), ("assert", [True, "no"], None),
    ("array_length", [[1, 2]], 2), ("array_contains", [[1, 2], 2], True), ("array_position", [[1, 2], 2], 2), ("array_remove", [[1, 2, 1], 1], [2]), ("array_append", [[1], 2], [1, 2]), ("array_prepend", [[1], 2], [2, 1]), ("array_cat", [[1], [2]], [1, 2]), ("array_unique", [[1, 1, 2]], [1, 2]), ("array_sort", [[2, 1]], [1, 2]), ("array_reverse", [[1, 2]], [2, 1]),
    ("array_slice", [[1, 2, 3], 2, 3], [2, 3]), ("array_sum", [[1.0, 2.0]], 3.0), ("array_avg", [[1.0, 2.0]], 1.5), ("array_min", [[2, 1]], 1), ("array_max", [[2, 1]], 2), ("array_join", [["a", "b"], "-"], "a-b"), ("array_fill", [7, 2], [7, 7]), ("array_dims", [[1, 2]], "[1:2]"), ("array_ndims", [[1]], 1), ("array_upper", [[1, 2]], 2), ("array_lower", [[1]], 1),
    ("array_intersect", [[1, 2], [2, 3]], [2]), ("array_except", [[1, 2], [2]], [1]), ("array_overlap", [[1, 2], [2]], True), ("array_to_json", [[1, 2]], "[1,2]"), ("json_to_array", ['["a","b"]'], ["a", "b"]), ("string_to_array", ["a.b", "."], ["a", "b"]), ("from_text_array", ["a,b"], ["a", "b"]), ("unnest", [[5]], 5),
    ("json_extract", ['{"a":{"b":1}}', "$.a.b"], "1"), ("json_array_length", ["[1,2]"], 2), ("json_object_keys", ['{"a":1,"b":2}'], ["a", "b"]), ("json_typeof", ["[1]"], "array"), ("json_typeof", ["1.5"], "number"), ("json_typeof", ["null"], "null"), ("json_typeof", ['"x"'], "string"), ("json_strip_nulls", ['{"a":1,"b":null,"c":2}'], '{"a":1,"c":2}'), ("json_strip_nulls", ['{"a":null}'], "{}"),
    ("json_build_object", ["a", 1, "b", 'x"'], '{"a":"1","b":"x\\""}'), ("json_build_array", [1, "b"], '["1","b"]'), ("json_extract_path", ['{"a":[1,{"b":2}]}', "a", "1", "b"], "2"), ("json_array_elements", ['[{"a":1}]'], '{"a":1}'), ("json_array_elements_text", ['["x"]'], "x"), ("jsonb_set", ['{"a":"1","b":"2"}', "a", "9"], '{"b":"2","a":"9"}'), ("jsonb_delete_path", ['{"a":"1","b":"2"}', "a"], '{"b":"2"}'),
    ("jsonb_concat", ['{"a":"1"}', '{"b":"2"}'], '{"a":"1","b":"2"}'), ("jsonb_exists", ['{"a":1}', "a"], True), ("jsonb_exists_any", ['{"a":1}', ["b", "a"]], True), ("jsonb_exists_all", ['{"a":1}', ["b", "a"]], False), ("int4range", [1, 5], "[1,5)"), ("set_bit", [0, 3], 8), ("set_bit", [15, 0, 0], 14), ("get_bit", [8, 3], 1), ("get_byte", [0x1234, 1], 0x12), ("set_byte", [0x1234, 0, 0xFF], 0x12FF),
    ("fnv1a", ["hello"], 0xA430D84680AABD0B - 2**64), ("fnv1a", [""], 0xCBF29CE484222325 - 2**64), ("hash_combine", [1, 2], 1 ^ (2 + 0x9E3779B9 + 64)), ("crc32", ["a"], 0xE8B7BE43), ("murmur3", ["hello"], NOW), ("hash", ["a"], NOW),
    ("st_distance", [0.0, 0.0, 0.0, 90.0], 6_371_000.0 * math.pi / 2), ("st_within_distance", [0.0, 0.0, 0.0, 1.0, 120_000.0], True), ("st_contains", ["0,0,10,10", 5.0, 5.0], True), ("st_contains", ["0,0,10,10", 5.0, 11.0], False), ("st_area", ["0,0,0,10"], 0.0), ("make_geohash_str", [57.64911, 10.40744, 6], "u4pruy"), ("make_geohash", [57.64911, 10.40744, 30], 877322078),
    ("geohash_to_str", [877322078, 30], "u4pruy"), ("str_to_geohash", ["u4pruy"], 877322078), ("geohash_bits", ["u4pruy"], 30), ("geohash_within", [877322078, 877322078, 30], True), ("geohash_distance", [877322078, 877322078, 30], 0.0), ("geohash_bbox", [3, 2], "0.0,0.0,90.0,180.0"), ("geohash_decode_lat", ["s"], 22.5), ("geohash_decode_lon", ["s"], 22.5), ("geohash_lat", [24, 5], 22.5), ("geohash_lon", [24, 5], 22.5),
    ("geohash_neighbors_str", [24, 5], "u,k,t,e,v,g,m,7"), ("geo_to_h3", [1.0, 0.0, 0], 10_000_000), ("h3_to_geo", [5], "5.0E-7,0.0"), ("inet_aton", ["10.0.0.1"], 167_772_161), ("inet_ntoa", [167_772_161], "10.0.0.1"), ("host", ["10.0.0.1/8"], "10.0.0.1"), ("masklen", ["10.0.0.1/8"], 8), ("masklen", ["10.0.0.1"], 32), ("network", ["10.1.2.3/8"], "10.0.0.0/8"), ("broadcast", ["10.1.2.3/24"], "10.1.2.255"),
    ("best_bid", ["[[10.0,1],[9.0,2]]"], 10.0), ("best_ask", ["[[11.0,1],[12.0,2]]"], 11.0), ("spread", ["[[10.0,1]]", "[[11.0,1]]"], 1.0), ("mid_price", ["[[10.0,1]]", "[[11.0,1]]"], 10.5), ("vwap", [100.0, 4.0], 25.0), ("vwap", [100.0, 0.0], None), ("tick_delta_encode", ["[1.5,1.25,2.0]", 2], '{"base":150,"deltas":[-25,75]}'), ("tick_delta_decode", ['{"base":150,"deltas":[-25,75]}', 2], "[1.5,1.25,2.0]"),
    ("tick_delta_encode", ["[]", 2], '{"base":0,"deltas":[]}'), ("tick_delta_decode", ['{"base":0,"deltas":[]}', 2], "[]"), ("balance_available", [10.0, 3.0], 7.0), ("margin_ratio", [10.0, 4.0], 2.5), ("liquidation_price", [100.0, 10.0, "LONG"], 90.0), ("liquidation_price", [100.0, 10.0, "short"], 110.0), ("unrealized_pnl", [100.0, 110.0, 2.0, "sell"], -20.0), ("position_value", [10.0, 3.0], 30.0),
    ("margin_required", [10.0, 3.0, 5.0], 6.0), ("funding_payment", [2.0, 0.5, 10.0], 10.0), ("fee_amount", [10.0, 2.0, 0.25], 5.0), ("taker_buy_volume", [5.0, "BUY"], 5.0), ("taker_sell_volume", [5.0, "BUY"], 0.0), ("quote_volume", [2.0, 3.0], 6.0), ("trade_count", [], 1), ("delta", [5.0, "sell"], -5.0), ("delta_pct", [3.0, 1.0], 50.0), ("order_fill_pct", [1.0, 4.0], 25.0), ("is_fully_filled", [4.0, 4.0], True),
    ("remaining_qty", [4.0, 1.0], 3.0), ("effective_price", [10.0, 4.0], 2.5), ("slippage", [11.0, 10.0], 10.0), ("format_type", [25, 0], "text"), ("convert_from", ["abc"], "abc"), ("pg_char_to_encoding", ["utf8"], 6), ("pg_encoding_to_char", [6], "UTF8"), ("pg_column_size", ["abc"], 3), ("convert", ["a"], "a"),
    ("sum_long", [5], 5), ("count_distinct_str", ["a"], 1), ("eq_int_int", [1, 1], True), ("ne_long_long", [1, 1], False), ("lt_double_double", [1.0, 2.0], True), ("le_int_int", [2, 2], True), ("gt_int_int", [2, 1], True), ("ge_int_int", [1, 2], False), ("neg_int", [3], -3), ("add_int_int", [2, 3], 5), ("sub_int_int", [5, 3], 2), ("mul_int_int", [2, 3], 6), ("div_int_int", [7, 2], 3), ("div_double_double", [7.0, 2.0], 3.5), ("mod_int_int", [7, 0], None),
    ("cast_str_to_int", ["x"], None), ("cast_double_to_long", [1.9], 1), ("cast_int_to_str", [5], "5"),
]
#: Called, but with a value of their own each time or each session.
CHANGING = {"random": [], "now": [], "uuid": [], "rnd_int": [0, 5], "rnd_boolean": [], "rnd_float": [], "rnd_str": [], "rnd_char": [], "rnd_long": [], "rnd_byte": [], "rnd_short": [], "rnd_long256": [], "rnd_bin": [], "rnd_ipv4": [], "rnd_timestamp": [D(2024, 1, 1), D(2024, 1, 2)], "rnd_geohash": [20], "rnd_geohash_ex": [20], "yesterday": [], "tomorrow": [], "version": [], "current_user": [], "current_schema": [], "timeofday": [], "current_catalog": [], "current_database": [], "server_version": [], "server_version_num": [], "pg_catalog_version": [], "server_info": [], "current_setting": ["spark.sql.session.timeZone"], "to_char": [T], "nan": []}


def same(got, want):
    if want is NOW:
        return got is not None
    if isinstance(want, float) and isinstance(got, (int, float)):
        return got == want or math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)
    if isinstance(got, D) and got.tzinfo:
        got = got.replace(tzinfo=None)
    return got == want and isinstance(got, bool) == isinstance(want, bool)


@pytest.mark.parametrize("at", range(0, len(CASES), 60))
def test_values(spark, at):
    block = CASES[at : at + 60]
    generators = {"unnest", "json_array_elements", "json_array_elements_text"}
    columns = [call(n, *args).alias(f"c{i}") for i, (n, args, _) in enumerate(block) if n not in generators]
    row = spark.range(1).groupBy("id").agg(*columns).first() if any(n.startswith(("sum_", "count_distinct_")) for n, *_ in block) else spark.range(1).select(*columns).first()
    wrong = [(n, args, row[f"c{i}"], want) for i, (n, args, want) in enumerate(block) if n not in generators and not same(row[f"c{i}"], want)]
    wrong += [(n, got, want) for n, args, want in block if n in generators for got in [spark.range(1).select(call(n, *args).alias("x")).first().x] if not same(got, want)]
    assert not wrong


def test_those_that_change(spark):
    row = spark.range(1).select(*[call(n, *args).alias(n) for n, args in CHANGING.items()]).first()
    assert [n for n in CHANGING if row[n] is None] == []


def test_constants(spark):
    own = [n for n in constants.FUNCTIONS if n not in {c[0] for c in CASES} and n not in CHANGING and n not in ("pg_get_expr", "convert_to", "table_name")]
    row = spark.range(1).select(*[call(n).alias(n) for n in own]).first()
    assert [n for n in own if n not in constants.NOTHING.split() and row[n] is None] == []


def test_every_name_is_tried():
    """Of the names without aliases, all have a case but those that need a table of their own."""
    tried = {c[0] for c in CASES} | set(CHANGING) | set(constants.FUNCTIONS)
    tried |= {a for name, aliases in ALIASES.items() if name in tried for a in aliases}
    elsewhere = {"generate_timestamp_series", "json_agg", "jsonb_agg", "raise_error", "error", "json_each", "json_each_text", "jsonb_each", "jsonb_each_text", "regexp_split_to_table", "string_to_table", "to_json", "row_to_json", "to_jsonb", "jsonb_pretty", "jsonb_insert", "to_tsquery", "plainto_tsquery", "phraseto_tsquery", "websearch_to_tsquery", "ts_headline", "ts_rewrite", "tsvector_concat", "to_timestamp_str", "json_object", "json_extract_path_text", "numrange", "int8range", "tsrange", "tstzrange", "daterange"}
    assert {n for n in FUNCTIONS if n not in tried and n not in elsewhere and not n.startswith("jsonb_")} == set()


def test_names_resolve():
    for kind in TYPES:
        for head in ("sum", "ksum", "nsum", "avg", "min", "max", "count", "count_distinct", "first", "last", "first_not_null", "last_not_null", "stddev_samp", "stddev_pop", "var_samp", "var_pop"):
            find(f"{head}_{kind}")
        for head in ("eq", "ne", "lt", "le", "gt", "ge", "add", "sub", "mul", "div", "mod"):
            find(f"{head}_{kind}_{kind}")
        for other in TYPES:
            find(f"cast_{kind}_to_{other}")
    with pytest.raises(KeyError):
        find("no_such_function")


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 0.1, 2.0), (2, 0.2, 4.0), (2, None, None), (3, 0.3, 6.5)], "k int, x double, y double")
    x, y = F.col("x"), F.col("y")
    row = df.agg(*[call(n, x).alias(n) for n in AGGREGATES if n not in ("bool_and", "bool_or", "string_agg", "count_distinct", "median", "mode")], call("bool_or", x > 0.25).alias("any"), call("bool_and", x > 0.25).alias("every"), call("string_agg", x.cast("string")).alias("text"), call("mode", F.col("k")).alias("mode"), call("median", x).alias("median"),
                 *[call(n, x, y).alias(n) for n in WHOLE_COLUMN if n.startswith(("corr", "covar", "regr"))], call("string_agg_distinct", F.col("k").cast("string"), ",").alias("distinct")).first()
    assert row.ksum == pytest.approx(0.6, abs=1e-15) and row["count"] == 3 and row.first_not_null == 0.1 and row.any and not row.every and row.mode == 2 and row.median == pytest.approx(0.2)
    assert sorted(row.array_agg) == [0.1, 0.2, 0.3] and row.approx_count_distinct == 3 and row.regr_count == 3 and sorted(row.distinct.split(",")) == ["1", "2", "3"]
    many = spark.range(1000).select(F.when(F.col("id") == 0, 4e12).when(F.col("id") == 999, -4e12).otherwise(0.1).alias("x"))
    assert many.agg(call("ksum_double", F.col("x")).alias("s")).first().s == pytest.approx(99.8, abs=1e-9)
    assert math.isinf(spark.sql("SELECT double('inf') AS x").agg(call("nsum", F.col("x")).alias("s")).first().s)


def test_unit_errors(spark):
    with pytest.raises(ValueError):
        moments.difference("fortnight", F.lit(T), F.lit(T))
    with pytest.raises(Exception, match="no unit"):
        spark.range(1).select(moments.shifted(F.lit("fortnight"), F.lit(1), F.lit(T))).collect()


def test_murmur_and_fnv_equal_integer_arithmetic(spark):
    def fnv(s, first):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = ((h ^ b) * 0x100000001B3 if first else (h * 0x100000001B3) ^ b) & (2**64 - 1)
        return h

    def final(h):
        for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = ((h ^ (h >> 33)) * f) & (2**64 - 1)
        return h ^ (h >> 33)

    texts = ["", "a", "hello", "Zürich 😀", "x" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", call("fnv1a", F.col("s")).alias("f"), call("murmur3", F.col("s")).alias("m"))
    for r in df.collect():
        assert (r.f % 2**64, r.m % 2**64) == (fnv(r.s, True), final(fnv(r.s, False)))


def written(x):
    """A value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, float):
        return {"inf": "double('inf')", "nan": "double('nan')"}.get(str(x), f"{x!r}D")
    if isinstance(x, list):
        return f"array({', '.join(map(written, x))})"
    return f"TIMESTAMP_NTZ '{x}'" if isinstance(x, D) else str(x)


def test_values_by_name_in_sql(spark):
    """Functions that Spark lacks give the same values in SQL text as they do as columns."""
    from tidemark.plans import dialect

    own = [(n, args, want) for n, args, want in CASES if not spark.catalog.functionExists(n) and n not in ("unnest", "json_array_elements", "json_array_elements_text", "assert", "between", "overlay")]
    assert len({n for n, *_ in own}) > 200
    wrong = []
    for at in range(0, len(own), 40):
        block = own[at : at + 40]
        text = ", ".join(f"{n}({', '.join(map(written, args))}) AS c{i}" for i, (n, args, _) in enumerate(block))
        row = dialect.run(spark, f"SELECT {text}").first()
        wrong += [(n, args, row[f"c{i}"], want) for i, (n, args, want) in enumerate(block) if not same(row[f"c{i}"], want)]
    assert not wrong


def test_gcd_takes_no_more_steps_than_its_numbers_need(spark):
    import math

    fibonacci = [1, 1]
    while sum(fibonacci[-2:]) < 2**63:
        fibonacci.append(sum(fibonacci[-2:]))
    rows = [*zip(fibonacci, fibonacci[1:]), *zip(fibonacci[1:], fibonacci), (2**63 - 1, 2**63 - 2), (0, 0), (0, 5), (-12, 18), (None, 3), (4, None)]
    found = spark.createDataFrame(rows, "a long, b long").select("a", "b", call("gcd", F.col("a"), F.col("b")).alias("g"))
    assert [r.g for r in found.collect()] == [None if None in r else math.gcd(*r) for r in rows]
    assert "sequence(1, 93" not in found._jdf.queryExecution().analyzed().toString()
