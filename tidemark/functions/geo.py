"""Geohashes as numbers and as text, boxes, cell numbers and internet addresses, all as native expressions.

A geohash of `bits` bits halves longitude and latitude in turn, longitude first. Both are cut into 2**k equal
intervals at once and their bits interleaved by shifts and masks, instead of halving step by step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Fixed value: the alphabet of geohashes.
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Metres between (lat a, lon b) and (lat c, lon d), degrees."""
    h = F.pow(F.sin(F.radians(c - a) / 2), 2.0) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2.0)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def plain(x) -> int:
    """A whole number given as such or as a literal column."""
    return int(str(x._jc.toString()) if isinstance(x, Column) else x)


def shift_left(x: Column, n: int | Column) -> Column:
    return F.call_function("shiftleft", x, n if isinstance(n, Column) else F.lit(n))


def shift_right(x: Column, n: int | Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n if isinstance(n, Column) else F.lit(n))


def _cell(value: Column, low: float, span: float, bits: int) -> Column:
    """The number of the interval of 2**bits that a coordinate lies in; those outside fall into the outermost."""
    n = F.floor((value - low) / span * float(1 << bits)).cast("long")
    return F.least(F.greatest(n, F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def encode(lat: Column, lon: Column, bits: int) -> Column:
    """The geohash of a point as a number."""
    bits = plain(bits)
    x, y = _cell(lon, -180.0, 360.0, (bits + 1) // 2), _cell(lat, -90.0, 180.0, bits // 2)
    out = F.lit(0).cast("long")
    for k in range(bits):
        source, place = (x, (bits + 1) // 2 - 1 - k // 2) if k % 2 == 0 else (y, bits // 2 - 1 - k // 2)
        out = out.bitwiseOR(shift_left(shift_right(source, place).bitwiseAND(F.lit(1).cast("long")), bits - 1 - k))
    return out


def _gather(hash_: Column, bits: int, odd: int) -> Column:
    """Every second bit of a geohash, from its first (odd 0: longitude) or second one on, as a number."""
    places = range(odd, bits, 2)
    out = F.lit(0).cast("long")
    for i, k in enumerate(places):
        bit = shift_right(hash_, bits - 1 - k).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(shift_left(bit, len(places) - 1 - i))
    return out


def box(hash_: Column, bits: int) -> dict[str, Column]:
    """min_lat, min_lon, max_lat, max_lon of a geohash's cell."""
    bits = plain(bits)
    wide, high = 360.0 / (1 << ((bits + 1) // 2)), 180.0 / (1 << (bits // 2))
    lon, lat = _gather(hash_, bits, 0) * wide - 180.0, _gather(hash_, bits, 1) * high - 90.0
    return {"min_lat": lat, "min_lon": lon, "max_lat": lat + high, "max_lon": lon + wide}


def centre_lat(hash_: Column, bits: int) -> Column:
    b = box(hash_, bits)
    return (b["min_lat"] + b["max_lat"]) / 2


def centre_lon(hash_: Column, bits: int) -> Column:
    b = box(hash_, bits)
    return (b["min_lon"] + b["max_lon"]) / 2


def to_text(hash_: Column, bits: int) -> Column:
    """Base 32, five bits a digit, the last digit filled up with the bits of the cell's centre."""
    bits = plain(bits)
    length = max(1, -(-bits // 5))
    missing = 5 * length - bits  # the centre's further bits: one 1 for each coordinate, then zeros
    whole = shift_left(hash_, missing)
    for k in range(min(missing, 2)):
        whole = whole.bitwiseOR(shift_left(F.lit(1).cast("long"), missing - 1 - k))
    digit = lambda i: F.substring(F.lit(DIGITS), (shift_right(whole, 5 * (length - 1 - i)).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(i) for i in range(length)])


def encode_text(lat: Column, lon: Column, length: int) -> Column:
    length = max(1, plain(length))
    return to_text(encode(lat, lon, 5 * length), 5 * length)


def from_text(text: Column) -> Column:
    """The number of a geohash's text, of any length up to 12 digits."""
    digit = lambda c: F.greatest(F.call_function("locate", c, F.lit(DIGITS)) - 1, F.lit(0)).cast("long")
    return F.aggregate(F.split(F.lower(text), ""), F.lit(0).cast("long"), lambda a, c: shift_left(a, 5).bitwiseOR(digit(c)))


def _centre_of_text(text: Column, odd: int, low: float, span: float) -> Column:
    """The centre along one coordinate, halving its interval for each of its bits, whatever the text's length."""
    digit = lambda c: F.greatest(F.call_function("locate", c, F.lit(DIGITS)) - 1, F.lit(0)).cast("long")
    bits = F.flatten(F.transform(F.split(F.lower(text), ""), lambda c: F.array(*[shift_right(digit(c), 4 - j).bitwiseAND(F.lit(1).cast("long")) for j in range(5)])))
    own = F.filter(bits, lambda _, i: F.pmod(i, F.lit(2)) == odd)
    start = F.struct(F.lit(low).alias("at"), F.lit(span).alias("size"))
    half = lambda s, b: F.struct((s["at"] + F.when(b == 1, s["size"] / 2).otherwise(0.0)).alias("at"), (s["size"] / 2).alias("size"))
    found = F.aggregate(own, start, half)
    return found["at"] + found["size"] / 2


def neighbours(hash_: Column, bits: int) -> Column:
    """The texts of the eight cells around, joined by commas: north, south, east, west and the corners."""
    bits = plain(bits)
    lat, lon = centre_lat(hash_, bits), centre_lon(hash_, bits)
    high, wide = 180.0 / (1 << (bits // 2)), 360.0 / (1 << ((bits + 1) // 2))
    moves = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
    return F.concat_ws(",", *[encode_text(lat + i * high, lon + j * wide, max(1, -(-bits // 5))) for i, j in moves])


def _corners(text: Column) -> list[Column]:
    return [F.trim(F.split_part(text, F.lit(","), F.lit(i))).try_cast("double") for i in range(1, 5)]


def contains(text: Column, lat: Column, lon: Column) -> Column:
    """Whether a box `min_lat,min_lon,max_lat,max_lon` holds a point, borders included; null for another text."""
    a, b, c, d = _corners(text)
    return (lat >= a) & (lat <= c) & (lon >= b) & (lon <= d)


def area(text: Column) -> Column:
    """Square metres of a box, as wide as at its middle latitude."""
    a, b, c, d = _corners(text)
    return F.abs(F.radians(c - a) * EARTH_M) * F.abs(F.radians(d - b) * EARTH_M * F.cos(F.radians((a + c) / 2)))


def cell_number(lat: Column, lon: Column, resolution: Column) -> Column:
    """A number mixed from coordinates in units of 1e-7 degrees and a resolution; no hexagonal grid stands behind it."""
    x, y = (lat * 1e7).cast("long"), (lon * 1e7).cast("long")
    return x.bitwiseXOR(shift_left(y, 20)).bitwiseXOR(shift_left(resolution.cast("long"), 52))


def cell_parts(number: Column) -> Column:
    low = number.bitwiseAND(F.lit((1 << 20) - 1)) / 1e7
    high = F.call_function("shiftright", number, F.lit(20)).bitwiseAND(F.lit((1 << 32) - 1)) / 1e7
    return F.concat_ws(",", low.cast("string"), high.cast("string"))


def address(text: Column) -> Column:
    """The number of an IPv4 address."""
    return F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))


def dotted(n: Column) -> Column:
    return F.concat_ws(".", *[shift_right(n, k).bitwiseAND(F.lit(255).cast("long")).cast("string") for k in (24, 16, 8, 0)])


def mask_length(text: Column) -> Column:
    return F.when(text.contains("/"), F.coalesce(F.substring_index(text, "/", -1).try_cast("int"), F.lit(32))).otherwise(32)


def _host_bits(text: Column) -> Column:
    return shift_left(F.lit(1).cast("long"), 32 - F.least(mask_length(text), F.lit(32))) - 1


def network(text: Column) -> Column:
    at = address(F.substring_index(text, "/", 1))
    return F.concat(dotted(at - at.bitwiseAND(_host_bits(text))), F.lit("/"), mask_length(text).cast("string"))


def broadcast(text: Column) -> Column:
    return dotted(address(F.substring_index(text, "/", 1)).bitwiseOR(_host_bits(text)))


FUNCTIONS = {
    "st_distance": haversine,
    "st_within_distance": lambda a, b, c, d, m: haversine(a, b, c, d) <= m,
    "st_contains": contains,
    "st_area": area,
    "make_geohash": encode,
    "make_geohash_str": encode_text,
    "geohash_to_str": to_text,
    "str_to_geohash": from_text,
    "geohash_distance": lambda a, b, bits: haversine(centre_lat(a, bits), centre_lon(a, bits), centre_lat(b, bits), centre_lon(b, bits)),
    "geohash_within": lambda a, b, bits: shift_left(a, 64 - plain(bits)) == shift_left(b, 64 - plain(bits)),
    "geohash_lat": centre_lat,
    "geohash_lon": centre_lon,
    "geohash_bits": lambda s: F.octet_length(s) * 5,
    "geohash_bbox": lambda h, bits: F.concat_ws(",", *[c.cast("string") for c in box(h, bits).values()]),
    "geohash_neighbors_str": neighbours,
    "geohash_decode_lat": lambda s: _centre_of_text(s, 1, -90.0, 180.0),
    "geohash_decode_lon": lambda s: _centre_of_text(s, 0, -180.0, 360.0),
    "rnd_geohash_ex": lambda bits: encode(F.rand() * 180.0 - 90.0, F.rand() * 360.0 - 180.0, bits),
    "rnd_geohash": lambda bits=30: encode(F.rand() * 180.0 - 90.0, F.rand() * 360.0 - 180.0, bits),
    "geo_to_h3": cell_number,
    "h3_to_geo": cell_parts,
    "inet_aton": address,
    "inet_ntoa": dotted,
    "host": lambda s: F.substring_index(s, "/", 1),
    "masklen": mask_length,
    "network": network,
    "broadcast": broadcast,
}
