"""64-bit hashes of text bytes by native expressions. Arithmetic wraps at 64 bits, which SQL's does not, so sums and
products are put together from halves that can't overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = (1 << 32) - 1
#: Offset and prime of FNV, the golden ratio's bits, and the finaliser's factors.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN = 0x9E3779B9
FINAL = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _long(n: int) -> Column:
    return F.lit(n - (1 << 64) if n >= 1 << 63 else n).cast("long")


def _up(x: Column, n: int) -> Column:
    return F.call_function("shiftleft", x, F.lit(n))


def _down(x: Column, n: int) -> Column:
    return F.call_function("shiftrightunsigned", x, F.lit(n))


def let(x: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64."""

    def halves(s: Column) -> Column:
        low = s["a"].bitwiseAND(_long(LOW)) + s["b"].bitwiseAND(_long(LOW))
        return let(F.struct(low.alias("low"), (_down(s["a"], 32) + _down(s["b"], 32)).alias("high")), lambda t: _up(t["high"] + _down(t["low"], 32), 32).bitwiseOR(t["low"].bitwiseAND(_long(LOW))))

    return let(F.struct(a.alias("a"), b.alias("b")), halves)


def multiply(a: Column, factor: int) -> Column:
    """a * factor modulo 2**64, sixteen bits of the factor at a time."""
    parts = [(k, (factor >> (16 * k)) & 0xFFFF) for k in range(4)]

    def product(x: Column) -> Column:
        low, high = x.bitwiseAND(_long(LOW)), _down(x, 32)
        terms = [_up(add(_up(high * part, 32), low * part), 16 * k) for k, part in parts if part]
        return F.aggregate(F.array(*terms), _long(0), add)

    return let(a, product)


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    return F.transform(F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("long"))


def fnv1a(text: Column) -> Column:
    found = F.aggregate(_bytes(text), _long(FNV_OFFSET), lambda h, b: multiply(h.bitwiseXOR(b), FNV_PRIME))
    return F.when(text.isNotNull(), found)


def murmur3(text: Column) -> Column:
    """FNV-1 of the bytes, then the 64-bit finaliser of Murmur 3."""
    found = F.aggregate(_bytes(text), _long(FNV_OFFSET), lambda h, b: multiply(h, FNV_PRIME).bitwiseXOR(b), _finish)
    return F.when(text.isNotNull(), found)


def _finish(h: Column) -> Column:
    h = let(h, lambda x: multiply(x.bitwiseXOR(_down(x, 33)), FINAL[0]))
    h = let(h, lambda x: multiply(x.bitwiseXOR(_down(x, 33)), FINAL[1]))
    return let(h, lambda x: x.bitwiseXOR(_down(x, 33)))


def combine(a: Column, b: Column) -> Column:
    a, b = a.cast("long"), b.cast("long")
    return a.bitwiseXOR(add(add(add(b, _long(GOLDEN)), _up(a, 6)), _down(a, 2)))


FUNCTIONS = {
    "fnv1a": lambda s: fnv1a(s.cast("string")),
    "murmur3": lambda s: murmur3(s.cast("string")),
    "hash_combine": combine,
    "hash": F.xxhash64,
    "crc32": F.crc32,
}
