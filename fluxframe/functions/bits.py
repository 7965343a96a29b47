"""Integer and bit expressions on columns: wrap-around counters, sign extension, fixed-point rounding, masks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 1 << 32


def s16(v: Column) -> Column:
    """The low 16 bits of v as a signed number."""
    return ((v + 32768).bitwiseAND(F.lit(65535)) - 32768).cast("int")


def delta_mod(now: Column, before: Column, bits: int = 32) -> Column:
    """now - before modulo 2 ** bits. For 64 bits both are bit patterns, and the difference wraps like them."""
    if bits < 64:
        return F.pmod(now - before, F.lit(1 << bits))
    half, whole = F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64))
    wide = now.cast("decimal(20,0)") - before.cast("decimal(20,0)")
    return (F.pmod(wide + half, whole) - half).cast("long")


def signed_distance(a: Column, b: Column, bits: int = 32) -> Column:
    """a - b modulo 2 ** bits, as a number from -2 ** (bits - 1)."""
    half = F.lit(1 << (bits - 1))
    return F.pmod(a - b + half, F.lit(1 << bits)) - half


def round_half_away(acc: Column, shift: int) -> Column:
    """acc / 2 ** shift rounded to the nearest integer, halves away from zero. A shift right alone would floor."""
    up = F.shiftright(F.abs(acc) + F.lit(1 << (shift - 1)), shift)
    return F.when(acc < 0, -up).otherwise(up)


def saturate(v: Column, bits: int) -> Column:
    return F.greatest(F.lit(-(1 << (bits - 1))), F.least(F.lit((1 << (bits - 1)) - 1), v))


def u64_decimal(v: Column) -> Column:
    """A bit pattern in a BIGINT as the unsigned number."""
    d = v.cast("decimal(20,0)")
    return F.when(v < 0, (d + F.lit(Decimal(1 << 64))).cast("decimal(20,0)")).otherwise(d)


def bit(v: Column, place: int | Column) -> Column:
    return F.shiftright(v, place).bitwiseAND(F.lit(1)) if isinstance(place, int) else F.call_function("shiftright", v, place).bitwiseAND(F.lit(1))


def names_of(mask: Column, names: dict[int, str]) -> Column:
    """The names of the bits that are set, in order of the bits."""
    return F.array_compact(F.array(*[F.when(bit(mask, b) == 1, F.lit(n)) for b, n in sorted(names.items())]))


def unknown_bits(mask: Column, names: dict[int, str]) -> Column:
    known = sum(1 << b for b in names)
    return mask.bitwiseAND(F.lit(~known))


def spread_pairs(mask: Column, lanes: int = 8) -> Column:
    """A mask with two neighbouring bits for every bit of mask."""
    return sum((F.when(bit(mask, i) == 1, F.lit(3 << (2 * i))).otherwise(F.lit(0)) for i in range(1, lanes)), F.when(bit(mask, 0) == 1, F.lit(3)).otherwise(F.lit(0)))


def ones_complement_16(words: Column) -> Column:
    """The ones' complement of the ones' complement sum of an array of 16-bit words, as in an IPv4 header."""
    total = F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x)
    once = total.bitwiseAND(F.lit(65535)) + F.shiftright(total, 16)
    twice = once.bitwiseAND(F.lit(65535)) + F.shiftright(once, 16)
    return F.lit(65535) - twice


def mac_text(v: Column) -> Column:
    h = F.lower(F.lpad(F.hex(v), 12, "0"))
    return F.concat_ws(":", *[F.substring(h, 1 + 2 * i, 2) for i in range(6)])


def ipv4_text(v: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
