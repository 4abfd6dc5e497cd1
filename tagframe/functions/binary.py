"""Fixed-width numbers in binary columns, of either byte order.

Bytes are handled as hexadecimal text, since Spark has no cast between numbers and
binary: pairs of digits are reordered for little-endian bytes, ``conv`` reads them.
Everything stays in generated code; floats are put together from sign, exponent
and fraction, which is exact for all bit patterns.

Positions count from 0. A number that does not lie in the buffer as a whole is null.
``little`` is a Python bool or a boolean column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often body uses it; it also keeps generated methods small enough to be compiled."""
    return F.element_at(F.transform(F.array(value), body), 1)


def reversed_pairs(h: Column, width: int) -> Column:
    """The hex of ``width`` bytes in the opposite order."""
    return let(h, lambda x: F.concat(*[F.substring(x, 2 * k + 1, 2) for k in reversed(range(width))])) if width > 1 else h


def ordered(h: Column, width: int, little) -> Column:
    """Big-endian hex of a number."""
    if isinstance(little, bool):
        return reversed_pairs(h, width) if little else h
    return F.when(little, reversed_pairs(h, width)).otherwise(h)


def hex_at(buf: Column, pos, width: int, little=False) -> Column:
    """Big-endian hex of the number at a position; null if the buffer ends before it does."""
    pos = as_column(pos)
    part = F.hex(F.substring(buf, pos + 1, F.lit(width)))
    return let(part, lambda h: F.when((pos >= 0) & (F.octet_length(h) == 2 * width), ordered(h, width, little)))


def unsigned(h: Column, width: int) -> Column:
    """BIGINT up to 4 bytes, DECIMAL(20,0) for 8."""
    return F.conv(h, 16, 10).cast(U64 if width == 8 else "bigint")


def signed(h: Column, width: int) -> Column:
    """Two's complement as BIGINT."""
    if width == 8:
        return F.conv(h, 16, -10).cast("bigint")
    # Shifted to the top and back, the sign bit fills the rest.
    return F.shiftright(F.shiftleft(F.conv(h, 16, -10).cast("bigint"), 64 - 8 * width), 64 - 8 * width)


def _float(bits: Column, fraction_bits: int, exponent_bits: int) -> Column:
    """IEEE 754 value of the bits (a non-negative or two's-complement BIGINT), as DOUBLE."""
    return let(bits, lambda b: _float_of(b, fraction_bits, exponent_bits))


def _float_of(bits: Column, fraction_bits: int, exponent_bits: int) -> Column:
    most = (1 << exponent_bits) - 1
    bias = (most >> 1) + fraction_bits
    exponent = F.shiftright(bits, fraction_bits).bitwiseAND(F.lit(most))
    fraction = bits.bitwiseAND(F.lit((1 << fraction_bits) - 1))
    negative = F.shiftright(bits, fraction_bits + exponent_bits).bitwiseAND(F.lit(1)) == 1
    # Both factors and their product have exact doubles, so nothing is rounded.
    normal = (fraction + (1 << fraction_bits)).cast("double") * F.pow(F.lit(2.0), exponent - bias)
    small = fraction.cast("double") * F.pow(F.lit(2.0), F.lit(float(1 - bias)))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    value = F.when(exponent == most, special).when(exponent == 0, small).otherwise(normal)
    return F.when(negative, -value).otherwise(value)


def float32(h: Column) -> Column:
    return _float(F.conv(h, 16, 10).cast("bigint"), 23, 8).cast("float")


def float64(h: Column) -> Column:
    return _float(F.conv(h, 16, -10).cast("bigint"), 52, 11)


def read_unsigned(buf: Column, pos, width: int, little=False) -> Column:
    """u8, u16, u32 as BIGINT, u64 as DECIMAL(20,0)."""
    return unsigned(hex_at(buf, pos, width, little), width)


def read_signed(buf: Column, pos, width: int, little=False) -> Column:
    """i8, i16, i32, i64 as BIGINT."""
    return signed(hex_at(buf, pos, width, little), width)


def read_float(buf: Column, pos, width: int, little=False) -> Column:
    """f32 as FLOAT, f64 as DOUBLE."""
    h = hex_at(buf, pos, width, little)
    return float32(h) if width == 4 else float64(h)


def swapped_units(h: Column, unit: int) -> Column:
    """Hex with each whole unit of bytes reversed; a rest shorter than a unit stays."""
    if unit == 1:
        return h
    digits = "(..)" * unit
    return F.regexp_replace(h, digits, "".join(f"${k}" for k in range(unit, 0, -1)))


def fix_endianness(data: Column, little, bit_depth: Column) -> Column:
    """Bytes in big-endian order, swapped by 1, 2, 4 or 8 bytes for a bit depth up to 8, 16, 32 or more."""
    h = F.hex(data)
    by_depth = F.when(bit_depth <= 8, h).when(bit_depth <= 16, swapped_units(h, 2)).when(bit_depth <= 32, swapped_units(h, 4)).otherwise(swapped_units(h, 8))
    return F.unhex(F.when(as_column(little), by_depth).otherwise(h))


def canonical_hex(h: Column, little, unit: Column) -> Column:
    """Big-endian hex of values whose numbers are ``unit`` bytes wide (a column of 1, 2, 4 or 8)."""
    swapped = reduce(lambda c, u: c.when(unit == u, swapped_units(h, u)), (2, 4, 8), F.when(unit == 1, h))
    if isinstance(little, bool):
        return swapped if little else F.when(unit.isNotNull(), h)
    return F.when(little, swapped).otherwise(h)


def canonical(data: Column, little, unit: Column) -> Column:
    """Big-endian bytes of values whose numbers are ``unit`` bytes wide (a column of 1, 2, 4 or 8)."""
    return let(F.hex(data), lambda h: F.unhex(canonical_hex(h, little, unit)))


def elements(data: Column, width: int) -> Column:
    """array<string>: the hex of each whole element of ``width`` bytes."""
    n = F.floor(F.octet_length(data) / width).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.hex(F.substring(data, k * width + 1, F.lit(width))))
