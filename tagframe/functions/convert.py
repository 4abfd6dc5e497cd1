"""Checked conversions of loaded entries to numbers, lists and text.

An entry is a STRUCT<type_code, count, data> with big-endian data. Every conversion
returns STRUCT<value, error>: exactly one of the two is null for an entry that is not
null, and a null entry gives two nulls. The order of the checks is part of the
result, as it decides which error is reported.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagframe.functions import binary as B
from tagframe.functions.catalog import OFFSET_TYPES, SIGNED, TYPE, UNSIGNED, size_of
from tagframe.functions.geometry import whole_div

SIZES_DIFFER = "InconsistentSizesEncountered"
LIMITS = "LimitsExceeded"
NOT_UNSIGNED = "UnsignedIntegerExpected"
NOT_SIGNED = "SignedIntegerExpected"
NOT_FLOAT = "FloatExpected"
NOT_TEXT = "AsciiExpected"
INVALID = "InvalidTag"
TOO_LARGE = "IntSizeError"
IS_DIRECTORY = "IfdReadIntoEntry"


def checked(entry: Column, errors: list[tuple[Column, str | Column]], value: Column) -> Column:
    """The value, or the error of the first condition that holds."""
    found = F.lit(None).cast("string")
    for condition, name in reversed(errors):
        found = F.when(condition, F.lit(name)).otherwise(found)
    present = entry.isNotNull()
    return B.let(F.when(present, found), lambda error: F.struct(F.when(present & error.isNull(), value).alias("value"), error.alias("error")))


def once(f):
    """The conversion with its entry, which may be a long expression, computed once."""

    @wraps(f)
    def conversion(entry: Column, *args) -> Column:
        return B.let(entry, lambda e: f(e, *args))

    return conversion


def _hex(entry: Column) -> Column:
    return F.hex(entry["data"])


def _length(entry: Column) -> Column:
    return F.octet_length(entry["data"])


def _one_size(entry: Column) -> Column:
    return _length(entry) != size_of(entry["type_code"])


def _all_size(entry: Column) -> Column:
    return _length(entry).cast(B.U64) != (size_of(entry["type_code"]) * entry["count"]).cast("decimal(38,0)")


def unsigned_value(entry: Column) -> Column:
    return F.conv(_hex(entry), 16, 10).cast(B.U64)


def signed_value(entry: Column) -> Column:
    return _signed_of(_hex(entry), size_of(entry["type_code"]))


def _signed_of(h: Column, size: Column) -> Column:
    """Two's complement of ``size`` bytes: shifted to the top and back, the sign bit fills the rest."""
    shift = F.when(size.isin(1, 2, 4), 64 - 8 * size).otherwise(F.lit(0)).cast("int")
    n = F.conv(h, 16, -10).cast("bigint")
    return B.let(shift, lambda k: F.call_function("shiftright", F.call_function("shiftleft", n, k), k))


@once
def to_unsigned(entry: Column, bits: int) -> Column:
    """u8, u16, u32 as BIGINT or u64 as DECIMAL(20,0), from any unsigned type."""

    def narrowed(n: Column) -> Column:
        too_large = n > F.lit(str((1 << bits) - 1)).cast(B.U64)
        value = n if bits == 64 else n.cast("bigint")
        return checked(entry, [(_one_size(entry), SIZES_DIFFER), (~entry["type_code"].isin(*UNSIGNED), NOT_UNSIGNED), (too_large, TOO_LARGE)], value)

    return B.let(unsigned_value(entry), narrowed)


@once
def to_signed(entry: Column, bits: int) -> Column:
    """i8, i16, i32, i64 as BIGINT, from any signed type."""

    def narrowed(n: Column) -> Column:
        errors = [(_one_size(entry), SIZES_DIFFER), (~entry["type_code"].isin(*SIGNED), NOT_SIGNED)]
        if bits < 64:
            errors.append((~n.between(-(1 << (bits - 1)), (1 << (bits - 1)) - 1), TOO_LARGE))
        return checked(entry, errors, n)

    return B.let(signed_value(entry), narrowed)


@once
def to_f32(entry: Column) -> Column:
    return checked(entry, [(_one_size(entry), SIZES_DIFFER), (entry["type_code"] != TYPE["FLOAT"], NOT_FLOAT)], B.float32(_hex(entry)))


@once
def to_f64(entry: Column) -> Column:
    """DOUBLE, or FLOAT widened."""
    single = entry["type_code"] == TYPE["FLOAT"]
    value = F.when(single, B.float32(_hex(entry)).cast("double")).otherwise(B.float64(_hex(entry)))
    return checked(entry, [(_one_size(entry), SIZES_DIFFER), (~entry["type_code"].isin(TYPE["FLOAT"], TYPE["DOUBLE"]), NOT_FLOAT)], value)


@once
def get_u64(entry: Column, index) -> Column:
    """Element ``index`` of an unsigned entry, counted from 0."""
    index = B.as_column(index)
    size = size_of(entry["type_code"])
    n = F.conv(F.hex(F.substring(entry["data"], (index * size + 1).cast("int"), size)), 16, 10).cast(B.U64)
    return checked(entry, [(entry["count"] <= index, LIMITS), (~entry["type_code"].isin(*UNSIGNED), NOT_UNSIGNED), (_all_size(entry), SIZES_DIFFER)], n)


#: Target -> the types it takes; lists are not converted between types.
SLICES = {
    "u8": ("BYTE",), "u16": ("SHORT",), "u32": ("LONG", "IFD"), "u64": ("LONG8", "IFD8"),
    "i8": ("SBYTE",), "i16": ("SSHORT",), "i32": ("SLONG",), "i64": ("SLONG8",), "f32": ("FLOAT",), "f64": ("DOUBLE",),
}


def _decoder(target: str):
    width = int(target[1:]) // 8
    if target[0] == "u":
        return width, lambda h: B.unsigned(h, width)
    if target[0] == "i":
        return width, lambda h: B.signed(h, width)
    return width, (B.float32 if width == 4 else B.float64)


@once
def to_slice(entry: Column, target: str) -> Column:
    """All elements; a wrong type is reported as a wrong size."""
    width, decode = _decoder(target)
    codes = [TYPE[t] for t in SLICES[target]]
    return checked(entry, [(_all_size(entry), SIZES_DIFFER), (~entry["type_code"].isin(*codes), SIZES_DIFFER)], F.transform(B.elements(entry["data"], width), decode))


@once
def to_vec_f64(entry: Column) -> Column:
    """A copy of a DOUBLE list, or a FLOAT list widened."""
    wide = F.transform(B.elements(entry["data"], 8), B.float64)
    narrow = F.transform(B.elements(entry["data"], 4), lambda h: B.float32(h).cast("double"))
    value = F.when(entry["type_code"] == TYPE["FLOAT"], narrow).otherwise(wide)
    return checked(entry, [(_all_size(entry), SIZES_DIFFER), (~entry["type_code"].isin(TYPE["FLOAT"], TYPE["DOUBLE"]), NOT_FLOAT)], value)


@once
def to_vec_f32(entry: Column) -> Column:
    """A copy of a FLOAT list; DOUBLE is not narrowed."""
    return checked(entry, [(_all_size(entry), SIZES_DIFFER), (entry["type_code"] != TYPE["FLOAT"], NOT_FLOAT)], F.transform(B.elements(entry["data"], 4), B.float32))


#: Any number of ASCII bytes and a NUL at the end.
CLOSED_ASCII = "^(?:[0-7][0-9A-F])*+$"


def _not_closed(entry: Column) -> Column:
    h = _hex(entry)
    return ~(h.rlike(CLOSED_ASCII) & h.endswith("00"))


def _text(entry: Column) -> Column:
    """Without NULs at both ends; those within stay."""
    return F.trim(F.decode(entry["data"], "UTF-8"), F.lit("\u0000"))


@once
def to_text(entry: Column) -> Column:
    wrong_type = ~entry["type_code"].isin(TYPE["ASCII"], TYPE["BYTE"], TYPE["UNDEFINED"])
    return checked(entry, [(_length(entry).cast(B.U64) != entry["count"], SIZES_DIFFER), (wrong_type, NOT_TEXT), (_not_closed(entry), INVALID)], _text(entry))


def _display_rational(h: Column) -> Column:
    """Three decimals, cut off; none if they are zero. Null for a denominator of 0."""
    num, den = B.unsigned(F.substring(h, 1, 8), 4), B.unsigned(F.substring(h, 9, 8), 4)

    def cut(q: Column) -> Column:
        rest, frac = whole_div(q, F.lit(1000)), q % 1000
        return F.when(frac != 0, F.concat(rest.cast("string"), F.lit("."), F.lpad(frac.cast("string"), 3, "0"))).otherwise(rest.cast("string"))

    return B.let(whole_div(num * 1000, den), cut)


def _display_srational(h: Column) -> Column:
    return F.concat_ws("/", B.signed(F.substring(h, 1, 8), 4), B.signed(F.substring(h, 9, 8), 4))


VALUE = "struct<u:decimal(20,0),i:bigint,f:double,num:bigint,den:bigint,s:string>"


def _value(h: Column, type_code: Column) -> Column:
    """One element as STRUCT<u, i, f, num, den, s>; only the fields of its family are set."""
    t = TYPE
    is_unsigned = type_code.isin(*UNSIGNED, t["UNDEFINED"])
    sign = _signed_of(h, size_of(type_code))
    f = F.when(type_code == t["FLOAT"], B.float32(h).cast("double")).when(type_code == t["DOUBLE"], B.float64(h))
    first, second = F.substring(h, 1, 8), F.substring(h, 9, 8)
    ratio = lambda part: F.when(type_code == t["RATIONAL"], B.unsigned(part, 4)).when(type_code == t["SRATIONAL"], B.signed(part, 4))
    return F.struct(
        F.when(is_unsigned, F.conv(h, 16, 10).cast(B.U64)).alias("u"),
        F.when(type_code.isin(*SIGNED), sign).alias("i"),
        f.alias("f"),
        ratio(first).alias("num"),
        ratio(second).alias("den"),
        F.when(type_code == t["ASCII"], F.lit("")).alias("s"),
    )


@once
def to_values(entry: Column) -> Column:
    """STRUCT<value: array<STRUCT<u, i, f, num, den, s>>, error>: one element for a single value or a text."""
    code, one = entry["type_code"], entry["count"] == 1
    ascii_ = code == TYPE["ASCII"]
    size = size_of(code)
    n = F.when(one, F.lit(1)).otherwise(F.floor(_length(entry) / size).cast("int"))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    numbers = F.transform(at, lambda k: B.let(F.hex(F.substring(entry["data"], k * size + 1, size)), lambda h: _value(h, code)))
    none = F.lit(None)
    text = F.array(F.struct(none.cast(B.U64).alias("u"), none.cast("bigint").alias("i"), none.cast("double").alias("f"), none.cast("bigint").alias("num"), none.cast("bigint").alias("den"), _text(entry).alias("s")))
    errors = [
        ((one | (n > 0)) & code.isin(*OFFSET_TYPES), IS_DIRECTORY),
        (one & ascii_ & (F.substring(_hex(entry), 1, 2) != "00"), INVALID),
        (~one & ascii_ & _not_closed(entry), INVALID),
    ]
    return checked(entry, errors, F.when(ascii_ & ~one, text).otherwise(numbers))


@once
def display(entry: Column) -> Column:
    """STRUCT<value: string, error> of a single value or text; denominators of 0 and lists have no display."""
    return B.let(_hex(entry), lambda h: _display(entry, h))


def _display(entry: Column, h: Column) -> Column:
    code, one = entry["type_code"], entry["count"] == 1
    ascii_, ratio = code == TYPE["ASCII"], code == TYPE["RATIONAL"]
    shown = (
        F.when(ratio, _display_rational(h))
        .when(code == TYPE["SRATIONAL"], _display_srational(h))
        .when(ascii_, F.when(one, F.lit("")).otherwise(_text(entry)))
        .when(code == TYPE["FLOAT"], B.float32(h).cast("string"))
        .when(code == TYPE["DOUBLE"], B.float64(h).cast("string"))
        .when(code.isin(*SIGNED), signed_value(entry).cast("string"))
        .otherwise(unsigned_value(entry).cast("string"))
    )
    errors = [
        (~one & ~ascii_, "ListHasNoDisplay"),
        (code.isin(*OFFSET_TYPES), IS_DIRECTORY),
        (ascii_ & F.when(one, F.substring(h, 1, 2) != "00").otherwise(_not_closed(entry)), INVALID),
        (ratio & (F.substring(h, 9, 8) == "00000000"), "DivisionByZero"),
    ]
    return checked(entry, errors, shown)


def list_type(type_codes: Column) -> Column:
    """The type of a list of values: that of all of them, UNDEFINED for none or several."""
    distinct = F.array_distinct(type_codes)
    return F.when(F.size(distinct) == 1, F.element_at(distinct, 1)).otherwise(F.lit(TYPE["UNDEFINED"]))


def list_count(values: Column, is_list: Column) -> Column:
    """How many values: the length of a list, else 1 (for a text as well)."""
    return F.when(is_list, F.size(values)).otherwise(F.lit(1))
