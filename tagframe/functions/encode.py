"""Values to (type_code, count, data), the data in big-endian order.

``write_*`` give the bytes of one number in either order. Integers and text use
built-in functions; the bits of floats have no SQL expression, so they come from
one vectorised Arrow function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tagframe.functions.binary import as_column, canonical, ordered
from tagframe.functions.catalog import TYPE, swap_unit_of

#: Integer types: name -> bytes.
INTEGERS = {"BYTE": 1, "UNDEFINED": 1, "SHORT": 2, "LONG": 4, "IFD": 4, "LONG8": 8, "IFD8": 8, "SBYTE": 1, "SSHORT": 2, "SLONG": 4, "SLONG8": 8}
FLOATS = {"FLOAT": 4, "DOUBLE": 8}


def hex_of_integer(value: Column, width: int) -> Column:
    """Big-endian hex of the low ``width`` bytes; 8 bytes take a DECIMAL(20,0) as unsigned, a BIGINT as it is."""
    if width == 8:
        # conv() is slow and needed from 2^63 on only.
        return F.when(value < 0, F.hex(value.cast("bigint"))).otherwise(F.lpad(F.coalesce(F.hex(value.try_cast("bigint")), F.conv(value.cast("string"), 10, 16)), 16, "0"))
    return F.lpad(F.hex(value.cast("bigint").bitwiseAND(F.lit((1 << 8 * width) - 1))), 2 * width, "0")


def write_integer(value: Column, width: int, little=False) -> Column:
    return F.unhex(ordered(hex_of_integer(value, width), width, little))


def _float_bytes(width: int):
    kind = {4: ">f4", 8: ">f8"}[width]

    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        numbers = np.asarray(values.fill_null(0.0)).astype(kind)
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(numbers), [None, pa.py_buffer(numbers.tobytes())])
        return pa.compute.if_else(values.is_null(), pa.scalar(None, pa.binary()), fixed.cast(pa.binary()))

    return encode


def write_float(value: Column, width: int, little=False) -> Column:
    data = _float_bytes(width)(value.cast("double"))
    return F.unhex(ordered(F.hex(data), width, little)) if little is not False else data


def _float_list_bytes(width: int):
    kind = {4: ">f4", 8: ">f8"}[width]

    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        flat = np.asarray(values.flatten().fill_null(0.0)).astype(kind).tobytes()
        sizes = pa.compute.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes) * width
        return pa.array([None if not v else flat[e - n * width : e] for v, e, n in zip(values.is_valid().to_pylist(), ends.tolist(), sizes.tolist(), strict=True)], pa.binary())

    return encode


def _entry(type_name: str, count: Column, data: Column) -> Column:
    return F.struct(F.lit(TYPE[type_name]).alias("type_code"), count.cast("decimal(20,0)").alias("count"), data.alias("data"))


def scalar(type_name: str, value: Column) -> Column:
    """One number of an integer or float type; count 1."""
    data = write_integer(value, INTEGERS[type_name]) if type_name in INTEGERS else write_float(value, FLOATS[type_name])
    return _entry(type_name, F.lit(1), data)


def array(type_name: str, values: Column) -> Column:
    """A list of numbers of one type; count is its length."""
    if type_name in INTEGERS:
        width = INTEGERS[type_name]
        data = F.unhex(F.array_join(F.transform(values, lambda x: hex_of_integer(x, width)), ""))
    else:
        data = _float_list_bytes(FLOATS[type_name])(values.cast("array<double>"))
    return _entry(type_name, F.size(values), data)


def repeated(type_name: str, value: Column, n: Column) -> Column:
    """As array() of ``n`` equal integers, which are encoded once."""
    return _entry(type_name, n, F.unhex(F.repeat(hex_of_integer(value, INTEGERS[type_name]), n.cast("int"))))


def rational(type_name: str, numerator: Column, denominator: Column) -> Column:
    """RATIONAL or SRATIONAL: two numbers of 4 bytes; count 1."""
    return _entry(type_name, F.lit(1), F.unhex(F.concat(hex_of_integer(numerator, 4), hex_of_integer(denominator, 4))))


def rationals(type_name: str, pairs: Column) -> Column:
    """A list of STRUCT<num, den>."""
    data = F.unhex(F.array_join(F.transform(pairs, lambda p: F.concat(hex_of_integer(p["num"], 4), hex_of_integer(p["den"], 4))), ""))
    return _entry(type_name, F.size(pairs), data)


def text(value: Column) -> Column:
    """ASCII with a closing NUL, count one more than the bytes; other text gives no bytes but the same count."""
    plain = (F.octet_length(value) == F.length(value)) & (F.position(F.lit("\u0000"), value) == 0)
    data = F.when(plain, F.concat(F.encode(value, "UTF-8"), F.unhex(F.lit("00")))).otherwise(F.unhex(F.lit("")))
    return _entry("ASCII", F.octet_length(value) + 1, data)


def text_value(value: Column) -> Column:
    """As text(), but any text keeps its bytes."""
    return _entry("ASCII", F.octet_length(value) + 1, F.concat(F.encode(value, "UTF-8"), F.unhex(F.lit("00"))))


def entry_list(entries: Column) -> Column:
    """STRUCT<entry, error>: encoded values of one type as one entry; none or several types give InvalidTag."""
    types = F.array_distinct(F.transform(entries, lambda e: e["type_code"]))
    total = F.aggregate(entries, F.lit(0).cast("decimal(20,0)"), lambda s, e: (s + e["count"]).cast("decimal(20,0)"))
    data = F.unhex(F.array_join(F.transform(entries, lambda e: F.hex(e["data"])), ""))
    joined = F.struct(F.element_at(types, 1).alias("type_code"), total.alias("count"), data.alias("data"))
    good = F.size(types) == 1
    return F.struct(F.when(good, joined).alias("entry"), F.when(~good, F.lit("InvalidTag")).alias("error"))


def n_bytes(entry: Column) -> Column:
    return F.octet_length(entry["data"])


def zeroed(size, count: Column) -> Column:
    """A buffer for ``count`` elements of ``size`` bytes."""
    return F.unhex(F.repeat(F.lit("00"), (as_column(size) * count).cast("int")))


def directory(entries: list[tuple[Column, Column]], little: bool = True, big: bool = False) -> Column:
    """The bytes of a directory of (tag, entry) with inline values, each padded to its field, and a next pointer of 0."""
    field = 8 if big else 4
    parts = [write_integer(F.lit(len(entries)), 8 if big else 2, little)]
    for tag, e in entries:
        parts += [write_integer(tag, 2, little), write_integer(e["type_code"], 2, little), write_integer(e["count"] if big else e["count"].cast("bigint"), 8 if big else 4, little)]
        value = canonical(e["data"], little, swap_unit_of(e["type_code"]))
        parts.append(F.unhex(F.rpad(F.hex(value), 2 * field, "0")))
    return F.concat(*parts, write_integer(F.lit(0), field, little))
