"""Wire formats: the table of known entries, odd entries, round trips of all types."""

from __future__ import annotations

import random
import re
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagframe.functions import binary, catalog, convert, encode
from tagframe.operators import directory, image

FIXTURES = Path(__file__).resolve().parent.parent / "FIXTURES.md"
ROW = re.compile(r"^\| (\d+) \| (classic|big) \| (LE|BE) \| `([0-9a-f]+)` \| (\w+) \| (\d+) \| (.*) \|$")
KNOWN = [m.groups() for line in FIXTURES.read_text().splitlines() if (m := ROW.match(line))]


def expected_of(text: str):
    if text.startswith("offset "):
        return ("offset", int(text[7:]))
    if text.startswith('"'):
        return ("text", text[1:-1])
    return ("bits" if text.startswith("bits") else "numbers", [int(x) for x in re.findall(r"-?\d+", text)])


def check_known(rows):
    for r in rows:
        kind, value = expected_of(r["expected"])
        assert r["error"] is None and r["type_code"] == catalog.TYPE[r["type"]] and int(r["count"]) == int(r["n"]), r
        if kind == "offset":
            assert (r["is_inline"], int(r["offset"]), r["data"]) == (False, value, None), r
            continue
        data = bytes(r["data"])
        assert r["is_inline"] and r["offset"] is None
        if kind == "text":
            assert r["text"]["value"] == value, r
            continue
        width = catalog.TYPES[[t[0] for t in catalog.TYPES].index(r["type"])][3]
        assert [int.from_bytes(data[k : k + width], "big") for k in range(0, len(data), width)] == value, r


def test_there_are_121_known_entries():
    assert len(KNOWN) == 121


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("in_directory", [False, True])
def test_known_entries(spark, big, in_directory):
    chosen = [(k[0], k[2] == "LE", bytes.fromhex(k[3]), k[4], k[5], k[6]) for k in KNOWN if (k[1] == "big") == big]
    df = spark.createDataFrame(chosen, "line string, little boolean, buf binary, type string, n string, expected string")
    if in_directory:
        number = encode.write_integer(F.lit(1), 8 if big else 2, F.col("little"))
        tag = encode.write_integer(F.lit(257), 2, F.col("little"))
        df = df.withColumn("buf", F.concat(number, tag, "buf"))
        keys = ["line", "type", "n", "expected"]
        e = directory.parse_directories(df, keys, "buf", F.col("little"), big)
        assert {r["tag"] for r in e.select("tag").collect()} == {257}
    else:
        e = directory.parse_entry(df, F.col("buf"), F.col("little"), big)
    rows = e.withColumn("text", convert.to_text(directory.entry())).collect()
    assert len(rows) == len(chosen)
    check_known(rows)


def parse_one(spark, buf: bytes, big: bool, little: bool = True):
    df = spark.createDataFrame([(buf,)], "buf binary")
    return directory.parse_entry(df, F.col("buf"), little, big).first()


def wire(type_code: int, count: int, field: bytes, big: bool) -> bytes:
    return struct.pack("<HQ" if big else "<HI", type_code, count) + field


def test_odd_entries(spark):
    assert parse_one(spark, wire(16, 1, (42).to_bytes(8, "little"), True), True)["is_inline"]
    assert int(parse_one(spark, wire(16, 1, (42).to_bytes(4, "little"), False), False)["offset"]) == 42
    for code, big in ((13, False), (18, True), (13, True)):
        assert parse_one(spark, wire(code, 1, bytes([7]) + bytes(7 if big else 3), big), big)["is_inline"] is False
    for code in (0, 14, 15, 19):
        assert parse_one(spark, wire(code, 1, bytes(4), False), False)["error"] == f"InvalidTagValueType({code})"
    assert parse_one(spark, wire(12, 1 << 62, bytes(8), True), True)["error"] == "LimitsExceeded"
    assert parse_one(spark, b"\x03\x00\x01", False)["error"] == "IoError"
    assert parse_one(spark, wire(3, 1, b"\x01", False), False)["error"] == "IoError"
    none = parse_one(spark, wire(3, 0, bytes(4), False), False)
    assert none["is_inline"] and bytes(none["data"]) == b""


def test_several_entries_and_fail_fast(spark):
    first = struct.pack("<HHIHxx", 256, 3, 1, 500)
    second = struct.pack("<HHII", 257, 4, 1, 70000)
    df = spark.createDataFrame([(1, struct.pack("<H", 2) + first + second + bytes(4)), (2, struct.pack("<H", 0)), (3, b""), (4, None)], "id int, buf binary")
    rows = directory.parse_directories(df, ["id"], "buf", True, False).orderBy("id", "entry_pos").collect()
    assert [(r["id"], r["tag"], r["error"]) for r in rows] == [(1, 256, None), (1, 257, None), (3, None, "IoError"), (4, None, "IoError")]
    assert [bytes(r["data"]) for r in rows[:2]] == [b"\x01\xf4", b"\x00\x01\x11\x70"]
    with pytest.raises(Exception, match="IoError"):
        directory.parse_directories(df, ["id"], "buf", True, False, "FAILFAST").collect()


def values_of(kind: str, rng: random.Random):
    size = {"BYTE": 8, "UNDEFINED": 8, "SHORT": 16, "LONG": 32, "IFD": 32, "LONG8": 64, "IFD8": 64}.get(kind)
    if size:
        return [0, (1 << size) - 1, rng.getrandbits(size)]
    size = {"SBYTE": 8, "SSHORT": 16, "SLONG": 32, "SLONG8": 64}[kind]
    return [-(1 << (size - 1)), (1 << (size - 1)) - 1, rng.getrandbits(size) - (1 << (size - 1))]


@pytest.mark.parametrize("kind", sorted(encode.INTEGERS))
def test_integers_round_trip(spark, kind):
    values = values_of(kind, random.Random(kind))
    signed = kind.startswith("S") and kind != "SHORT"
    bits = 8 * encode.INTEGERS[kind]
    df = spark.createDataFrame([(str(v),) for v in values], "s string").select(F.col("s").cast("bigint" if signed else "decimal(20,0)").alias("v"))
    e = encode.scalar(kind, F.col("v"))
    rows = df.select("v", convert.to_values(e).alias("x"), binary.read_signed(encode.write_integer(F.col("v"), bits // 8, True), 0, bits // 8, True).alias("le")).collect()
    for r in rows:
        if kind.startswith("IFD"):
            assert r["x"]["error"] == "IfdReadIntoEntry"
        else:
            got = r["x"]["value"][0]
            assert int(got["i"] if signed else got["u"]) == int(r["v"])
        assert r["le"] % (1 << bits) == int(r["v"]) % (1 << bits)


def test_floats_of_all_kinds(spark):
    rng = random.Random(5)
    doubles = [0.0, -0.0, 1.5, -2.25e300, 5e-324, 2.2250738585072014e-308, float("inf"), float("-inf"), *(struct.unpack(">d", rng.randbytes(8))[0] for _ in range(200))]
    singles = [struct.unpack(">f", rng.randbytes(4))[0] for _ in range(200)] + [1e-45, 3.4028234663852886e38]
    df = spark.createDataFrame([(struct.pack(">d", d), struct.pack(">f", s)) for d, s in zip(doubles[:200], singles, strict=False)], "d binary, s binary")
    for r in df.select("d", "s", binary.read_float(F.col("d"), 0, 8).alias("x"), binary.read_float(F.col("s"), 0, 4).alias("y")).collect():
        want_d, want_s = struct.unpack(">d", r["d"])[0], struct.unpack(">f", r["s"])[0]
        assert (r["x"] == want_d) or (r["x"] != r["x"] and want_d != want_d)
        assert (r["y"] == want_s) or (r["y"] != r["y"] and want_s != want_s)
    back = spark.createDataFrame([(d,) for d in doubles if d == d], "v double").select("v", encode.write_float(F.col("v"), 8).alias("b"), encode.write_float(F.col("v"), 8, True).alias("l")).collect()
    for r in back:
        assert bytes(r["b"]) == struct.pack(">d", r["v"]) and bytes(r["l"]) == struct.pack("<d", r["v"])


def entry_of(type_name: str, count: int, data: bytes):
    return F.struct(F.lit(catalog.TYPE[type_name]).alias("type_code"), F.lit(count).cast("decimal(20,0)").alias("count"), F.unhex(F.lit(data.hex())).alias("data"))


@pytest.mark.parametrize(
    ("entry", "conversion", "value", "error"),
    [
        (("ASCII", 8, b"\0AB\0C\0\0\0"), convert.to_text, "AB\0C", None),
        (("ASCII", 2, b"AB"), convert.to_text, None, "InvalidTag"),
        (("ASCII", 2, b"\xc3\0"), convert.to_text, None, "InvalidTag"),
        (("SHORT", 2, bytes(4)), convert.to_text, None, "InconsistentSizesEncountered"),
        (("SHORT", 1, b"\0"), convert.to_text, None, "AsciiExpected"),
        (("FLOAT", 1, bytes(4)), lambda e: convert.get_u64(e, 5), None, "LimitsExceeded"),
        (("FLOAT", 1, bytes(4)), lambda e: convert.get_u64(e, 0), None, "UnsignedIntegerExpected"),
        (("BYTE", 5, bytes([42, 43, 44, 45, 46])), lambda e: convert.get_u64(e, 2), 44, None),
        (("LONG", 1, bytes(4)), lambda e: convert.to_slice(e, "u16"), None, "InconsistentSizesEncountered"),
        (("RATIONAL", 1, struct.pack(">II", 1, 2)), convert.display, "0.500", None),
        (("RATIONAL", 1, struct.pack(">II", 1, 20)), convert.display, "0.050", None),
        (("RATIONAL", 1, struct.pack(">II", 4, 2)), convert.display, "2", None),
        (("RATIONAL", 1, struct.pack(">II", 2, 3)), convert.display, "0.666", None),
        (("RATIONAL", 1, struct.pack(">II", 2, 0)), convert.display, None, "DivisionByZero"),
        (("SRATIONAL", 1, struct.pack(">ii", -1, 3)), convert.display, "-1/3", None),
        (("SHORT", 2, bytes(4)), convert.display, None, "ListHasNoDisplay"),
        (("BYTE", 43, bytes([42] * 43)), lambda e: convert.to_slice(e, "u8"), [42] * 43, None),
        (("SHORT", 1, struct.pack(">H", 300)), lambda e: convert.to_unsigned(e, 8), None, "IntSizeError"),
        (("DOUBLE", 1, struct.pack(">d", 1.5)), convert.to_vec_f32, None, "FloatExpected"),
        (("DOUBLE", 1, struct.pack(">d", 1.5)), convert.to_f32, None, "FloatExpected"),
        (("FLOAT", 1, struct.pack(">f", 1.5)), convert.to_f64, 1.5, None),
    ],
)
def test_conversions(spark, entry, conversion, value, error):
    got = spark.range(1).select(conversion(entry_of(*entry)).alias("x")).first()["x"]
    assert (got["value"], got["error"]) == (value, error)


def test_text_encoding(spark):
    df = spark.createDataFrame([("é",), ("a\0b",), ("ok",), ("",)], "t string")
    rows = [(int(r["e"]["count"]), bytes(r["e"]["data"])) for r in df.select(encode.text(F.col("t")).alias("e")).collect()]
    assert rows == [(3, b""), (4, b""), (3, b"ok\0"), (1, b"\0")]


def test_swapping_keeps_a_ragged_end(spark):
    data = F.unhex(F.lit("010203"))
    got = spark.range(1).select(*[binary.fix_endianness(data, True, F.lit(d)).alias(f"d{d}") for d in (8, 16, 32, 64)]).first()
    assert [bytes(x).hex() for x in got] == ["010203", "020103", "010203", "010203"]


def test_lists_of_values(spark):
    one, other = encode.scalar("SHORT", F.lit(1)), encode.scalar("LONG", F.lit(1))
    got = spark.range(1).select(convert.list_type(F.array(F.lit(3), F.lit(4))).alias("mixed"), convert.list_type(F.array().cast("array<int>")).alias("none"), encode.entry_list(F.array(one, other))["error"].alias("error")).first()
    assert tuple(got) == (7, 7, "InvalidTag")


def test_elements_are_not_cut_out_of_a_column(spark):
    """A row copies all bytes of a list whenever they are read, so that must not happen for each element."""
    entries = spark.range(3).select("id", encode.array("LONG8", F.sequence(F.lit(0).cast("bigint"), F.col("id"))).alias("e"))
    got = entries.select("id", image.unsigned_list(F.col("e")).alias("x"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"substring\((\w+)", plan) == ["lambda"]
    assert [[int(v) for v in r["x"]["value"]] for r in got.orderBy("id").collect()] == [[0], [0, 1], [0, 1, 2]]


def test_chunk_lists_are_decoded_in_pages(spark):
    """1,100 strips, so three pages, with offsets up to 2^64 - 1; elements of every width."""
    n = 1100
    offsets = [(1 << 64) - 1 - k if k % 3 == 0 else k for k in range(n)]
    tags = [(256, "SHORT", [40]), (257, "LONG", [n]), (262, "SHORT", [1]), (278, "SHORT", [1]), (273, "LONG8", offsets)]
    sizes = {1: ("BYTE", [k % 256 for k in range(n)]), 2: ("SHORT", [60 * k % 65536 for k in range(n)]), 3: ("LONG", [3900000 * k for k in range(n)])}
    wide = {"BYTE": 1, "SHORT": 2, "LONG": 4, "LONG8": 8}
    made = [(k, pos, tag, catalog.TYPE[t], str(len(v)), b"".join(x.to_bytes(wide[t], "big") for x in v)) for k, s in sizes.items() for pos, (tag, t, v) in enumerate([*tags, (279, *s)])]
    e = spark.createDataFrame(made, "k int, entry_pos int, tag int, type_code int, count string, data binary").withColumns({"count": F.col("count").cast("decimal(20,0)"), "offset": F.lit(None).cast("decimal(20,0)")})
    found = image.chunks(image.images(e, ["k"], layout=True), ["k"])
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    rows = found.orderBy("k", "chunk").collect()
    assert [(r["k"], r["chunk"], r["row"], r["col"], r["plane"], int(r["offset"]), int(r["byte_count"])) for r in rows] == [(k, i, i, 0, 0, offsets[i], v[i]) for k, (_, v) in sizes.items() for i in range(n)]
