"""Headers, chains of directories, streams and byte ranges, over files written here."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from tagframe.functions import geometry
from tagframe.operators import directory
from tagframe.sources import files
from tagframe.sources.byte_ranges import DirectorySource
from tagframe.streaming.files import stream_entries


def classic(order: str, widths: list[int], last_to_first: bool = False) -> bytes:
    mark = b"II" if order == "<" else b"MM"
    out = mark + struct.pack(order + "HI", 42, 8)
    for k, w in enumerate(widths):
        start = len(out)
        after = start + 2 + 24 + 4
        following = 0 if k == len(widths) - 1 else after + 4
        if last_to_first and not following:
            following = 8
        out += struct.pack(order + "H", 2) + struct.pack(order + "HHII", 256, 4, 1, w) + struct.pack(order + "HHII", 270, 2, 4 + 4, after - 4) + struct.pack(order + "I", following)
        out += b"abc\0"
    return out


def big(widths: list[int]) -> bytes:
    out = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16)
    for k, w in enumerate(widths):
        following = 0 if k == len(widths) - 1 else len(out) + 8 + 20 + 8
        out += struct.pack("<Q", 1) + struct.pack("<HHQQ", 256, 16, 1, w) + struct.pack("<Q", following)
    return out


def write(folder):
    (folder / "a.tif").write_bytes(classic("<", [10, 20]))
    (folder / "b.tif").write_bytes(classic(">", [30]))
    (folder / "c.tif").write_bytes(big([40, 50, 60]))
    (folder / "d.tif").write_bytes(classic("<", [70, 80], last_to_first=True))
    (folder / "e.tif").write_bytes(b"nothing")
    (folder / "f.tif").write_bytes(b"II\x2b\0\x04\0\0\0")


def short(rows, *names):
    return sorted(tuple(r[n] if n != "file_id" else r[n].rsplit("/", 1)[1] for n in names) for r in rows)


def test_files(spark, tmp_path):
    write(tmp_path)
    f = files.with_header(files.read_files(spark, str(tmp_path), "*.tif"))
    assert short(f.where("error IS NOT NULL").collect(), "file_id", "error") == [("e.tif", files.NO_SIGNATURE), ("f.tif", files.BAD_SIGNATURE)]
    e = files.entries(files.ifds(f))
    widths = e.where("tag = 256").select("file_id", "ifd_index", F.conv(F.hex("data"), 16, 10).cast("int").alias("w")).collect()
    expected = [("a.tif", 0, 10), ("a.tif", 1, 20), ("b.tif", 0, 30), ("c.tif", 0, 40), ("c.tif", 1, 50), ("c.tif", 2, 60), ("d.tif", 0, 70), ("d.tif", 1, 80)]
    assert short(widths, "file_id", "ifd_index", "w") == expected
    cycle = f.where("NOT bigtiff").select("file_id", files.chain(F.col("content"), F.col("first_ifd"), F.col("little_endian"), False)["error"].alias("error")).where("error IS NOT NULL")
    assert short(cycle.collect(), "file_id", "error") == [("d.tif", files.CYCLE)]
    loaded = directory.load_deferred(e.join(f.select("file_id", "content", "little_endian"), "file_id").where("tag = 270"), F.col("content"), F.col("little_endian"))
    assert {(r["error"], bytes(r["data"])[-4:]) for r in loaded.where("file_id LIKE '%b.tif'").collect()} == {(None, b"abc\0")}


def test_byte_ranges(spark, tmp_path):
    write(tmp_path)
    spark.dataSource.register(DirectorySource)
    d = spark.read.format("tag_directories").option("path", f"{tmp_path}/*.tif").load()
    found = short(d.where("error IS NULL").collect(), "file_id", "ifd_index")
    assert found == [("a.tif", 0), ("a.tif", 1), ("b.tif", 0), ("c.tif", 0), ("c.tif", 1), ("c.tif", 2), ("d.tif", 0), ("d.tif", 1)]
    assert short(d.where("error IS NOT NULL").collect(), "file_id", "error") == [("d.tif", "CycleInOffsets"), ("e.tif", "TiffSignatureNotFound"), ("f.tif", "TiffSignatureInvalid")]
    entries = files.entries(d.where("error IS NULL"))
    assert entries.where("tag = 256").count() == 8


def test_byte_ranges_of_a_long_chain(spark, tmp_path):
    (tmp_path / "long.tif").write_bytes(big(list(range(70))))
    spark.dataSource.register(DirectorySource)
    d = spark.read.format("tag_directories").option("path", f"{tmp_path}/*.tif").load()
    assert d.where("error IS NULL").count() == 70 and d.count() == 70


def test_broken_files(spark, tmp_path):
    """Both readers give the same rows: chains that end early, offsets beyond any file, counts that no file can hold."""
    (tmp_path / "far.tif").write_bytes(b"II\x2b\0\x08\0\0\0" + b"\xff" * 8)
    (tmp_path / "many.tif").write_bytes(b"II\x2b\0\x08\0\0\0" + struct.pack("<Q", 16) + b"\xff" * 8 + b"rest")
    (tmp_path / "cut.tif").write_bytes(classic("<", [10])[:-6])
    (tmp_path / "loop.tif").write_bytes(classic("<", [10, 20], last_to_first=True))
    (tmp_path / "short.tif").write_bytes(b"MM\0\x2a\0\0")
    spark.dataSource.register(DirectorySource)
    ranges = spark.read.format("tag_directories").option("path", str(tmp_path)).option("files_per_partition", 2).load()
    whole = files.ifds(files.with_header(files.read_files(spark, str(tmp_path), "*.tif")))
    names = ("file_id", "ifd_index", "error")
    expected = [("cut.tif", 0, None), ("cut.tif", 1, "IoError"), ("far.tif", 0, "IoError"), ("loop.tif", 0, None), ("loop.tif", 1, None), ("loop.tif", 2, "CycleInOffsets")]
    assert [r for r in short(whole.where("file_id NOT LIKE '%many%'").collect(), *names) if r[0] != "short.tif"] == expected
    assert [r for r in short(ranges.where("file_id NOT LIKE '%many%'").collect(), *names) if r[0] != "short.tif"] == expected
    assert short(ranges.where("file_id LIKE '%short%' OR file_id LIKE '%many%'").collect(), *names) == [("many.tif", 0, None), ("many.tif", 1, "IoError"), ("short.tif", 0, "IoError")]
    # Each of them keeps what there is of the entries.
    assert files.entries(whole).where("file_id LIKE '%loop%' AND tag = 256").count() == 2
    assert files.entries(whole).where("error IS NOT NULL").count() >= 4


def test_byte_ranges_of_uris(spark, tmp_path):
    write(tmp_path)
    spark.dataSource.register(DirectorySource)
    d = spark.read.format("tag_directories").option("path", f"file://{tmp_path}/[ab].tif").load()
    assert d.where("error IS NULL").count() == 3
    assert spark.read.format("tag_directories").option("path", f"{tmp_path}/none/*.tif").load().count() == 0


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder)
    q = stream_entries(spark, str(folder)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrived").where("tag = 256").count() == 8


def test_geometry(spark):
    n = lambda v: F.lit(v).cast("bigint")
    pad = lambda t, w, h, a, b: geometry.tile_padding(n(t), n(w), n(h), n(a), n(b))
    row = spark.range(1).select(
        geometry.tiles_across(n(1000), n(256)), geometry.tiles_down(n(600), n(256)),
        *[pad(t, 1000, 600, 256, 256).alias(f"t{t}") for t in (3, 8, 11, 0)], pad(3, 512, 512, 256, 256).alias("even"),
    ).first()
    assert tuple(row[:2]) == (4, 3)
    assert [tuple(x) for x in row[2:]] == [(24, 0), (0, 168), (24, 168), (0, 0), (0, 0)]
