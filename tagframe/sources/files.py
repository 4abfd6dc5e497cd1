"""Files as rows: headers, the chain of directories, and byte ranges of their content.

``spark.read.format("binaryFile")`` lists and reads files on any file system that Spark
reaches; a filter on path or length is pushed into it, and ``content`` is not read
unless a column needs it. Files of 2 GiB and more need ``byte_ranges``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.functions import binary as B
from tagframe.operators import directory

NO_SIGNATURE, BAD_SIGNATURE, CYCLE = "TiffSignatureNotFound", "TiffSignatureInvalid", "CycleInOffsets"


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """file_id (the path), length, content."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("file_id"), "length", "content")


def range_bytes(content: Column, start: Column, n: Column) -> Column:
    """Bytes start .. start + n of a file, null where it ends before. Directories, values and image data alike."""
    return directory.byte_range(content, B.as_column(start), B.as_column(n))


def with_header(files: DataFrame) -> DataFrame:
    """files with little_endian, bigtiff, first_ifd and error, from the first 16 bytes of content."""
    head = F.substring(F.col("content"), F.lit(1), F.lit(16))
    mark = F.hex(F.substring(head, F.lit(1), F.lit(2)))
    little = F.when(mark == "4949", True).when(mark == "4D4D", False)
    version = F.when(little, B.read_unsigned(head, 2, 2, True)).otherwise(B.read_unsigned(head, 2, 2, False))
    either = lambda at, width: F.when(little, B.read_unsigned(head, at, width, True)).otherwise(B.read_unsigned(head, at, width, False))
    big = version == 43
    widths_good = ~big | ((either(4, 2) == 8) & (either(6, 2) == 0))
    first = F.when(big, either(8, 8)).otherwise(either(4, 4).cast(B.U64))
    error = F.when(little.isNull(), F.lit(NO_SIGNATURE)).when(~F.coalesce(version.isin(42, 43) & widths_good, F.lit(False)), F.lit(BAD_SIGNATURE)).when(first.isNull(), F.lit(directory.SHORT))
    good = error.isNull()
    return files.withColumns({"little_endian": F.when(good, little), "bigtiff": F.when(good, big), "first_ifd": F.when(good, first), "error": error})


def chain(content: Column, first: Column, little: Column, big: bool) -> Column:
    """STRUCT<offsets: array<bigint>, stop, error>: offsets of the directories, each giving that of the next.

    The walk ends at offset 0, at an offset met before (CycleInOffsets), or where the
    file ends (IoError); ``stop`` is the offset that could not be followed. As no offset
    is followed twice, a file's length bounds the number of directories.
    """
    head, stride, width = (8, 20, 8) if big else (2, 12, 4)

    def step(state: Column, _: Column) -> Column:
        # The optimiser may run this on files of the other kind before they are filtered out, so no cast may fail.
        at = state["next"]
        place = at.try_cast("int")
        n = B.read_unsigned(content, place, head, little).try_cast("int").cast("bigint")
        following = B.read_unsigned(content, (place.cast("bigint") + head + n * stride).try_cast("int"), width, little).cast("decimal(20,0)")
        error = F.when(F.array_contains(state["offsets"], at), F.lit(CYCLE)).when(n.isNull(), F.lit(directory.SHORT))

        def moved(x: Column) -> Column:
            return F.struct(
                F.when(x["error"].isNull(), F.concat(state["offsets"], F.array(at))).otherwise(state["offsets"]).alias("offsets"),
                F.when(x["error"].isNull(), F.coalesce(x["following"], F.lit(0))).otherwise(F.lit(0)).cast("decimal(20,0)").alias("next"),
                F.when(x["error"].isNotNull(), at).alias("stop"),
                F.coalesce(x["error"], F.when(x["following"].isNull(), F.lit(directory.SHORT))).alias("error"),
            )

        return B.let(F.struct(error.alias("error"), following.alias("following")), moved)

    def going(state: Column) -> Column:
        return (state["next"] != 0) & state["error"].isNull()

    start = F.struct(
        F.array().cast("array<decimal(20,0)>").alias("offsets"),
        F.coalesce(first.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("next"),
        F.lit(None).cast("decimal(20,0)").alias("stop"),
        F.lit(None).cast("string").alias("error"),
    )
    # Rounds of as many steps as there are rounds: short chains end in the first and pass over the others.
    side = F.ceil(F.sqrt(F.octet_length(content) + 1)).cast("int")
    steps = F.sequence(F.lit(1), F.coalesce(side, F.lit(1)))
    walk = lambda state, _: F.when(going(state), F.aggregate(steps, state, lambda s, i: F.when(going(s), step(s, i)).otherwise(s))).otherwise(state)
    return F.aggregate(steps, start, walk, lambda s: F.struct(s["offsets"].alias("offsets"), s["stop"].alias("stop"), s["error"].alias("error")))


def ifds(files: DataFrame) -> DataFrame:
    """A row per directory: file_id, ifd_index, ifd_offset, little_endian, bigtiff, buf (its bytes), error.

    A file with a bad header, and a chain that ends too early, give a last row with the error and without buf.
    """
    parts = [files.where("error IS NOT NULL").select("file_id", F.lit(0).alias("ifd_index"), F.lit(None).cast("decimal(20,0)").alias("ifd_offset"), "little_endian", "bigtiff", F.lit(None).cast("binary").alias("buf"), "error")]
    good = files.where("error IS NULL")
    for big in (False, True):
        some = good.where(F.col("bigtiff") == F.lit(big))
        walked = some.withColumn("_walk", chain(F.col("content"), F.col("first_ifd"), F.col("little_endian"), big))
        found = F.transform("_walk.offsets", lambda at: F.struct(at.alias("at"), F.lit(None).cast("string").alias("error")))
        last = F.when(F.col("_walk.error").isNotNull(), F.array(F.struct(F.col("_walk.stop").alias("at"), F.col("_walk.error").alias("error")))).otherwise(F.array().cast("array<struct<at:decimal(20,0),error:string>>"))
        # The bytes of each directory, not the file, go to the rows.
        cut = F.transform(F.concat(found, last), lambda d: F.struct(d["at"].alias("at"), F.when(d["error"].isNull(), directory.directory_bytes(F.col("content"), d["at"], F.col("little_endian"), big)).alias("buf"), d["error"].alias("error")))
        rows = walked.select("file_id", "little_endian", "bigtiff", F.posexplode(cut).alias("ifd_index", "_d"))
        parts.append(rows.select("file_id", "ifd_index", F.col("_d.at").alias("ifd_offset"), "little_endian", "bigtiff", F.col("_d.buf").alias("buf"), F.col("_d.error").alias("error")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def entries(directories: DataFrame) -> DataFrame:
    """The entries of ifds(), classic and big; a row of ifds() with an error is one here, without an entry."""
    keys = ["file_id", "ifd_index"]
    good = directories.where("error IS NULL")
    both = [directory.parse_directories(good.where(F.col("bigtiff") == F.lit(big)), keys, "buf", F.col("little_endian"), big) for big in (False, True)]
    return both[0].unionByName(both[1]).unionByName(directories.where("error IS NOT NULL").select(*keys, "error"), allowMissingColumns=True)


def chunk_bytes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks with their stored bytes (null where the file ends before); image data stays compressed.

    The chunks of a file are gathered, so its content meets them once.
    """
    names = chunks.columns
    of_file = chunks.groupBy("file_id").agg(F.collect_list(F.struct(*[n for n in names if n != "file_id"])).alias("_chunks"))
    joined = of_file.join(files.select("file_id", "content"), "file_id")
    cut = F.transform("_chunks", lambda c: F.struct(c.alias("c"), range_bytes(F.col("content"), c["offset"], c["byte_count"]).alias("bytes")))
    rows = joined.select("file_id", F.explode(cut).alias("_c"))
    return rows.select(*["file_id" if n == "file_id" else F.col(f"_c.c.{n}").alias(n) for n in names], F.col("_c.bytes").alias("bytes"))
