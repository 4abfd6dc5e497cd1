"""Packing documents into sequences of a fixed length by harmonic packing.

Every document becomes its token ids plus one end id, cut into pieces of the
lengths ``capacity // i`` for i = 1, 2, .. 16 and a tail that is shorter than
``capacity // 16``. A piece of length L belongs to the reciprocal-capacity class
i = capacity // L, whose bins all hold exactly i pieces. So where a piece lies
follows from its number within its class alone: number // i is the bin,
number % i * L the offset. Workers number the pieces of hash buckets
independently; only the counts of (class, bucket) meet. What does not fill the
last bin of a class (fewer than i pieces, at most about 11,000 pieces over all
classes, however large the input) is packed by best fit in one task.

Inputs: null text counts as empty (one piece, the end id alone); repeated rows
are packed as often as they occur; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tagframe.llm import common
from tagframe.llm.wordbpe import word_encoder

#: Lengths capacity // 1 .. capacity // RECIPROCALS are cut out exactly; what is shorter stays whole.
RECIPROCALS = 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def cuts(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n ids: the longest reciprocal length that fits, again and again."""
    lengths = [capacity] * (n // capacity)
    rest = n % capacity
    least = capacity // RECIPROCALS
    while rest >= least:
        # capacity // i <= rest for the smallest such i
        i = capacity // (rest + 1) + 1
        while capacity // i > rest:
            i += 1
        lengths.append(capacity // i)
        rest -= capacity // i
    return lengths + [rest] * (rest > 0)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece; ``ids`` (little-endian unsigned 32-bit) is null unless keep_ids."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        try:
            for batch in batches:
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, data in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    data += end
                    n, start = len(data) // 4, 0
                    for length in cuts(n, capacity):
                        part = data[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (doc_id, start, length, zlib.crc32(part), n, part if keep_ids else None), strict=True):
                            column.append(value)
                        start += length
                yield pa.record_batch([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        finally:
            encode.forget()
            common.release()

    return docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).mapInArrow(cut, PIECES)


def best_fit(capacity: int):
    """Packs the rest of all classes, longest piece first, into the fullest bin that has room."""

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"], r["start"], r["ids_crc32"]))
        room: list[tuple[int, int]] = []  # (free ids, bin), sorted
        bins = 0
        for row in rows:
            k = bisect.bisect_left(room, (row["length"], -1))
            if k == len(room):
                free, number = capacity, bins
                bins += 1
            else:
                free, number = room.pop(k)
            row["sequence_id"], row["offset"] = number, capacity - free
            if free > row["length"]:
                bisect.insort(room, (free - row["length"], number))
        return pa.Table.from_pylist(rows, schema=pa.schema([*table.schema, ("sequence_id", pa.int64()), ("offset", pa.int64())]))

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, keep_ids: bool = False, buckets: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece.

    ``buckets``: hash buckets in which pieces of a class are numbered; 0 takes
    four for each shuffle partition.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * common.shuffle_width(spark)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    cut = common.stage(pieces(docs, tokenizer, capacity, end_id, keep_ids).select(*columns), "pieces")
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    per_bin = F.floor(F.lit(capacity) / F.col("length")).cast("long")

    # Joined by (length, bucket), by which the pieces are numbered anyway.
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_class = W.partitionBy("length")
    counts = counts.select(
        "length", "bucket",
        (F.sum("n").over(by_class.orderBy("bucket")) - F.col("n")).alias("before"),
        F.sum("n").over(by_class).alias("total"),
    )
    counts = common.stage(counts, "class-counts")
    classes = counts.groupBy("length").agg(F.first("total").alias("total")).withColumn("bins", F.floor(F.col("total") / per_bin).cast("long"))
    # A row for each class: capacity / RECIPROCALS + RECIPROCALS at most.
    classes = classes.select("length", F.coalesce(F.sum("bins").over(W.orderBy("length").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first_bin"), "bins")
    counts = counts.join(F.broadcast(classes), "length").drop("total")

    number = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    numbered = dealt.withColumn("number", number).join(counts, ["length", "bucket"]).withColumn("number", F.col("number") + F.col("before"))
    in_bin = F.floor(F.col("number") / per_bin).cast("long")
    numbered = numbered.withColumn("bin", in_bin)
    full = numbered.where("bin < bins").select(
        *columns, (F.col("first_bin") + F.col("bin")).alias("sequence_id"), ((F.col("number") - F.col("bin") * per_bin) * F.col("length")).alias("offset")
    )
    rest = numbered.where("bin >= bins").select(*columns)
    fields = [*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    rest = rest.groupBy(F.lit(0).alias("all")).applyInArrow(drop_key(best_fit(capacity)), T.StructType(fields))
    bins = classes.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("full_bins"))
    rest = rest.join(F.broadcast(bins)).select(*columns, (F.col("sequence_id") + F.col("full_bins")).alias("sequence_id"), "offset")
    return full.unionByName(rest)


def drop_key(f):
    """applyInArrow hands over the grouping column as well when it is a constant."""

    def g(table: pa.Table) -> pa.Table:
        return f(table.drop_columns([c for c in ("all",) if c in table.column_names]))

    return g


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence of a table packed with keep_ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(parts, "")).alias("ids"))


def padding(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """n_sequences, tokens and padding; a sequence whose length is a power of two needs none."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    pad = F.when(F.bit_count("filled") == 1, F.lit(0)).otherwise(F.lit(capacity) - F.col("filled"))
    return filled.agg(F.count("*").alias("n_sequences"), F.sum("filled").alias("tokens"), F.sum(pad).alias("padding"))
