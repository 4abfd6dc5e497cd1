"""Directories of tag entries, as a long table with one row per entry.

Parsing is a projection and one Generate over the entry numbers: entry k lies at
header + k * stride, so no cursor is needed and rows are independent. Lookups are
joins with the directories asked for times a literal list of at most a few dozen
tags; both sides grow with the input, so neither is ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagframe.functions import binary as B
from tagframe.functions.catalog import OFFSET_TYPES, name_or_unknown, size_of, swap_unit_of

MOST_U64 = str((1 << 64) - 1)
LIMITS, SHORT = "LimitsExceeded", "IoError"
ENTRY_COLUMNS = ("entry_pos", "tag", "type_code", "count", "is_inline", "offset", "data", "error")


def parse_fields(h: Column, little, big: bool) -> Column:
    """STRUCT<type_code, count, is_inline, offset, data, error> of an entry from the hex of what follows its tag; it may end early."""
    width = 8 if big else 4

    def number(at: int, n: int) -> Column:
        digits = F.substring(h, 2 * at + 1, 2 * n)
        return F.when(F.length(digits) == 2 * n, B.unsigned(B.ordered(digits, n, little), n))

    code = number(0, 2).cast("int")
    head = F.struct(code.alias("code"), number(2, width).cast(B.U64).alias("count"), F.substring(h, 2 * width + 5, 2 * width).alias("field"))
    return B.let(head, lambda e: B.let(size_of(e["code"]), lambda size: _classified(e["code"], e["count"], e["field"], size, width, little)))


def _classified(code: Column, count: Column, field: Column, size: Column, width: int, little) -> Column:
    n = (count * size.cast(B.U64)).cast("decimal(38,0)")
    error = (
        F.when(code.isNull(), F.lit(SHORT))
        .when(size.isNull(), F.concat(F.lit("InvalidTagValueType("), code.cast("string"), F.lit(")")))
        .when(count.isNull(), F.lit(SHORT))
        .when(n > F.lit(MOST_U64).cast("decimal(38,0)"), F.lit(LIMITS))
        .when(F.length(field) < 2 * width, F.lit(SHORT))
    )
    deferred = (n > width) | code.isin(*OFFSET_TYPES)
    inline = F.substring(field, F.lit(1), F.least(n * 2, F.lit(2 * width)).cast("int"))

    def fields(found: Column) -> Column:
        good, later = found["error"].isNull(), found["deferred"]
        return F.struct(
            code.alias("type_code"),
            count.alias("count"),
            F.when(good, ~later).alias("is_inline"),
            F.when(good & later, B.unsigned(B.ordered(field, width, little), width).cast(B.U64)).alias("offset"),
            F.when(good & ~later, F.unhex(B.canonical_hex(inline, little, swap_unit_of(code)))).alias("data"),
            found["error"].alias("error"),
        )

    return B.let(F.struct(error.alias("error"), deferred.alias("deferred")), fields)


FIELDS = ("type_code", "count", "is_inline", "offset", "data", "error")


def parse_entry(df: DataFrame, buf: Column, little, big: bool) -> DataFrame:
    """``df`` with the fields of the entry at the start of ``buf``, which has no tag before them."""
    width = 8 if big else 4
    kept = [c for c in df.columns if c not in FIELDS]
    found = df.withColumn("_entry", parse_fields(F.hex(F.substring(buf, F.lit(1), F.lit(2 + 2 * width))), little, big))
    return found.select(*kept, *[F.col("_entry")[f].alias(f) for f in FIELDS])


def parse_directories(df: DataFrame, keys: list[str], buf: str, little, big: bool, mode: str = "PERMISSIVE") -> DataFrame:
    """A row for each entry of each directory: keys and ENTRY_COLUMNS.

    ``buf`` holds the directory from its number of entries on; what follows the last
    entry is ignored. A buffer that ends early gives its whole entries and one row
    with IoError. PERMISSIVE keeps errors as rows, FAILFAST raises on the first.
    The Generate gives every row the bytes of its own entry and nothing else of the buffer.
    """
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"unknown mode {mode}")
    head, stride = (8, 20) if big else (2, 12)
    b = F.col(buf)
    n = B.read_unsigned(b, 0, head, little).cast("decimal(20,0)")
    there = F.greatest(F.floor((F.octet_length(b) - head) / stride).cast("int"), F.lit(0))
    # One more than what is there stands for the missing rest.
    shown = F.when(n.isNull(), F.lit(1)).otherwise(F.least(n, (there + 1).cast("decimal(20,0)")).cast("int"))
    at = B.let(shown, lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")))
    slices = F.transform(at, lambda k: F.hex(F.substring(b, k * stride + head + 1, F.lit(stride))))
    order = little if isinstance(little, bool) else F.col("_little")
    kept = [] if isinstance(little, bool) else [little.alias("_little")]
    rows = df.select(*keys, *kept, F.posexplode(F.coalesce(slices, F.array(F.lit("")))).alias("entry_pos", "_hex"))
    tag = F.substring("_hex", 1, 4)
    tag = F.when(F.length(tag) == 4, B.unsigned(B.ordered(tag, 2, order), 2)).cast("int")
    out = rows.select(*keys, "entry_pos", tag.alias("tag"), parse_fields(F.substring("_hex", 5, 2 * stride), order, big).alias("_entry"))
    out = out.select(*keys, "entry_pos", "tag", *[F.col("_entry")[f].alias(f) for f in FIELDS])
    if mode == "FAILFAST":
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("cannot parse entry: "), "error"))))
    return out


def directory_bytes(buf: Column, start, little, big: bool) -> Column:
    """The part of ``buf`` that holds the directory at ``start``."""
    head, stride = (8, 20) if big else (2, 12)
    start = B.as_column(start)
    n = F.coalesce(B.read_unsigned(buf, start, head, little).cast("decimal(20,0)"), F.lit(0))
    length = F.least(n * stride + head, F.lit((1 << 31) - 1)).cast("int")
    return F.substring(buf, (start.cast("decimal(20,0)") + 1).try_cast("int"), length)


def last_of_each_tag(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Of entries with one tag in a directory the last counts. One exchange, with partial maxima before it."""
    fields = [c for c in entries.columns if c not in (*keys, "tag")]
    best = entries.groupBy(*keys, "tag").agg(F.max_by(F.struct(*fields), "entry_pos").alias("_e"))
    return best.select(*keys, "tag", "_e.*")


def wanted(df: DataFrame, entries: DataFrame, keys: list[str], tags: list[int]) -> DataFrame:
    """A row for each directory of ``df`` (keys) and each wanted tag, with the entry if there is one, and ``present``."""
    asked = df.select(*keys, F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag"))
    found = entries.where(F.col("tag").isin(tags)).withColumn("present", F.lit(True))
    return asked.join(found.hint("merge"), [*keys, "tag"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def tag_name(tag: Column) -> Column:
    return name_or_unknown("Tag", tag)


def not_found(tag: Column) -> Column:
    return F.concat(F.lit("RequiredTagNotFound("), tag_name(tag), F.lit(")"))


def not_loaded(tag: Column, type_code: Column, count: Column, offset: Column) -> Column:
    from tagframe.functions.catalog import name_of

    return F.concat(F.lit("RequiredTagNotLoaded("), F.concat_ws(", ", tag_name(tag), name_of("TagType", type_code), count.cast("string"), offset.cast("string")), F.lit(")"))


def _deferred() -> Column:
    return F.col("present") & F.col("data").isNull()


def get_tag(found: DataFrame) -> DataFrame:
    """Rows of wanted() whose tag is there, loaded or not."""
    return found.where("present")


def require_tag(found: DataFrame) -> DataFrame:
    """error RequiredTagNotFound where a tag is absent."""
    return found.withColumn("error", F.when(~F.col("present"), not_found(F.col("tag"))))


def require_tag_value(found: DataFrame) -> DataFrame:
    """As require_tag, and RequiredTagNotLoaded where only an offset is there."""
    missing = F.when(~F.col("present"), not_found(F.col("tag")))
    return found.withColumn("error", missing.when(_deferred(), not_loaded(F.col("tag"), F.col("type_code"), F.col("count"), F.col("offset"))))


def get_tag_value(found: DataFrame) -> DataFrame:
    """No error where a tag is absent; RequiredTagNotLoaded where only an offset is there."""
    return found.withColumn("error", F.when(_deferred(), not_loaded(F.col("tag"), F.col("type_code"), F.col("count"), F.col("offset"))))


def contains_tag(df: DataFrame, entries: DataFrame, keys: list[str], tag: int) -> DataFrame:
    """``df`` keys with ``contains``; one partial aggregation of entries, then a join on the keys."""
    has = entries.groupBy(*keys).agg(F.bool_or(F.col("tag") == tag).alias("contains"))
    return df.select(*keys).join(has.hint("merge"), keys, "left").withColumn("contains", F.coalesce("contains", F.lit(False)))


def upsert(entries: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Entries with the buffers of ``loaded`` (keys, tag, type_code, count, data) put in, whether or not the tag was there.

    Neither type nor count is compared with the entry replaced; that one is returned in old_* columns.
    """
    old = entries.select(*keys, "tag", *[F.col(c).alias(f"old_{c}") for c in ("type_code", "count", "offset", "data")], F.lit(True).alias("existed"))
    new = loaded.select(*keys, "tag", *[F.col(c).alias(f"new_{c}") for c in ("type_code", "count", "data")], F.lit(True).alias("replaced"))
    both = old.join(new, [*keys, "tag"], "full_outer")
    took = F.coalesce("replaced", F.lit(False))
    return both.select(
        *keys,
        "tag",
        F.when(took, F.col("new_type_code")).otherwise(F.col("old_type_code")).alias("type_code"),
        F.when(took, F.col("new_count")).otherwise(F.col("old_count")).alias("count"),
        F.when(~took, F.col("old_offset")).alias("offset"),
        F.when(took, F.col("new_data")).otherwise(F.col("old_data")).alias("data"),
        took.alias("replaced"),
        F.coalesce("existed", F.lit(False)).alias("existed"),
        *[F.when(took, F.col(f"old_{c}")).alias(f"old_{c}") for c in ("type_code", "count", "offset", "data")],
    )


def same_entry(a: Column, b: Column) -> Column:
    """Equality of entries; two absent ones are equal."""
    return a.eqNullSafe(b)


def same_directories(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``same``: whether two directories have the same tags with equal entries, loaded or not. Each tag stands once (last_of_each_tag)."""
    fields = ("type_code", "count", "offset", "data")
    x = a.select(*keys, "tag", F.struct(*fields).alias("_a"))
    y = b.select(*keys, "tag", F.struct(*fields).alias("_b"))
    return x.join(y, [*keys, "tag"], "full_outer").groupBy(*keys).agg(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("same"))


def entry(type_code="type_code", count="count", data="data") -> Column:
    """The STRUCT that conversions take; null where no data is loaded."""
    return F.when(F.col(data).isNotNull(), F.struct(F.col(type_code).alias("type_code"), F.col(count).alias("count"), F.col(data).alias("data")))


def byte_range(content: Column, start: Column, n: Column) -> Column:
    """Bytes start .. start + n of a binary column, null where it ends before; any number may be asked for."""
    wide = lambda x: x.cast("decimal(38,0)")
    inside = wide(start) + wide(n) <= F.octet_length(content)
    return F.when(inside & (wide(start) >= 0) & (wide(n) >= 0), F.substring(content, (wide(start) + 1).try_cast("int"), wide(n).try_cast("int")))


def load_deferred(entries: DataFrame, content: Column, little) -> DataFrame:
    """Entries whose bytes lie in ``content`` (the whole file): data of deferred ones is cut out, IoError if it ends before."""
    n = F.col("count").cast("decimal(38,0)") * size_of(F.col("type_code"))
    todo = F.col("data").isNull() & F.col("offset").isNotNull() & F.col("error").isNull()
    loaded = B.canonical(byte_range(content, F.col("offset"), n), little, swap_unit_of(F.col("type_code")))
    rows = entries.withColumn("_loaded", F.when(todo, loaded))
    short = todo & F.col("_loaded").isNull()
    done = rows.withColumns({"data": F.coalesce("data", "_loaded"), "error": F.when(short, F.lit(SHORT)).otherwise(F.col("error"))})
    return done.drop("_loaded")
