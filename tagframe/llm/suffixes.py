"""Removal of repeated strings, by interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is
removed, in all places. Four steps:

1. Anchors. Of each window of ``length`` bytes the k-gram with the least hash
   (leftmost of equals) is its anchor, so equal windows have equal anchors at equal
   offsets. Windows in a row with one anchor occurrence form a context. Only anchors
   that occur twice matter further. Contexts that are equal byte for byte (128 bits:
   hash of the anchor and of the context) are one string that counts several times.
2. Blocks. The contexts of one anchor meet in one block; anchors are dealt into blocks
   by their running size. In a block the contexts are concatenated and their suffixes
   sorted, which gives the Burrows-Wheeler transform; breadth-first backward extension
   of intervals then sets the boundaries between suffixes whose common prefix is
   0, 1, 2, .. bytes long and stops at ``length``: boundaries not set by then part
   nothing, windows between the same two boundaries are equal, and they are repeated
   if their contexts count more than once together.
3. An anchor whose contexts would not fit a block (a passage in very many surroundings)
   is divided: contexts are cut into shorter runs of windows at fixed offsets from the
   anchor, and what all windows of such offsets have in common, their core, is the new anchor.
   Equal windows have equal offsets and so equal cores. Runs are 16 windows and then
   one window long; of single windows with one core there is only one.
4. Verdicts go back to all places of a context, are united per text, and the bytes cut out.

Documents with equal texts (md5 of the text) are one text for all this; they repeat
each other, so with ``length`` bytes or more nothing of them is left. Matches never
cross documents. Null text counts as empty; repeated rows are copies; null doc_ids are
ids like any other; an empty table gives no rows; other columns are kept by remove()
and ignored by digests().

A length in bytes misses passages of short words. remove_passages() counts words: each
is coded by as many characters, so that the same four steps find repeated strings of so
many words, whatever white space stands between them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagframe.llm import common

LENGTH, BLOCK_BYTES = 400, 1 << 20
#: Windows of a run where the contexts of an anchor do not fit a block.
RUNS = (16, 1)
#: Bytes that a worker gathers before it hands them on.
OUT_BYTES = 4 << 20
#: Windows hashed at a time: longer texts are taken in overlapping parts.
PART = 1 << 18
#: Fewer suffixes than this have ranks of 21 bits, three to a key.
TRIPLED = (1 << 21) - 1
BASE = 0x9E3779B97F4A7C15
#: Characters that code a word: 56 bits of its hash, as ASCII.
CODE = 8
KEPT_CODES = 300_000
WORD = re.compile(common.WORD_PATTERN.encode())


@lru_cache(maxsize=8)
def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, powers of the base and of its inverse, modulo 2**64."""
    values = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    forth = np.full(n, BASE, np.uint64)
    back = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    forth[0] = back[0] = 1
    return values, np.cumprod(forth, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-gram of bytes."""
    values, forth, back = tables(PART + 4096 if len(data) <= PART + 4096 else len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * forth[: len(data)], out=sums[1:], dtype=np.uint64)
    h = (sums[k:] - sums[:-k]) * back[: len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchor_size(length: int) -> int:
    return max(1, length * 8 // 25)


def anchored(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchor hash, its place, first and last window start of each run of windows with one anchor."""
    k = anchor_size(length)
    width = length - k + 1
    h = rolling(data, k)
    n = len(data) - length + 1
    low = np.uint64((1 << 24) - 1)
    key = np.full(-(-len(h) // width) * width, ~np.uint64(0))
    key[: len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    # Least of each window of ``width`` hashes: the end of one row of a table and the start of the next.
    rows = key.reshape(-1, width)
    starts = np.minimum.accumulate(rows, axis=1).ravel()
    ends = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(ends[:n], starts[width - 1 : width - 1 + n]) & low).astype(np.int64)
    new = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], new])
    return h[at[first]], at[first], first, np.concatenate([new - 1, [n - 1]])


def contexts(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, context hash, first and last window start of all contexts of a text."""
    out: list[tuple[np.ndarray, ...]] = []
    for part in range(0, max(0, len(text) - length + 1), PART):
        piece = text[part : part + PART + length - 1]
        anchor, at, first, last = anchored(np.frombuffer(piece, np.uint8), length)
        hashes = [xxhash.xxh3_64_intdigest(piece[i:j], seed=s) for i, j, s in zip(first.tolist(), (last + length).tolist(), (at - first).tolist(), strict=True)]
        out.append((anchor, np.array(hashes, np.uint64), first + part, last + part))
    if not out:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


CONTEXTS = "text_key binary, first int, last int, anchor long, context long"


def instances(texts: DataFrame, length: int) -> DataFrame:
    """The contexts of each text of (text_key, text), of equal texts in one part of the input once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys: list[bytes] = []
            cols: list[tuple[np.ndarray, ...]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                anchor, context, first, last = contexts(text.encode(), length)
                keys += [key] * len(anchor)
                cols.append((first.astype(np.int32), last.astype(np.int32), anchor.view(np.int64), context.view(np.int64)))
            if keys:
                yield pa.record_batch([pa.array(keys, pa.binary()), *(pa.array(np.concatenate(c)) for c in zip(*cols, strict=True))], names=["text_key", "first", "last", "anchor", "context"])
        common.release()

    return texts.mapInArrow(run, CONTEXTS)


def suffix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``length`` bytes: sorted prefixes are doubled, or tripled where three ranks fit a key, and only suffixes that still share theirs are sorted again."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    # Seven bytes of nine bits at first; the end of the data sorts before any byte.
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    known = 7
    times = 3 if n < TRIPLED else 2
    bits = np.uint64(64 // times)
    order = np.argsort(key)
    # The places in the order that are still open, and the suffixes and keys there.
    slots, at, key = np.arange(n), order, key[order]
    rank = np.zeros(n + length, np.uint64)
    new = np.ones(n + 1, bool)
    while True:
        new[slots[1:]] = key[1:] != key[:-1]
        # The first place of those that share a prefix, from 1.
        rank[at] = np.maximum.accumulate(np.where(new[slots], slots, 0)) + 1
        if known >= length:
            return order
        shared = ~(new[slots] & new[slots + 1])
        slots, at = slots[shared], at[shared]
        if not len(slots):
            return order
        key = rank[at]
        for k in range(1, times):
            key = (key << bits) | rank[at + min(k * known, length - known)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        known = min(times * known, length)


def boundaries(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes of ranks r - 1 and r share fewer than ``length`` bytes, for r = 0 .. n.

    Intervals of ranks with a common prefix w are extended backward by every byte c
    before their suffixes: the suffixes with prefix cw form an interval again, and
    where that ends for the first time at step l, the common prefix there is l long.
    """
    n = len(data)
    last = data[order - 1]  # the transform
    by = np.argsort(last, kind="stable")
    to = np.empty(n, np.int64)
    to[by] = np.arange(n)  # backward extension of one suffix
    before, behind = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    same = last[by[1:]] == last[by[:-1]]
    before[by[1:][same]] = by[:-1][same]
    behind[by[:-1][same]] = by[1:][same]
    set_ = np.zeros(n + 1, bool)
    set_[0] = set_[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        one = high - low == 1
        new_low, new_high = [to[low[one]]], [to[low[one]] + 1]
        low, high = low[~one], high[~one]
        if len(low):
            sizes = high - low
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(low, sizes)
            owner = np.repeat(np.arange(len(low)), sizes)
            is_first, is_last = before[at] < low[owner], behind[at] >= high[owner]
            # First and last place of each byte in each interval, both in order of interval and byte.
            f, z = at[is_first], at[is_last]
            f = f[np.argsort(owner[is_first] * 512 + last[f], kind="stable")]
            z = z[np.argsort(owner[is_last] * 512 + last[z], kind="stable")]
            new_low.append(to[f])
            new_high.append(to[z] + 1)
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = ~set_[high]
        low, high = low[fresh], high[fresh]
        set_[high] = True
        if not len(low):
            break
    return set_


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int, times: np.ndarray | None = None) -> np.ndarray:
    """Whether the window at each of ``starts``, which counts ``times`` (once), equals that at another of them or counts several times."""
    # An end mark that is less than any byte makes the suffixes those of a ring.
    text = np.concatenate([data.astype(np.int16) + np.int16(1), np.zeros(1, np.int16)])
    order = suffix_order(text, length)
    parts = boundaries(text, order, length)
    label = np.empty(len(text), np.int64)
    label[order] = np.cumsum(parts[:-1])
    mine = label[starts]
    return np.bincount(mine, weights=times)[mine] > 1


def in_block(length: int):
    """(anchor, context, low, high): the runs of repeated windows of the contexts of a block, from each context's first window."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("data").to_pylist()
        n = np.array([len(c) - length + 1 for c in chunks])
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in chunks])[:-1]])
        owner = np.repeat(np.arange(len(chunks)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        times = np.minimum(table.column("n").to_numpy(), 2)[owner]
        hit = repeated_windows(np.frombuffer(b"".join(chunks), np.uint8), offsets[owner] + within, length, times)
        owner, within = owner[hit], within[hit]
        new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(within) != 1)]) if len(owner) else np.empty(0, bool)
        i = np.flatnonzero(new)
        j = np.concatenate([i[1:], [len(owner)]]) - 1 if len(i) else i
        of = pa.array(owner[i])
        return pa.table({"anchor": table.column("anchor").take(of), "context": table.column("context").take(of), "low": pa.array(within[i].astype(np.int32)), "high": pa.array(within[j].astype(np.int32))})

    return run


def fetched(texts: DataFrame, wanted: DataFrame, length: int, kept: str) -> DataFrame:
    """``wanted`` (anchor, context, n, text_key, first, last and ``kept``, a long) with the bytes of each context instead of its place."""
    each = wanted.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "context", "n", kept, "first", "last")).alias("ranges"))
    # Copies of a text are sent once by each part of the input, and read once. Both sides grow with the input: no broadcast.
    joined = texts.dropDuplicates(["text_key"]).join(each.hint("merge"), "text_key").select("text", "ranges")
    types = [pa.int64()] * 4 + [pa.binary()]
    names = ["anchor", "context", "n", kept, "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for r in ranges:
                    part = data[r["first"] : r["last"] + length]
                    rows.append((r["anchor"], r["context"], r["n"], r[kept], part))
                    size += len(part) + 200
                    if size > OUT_BYTES:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()
        common.release()

    return joined.mapInArrow(run, f"anchor long, context long, n long, {kept} long, data binary")


def divided(found: DataFrame, length: int, windows: int) -> DataFrame:
    """Contexts (anchor, context, n, data) cut into runs of ``windows`` windows: of_anchor, of_context, low, then anchor, context, n, data of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, context, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = len(data) - length + 1
                # A context's windows have their anchor at one place.
                place = int(anchored(np.frombuffer(data, np.uint8), length)[1][0])
                low = 0
                while low < count:
                    offset, kind = (place - low) % windows, (place - low) // windows
                    high = min(low + offset, count - 1)
                    # What all windows with offsets of this kind hold, also where the context has only some of them.
                    start = place - kind * windows
                    core = xxhash.xxh3_64_intdigest(data[start : start + length - windows + 1], seed=(anchor ^ kind) & 0xFFFFFFFFFFFFFFFF)
                    part = data[low : high + length]
                    rows.append((anchor, context, low, core - (1 << 63), xxhash.xxh3_64_intdigest(part, seed=place - low) - (1 << 63), n, part))
                    low = high + 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["of_anchor", "of_context", "low", "anchor", "context", "n", "data"]
            for k in range(0, len(rows), 4096):
                yield pa.record_batch([pa.array([r[c] for r in rows[k : k + 4096]], t) for c, t in enumerate(types)], names=names)

    return found.select("anchor", "context", "n", "data").mapInArrow(run, "of_anchor long, of_context long, low int, anchor long, context long, n long, data binary")


def dealt(each: DataFrame, length: int, block_bytes: int, last: bool) -> DataFrame:
    """Distinct contexts (anchor, context, n, bytes, ..) of anchors that occur twice, with their block: null where an anchor's contexts do not fit one."""
    anchors = each.groupBy("anchor").agg(F.sum("n").alias("all"), F.sum("bytes").alias("size")).where(F.col("all") > 1)
    fits = F.lit(True) if last else F.col("size") <= block_bytes
    # Each bucket fills its blocks one after the other.
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(common.shuffle_width(each.sparkSession)))
    before = F.coalesce(F.sum(F.when(fits, F.col("size")).otherwise(0)).over(W.partitionBy("bucket").orderBy("anchor").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    block = F.when(fits, F.col("bucket") * F.lit(1 << 32) + F.floor(before / block_bytes))
    anchors = anchors.withColumn("bucket", bucket).select("anchor", block.alias("block"))
    return each.join(anchors, "anchor")


def judged(found: DataFrame, length: int) -> DataFrame:
    """Verdicts on the contexts of all blocks."""
    return found.groupBy("block").applyInArrow(in_block(length), "anchor long, context long, low int, high int")


def verdicts(texts: DataFrame, every: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(anchor, context, low, high) for the distinct contexts of ``every`` (text_key, first, last, anchor, context)."""
    place = F.min(F.struct("text_key", "first", "last")).alias("at")
    each = every.groupBy("anchor", "context").agg(F.count("*").alias("n"), place).select("anchor", "context", "n", "at.*")
    each = common.stage(dealt(each.withColumn("bytes", F.col("last") - F.col("first") + length), length, block_bytes, False), "distinct-contexts")
    out = judged(fetched(texts, each.where("block IS NOT NULL"), length, "block"), length)
    large = each.where("block IS NULL").withColumn("block", F.lit(0).cast("long"))
    if large.isEmpty():
        return out
    found = fetched(texts, large, length, "block")
    ways = []
    for windows in RUNS:
        parts = common.stage(divided(found, length, windows), "divided-contexts")
        each = parts.groupBy("anchor", "context").agg(F.sum("n").alias("n"), F.first("data").alias("data"))
        each = common.stage(dealt(each.withColumn("bytes", F.octet_length("data")), length, block_bytes, windows == 1), "distinct-parts")
        ways.append(parts.select("of_anchor", "of_context", F.col("low").alias("shift"), "anchor", "context"))
        inner = judged(each.where("block IS NOT NULL").select("block", "anchor", "context", "n", "data"), length)
        for way in reversed(ways):  # back to the contexts that were divided
            inner = inner.join(way, ["anchor", "context"]).select(F.col("of_anchor").alias("anchor"), F.col("of_context").alias("context"), (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high"))
        out = out.union(inner)
        found = each.where("block IS NULL")
    return out


def repeated_ranges(texts: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """text_key, first, last: ranges of window starts in texts (text_key, text) that are repeated in a different or the same text."""
    since = len(common.STAGED)
    every = common.stage(instances(texts, length), "contexts")
    # Staged, so that a join can split an anchor that very many contexts have.
    twice = common.stage(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    every = common.stage(every.join(twice, "anchor", "left_semi"), "anchored")
    common.drop_staged(texts.sparkSession, since, 1)
    found = common.stage(verdicts(texts, every, length, block_bytes), "verdicts")
    return every.join(found, ["anchor", "context"]).select("text_key", (F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.col("high")).alias("last"))


def key_of(column: str = "text"):
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(common.text_or_empty(column).cast("binary")))


def removed(docs: DataFrame, length: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(text_key, ranges) of texts that lose part of their bytes, and (text_key) of those that lose all."""
    since = len(common.STAGED)
    long = common.text_or_empty()
    texts = docs.select(key_of().alias("text_key"), long.alias("text")).where(F.octet_length("text") >= length)
    copies = texts.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select("text_key")
    copies = common.stage(copies, "copied-texts")
    ranges = repeated_ranges(texts, length, block_bytes).join(copies, "text_key", "left_anti")
    ranges = ranges.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    ranges = common.stage(ranges, "ranges")
    common.drop_staged(docs.sparkSession, since + 1, 1)
    return ranges, copies


def cut_bytes(data: bytes, ranges: list[dict], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs (end exclusive), and what remains; ranges are sorted."""
    runs: list[list[int]] = []
    for r in ranges:
        i, j = r["first"], r["last"] + length
        if runs and i <= runs[-1][1]:
            runs[-1][1] = max(j, runs[-1][1])
        else:
            runs.append([i, j])
    kept, at = [], 0
    for i, j in runs:
        kept.append(data[at:i])
        at = j
    return [tuple(r) for r in runs], b"".join([*kept, data[at:]])


def digests(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    ranges, copies = removed(docs, length, block_bytes)
    text = common.text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of().alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, n, spans, sha = [], [], [], []
            for text, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                runs, kept = cut_bytes(data, r, length)
                sizes.append(len(data))
                n.append(sum(j - i for i, j in runs))
                spans.append(len(runs))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, n, spans)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    part = rows.join(ranges.hint("merge"), "text_key").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    part = common.stage(part, "cut-digests")
    gone = copies.withColumn("gone", F.lit(True)).union(ranges.select("text_key", F.lit(False).alias("gone")))
    rest = rows.drop("text").join(gone, "text_key", "left").where("gone IS NULL OR gone")
    zero = F.lit(0).cast("long")
    rest = rest.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(zero).alias("n_removed"),
        F.when(F.col("gone"), F.lit(1).cast("long")).otherwise(zero).alias("n_spans"),
        F.when(F.col("gone"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("whole")).alias("kept_sha256"),
    )
    return part.unionByName(rest)


def without(docs: DataFrame, marks: DataFrame, cut: Callable[[str | None, list[dict] | None, bool | None], str | None]) -> DataFrame:
    """The documents with ``cut`` applied to their texts and what ``marks`` (text_key, ranges, gone) says of these."""
    key, gone, some, runs = common.free_names(docs, "key", "gone", "some", "ranges")
    marks = marks.select(F.col("text_key").alias(some), F.col("ranges").alias(runs), F.col("gone").alias(gone))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = [batch.column(c).to_pylist() for c in ("text", runs, gone)]
            texts = pa.array(map(cut, *marked), pa.string())
            yield pa.record_batch([texts if c == "text" else batch.column(c) for c in names], names=names)
        common.release()

    # One exchange of the texts; both sides grow with the input: no broadcast.
    joined = docs.withColumn(key, key_of()).join(marks.hint("merge"), F.col(key) == F.col(some), "left")
    return common.stage(joined.select(*names, runs, gone).mapInArrow(run, docs.schema), "cut-texts")


def marked(ranges: DataFrame, copies: DataFrame) -> DataFrame:
    """text_key, ranges, gone: what removed() found."""
    return ranges.withColumn("gone", F.lit(False)).unionByName(copies.withColumn("gone", F.lit(True)), allowMissingColumns=True)


def remove(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with repeated bytes cut out of ``text``; characters cut in two go as a whole."""

    def cut(text: str | None, ranges: list[dict] | None, all_: bool | None) -> str | None:
        if ranges is None:
            return "" if all_ else text
        return cut_bytes(text.encode(), ranges, length)[1].decode(errors="ignore")

    since = len(common.STAGED)
    out = without(docs, marked(*removed(docs, length, block_bytes)), cut)
    common.drop_staged(docs.sparkSession, since, 1)  # all but the cut texts
    return out


class Codes(dict):
    """word -> its code."""

    def __missing__(self, word: bytes) -> bytes:
        code = self[word] = (xxhash.xxh3_64_intdigest(word) & 0x7F7F7F7F7F7F7F7F).to_bytes(CODE, "little")
        return code


def coded(docs: DataFrame, words: int) -> DataFrame:
    """(of, text): the key and the coded words of each text that has so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            keys, out = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = text.encode().split()  # at the white space of WORD, as these are bytes
                if len(found) >= words:
                    keys.append(key)
                    out.append(b"".join(map(codes.__getitem__, found)).decode("ascii"))
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["of", "text"])
            if len(codes) > KEPT_CODES:
                codes.clear()
        common.release()

    return docs.select(key_of().alias("of"), common.text_or_empty().alias("text")).mapInArrow(run, "of binary, text string")


def cut_words(text: str, ranges: list[dict] | None, words: int) -> str:
    """The text without the runs of words that ``ranges`` of its codes cover, without ranges from the first word to the last; white space around them stays."""
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data)]
    if ranges is None:
        runs = [[0, len(at) - 1]]
    else:
        runs = []
        for r in ranges:
            i, j = -(-r["first"] // CODE), r["last"] // CODE + words - 1
            if j - i < words - 1:  # equal between the starts of codes, by chance
                continue
            if runs and i <= runs[-1][1] + 1:
                runs[-1][1] = max(j, runs[-1][1])
            else:
                runs.append([i, j])
    return cut_bytes(data, [{"first": at[i][0], "last": at[j][1]} for i, j in runs], 0)[1].decode()


def remove_passages(docs: DataFrame, words: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the words covered by a string of so many words that also starts elsewhere; texts of equal words repeat each other."""
    since = len(common.STAGED)
    texts = common.stage(coded(docs, words), "word-codes")
    found = marked(*removed(texts, words * CODE, block_bytes))
    # Equal texts have equal codes.
    keys = texts.select("of", key_of().alias("text_key")).dropDuplicates(["of"])
    marks = keys.join(found.hint("merge"), "text_key").select(F.col("of").alias("text_key"), "ranges", "gone")

    def cut(text: str | None, ranges: list[dict] | None, all_: bool | None) -> str | None:
        return text if all_ is None else cut_words(text, ranges, words)

    out = without(docs, marks, cut)
    common.drop_staged(docs.sparkSession, since, 1)  # all but the cut texts
    return out
