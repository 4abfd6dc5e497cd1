"""Join of documents by the Jaccard similarity of their word n-grams, and its components.

The document-by-n-gram incidence matrix is multiplied with its transpose in blocks.
Which documents meet in a block follows from bounds on set sizes and a threshold t:

- two sets with similarity t overlap in at least t times the larger, so if all
  n-grams have one global order, they share one among their first n - ceil(t n) + 1.
  The documents that hold an n-gram there are its list; the order puts n-grams that
  many documents hold last, so lists are short;
- sizes differ by a factor of 1 / t at most, so an entry of a list without another of
  a fitting size goes;
- two sets must share so many n-grams of their prefixes that the rest behind the
  prefixes can make up the overlap; a document with fewer entries left than any
  partner in a list needs loses the entry.

Every list has a pivot, the member that a hash puts first. Lists of one pivot are one
group, so a document goes once to a group however many lists it shares there, and a
group holds only documents that share an n-gram with its pivot. Groups are cut into
blocks of bounded size; a worker multiplies the incidence of two blocks over slices
of columns, which gives all overlap counts, and returns a spanning forest of the links
found: never more rows than documents. In a group of more than one block its members
first meet its centre only, which is linear, and then only the pairs remain of which
at least one member is not linked with the centre.

N-grams are told apart by 64-bit hashes, sets by 96 bits of checksums and their size;
documents with equal sets are one node. The order's frequency table is bounded
(HEAVY_MOST entries, those with the highest counts); an n-gram beyond it only makes a
list longer. Lists of more than HOT_LIST members are salted where members are counted.
Null or blank text has an empty set, which is linked with nothing; null doc_ids are
documents like any other; repeated rows are copies; an empty table gives no rows;
other columns are ignored by join() and kept by representatives().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagframe.llm import common, graph

SIZE = 5
#: Similarity as a fraction: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 3, 4
HEAVY_FROM, HEAVY_MOST = 32, 1 << 19
KEPT_COUNTS = 1_000_000
HOT_LIST = 1 << 17
#: Documents and n-grams of a block at most (a longer document is a block of its own).
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


#: White space, and a random value of each byte, A-Z the same as a-z.
GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
VALUES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
VALUES[65:91] = VALUES[97:123]
BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at a time; a word is never cut.
PART = 1 << 20


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    forth, back = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    forth[0] = back[0] = 1
    return np.cumprod(forth, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit over all."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word: its bytes' values times powers of a base, from sums over all bytes before its end and its start."""
    data = np.frombuffer(text, np.uint8)
    gap = GAPS[data]
    out = []
    at = 0
    while at < len(data):
        end = at + PART
        if end < len(data) and not gap[end]:
            end += int(np.argmax(gap[end:])) or len(data)
        part, g = data[at:end], gap[at:end]
        n = len(part)
        forth, back = powers(max(1 << 16, 1 << (n - 1).bit_length()))
        marks = np.flatnonzero(np.diff(g, prepend=True, append=True))
        starts, ends = marks[::2], marks[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[part] * forth[:n], out=sums[1:])
        out.append(mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text, A-Z in lower case."""
    h = word_hashes(text.encode())
    n = len(h)
    if not n:
        return h
    if n < size:
        return mixed(np.array([(h * ODD[np.arange(n) % len(ODD)]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = h[: n - size + 1] * ODD[0]
    for k in range(1, size):
        total += h[k : n - size + 1 + k] * (ODD[k % len(ODD)] * np.uint64(2 * (k // len(ODD)) + 1))
    return distinct(mixed(total))


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two numbers that tell sets apart: a 64-bit sum; the size and 32 bits of another sum."""
    m = mixed(s ^ ODD[0])
    a, b = m.sum(dtype=np.uint64), mixed(m).sum(dtype=np.uint64)
    return int(a.view(np.int64)), len(s) << 32 | int(b) >> 32


SCANNED = "doc_id long, node long, tail long, shingle long, n long"


def scanned(docs: DataFrame, size: int) -> DataFrame:
    """Two kinds of rows from one pass over the texts.

    With a null shingle: doc_id, node, tail, the identity of a document's set. Else: shingle, n,
    counts of n-grams over distinct sets, of each part of the input those that occur twice or more
    in it. So an n-gram of more documents than there are parts is always counted, short by one
    per part at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "node", "tail", "shingle", "n"]
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        total = 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            twice = counts > 1
            none = pa.nulls(int(twice.sum()), pa.int64())
            return pa.record_batch([none, none, none, pa.array(values[twice].view(np.int64)), pa.array(counts[twice].astype(np.int64))], names=names)

        try:
            for batch in batches:
                nodes, tails = [], []
                for text in batch.column(1).to_pylist():
                    s = shingles(text, size)
                    both = identity(s)
                    nodes.append(both[0])
                    tails.append(both[1])
                    if both not in seen:
                        seen.add(both)
                        held.append(s)
                        total += len(s)
                    if total > KEPT_COUNTS:
                        yield counted()
                        held, total = [], 0
                none = pa.nulls(len(nodes), pa.int64())
                yield pa.record_batch([batch.column(0), pa.array(nodes, pa.int64()), pa.array(tails, pa.int64()), none, none], names=names)
            if held:
                yield counted()
        finally:
            common.release()

    return docs.mapInArrow(run, SCANNED)


class Order:
    """Global order of n-grams: those not in the table by hash, then those in it by count and hash."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray):
        by = np.argsort(heavy)
        self.heavy, self.counts = heavy[by], counts[by]
        self.hint = np.zeros(1 << 22, bool)
        self.hint[self.slot(self.heavy)] = True

    @staticmethod
    def slot(s: np.ndarray) -> np.ndarray:
        return (s >> np.uint64(42)).astype(np.int64)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The first n - ceil(t n) + 1 of the sorted set s, and their counts (0: not in the table) unless all are 0."""
        n = len(s)
        length = n - -(-n * NUMERATOR // DENOMINATOR) + 1
        maybe = np.flatnonzero(self.hint[self.slot(s)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.heavy, s[maybe]), len(self.heavy) - 1)
            held = self.heavy[at] == s[maybe]
            if held.any():
                rank = np.zeros(n, np.int64)
                rank[maybe[held]] = self.counts[at[held]]
                by = np.argsort(rank, kind="stable")[:length]
                return s[by], rank[by]
        return s[:length], None


def postings(docs: DataFrame, size: int, heavy: np.ndarray, counts: np.ndarray, hot_list: int) -> DataFrame:
    """shingle, salt, node, tail for the prefix of each distinct set (once for each part of the input that holds it). Only lists beyond ``hot_list`` have salts, from 1."""
    packed = (heavy.tobytes(), counts.tobytes())
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # HEAVY_MOST entries of 16 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(np.frombuffer(shared.value[0], np.uint64), np.frombuffer(shared.value[1], np.int64))
        seen: set[tuple[int, int]] = set()
        try:
            for batch in batches:
                parts, salts, ids = [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingles(text, size)
                    both = identity(s)
                    if len(s) and both not in seen:
                        seen.add(both)
                        prefix, times = order.prefix(s)
                        parts.append(prefix)
                        ids.append(both)
                        salt = np.zeros(len(prefix), np.int32)
                        if times is not None and times[-1] > hot_list:
                            hot = times > hot_list
                            salt[hot] = 1 + both[1] % 0x7FFFFFFF % (times[hot] // hot_list + 1)
                        salts.append(salt)
                if parts:
                    times = [len(p) for p in parts]
                    yield pa.record_batch(
                        [
                            pa.array(np.concatenate(parts).view(np.int64)),
                            pa.array(np.concatenate(salts)),
                            pa.array(np.repeat(np.array([i for i, _ in ids], np.int64), times)),
                            pa.array(np.repeat(np.array([i for _, i in ids], np.int64), times)),
                        ],
                        names=["shingle", "salt", "node", "tail"],
                    )
        finally:
            common.release()

    return docs.mapInArrow(run, "shingle long, salt int, node long, tail long")


def size_of(tail: Column) -> Column:
    return F.shiftright(tail, 32)


def needed(nx: Column, ny: Column) -> Column:
    """The least number of n-grams that the prefixes of similar sets of these sizes share: the rest behind the longer rest adds no more."""
    overlap = F.ceil((nx + ny) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    rest = lambda n: F.ceil(n * NUMERATOR / DENOMINATOR) - 1
    return overlap - F.greatest(rest(nx), rest(ny))


def candidates(shared: DataFrame) -> DataFrame:
    """pivot, node, tail: the groups in which the members of lists (shingle, node, tail) meet, without entries that the bounds exclude."""
    n = size_of(F.col("tail"))
    # Four classes for the factor by which sizes may differ: at most some 200, whatever the input.
    kind = F.floor(F.log(n) * F.lit(4 / math.log(DENOMINATOR / NUMERATOR))).cast("int")
    rows = shared.select("shingle", "node", "tail", n.alias("n"), kind.alias("kind"))
    first = F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("first")
    lists = rows.groupBy("shingle", "kind").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"), first)
    lists = lists.groupBy("shingle").agg(F.collect_list(F.struct("kind", "k", "low", "high")).alias("kinds"), F.min("first").alias("first"))
    lists = common.stage(lists, "lists")  # so that the join can split a list of very many members
    n = F.col("n")
    fits = F.filter("kinds", lambda e: (e["high"] * DENOMINATOR >= n * NUMERATOR) & (e["low"] * NUMERATOR <= n * DENOMINATOR) & ((e["kind"] != F.col("kind")) | (e["k"] > 1)))
    met = rows.join(lists, "shingle").withColumn("fits", fits).where(F.size("fits") > 0)
    small = F.greatest(F.array_min(F.transform("fits", lambda e: e["low"])), F.ceil(n * NUMERATOR / DENOMINATOR))
    large = F.least(F.array_max(F.transform("fits", lambda e: e["high"])), F.floor(n * DENOMINATOR / NUMERATOR))
    # Between the smallest and the largest partner the need is least at one of them.
    met = met.select("node", "tail", F.col("first.node").alias("pivot"), F.least(needed(n, small), needed(n, large)).alias("need"))
    met = met.groupBy("node", "tail", "pivot").agg(F.count("*").alias("k"), F.min("need").alias("need"))
    met = common.stage(met, "fitting")
    enough = met.groupBy("node", "tail").agg(F.sum("k").alias("all"))
    return met.join(enough, ["node", "tail"]).where("all >= need").select("pivot", "node", "tail")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """The product of two incidence matrices, given by rows: entry (i, j) counts what sets i and j share. right None: of left with itself."""
    sets = left if right is None else left + right
    n = len(left)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    fresh = np.diff(every[order], prepend=every[order[:1]] ^ np.uint64(1)) != 0
    column = np.empty(len(every), np.int64)
    column[order] = np.cumsum(fresh) - 1
    count = np.bincount(column)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if right is None:
        useful = count > 1
    else:
        of_left = np.bincount(column[row < n], minlength=len(count))
        useful = (of_left > 0) & (of_left < count)
    keep = useful[column]
    row, column = row[keep], (np.cumsum(useful) - 1)[column[keep]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    width = max(64, (1 << 21) // len(sets))
    product = np.zeros((n, len(sets) - n * (right is not None)))
    edges = np.searchsorted(column, np.arange(0, int(useful.sum()) + width, width))
    for k in range(len(edges) - 1):
        slice_ = np.zeros((len(sets), width), np.float32)
        slice_[row[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * width] = 1
        product += slice_[:n] @ (slice_ if right is None else slice_[n:]).T
    return product


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, root) of the components of a symmetric matrix of links."""
    out, open_ = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not open_[root]:
            continue
        open_[root] = False
        front = [root]
        while front:
            new = np.flatnonzero(linked[front.pop()] & open_)
            open_[new] = False
            front += new.tolist()
            out += [(k, root) for k in new.tolist()]
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """A spanning forest of the links within left, or between left and right (numbered behind left)."""
    size = np.array([len(s) for s in left])
    other = size if right is None else np.array([len(s) for s in right])
    good = overlaps(left, right) * (NUMERATOR + DENOMINATOR) >= (size[:, None] + other[None, :]) * NUMERATOR
    if right is None:
        return forest(good)
    n, m = good.shape
    both = np.zeros((n + m, n + m), bool)
    both[:n, n:], both[n:, :n] = good, good.T
    return forest(both)


#: side 0: left, 1: right, 2: the only block, whose members all meet.
CELLS = "pivot long, i int, j int, side int, vertex long, node long, tail long, text string"


def multiplied(cells: DataFrame, size: int) -> DataFrame:
    """Edges (pivot, x, y) of each cell (pivot, i, j): its left block against its right one."""
    width = max(common.shuffle_width(cells.sparkSession), 1)
    dealt = cells.repartition(width, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "side", "vertex")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple = ()
        names: tuple[list[int], list[int]] = ([], [])
        sets: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def product() -> list[tuple[int, int]]:
            if not sets[0] or len(sets[0]) + len(sets[1]) < 2 or (key and key[3] != 2 and not sets[1]):
                return []
            both = names[0] + names[1]
            return [(both[a], both[b]) for a, b in linked(sets[0], None if key[3] == 2 else sets[1])]

        def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([key[0]] * len(found), pa.int64()), *(pa.array([e[k] for e in found], pa.int64()) for k in (0, 1))], names=["pivot", "x", "y"])

        try:
            for batch in batches:
                pivots, is_, js, sides, vertices, nodes, tails, texts = (c.to_pylist() for c in batch.columns)
                for p, i, j, side, vertex, node, tail, text in zip(pivots, is_, js, sides, vertices, nodes, tails, texts, strict=True):
                    if key[:3] != (p, i, j):
                        if found := product():
                            yield edges(found)
                        key, names, sets = (p, i, j, side), ([], []), ([], [])
                    s = shingles(text, size)
                    # Rows that share a doc_id may have other texts; copies come once.
                    if identity(s) == (node, tail) and vertex not in names[side % 2][-1:]:
                        names[side % 2].append(vertex)
                        sets[side % 2].append(s)
            if found := product():
                yield edges(found)
        finally:
            common.release()

    return dealt.mapInArrow(run, "pivot long, x long, y long")


def with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The cells of members (doc_id, vertex, node, tail, pivot, at array<struct<i, j, side>>) with their texts."""
    wanted = members.groupBy(F.col("doc_id").alias("r_id")).agg(F.collect_list(F.struct("vertex", "node", "tail", "pivot", "at")).alias("m"))
    # Both sides grow with the input, so neither is ever broadcast.
    rows = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("r_id"))).select("text", F.explode("m").alias("m"))
    rows = rows.select("m.*", "text").withColumn("at", F.explode("at"))
    return rows.select("pivot", "at.i", "at.j", "at.side", "vertex", "node", "tail", "text")


def links(docs: DataFrame, size: int, classes: DataFrame, counts: DataFrame, block_rows: int, block_shingles: int, hot_list: int) -> DataFrame:
    """Edges (x, y) between vertices that have the components of all links. classes: (node, tail, doc_id, vertex), counts: (shingle, n) as far as known."""
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_FROM).orderBy(F.desc("n"), "shingle").limit(HEAVY_MOST).toArrow()
    heavy = counts.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    shared = postings(docs, size, heavy, counts.column("n").to_numpy().astype(np.int64), hot_list)
    members = F.count("*").over(W.partitionBy("shingle", "salt"))
    shared = shared.withColumn("members", members).where("members > 1 OR salt > 0").select("shingle", "salt", "node", "tail").distinct()
    groups = candidates(common.stage(shared.drop("salt"), "shared-postings"))
    groups = common.stage(groups.join(classes, ["node", "tail"]), "group-members")
    n = size_of(F.col("tail"))
    centre = F.min(F.struct(F.xxhash64("vertex").alias("h"), "vertex", "node", "tail", "doc_id")).alias("centre")
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(n) / block_shingles)).cast("int")
    sizes = groups.groupBy("pivot").agg(F.count("*").alias("m"), blocks.alias("blocks"), centre).where("m > 1")
    groups = common.stage(groups.join(sizes, "pivot"), "groups")

    def place(i: Column, j: Column, side: int) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))

    zero, plain = F.lit(0), ("doc_id", "vertex", "node", "tail", "pivot")
    small = groups.where("blocks = 1").select(*plain, F.array(place(zero, zero, 2)).alias("at"))
    edges = common.stage(multiplied(with_texts(docs, small), size).select("x", "y"), "links")
    large = groups.where("blocks > 1")
    if large.isEmpty():
        return edges
    # Each block meets the centre of its group.
    block = F.pmod(F.xxhash64("vertex", "pivot"), F.col("blocks"))
    centres = large.select("pivot", "blocks", "centre.*").distinct()
    every = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda i: place(i, zero, 1))
    star = large.select(*plain, F.array(place(block, zero, 0)).alias("at")).unionByName(centres.select(*plain, every.alias("at")))
    star = common.stage(multiplied(with_texts(docs, star), size), "star-links")
    # A star's edges join its members with one vertex: all of them are linked with the centre.
    settled = star.select("pivot", F.col("x").alias("vertex")).union(star.select("pivot", "y")).distinct()
    left_over = common.stage(large.where(F.col("vertex") != F.col("centre.vertex")).join(settled, ["pivot", "vertex"], "left_anti"), "unsettled")
    ends = left_over.groupBy("pivot").agg(blocks.alias("ends"))
    large = large.join(ends, "pivot").select(*plain, F.transform(F.sequence(zero, F.col("ends") - 1), lambda j: place(block, j, 0)).alias("at"))
    end = F.pmod(F.xxhash64("vertex", "pivot", F.lit(1)), F.col("ends"))
    right = left_over.join(ends, "pivot").select(*plain, F.transform(F.sequence(zero, F.col("blocks") - 1), lambda i: place(i, end, 1)).alias("at"))
    rest = common.stage(multiplied(with_texts(docs, large.unionByName(right)), size), "block-links")
    return edges.union(star.select("x", "y")).union(rest.select("x", "y"))


def join(docs: DataFrame, size: int = SIZE, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, hot_list: int = HOT_LIST) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    spark, since = docs.sparkSession, len(common.STAGED)
    rows = common.stage(scanned(docs, size), "nodes")
    every = rows.where("shingle IS NULL").select("doc_id", "node", "tail")
    classes = every.where(size_of(F.col("tail")) > 0).groupBy("node", "tail").agg(F.min("doc_id").alias("doc_id"))
    classes = common.stage(classes.withColumn("vertex", F.monotonically_increasing_id()), "classes")
    edges = links(docs, size, classes, rows.where("shingle IS NOT NULL").select("shingle", "n"), block_rows, block_shingles, hot_list)
    found = common.stage(graph.components(edges).withColumnRenamed("node", "vertex"), "components")
    common.drop_staged(spark, since + 2, 1)
    named = classes.join(found, "vertex").select("node", "tail", F.col("doc_id").alias("least"), "component")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # Nodes with links, and copies without: the others are their own components.
    named = named.join(least, "component").select("node", "tail", "component_id")
    alone = classes.join(named, ["node", "tail"], "left_anti").select("node", "tail", F.col("doc_id").alias("component_id"))
    found = every.join(named.union(alone), ["node", "tail"], "left")
    return found.select("doc_id", size_of(F.col("tail")).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One document of each component, that with the smallest doc_id; documents without n-grams all stay.

    Rows that share a doc_id stay or go together, equal texts among them once.
    """
    joined = common.stage(join(docs, size), "components-of-documents")
    id_, first, n = common.free_names(docs, "id", "first", "n")
    own = joined.select(F.col("doc_id").alias(id_), F.col("doc_id").eqNullSafe(F.col("component_id")).alias(first))
    ids = common.stage(own.groupBy(id_).agg(F.max(first).alias(first), F.count("*").alias(n)), "document-ids")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
    # Those that go and those that repeat an id are fewer than those that stay.
    alone = docs.join(ids.where(~F.col(first) | (F.col(n) > 1)).hint("merge"), same, "left_anti")
    repeated = docs.join(ids.where(F.col(first) & (F.col(n) > 1)).hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.unionByName(repeated)


JOIN_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s AS a JOIN s AS b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), l AS (SELECT x, y FROM p JOIN n AS a ON a.r = x JOIN n AS b ON b.r = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reached(r, m) AS (SELECT r, r FROM d UNION SELECT reached.r, e.y FROM reached JOIN e ON e.x = reached.m
)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, coalesce(min(o.doc_id), d.doc_id) AS component_id
FROM d JOIN reached ON reached.r = d.r JOIN d AS o ON o.r = reached.m LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""
