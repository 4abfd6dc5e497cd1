"""Exact top-k search over 64-bit binary codes by incremental multi-index hashing.

A code is cut into m segments of about log2(n) bits. Codes within Hamming distance
d of a query agree with it in some segment up to floor(d / m) bits, so after all
segments were probed up to radius r every code within m * (r + 1) - 1 has been
met and its full distance verified. Radii grow until the k-th best verified
distance is within that bound; queries for which the probes of the next radius
would outnumber the codes compare with the rest directly.

Equal codes are one entry with its k smallest ids, so a code that many rows share
costs as much as any other. Entries are dealt by hash into shards of at most about
``shard_codes`` entries and queries into blocks of ``block_queries`` distinct codes;
every (shard, block) is one group with bounded memory that searches on its own, and
the k best of the shards are merged per query. So each query meets every row, the
stated query set against all rows, in blocks.

Ties are broken by id. Rows without a code or id are neither queries nor results;
a repeated row counts as often as it occurs; with fewer than k rows all are
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagframe.llm import common

BITS = 64


def sign_code(vector: Column) -> Column:
    """Bit i is set where component i is positive; null for another number of components than 64."""
    word = F.aggregate(vector, F.lit(0).cast("long"), lambda code, x: F.shiftleft(code, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
    return F.when(F.size(vector) == BITS, word)


@lru_cache(maxsize=512)
def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits of which ``radius`` are set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], dtype=np.int64)


class MultiIndex:
    """Segment tables over the codes of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        width = max(4, min(16, int(np.log2(max(2, len(codes))))))
        self.m = -(-BITS // width)
        edges = np.linspace(0, BITS, self.m + 1).astype(int)
        self.segments = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            values = self.segment(codes, low, high)
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << (high - low)) + 1))
            self.segments.append((low, high, order, starts))

    @staticmethod
    def segment(codes: np.ndarray, low: int, high: int) -> np.ndarray:
        return ((codes >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)).astype(np.int64)

    def nearest(self, query: np.uint64, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and distances of all codes that can hold one of the k nearest rows."""
        met = np.zeros(len(self.codes), bool)
        found, distances = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(BITS + 1):
            probes = sum(comb(int(h - low), radius) for low, h, _, _ in self.segments)
            if probes >= len(self.codes):
                new, covered = np.flatnonzero(~met), BITS
            else:
                parts = []
                for low, high, order, starts in self.segments:
                    value = int(query >> np.uint64(low)) & ((1 << int(high - low)) - 1)
                    at = value ^ masks(int(high - low), radius)
                    first, n = starts[at], starts[at + 1] - starts[at]
                    some = n > 0
                    first, n = first[some], n[some]
                    ends = np.cumsum(n)
                    if len(ends):
                        parts.append(order[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first, n)])
                new = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
                new = new[~met[new]]
                covered = self.m * (radius + 1) - 1
            met[new] = True
            found = np.concatenate([found, new])
            distances = np.concatenate([distances, np.bitwise_count(self.codes[new] ^ query).astype(np.int64)])
            by = np.argsort(distances, kind="stable")
            enough = np.searchsorted(np.cumsum(counts[found[by]]), k)
            if enough < len(by):
                kth = distances[by[enough]]
                if kth <= covered:
                    near = distances <= kth
                    return found[near], distances[near]
            if covered >= BITS:
                return found, distances
        raise AssertionError("radii cover all distances")


def search_group(k: int):
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q_code": [], "distance": [], "id": []}
        if index.num_rows and queries.num_rows:
            codes = index.column("code").to_numpy().astype(np.int64).view(np.uint64)
            ids = index.column("ids").to_pylist()
            counts = np.array([len(x) for x in ids])
            tables = MultiIndex(codes)
            for q in queries.column("q_code").to_numpy().tolist():
                at, distances = tables.nearest(np.int64(q).view(np.uint64), counts, k)
                rows = sorted((d, i) for p, d in zip(at.tolist(), distances.tolist(), strict=True) for i in ids[p])[:k]
                out["q_code"] += [q] * len(rows)
                out["distance"] += [d for d, _ in rows]
                out["id"] += [i for _, i in rows]
        return pa.table({"q_code": pa.array(out["q_code"], pa.int64()), "distance": pa.array(out["distance"], pa.int64()), "id": pa.array(out["id"], pa.int64())})

    return search


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, shard_codes: int = 1 << 14, block_queries: int = 1 << 12) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k nearest of ``rows`` (id, code) for each of ``queries`` (id, code)."""
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).where("id IS NOT NULL AND code IS NOT NULL")
    queries = queries.select(F.col("id").cast("long").alias("query_id"), F.col("code").cast("long").alias("q_code")).where("query_id IS NOT NULL AND q_code IS NOT NULL")
    # The limit of k by code is taken before the exchange as well as behind it.
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    entries = common.stage(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = common.stage(queries.select("q_code").distinct(), "query-codes")
    shards = max(1, -(-entries.count() // shard_codes))
    blocks = max(1, -(-asked.count() // block_queries))
    spread = lambda code, n, seed: F.pmod(F.xxhash64(code, F.lit(seed)), F.lit(n)).cast("int")
    left = entries.withColumn("shard", spread("code", shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", spread("q_code", blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # Dealt out here, as groups with little data and much work would else be merged into few tasks.
    width = common.shuffle_width(spark)
    left, right = left.repartition(width, "shard", "block"), right.repartition(width, "shard", "block")
    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(search_group(k), "q_code long, distance long, id long")
    )
    order = W.partitionBy("q_code").orderBy("distance", "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return queries.join(best, "q_code").select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")


TOP_K_SQL = """
WITH c AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code
  FROM embeddings
), d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id, bit_count(xor(q.code, r.code))::BIGINT AS distance
  FROM c AS q, c AS r WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 10
"""
