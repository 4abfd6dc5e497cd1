"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual_nodes`` points of a ring of 2**cell_bits cells; a key
belongs to the owner of the next point clockwise of its hash. Loads are bounded:
a shard takes its capacity and no more, and keys that find it full continue
clockwise to the next shard that has room. Here a key counts 1, and capacities
are n // shards or one more, so the counts of any two shards differ by one at
most (law ``rows``).

Keys of one cell all see the same shards in the same order, so the walk needs
only the number of keys of each cell: one row per cell, at most 2**cell_bits,
goes to the driver. The walk gives each cell one or more ranges of ranks; keys
are ranked within SALTS parts of their cell, in parallel, and find their range by a
join with at most 2**cell_bits + shards rows.

Null and repeated doc_ids are keys like any other (repeated rows get different
slots), null text counts no bytes, an empty table gives no rows, other columns
are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagframe.llm import common

CELL_BITS, VIRTUAL_NODES, SALTS = 14, 64, 8


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS) -> list[int]:
    """The owner of each cell: that of the next point clockwise, the cell's own point included."""
    cells = 1 << cell_bits
    points: dict[int, int] = {}
    for node in range(virtual_nodes):
        for shard in range(shards):  # a further shard's points never displace others' within a node round
            at = zlib.crc32(f"{shard}/{node}".encode()) % cells
            while at in points:
                at = zlib.crc32(f"{shard}/{node}/{at}".encode()) % cells
            points[at] = shard
    owner, last = [0] * cells, points[min(points)]
    for cell in range(cells - 1, -1, -1):
        last = points.get(cell, last)
        owner[cell] = last
    return owner


def walk(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS) -> list[tuple[int, int, int, int, int]]:
    """(cell, shard, first rank, end rank, first slot) for each range of keys, cells in order of the ring."""
    owner = ring(shards, virtual_nodes, cell_bits)
    total, cells = sum(counts.values()), len(owner)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    used, plan = [0] * shards, []
    for cell in sorted(counts):
        rank, left, at = 0, counts[cell], cell
        while left:
            shard = owner[at]
            if take := min(left, capacity[shard] - used[shard]):
                plan.append((cell, shard, rank, rank + take, used[shard]))
                used[shard] += take
                rank += take
                left -= take
            at = (at + 1) % cells
    return plan


def cell_of(key: Column, cell_bits: int = CELL_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - cell_bits).cast("int")


def shard(rows: DataFrame, key: str, shards: int, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS) -> DataFrame:
    """``rows`` with shard, slot (gapless from 0 in each shard) and home_shard, which an unbounded ring would give.

    Columns of these three names are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "home_shard")
    cell, part, n, at, first, end, slot, rank, before, salt, of, home, into = common.free_names(rows, *(f"{x}_" for x in ("cell", "part", "n", "at", "first", "end", "slot", "rank", "before", "salt", "of", "home", "into")))
    # A cell that many keys or one very frequent key share is ranked in parts.
    salted = rows.withColumn(cell, cell_of(F.col(key), cell_bits)).withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    # At most SALTS * 2**cell_bits rows, and 2**cell_bits of them for the driver.
    parts = common.stage(salted.groupBy(cell, salt).agg(F.count("*").alias(n)), "ring-cells")
    counts = {r[cell]: r[n] for r in parts.groupBy(cell).agg(F.sum(n).alias(n)).collect()}
    plan = spark.createDataFrame(walk(counts, shards, virtual_nodes, cell_bits), f"{of} int, {into} int, {first} long, {end} long, {slot} long")
    homes = spark.createDataFrame(list(enumerate(ring(shards, virtual_nodes, cell_bits))), f"{of} int, {home} int")
    plan = plan.join(F.broadcast(homes), of)
    ahead = F.sum(n).over(W.partitionBy(cell).orderBy(salt)) - F.col(n)
    parts = parts.select(F.col(cell).alias(at), F.col(salt).alias(part), ahead.alias(before))
    order = W.partitionBy(cell, salt).orderBy(F.xxhash64(key), key, *[c for c in rows.columns if c != key])
    ranked = salted.withColumn(rank, F.row_number().over(order) - 1)
    ranked = ranked.join(parts, (F.col(cell) == F.col(at)) & (F.col(salt) == F.col(part))).withColumn(rank, F.col(rank) + F.col(before))
    mine = (F.col(cell) == F.col(of)) & (F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(end))
    found = ranked.join(F.broadcast(plan), mine)  # at most 2**cell_bits + shards rows
    return found.select(*rows.columns, F.col(into).alias("shard"), (F.col(slot) + F.col(rank) - F.col(first)).alias("slot"), F.col(home).alias("home_shard"))
