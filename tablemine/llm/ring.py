"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``CELLS`` equal cells.  A key's hash gives its cell, and
its home is the shard of the first virtual node at or after the cell.  Shards
have a capacity (all rows divided evenly, at most one row apart); keys that
overflow a full shard continue clockwise to the next node whose shard has
room.  The driver sees the counts by cell, a number that the ring fixes, and
settles which rank range of a cell goes to which shard; rows are ranked within
their cell and look their range up.
"""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, read

SHARDS, NODES, CELLS = 16, 64, 1 << 14


def virtual_nodes(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise.  A shard's nodes do not
    depend on the number of shards."""
    spots = []
    for s in range(shards):
        for v in range(nodes):
            h = xxhash.xxh3_64_intdigest(f"{s}/{v}")
            spots.append((h % CELLS, h, s))
    return [(cell, s) for cell, _, s in sorted(spots)]


def settle(counts: dict[int, int], shards: int, nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """Ranges (cell, first rank, end rank, shard, first slot) that place all
    keys: homes take their own keys clockwise until full, then the overflow
    walks on from its home, clockwise too."""
    ring = virtual_nodes(shards, nodes)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out, over = [], []
    node = 0
    for cell in sorted(counts):
        while node < len(ring) and ring[node][0] < cell:
            node += 1
        home, n = node % len(ring), counts[cell]
        s = ring[home][1]
        take = min(n, room[s] - used[s])
        if take:
            out.append((cell, 0, take, s, used[s]))
            used[s] += take
        if take < n:
            over.append((cell, take, n, home))
    for cell, at, n, home in over:
        k = home
        while at < n:
            k = (k + 1) % len(ring)
            s = ring[k][1]
            take = min(n - at, room[s] - used[s])
            if take:
                out.append((cell, at, at + take, s, used[s]))
                used[s] += take
                at += take
    return out


def assign(rows: DataFrame, key: list[str], shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard).

    The key columns give the place on the ring; rows with equal keys follow
    each other there, in the order of their other columns.  Null keys have a
    place like any other; an empty table gives no rows.
    """
    rows = rows.drop("shard", "slot", "_cell", "_spot")
    spot = F.xxhash64(*key)
    placed = checkpointed(rows.withColumn("_spot", spot).withColumn("_cell", F.pmod("_spot", F.lit(CELLS)).cast("int")))
    counts = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    # at most CELLS rows and one for each virtual node that takes overflow of a cell
    ranges = (rows.sparkSession.range(1).select(F.explode(F.from_json(
        F.lit(json.dumps([dict(zip("clesf", r)) for r in settle(counts, shards, nodes)])),
        "array<struct<c int, l long, e long, s int, f long>>")).alias("r"))
        .groupBy(F.col("r.c").alias("_cell")).agg(F.collect_list("r").alias("_ranges")))
    order = ["_spot", *rows.columns]
    rank = (F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1).cast("long")
    found = placed.withColumn("_rank", rank).join(ranges, "_cell").withColumn(
        "_r", F.filter("_ranges", lambda r: (r["l"] <= F.col("_rank")) & (F.col("_rank") < r["e"]))[0])
    return found.select(*rows.columns, F.col("_r.s").alias("shard"),
                        (F.col("_r.f") + F.col("_rank") - F.col("_r.l")).alias("slot"))


def op6_ring(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards whose counts differ by at most one."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"))
    out = assign(rows, ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
