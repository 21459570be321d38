"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of positions. A key's hash gives its position; the next virtual
node clockwise owns it. Every shard has a capacity (the capacities add up to the number of rows, so
counts differ by one at most); rows that find a shard full continue clockwise to the next virtual
node of a shard with room. Only the number of rows per ring position is looked at to plan this, so
the plan has a fixed size; the rows themselves are numbered where they are.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlens.scaling import cut_lineage

RING = 4096  # positions of the ring: bounds the plan
VIRTUAL_NODES = 64  # per shard
SUBCELLS = 16  # a position's rows are numbered in so many pieces

SEGMENT = "ring_position int, first_rank long, end_rank long, shard int, first_slot long"


def ring_nodes(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Virtual nodes as (position, shard) in ring order; a node belongs to one shard for good."""
    points = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            at = zlib.crc32(f"shard {shard} node {v}".encode()) % RING
            points.setdefault(at, shard)  # of two on one point the lower shard stays
    return sorted(points.items())


def place(loads: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple]:
    """Which rows of each ring position go to which shard, and to which slots there.

    Home shards are served first, each from its own positions in ring order; then what overflowed
    moves clockwise, in ring order. Returns (position, first rank, end rank, shard, first slot).
    """
    nodes = ring_nodes(shards, virtual_nodes)
    total = sum(loads.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slots = [0] * shards
    segments, overflow = [], []

    def give(position: int, rank: int, count: int, shard: int) -> int:
        taken = min(count, room[shard])
        if taken:
            segments.append((position, rank, rank + taken, shard, slots[shard]))
            room[shard] -= taken
            slots[shard] += taken
        return taken

    at = 0
    for position in sorted(loads):
        while at < len(nodes) and nodes[at][0] < position:
            at += 1
        node = at % len(nodes)
        taken = give(position, 0, loads[position], nodes[node][1])
        if taken < loads[position]:
            overflow.append((position, taken, loads[position] - taken, node))
    for position, rank, count, node in overflow:
        while count:
            node = (node + 1) % len(nodes)
            if not any(room[s] for s in {s for _, s in nodes}):
                # shards whose every point was taken by a lower one still have room
                shard = next(s for s in range(shards) if room[s])
            else:
                shard = nodes[node][1]
            taken = give(position, rank, count, shard)
            rank, count = rank + taken, count - taken
    return segments


def shard_rows(
    docs: DataFrame,
    shards: int = 8,
    key: str = "doc_id",
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """All rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    The key's hash gives the ring position. Rows without a key are placed by their whole content.
    Within a position, rows are ordered by a hash of all their columns, so a hot key is numbered in
    ``SUBCELLS`` pieces; rows equal in every column may swap their slots. Texts may be null, empty
    or long: they only enter a hash. Columns named like a result are replaced. An empty table gives
    an empty table.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    hashable = [f"`{f.name}`" for f in rows.schema if not isinstance(f.dataType, T.MapType)]
    content = F.xxhash64(*hashable)
    point = F.when(F.col(f"`{key}`").isNull(), content).otherwise(F.xxhash64(F.col(f"`{key}`")))
    kept = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    rows = rows.select(
        kept,
        F.pmod(point, F.lit(RING)).cast("int").alias("ring_position"),
        F.pmod(content, F.lit(SUBCELLS)).cast("int").alias("_sub"),
        content.alias("_content"),
    )
    spark = docs.sparkSession
    cells = cut_lineage(rows.groupBy("ring_position", "_sub").agg(F.count(F.lit(1)).alias("_n")))
    # one row per ring position: at most RING, whatever the input
    loads = {r[0]: r[1] for r in cells.groupBy("ring_position").agg(F.sum("_n")).collect()}
    segments = spark.createDataFrame(place(loads, shards, virtual_nodes), SEGMENT)
    earlier = Window.partitionBy("ring_position").orderBy("_sub").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = cells.select(
        "ring_position", "_sub", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    numbered = rows.withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy("ring_position", "_sub").orderBy("_content")) - 1,
    )
    # both tables have a fixed bound: RING * SUBCELLS rows, and RING + shards segments
    placed = numbered.join(F.broadcast(offsets), ["ring_position", "_sub"]).withColumn(
        "_rank", F.col("_rank") + F.col("_before")
    )
    s = F.broadcast(segments).alias("s")
    placed = placed.alias("r").join(
        s,
        (F.col("r.ring_position") == F.col("s.ring_position"))
        & (F.col("r._rank") >= F.col("s.first_rank"))
        & (F.col("r._rank") < F.col("s.end_rank")),
    )
    return placed.select(
        "_row.*",
        F.col("s.shard").alias("shard"),
        (F.col("s.first_slot") + F.col("r._rank") - F.col("s.first_rank")).alias("slot"),
    )
