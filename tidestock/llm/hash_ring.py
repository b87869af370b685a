"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into cells; every shard owns the cells before each of its virtual nodes. A shard
takes rows from its own cells until it is full; what is left continues clockwise to the next
virtual node whose shard has room. Capacities sum to the rows (plus slack), so every row finds a
place and no shard exceeds its capacity. With slack 0 the counts of any two shards differ by one at
most; a larger slack moves fewer rows when the number of shards changes.

Only the counts per cell come to the driver (CELLS of them, whatever the table), where the ring is
filled; the rows then look up their piece of the ring. Rows are placed by a hash of key and text,
so that a key or a text that repeats is one point only if both repeat. Rows that are equal in both are
counted first and numbered as ranges of at most RANGE rows, so a cell that they crowd is few rows to
its task; the rows themselves come out of the ranges at the end, spread over tasks again.

Defined cases: null text has size 16 and the checksum of the empty text; null keys and repeated
rows are placed like others; texts are hashed whole; an empty table gives an empty result; further
columns are left out.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Cells of the ring: counts the driver reads, and groups that rows are numbered in.
CELL_BITS = 14
CELLS = 1 << CELL_BITS
VIRTUAL_NODES = 64
#: Equal rows that are numbered as one, and rows that one task gives out at the end.
RANGE, SHARE = 1000, 100_000


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    points = [
        (xxhash.xxh64_intdigest(f"shard {s} node {v}") >> (64 - CELL_BITS), xxhash.xxh64_intdigest(f"{s}/{v}"), s)
        for s in range(shards) for v in range(virtual_nodes)
    ]
    return [(cell, s) for cell, _, s in sorted(points)]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows per shard: at least an equal share, and sums to the rows or more."""
    if slack:
        return [-(-int(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (cell, first, end, shard, slot of first): rows first .. end - 1 of a cell go to a shard."""
    room, taken, pieces = list(room), [0] * len(room), []
    cells = [cell for cell, _ in nodes]
    queue = [(bisect.bisect_left(cells, cell) % len(nodes), cell, 0, n) for cell, n in sorted(counts.items()) if n]
    while queue:
        left = []
        for node, cell, first, n in queue:
            shard = nodes[node][1]
            if k := min(n, room[shard]):
                pieces.append((cell, first, first + k, shard, taken[shard]))
                room[shard] -= k
                taken[shard] += k
            if k < n:
                left.append(((node + 1) % len(nodes), cell, first + k, n - k))
        queue = left
    return pieces


def place(docs: DataFrame, shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot): slots of a shard count from 0 without gaps."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(docs["text"], F.lit(""))
    points = scratch.store(
        docs.select(
            docs[key].alias("key"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(docs[key].cast("string"), F.xxhash64(text)).alias("point"),
        ).withColumn("cell", F.expr(f"shiftrightunsigned(point, {64 - CELL_BITS})")),
        "points",
    )
    # Equal rows as ranges: every column of the result is the same for all of them but the slot.
    same = points.groupBy("cell", "point", "key", "size", "text_crc32").agg(F.count("*").alias("n"))
    firsts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE).cast("long")))
    ranges = same.withColumn("from", firsts).withColumn("n", F.least(F.col("n") - F.col("from"), F.lit(RANGE)))
    ranges = scratch.store(ranges, "ranges")
    counts = {r["cell"]: r["n"] for r in ranges.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # CELLS rows at most
    total = sum(counts.values())
    pieces = fill(counts, ring(shards, virtual_nodes), capacities(total, shards, slack))
    found = spark.createDataFrame(pieces, "cell long, first long, end long, shard int, slot0 long")
    order = Window.partitionBy("cell").orderBy("point", "text_crc32", "size", "key", "from")
    ends = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = ranges.withColumn("number", ends - F.col("n"))
    here = F.broadcast(found)  # CELLS rows, and one for every cut
    # A range may lie across cuts: each piece takes its share of it.
    low, high = F.greatest("number", "first"), F.least(F.col("number") + F.col("n"), F.col("end"))
    inside = (numbered["cell"] == here["cell"]) & (numbered["number"] < here["end"]) & (numbered["number"] + numbered["n"] > here["first"])
    placed = numbered.join(here, inside).select("key", "size", "text_crc32", "shard", (F.col("slot0") + low - F.col("first")).alias("slot"), (high - low).alias("n"))
    placed = placed.repartition(-(-total // SHARE) or 1)
    rows = F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1)).alias("slot")
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", rows)
