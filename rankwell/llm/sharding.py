"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every document has a place on a ring of ``CELLS`` cells, every shard has
``VIRTUAL_NODES`` virtual nodes there.  A document belongs to the next virtual
node clockwise; where that shard is full, it walks on to the next one with room.
With no slack the capacities add up to the number of rows, so counts differ by
at most one (law ``rows``), while only the overflow leaves its own place.

Only the number of rows per cell decides where documents go, so the walk is
planned on ``CELLS`` counts, a table of fixed size.  The rows themselves get
their place in their cell from a window over narrow rows and look their shard up
in the plan: texts are never shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.common import slim

CELL_BITS = 14
CELLS = 1 << CELL_BITS
VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise.

    A shard's places depend on its own number only, so one more shard leaves all
    others where they are.
    """
    return sorted(
        (zlib.crc32(f"shard {s} node {v}".encode()) >> (32 - CELL_BITS), s)
        for s in range(shards)
        for v in range(virtual_nodes)
    )


def plan_ring(
    counts: Sequence[tuple[int, int]], shards: int, slack: float = 0.0
) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(cell, first, last, shard, slot of first)`` over the places of each cell.

    First every cell fills the shard of its own virtual node, clockwise; then what
    is left over walks on, in the same order, to the next shards with room.
    """
    total = sum(n for _, n in counts)
    if slack:
        room = [-int(-(1 + slack) * total // shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    nodes = ring(shards)
    cells_of_nodes = [c for c, _ in nodes]
    used = [0] * shards
    runs: list[tuple[int, int, int, int, int]] = []

    def give(cell: int, first: int, n: int, shard: int) -> int:
        taken = min(n, room[shard] - used[shard])
        if taken:
            runs.append((cell, first, first + taken - 1, shard, used[shard]))
            used[shard] += taken
        return taken

    left: list[tuple[int, int, int, int]] = []
    for cell, n in sorted(counts):
        at = bisect_left(cells_of_nodes, cell) % len(nodes)
        taken = give(cell, 0, n, nodes[at][1])
        if taken < n:
            left.append((cell, taken, n - taken, at))
    for cell, first, n, at in left:
        while n:
            at = (at + 1) % len(nodes)
            taken = give(cell, first, n, nodes[at][1])
            first, n = first + taken, n - taken
    return runs


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    slack: float = 0.0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A NULL text has no bytes (size 8, crc of the empty text).  NULL ids share a
    place on the ring.  Repeated rows each get a slot of their own; which of two
    equal rows gets which slot makes no difference.  An empty table gives an empty
    table.  Other columns are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = slim(docs, doc_id=doc_id, text=text).select(
        "doc_id",
        (F.octet_length(body) + 8).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64("doc_id").alias("hash"),
    ).withColumn("cell", F.shiftrightunsigned("hash", 64 - CELL_BITS).cast("int"))
    # at most CELLS rows, however many documents there are
    counts = [(r["cell"], r["n"]) for r in _cell_counts(docs, doc_id).collect()]
    plan = spark.createDataFrame(
        plan_ring(counts, shards, slack),
        "at_cell int, first bigint, last bigint, shard int, slot_first bigint",
    )
    order = Window.partitionBy("cell").orderBy("hash", "doc_id", "size", "text_crc32")
    placed = narrow.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))
    # the plan has at most CELLS + shards * virtual nodes runs or so: a fixed bound
    return placed.join(
        F.broadcast(plan),
        (F.col("cell") == F.col("at_cell")) & F.col("place").between(F.col("first"), F.col("last")),
    ).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows" if not slack else "bounded").alias("law"),
        "shard",
        (F.col("slot_first") + F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _cell_counts(docs: DataFrame, doc_id: str) -> DataFrame:
    """Rows per cell; reads the id column only."""
    cell = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - CELL_BITS).cast("int")
    return slim(docs, doc_id=doc_id).groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n")
    )
