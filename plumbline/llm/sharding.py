"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` positions. Every shard owns ``VIRTUAL_NODES`` positions, picked by hash;
a document's id hashes to a position and belongs to the next owned position clockwise. A shard
holds at most its share of rows (the mean, rounded up for the first few shards and down for the
others), so counts are at most one apart. A shard first takes the rows of its own positions in
ring order; the rows that find it full continue clockwise to the next shard with room. Only
those rows leave the place the ring gives them: when a shard is added, rows move onto it or
along the overflow, and all others stay.

The ring works on counts per position, of which there are ``CELLS`` at most whatever the size of
the corpus: those alone reach the driver, which walks them once, and go back as a broadcast
table of at most ``CELLS`` rows plus one per shard and walked gap. Rows are ranked inside a
position by hash, in slices, so no position is gathered by one task. Only DataFrame functions
touch rows.

Defined results: a null text counts 8 bytes; a null id hashes as the text ``null``; rows that
repeat an id share a position and may lie in different shards once the first is full; an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import order_key, stored, total_before
from plumbline.sources.relations import relation

CELLS = 65_536
VIRTUAL_NODES = 64
RECORD_BYTES = 8


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Owned positions in clockwise order as ``(position, shard)``. Where two virtual nodes
    fall on one position, the lower shard owns it."""
    owner: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.md5(f"shard:{shard}:{node}".encode()).hexdigest()
            owner.setdefault(int(digest[:4], 16), shard)
    return sorted(owner.items())


def bounded_loads(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """``(cell, first, last, shard, slot)``: rows ``first`` up to before ``last`` of a cell go to
    ``shard``, from ``slot`` on. At most one entry per cell and one more per shard filled up."""
    nodes = ring(shards)
    positions = [p for p, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    placed, waiting = [], []

    def put(cell: int, first: int, last: int, shard: int) -> int:
        take = min(last - first, room[shard] - used[shard])
        if take:
            placed.append((cell, first, first + take, shard, used[shard]))
            used[shard] += take
        return first + take

    for cell in sorted(counts):
        node = bisect_left(positions, cell) % len(nodes)
        left = put(cell, 0, counts[cell], nodes[node][1])
        if left < counts[cell]:
            waiting.append((cell, left, counts[cell], node))
    # Overflow walks on in ring order; a full shard never has room again, so the walk of a
    # cell starts where that of the cell before it stopped, if that is further on.
    reached = 0
    for cell, first, last, node in waiting:
        reached = max(reached, node)
        while first < last:
            first = put(cell, first, last, nodes[reached % len(nodes)][1])
            reached += first < last
    return placed


def shard_rows(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(content) + RECORD_BYTES).cast("bigint").alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(order_key("doc", doc_id), 1, 4), 16, 10).cast("int").alias("_pl_cell"),
        ).withColumn("_pl_key", F.md5(F.concat_ws(":", "doc_id", "size", "text_crc32"))),
        "rows",
    )
    counts = {r[0]: r[1] for r in rows.groupBy("_pl_cell").count().collect()}
    places = relation(
        docs.sparkSession,
        "_pl_cell int, _pl_first bigint, _pl_last bigint, shard int, _pl_slot bigint",
        bounded_loads(counts, shards),
    )
    ranked = total_before(
        rows, ["_pl_cell"], "_pl_key", ["doc_id", "size", "text_crc32"],
        F.lit(1).cast("bigint"), "_pl_rank", max(counts.values(), default=0), least_digits=0,
    )
    inside = (F.col("_pl_rank") >= F.col("_pl_first")) & (F.col("_pl_rank") < F.col("_pl_last"))
    return (
        ranked.join(F.broadcast(places), "_pl_cell")
        .where(inside)
        .select(
            "doc_id", "size", "text_crc32", "shard",
            (F.col("_pl_slot") + F.col("_pl_rank") - F.col("_pl_first")).alias("slot"),
        )
    )
