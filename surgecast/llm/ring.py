"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of the ring.  A document stands at the hash
of its text (equal texts stand together, in the order of their ids) and belongs
to the next point clockwise.  A shard takes no more than its capacity; what
overflows continues clockwise to the next point whose shard has room.

Only counts per arc (one per ring point) and per partition reach the driver; it
cuts the arcs into pieces, and each row finds its piece by its rank on the ring.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import keep, partitions, released


def ring_points(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all points in ring order, and the shard of each."""
    placed = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s)
                    for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in placed], np.int64), np.array([s for _, s in placed])


def pieces(arc_rows: np.ndarray, owner: np.ndarray, capacity: list[int]) -> list[tuple[int, int, int]]:
    """``(first rank on the ring, shard, first slot)`` in ring order.

    First every arc fills its own shard, in ring order, as far as there is room;
    the rest of each arc then moves on, one ring point at a time."""
    begin = np.cumsum(arc_rows) - arc_rows
    left, done, room = arc_rows.copy(), np.zeros(len(arc_rows), np.int64), list(capacity)
    out, points = [], len(owner)
    for hop in range(points):
        for arc in np.flatnonzero(left):
            shard = int(owner[(arc + hop) % points])
            n = min(int(left[arc]), room[shard])
            if n:
                out.append((int(begin[arc] + done[arc]), shard, capacity[shard] - room[shard]))
                room[shard] -= n
                left[arc] -= n
                done[arc] += n
    return sorted(out)


def shard(docs: DataFrame, shards: int = 8, virtual: int = 64, slack: float = 0.0, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)``, a row per row.

    size is the text's UTF-8 bytes plus 1 (null: 1).  With no slack the law is
    ``rows``: capacities add up to the rows, so counts are at most one apart; with
    slack a shard takes up to ``(1 + slack)`` of the mean and law is null.  Slots
    are gapless from 0 in each shard.  Null ids stand before others of their text;
    repeated rows get a slot each; null and empty texts are equal.  grown_shard is
    null: loads, not the id alone, decide.
    """
    spark = docs.sparkSession
    place, owner = ring_points(shards, virtual)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("_at"))
    ordered = rows.repartitionByRange(partitions(spark), "_at", id_col).sortWithinPartitions("_at", id_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def number(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            arc = np.searchsorted(place, batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.full(n, part, np.int32)), pa.array(np.arange(k, k + n)), pa.array(arc.astype(np.int32))],
                [id_col, "size", "text_crc32", "_part", "_k", "_arc"])
            k += n

    # checkpointed: ranks and counts come from the same numbering
    numbered = keep(ordered.mapInArrow(released(number), f"`{id_col}` {kind}, size long, text_crc32 long, _part int, _k long, _arc int"))
    arc_rows = np.zeros(len(place) + 1, np.int64)  # the last arc wraps around to the first point
    for r in numbered.groupBy("_arc").count().collect():
        arc_rows[r["_arc"]] = r["count"]
    parts = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}
    total = int(arc_rows.sum())
    if slack:
        capacity = [int(np.ceil(total * (1 + slack) / shards))] * shards
    else:
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    cut = pieces(arc_rows, owner, capacity) or [(0, 0, 0)]
    first, to, slot = (np.array(x, np.int64) for x in zip(*cut))
    before, at = {}, 0
    for p in sorted(parts):
        before[p], at = at, at + parts[p]
    law = "rows" if not slack else None

    def locate(batches):
        for batch in batches:
            part = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(4).to_numpy(zero_copy_only=False) + np.array([before[p] for p in part.tolist()], np.int64)
            i = np.searchsorted(first, rank, side="right") - 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([law] * n, pa.string()), pa.array(to[i].astype(np.int32)), pa.array(slot[i] + rank - first[i]),
                 pa.nulls(n, pa.int32())], [id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"])

    return numbered.mapInArrow(
        released(locate), f"`{id_col}` {kind}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
