"""Connected components and grouped exact linking.

Both work on tables: no group is gathered whole beyond a stated size, and no
list of links, labels or members passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from ..sources.sinks import remove_path
from .common import keep, released


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``, component being
    the smallest node that can be reached.

    Contraction: every node moves to the smallest node of its neighbourhood, the
    edges follow, self-loops and repeats go.  Each round at least halves the
    nodes of a component that is not done, so the rounds grow with the logarithm
    of the longest chain.  Each round is written to the shared folder and read
    again: a checkpoint would carry its size estimate along, and the estimates of
    chained joins multiply.
    """
    spark, path, written = edges.sparkSession, scratch_path(edges.sparkSession, "components"), 0

    def table(df: DataFrame) -> DataFrame:
        nonlocal written
        written += 1
        df.write.parquet(f"{path}/{written}")
        return spark.read.schema(df.schema).parquet(f"{path}/{written}")

    both = edges.select("a", "b").where("a <> b")
    live = table(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    moves = table(live.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
    label = moves.select(F.col("a").alias("node"), F.col("to").alias("component"))
    while True:
        one = live.join(moves.withColumnRenamed("to", "a2"), "a")
        two = one.join(moves.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b")
        live = table(two.where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct())
        if live.isEmpty():
            label = keep(label)
            remove_path(spark, path)
            return label
        moves = table(live.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        step = moves.select(F.col("a").alias("component"), "to")
        label = table(label.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def tiles(df: DataFrame, member: str, size: Column, limit: int) -> DataFrame:
    """Split large groups: adds ``tile_a``, ``tile_b``.  A group of ``size`` over
    ``limit`` is cut into ``k`` chunks by a hash of the member, and every pair of
    chunks is a tile, so any two members meet in some tile and no tile holds
    more than about ``2 * limit``."""
    k = F.ceil(size / F.lit(limit)).cast("int")
    chunk = F.pmod(F.xxhash64(F.col(member), F.lit("tile")), k).cast("int")
    pairs = F.when(k <= 1, F.array(F.struct(F.lit(0).alias("tile_a"), F.lit(0).alias("tile_b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1),
                    lambda other: F.struct(F.least(chunk, other).cast("int").alias("tile_a"),
                                           F.greatest(chunk, other).cast("int").alias("tile_b"))))
    return df.withColumn("_t", F.explode(pairs)).select("*", "_t.tile_a", "_t.tile_b").drop("_t")


def reach(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Star edges of the components of ``n`` members.  ``linked(x, rest)`` tells
    which of the members ``rest`` are linked to ``x``; every member is asked once,
    and only about those that are not reached yet."""
    rest = np.arange(n)
    out = []
    while len(rest) > 1:
        centre, queue, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while queue and len(rest):
            hit = linked(queue.pop(), rest)
            if hit.any():
                found = rest[hit]
                out.extend((centre, int(y)) for y in found)
                queue.extend(found.tolist())
                rest = rest[~hit]
    return out


def star_edges(df: DataFrame, keys: list[str], member: str, payload: str,
               linker: Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]]) -> DataFrame:
    """Links ``(a, b)`` inside each group of ``keys``, as stars of their components.

    Rows are dealt by key and sorted, and a task reads one group after another;
    a group is bounded by ``tiles``.  ``linker(payloads)`` gives the test.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, ids, loads, out = None, [], [], []

        def flush():
            if len(ids) > 1:
                out.extend((ids[x], ids[y]) for x, y in reach(len(ids), linker(loads)))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for key, one, load in zip(zip(*columns), batch.column(member).to_pylist(), batch.column(payload).to_pylist()):
                if key != held_key:
                    flush()
                    held_key, ids, loads = key, [], []
                ids.append(one)
                loads.append(load)
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        flush()
        yield _pairs(out)

    dealt = df.select(*keys, member, payload).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(released(run), "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})
