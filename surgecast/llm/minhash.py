"""Near duplicates by a signature-coordinate inverted join (MinHash).

Every distinct shingle set gets a signature of ``COORDINATES`` minima.  A set is
posted under its coordinate-value pairs.  Two sets with a similarity of 0.8 agree
in each coordinate with that chance, so fewer than ``MATCHES`` agreements of 48
come about once in some millions of such pairs; pairs with at least ``MATCHES``
agreements are candidates.

* Prefix: with pairs ordered rarest first, two sets that agree ``MATCHES`` times
  share one of the first ``COORDINATES - MATCHES + 1`` of each.  Only those are
  posted; pairs that one set alone has are skipped.
* Lists: inside a list, agreements are counted on whole signatures, from each set
  to those not reached yet, so copies never make all their pairs.
* Confirmation: the sets of a candidate cluster meet, and links are decided on the
  full sets in the same way: exact components, without expanding pairs.

Lists and clusters beyond a bound are cut into chunks, and every two chunks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import keep, released, text_bytes
from .graph import components, star_edges, tiles

COORDINATES = 48
MATCHES = 24
LIST_LIMIT = 4096  # members of a posting list that one task compares
CLUSTER_LIMIT = 4_000_000  # shingles of a cluster that one task holds
_MULT = np.random.default_rng(4242).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = np.random.default_rng(99).integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first document, distinct shingles, where each document's begin)`` by chunks."""
    for begin, run in W.chunks(texts):
        value, owner = W.shingles(W.scan(run), width)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[first], owner[first]
        yield begin, value, np.searchsorted(owner, np.arange(len(run) + 1))


def signatures(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, n_shingles, set_id, sig)``: key is a hash of the text, set_id one of
    the whole set (null if empty), sig the packed 32-bit minima (null if empty)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n, ids, sigs = [], [], []
            for _, value, cut in _sets(texts, width):
                size = np.diff(cut)
                some = np.flatnonzero(size)
                n.extend(size.tolist())
                own_id = np.zeros(len(size), np.uint64)
                low = np.zeros((len(size), COORDINATES), np.uint32)
                if len(some):
                    at = cut[some]
                    own_id[some] = W.mix(np.add.reduceat(W.mix(value * _KEY[0]), at) * _KEY[1] + size[some].astype(np.uint64))
                    for j in range(COORDINATES):
                        low[some, j] = np.minimum.reduceat(value * _MULT[j], at) >> np.uint64(32)
                signed = own_id.view(np.int64).tolist()
                ids.extend(x if s else None for x, s in zip(signed, size))
                sigs.extend(low[i].tobytes() if s else None for i, s in enumerate(size))
            yield pa.record_batch({id_col: batch.column(0), "key": batch.column(1), "n_shingles": pa.array(n, pa.int64()),
                                   "set_id": pa.array(ids, pa.int64()), "sig": pa.array(sigs, pa.binary())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.xxhash64(text_col).alias("key"), text_bytes(text_col).alias("_b")).mapInArrow(
        released(run), f"`{id_col}` {kind}, key long, n_shingles long, set_id long, sig binary")


def _agree(loads: list[bytes]):
    sig = np.frombuffer(b"".join(loads), np.uint32).reshape(len(loads), COORDINATES)
    return lambda x, rest: (sig[rest] == sig[x]).sum(1) >= MATCHES


def similar(percent: int):
    """Test on full sets: ``100 * intersection >= percent * union``."""

    def linker(loads: list[bytes]):
        size = np.array([len(x) // 8 for x in loads])
        local = np.unique(np.frombuffer(b"".join(loads), np.uint64), return_inverse=True)[1].reshape(-1)
        begin = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(local.max() + 2, np.int64)

        def linked(x, rest):
            own = local[begin[x] : begin[x + 1]]
            fits = np.minimum(size[rest], size[x]) * 100 >= percent * np.maximum(size[rest], size[x])
            out = np.zeros(len(rest), bool)
            near = rest[fits]
            if len(near):
                mark[own] = 1
                take = np.repeat(begin[near] - np.concatenate(([0], np.cumsum(size[near])[:-1])), size[near]) + np.arange(size[near].sum())
                both = np.add.reduceat(mark[local[take]], np.concatenate(([0], np.cumsum(size[near])[:-1])))
                mark[own] = 0
                out[fits] = 100 * both >= percent * (size[near] + size[x] - both)
            return out

        return linked

    return linker


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Star edges of candidates from ``classes (set_id, sig)``, one row a set."""

    def coordinates(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32)
            m = len(sig) // COORDINATES
            yield pa.record_batch({
                "set_id": pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), COORDINATES)),
                "post": pa.array(np.tile(np.arange(COORDINATES, dtype=np.int64), m) << 32 | sig.astype(np.int64) & 0xFFFFFFFF)})

    posts = classes.select("set_id", "sig").mapInArrow(released(coordinates), "set_id long, post long")
    common = posts.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    shared = posts.join(common, "post")
    prefix = COORDINATES - MATCHES + 1
    listed = (shared.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("n", "post"))).alias("p"))
              .where(F.size("p") >= MATCHES)
              .select("set_id", F.explode(F.slice("p", 1, F.size("p") - (MATCHES - 1))).alias("q"))
              .select("set_id", "q.n", "q.post"))
    assert prefix > 0
    # values that only one set has in its prefix meet nobody: drop those lists before the signatures are joined
    lists = keep(listed)
    sizes = lists.groupBy("post").agg(F.count("*").alias("m")).where("m > 1")
    ready = tiles(lists.join(sizes, "post").select("set_id", "post", "m"), "set_id", F.col("m"), LIST_LIMIT)
    loaded = ready.join(classes.select("set_id", "sig"), "set_id")
    return star_edges(loaded, ["post", "tile_a", "tile_b"], "set_id", "sig", _agree).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Groups of near duplicates.

    Returns ``(id, n_shingles, set_id, component_id, kept)``, one row for each
    row of ``docs``: set_id names the class of equal sets and group the group (both
    null if empty), key is ``xxhash64`` of the text, component_id the smallest id of
    the group.  Texts without words (null,
    empty, blank) link with nothing.  Repeated rows come back repeated; rows with
    a null id link like others, but never name a group unless it has no other id.
    """
    signed = keep(signatures(docs, width, id_col, text_col))
    classes = keep(signed.where("set_id is not null").groupBy("set_id").agg(
        F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.min(id_col).alias("rep")))
    cluster = keep(components(keep(candidate_edges(classes))))
    # full sets of the sets that have a candidate; one text of each class
    sized = cluster.join(classes.select(F.col("set_id").alias("node"), "n_shingles", "rep"), "node")
    total = sized.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    member = sized.join(total, "component").select(F.col("node").alias("set_id"), "component", "total", F.col("rep").alias("_id"))
    texts = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_b"))
    found = member.join(texts, member["_id"].eqNullSafe(texts["_id"])).select("set_id", "component", "total", "_b")

    def as_sets(batches):
        for batch in batches:
            loads, ids = [], []
            for _, value, cut in _sets(batch.column(3).to_pylist(), width):
                loads.extend(value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:]))
                size = np.diff(cut)
                some = np.flatnonzero(size)
                own = np.zeros(len(size), np.uint64)
                if len(some):
                    own[some] = W.mix(np.add.reduceat(W.mix(value * _KEY[0]), cut[some]) * _KEY[1] + size[some].astype(np.uint64))
                ids.extend(own.view(np.int64).tolist())
            out = pa.record_batch({"set_id": batch.column(0), "component": batch.column(1), "total": batch.column(2),
                                   "payload": pa.array(loads, pa.binary())})
            # a repeated id may bring another text: it counts only for its own class
            yield out.filter(pa.array(np.array(ids, np.int64) == batch.column(0).to_numpy(zero_copy_only=False)))

    full = found.mapInArrow(released(as_sets), "set_id long, component long, total long, payload binary").dropDuplicates(["set_id"])
    tiled = tiles(full, "set_id", F.col("total"), CLUSTER_LIMIT)
    links = star_edges(tiled, ["component", "tile_a", "tile_b"], "set_id", "payload", similar(percent)).distinct()
    group = components(keep(links)).select(F.col("node").alias("set_id"), F.col("component").alias("_group"))
    grouped = signed.join(group, "set_id", "left").withColumn("_group", F.coalesce("_group", "set_id"))
    least = (grouped.where("_group is not null").groupBy("_group").agg(F.min(id_col).alias("component_id")))
    out = grouped.join(least, "_group", "left").withColumn(
        "component_id", F.when(F.col("set_id").isNull(), F.col(id_col)).otherwise(F.col("component_id")))
    return out.select(id_col, "key", "n_shingles", "set_id", F.col("_group").alias("group"), "component_id",
                      F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))
