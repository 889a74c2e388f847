"""Merkle manifest of a dataset as a persistent, path-copying tree.

The rows of a group (a source) are leaves in the order of their ids; every ``FAN``
consecutive nodes hash to one above them, until one is left, the group's subroot.
The subroots make a tree of the same form, whose top is the root.

Leaves stand in aligned blocks of ``FAN ** INNER``: a block's levels are arrays of one
row, made without any shuffle, so a group of any size is spread over its blocks.  The
levels above the blocks are tables, one round a level.  A changed leaf makes a version
of the tree: it copies only the leaf's ancestors, within the block and then along the
block's path to the root, and shares every other node with the base tree.  Digests
travel, texts do not.  Everything is made of built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.common import join_on
from ..operators.ranking import ranked
from .common import keep

FAN = 16
INNER = 3  # levels made within a block
BLOCK = FAN ** INNER  # leaves of a block

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _above(nodes: Column) -> Column:
    """Digests of the runs of ``FAN`` in an array of digests."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")),
                       lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def _siblings(nodes: Column, at: Column) -> Column:
    """The rest of the run of node ``at`` (from 0): what stands left and right of it."""
    begin = at - at % FAN
    return F.struct(F.array_join(F.slice(nodes, begin + 1, at - begin), "").alias("left"),
                    F.array_join(F.slice(nodes, at + 2, begin + (FAN - 1) - at), "").alias("right"))


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def _climb(nodes: DataFrame, group: str) -> tuple[DataFrame, list[DataFrame]]:
    """The levels above ``nodes (group, at, n, digest)``: the paths
    ``(group, at, path, top)`` of all nodes, and the tables of new nodes by level.

    One round a level; a group of one node takes no further part.  Paths are handed
    down level by level the same way."""
    rounds, levels = [], []
    left = nodes.agg(F.max("n")).first()[0] or 1
    while left > 1:
        run = F.floor(F.col("at") / FAN)
        up = nodes.groupBy(group, run.alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("_kids"), F.max("n").alias("n"))
        kids = F.col("_kids.digest")
        up = keep(up.select(group, F.col("up").alias("at"), kids.alias("kids"), (F.col("n") > 1).alias("grown"), F.ceil(F.col("n") / FAN).alias("n"),
                            F.when(F.col("n") > 1, F.sha2(F.array_join(kids, ""), 256)).otherwise(kids[0]).alias("digest")))
        rounds.append(up)
        levels.append(up.where("grown").select(group, "at", "digest"))
        nodes = up.select(group, "at", "n", "digest")
        left = -(-left // FAN)
    paths = nodes.select(group, "at", _no_path().alias("path"), F.col("digest").alias("top"))
    for up in reversed(rounds):
        at = F.col("_i") + F.col("at") * FAN
        kid = (join_on(up.select(group, "at", "kids", "grown"), paths, [group, "at"])
               .select(group, "at", "path", "top", "grown", "kids", F.explode(F.sequence(F.lit(0), F.size("kids") - 1)).alias("_i")))
        step = F.when(F.col("grown"), F.array(_siblings(F.col("kids"), F.col("_i")))).otherwise(_no_path())
        paths = kid.select(group, at.alias("at"), F.concat(step, "path").alias("path"), "top")
    return paths, levels


@dataclass
class Tree:
    """``blocks``: one row of ``group``, ``block``, ``items`` (leaf rows) and ``levels``
    (the block's arrays of digests, from the leaves up); ``paths``: for every block
    what stands beside it on the way up, with ``subroot`` and ``root``."""

    group: str
    blocks: DataFrame
    paths: DataFrame
    upper: list[DataFrame]
    top: list[DataFrame]

    def nodes(self) -> DataFrame:
        """``(tree, group, level, at, digest)``: all nodes of the base tree, each once;
        tree ``group`` from the leaves up, tree ``top`` above the subroots (group null)."""
        inner = (self.blocks.select(self.group, "block", F.posexplode("levels").alias("level", "_nodes"))
                 .select(self.group, "block", "level", F.posexplode("_nodes").alias("_i", "digest")))
        wide = F.pow(F.lit(FAN), INNER - F.col("level")).cast("long")
        out = inner.select(F.lit("group").alias("tree"), self.group, "level", (F.col("block") * wide + F.col("_i")).alias("at"), "digest")
        for i, level in enumerate(self.upper):
            out = out.unionByName(level.select(F.lit("group").alias("tree"), self.group, F.lit(INNER + 1 + i).alias("level"), "at", "digest"))
        none = F.lit(None).cast(self.blocks.schema[self.group].dataType).alias(self.group)
        for i, level in enumerate(self.top):
            out = out.unionByName(level.select(F.lit("top").alias("tree"), none, F.lit(1 + i).alias("level"), "at", "digest"))
        return out

    def leaves(self) -> DataFrame:
        """A row per leaf: the fields of its item, its place ``at``, ``subroot``,
        ``root`` and ``path``, the siblings left and right of it level by level."""
        both = join_on(self.blocks, self.paths, [self.group, "block"])
        levels = [F.col("levels")[k] for k in range(INNER)]
        high = F.size("levels")

        def one(item: Column, i: Column) -> Column:
            low = [F.when(high > k + 1, F.array(_siblings(levels[k], F.floor(i / FAN ** k).cast("int")))).otherwise(_no_path()) for k in range(INNER)]
            return F.struct(item.alias("item"), F.concat(*low, "path").alias("path"))

        rows = both.select(self.group, "subroot", "root", F.explode(F.transform("items", one)).alias("_x"))
        return rows.select(self.group, "_x.item.*", "_x.path", "subroot", "root")

    def versions(self, changed: str = "changed") -> DataFrame:
        """``leaves`` with ``copies``: the leaf's digest (the changed one where there is
        one) and its copied ancestors up to the new root.  A version is these copies
        over the base tree; copy ``k`` replaces node ``at div FAN**k`` of level ``k``
        of the group's tree, later ones those of the tree of subroots."""
        start = F.coalesce(F.col(changed), F.col("leaf"))
        copies = F.aggregate("path", F.array(start), lambda done, p: F.concat(done, F.array(
            F.sha2(F.concat(p["left"], F.element_at(done, -1), p["right"]), 256))))
        return self.leaves().withColumn("copies", copies)


def build(leaves: DataFrame, group: str, order: list[str]) -> Tree:
    """The tree over ``leaves``, which hold ``group``, ``leaf`` (a digest) and what else
    shall come back with them (``changed``, the digest of a version)."""
    names = [c for c in leaves.columns if c != group]
    placed = ranked(leaves, [group], [*order, "leaf"])
    blocks = (placed.groupBy(group, F.floor(F.col("at") / BLOCK).alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("at", *names))).alias("items"), F.max("n").alias("n")))
    # each array is a column that the next one reads twice, so none is made anew per element
    made = blocks.select(group, "block", "n", "items", F.col("items.leaf").alias("l0"))
    for k in range(1, INNER + 1):
        made = made.select("*", F.when(F.col("n") > FAN ** (k - 1), _above(F.col(f"l{k - 1}"))).alias(f"l{k}"))
    levels = F.filter(F.array(*[f"l{k}" for k in range(INNER + 1)]), lambda a: a.isNotNull())
    made = keep(made.select(group, "block", "n", "items", levels.alias("levels")))
    tops = keep(made.select(group, F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"),
                            F.element_at(F.element_at("levels", -1), 1).alias("digest")))
    paths, upper = _climb(tops, group)
    paths = keep(paths.select(group, F.col("at").alias("block"), "path", F.col("top").alias("subroot")))
    subroots = paths.where("block = 0").select(F.lit(0).alias("_all"), group, F.col("subroot").alias("digest"))
    subroots = keep(ranked(subroots, ["_all"], [group]))
    high, top = _climb(subroots, "_all")
    ends = subroots.select(group, "at").join(high, "at").select(group, F.col("path").alias("_high"), F.col("top").alias("root"))
    paths = keep(join_on(paths, ends, [group]).select(group, "block", F.concat("path", "_high").alias("path"), "subroot", "root"))
    return Tree(group, made, paths, upper, [t.drop("_all") for t in top])


def tampered(id_col: str, every: int = 5) -> Column:
    """Rows that are tampered with (a null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % every == 0


def manifest(docs: DataFrame) -> Tree:
    """The tree of ``documents``, by source.

    A leaf is the digest of doc_id, source, lang, n_chars and text, each framed (null:
    ``-``).  Leaves ascend by doc_id (null first; rows of one id by their digest, and
    repeated rows are a leaf each), groups by source (null first, bytewise).  Other
    columns play no part.  A tampered row's version lower-cases A-Z of the text.  Of an
    empty table there is no leaf and no root."""
    head = [framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    low = digest(*head, framed(F.translate("text", UPPER, LOWER)))
    rows = docs.select("source", "doc_id", digest(*head, framed(F.col("text"))).alias("leaf"), F.when(tampered("doc_id"), low).alias("changed"))
    return build(rows, "source", ["doc_id"])


def proofs(tree: Tree) -> DataFrame:
    """``(source, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, a
    row per leaf: the digest of its siblings up to the root, the root of its version
    and whether that is the base tree's."""
    beside = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    return tree.versions().select("source", "doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"),
                                  F.element_at("copies", -1).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
