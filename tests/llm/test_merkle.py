import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from surgecast.llm import merkle

from .common import awkward, multiset


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return h(*map(framed, row[:4]), framed(text))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """All levels of a tree, from its nodes up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def proof(levels, at):
    out = []
    for level in levels[:-1]:
        begin = at // 16 * 16
        out += level[begin:at] + level[at + 1 : begin + 16]
        at //= 16
    return out


def brute(rows):
    """The contract, a whole tree built anew for every tampered leaf."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in groups:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: climb([x[1] for x in groups[s]]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, (doc_id, own, r) in enumerate(groups[s]):
            leaves, heads = [x[1] for x in groups[s]], [trees[x][-1][0] for x in names]
            if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0:
                leaves[at] = leaf(r, lowered(r[4]))
                heads[place] = climb(leaves)[-1][0]
            folded = climb(heads)[-1][0]
            beside = h(*proof(trees[s], at), *proof(top, place))
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], beside, folded, folded == top[-1][0]))
    return sorted(map(str, out))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def got(df, tree=None):
    out = merkle.proofs(merkle.manifest(df))
    return multiset(out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))


def sample(n):
    sources = [None, "", "é", "a", "B", "src10", "src9"]
    rows = [(i, sources[i % 7] if i % 3 else "hot", "en" if i % 2 else None, i if i % 5 else None, f"Text No {i} " + "X" * (i % 9)) for i in range(n)]
    return rows + [(i, None if i is None else "src1", "de", len(t or ""), t) for i, t in awkward()]


@pytest.mark.parametrize("n", [0, 1, 16, 17, 300])
def test_as_whole_trees_built_anew(spark, n):
    rows = sample(n)
    assert got(docs(spark, rows)) == brute(rows)


def test_many_blocks_and_levels(spark, monkeypatch):
    """Blocks of 16 leaves, so that three levels stand above them; repeated rows and
    one id that a third of all rows bear."""
    monkeypatch.setattr(merkle, "INNER", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i % 400 if i % 3 else 7, "one", "en", 3, "Abc" if i % 3 == 0 else f"T{i}") for i in range(700)] + sample(40)
    df = docs(spark, rows)
    assert got(df) == brute(rows)
    assert got(df.repartition(3)) == got(df.coalesce(1))


def test_many_sources(spark):
    rows = [(i, f"s{i % 290}", "en", i, f"Text {i}") for i in range(600)]
    assert got(docs(spark, rows)) == brute(rows)


def test_one_source_and_one_row(spark):
    rows = [(5, "only", "en", 4, "Text")]
    assert got(docs(spark, rows)) == brute(rows)
    assert got(docs(spark, rows * 2)) == brute(rows * 2)


def test_empty_table_and_clashing_names(spark):
    assert got(docs(spark, [])) == []
    rows = sample(60)
    df = docs(spark, rows)
    for c in ("at", "n", "leaf", "changed", "block", "root", "path", "_tie", "_part", "items"):
        df = df.withColumn(c, F.lit("own"))
    assert got(df) == brute(rows)


def test_a_version_is_its_copies_over_the_base_tree(spark):
    """Copied nodes replace those of the base tree: together they are the tree of the
    changed leaves, and no version copies more than its own ancestors."""
    rows = [(i, "a" if i % 4 else "b", "en", i, f"Text {i}") for i in range(400)]
    tree = merkle.manifest(docs(spark, rows))
    base = {(r.tree, r.source, r.level, r["at"]): r.digest for r in tree.nodes().collect()}
    for s in "ab":
        levels = climb([leaf(r, r[4]) for r in rows if r[1] == s])
        assert [[base["group", s, k, i] for i in range(len(x))] for k, x in enumerate(levels)] == levels
    assert len(base) == sum(len(x) for s in "ab" for x in climb([leaf(r, r[4]) for r in rows if r[1] == s])) + 1
    versions = [r for r in tree.versions().collect() if r.changed is not None]
    assert versions
    for v in versions[:20]:
        leaves = [leaf(r, lowered(r[4]) if r[0] == v.doc_id else r[4]) for r in rows if r[1] == v.source]
        levels = climb(leaves)
        assert len(v.copies) == len(levels) + 1
        for k, level in enumerate(levels):
            mine = {i: base["group", v.source, k, i] for i in range(len(level))}
            mine[v["at"] // 16 ** k] = v.copies[k]
            assert [mine[i] for i in range(len(level))] == level
