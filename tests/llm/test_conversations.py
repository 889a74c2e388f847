import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from surgecast.llm import conversations as C

from .common import multiset

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each row, straight from the contract."""
    out, seen = [], []
    for _, role, text in rows:
        bare = [c for c in text if c not in SPACE]
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.append((role, text))
    return out


def every_script(rows):
    """(cost, audit, repaired rows) of all edit scripts with up to two insertions at a place."""
    bad = faults(rows)
    gaps = [()] + [("I" + r,) for r in ("user", "assistant")] + [tuple("I" + r for r in p) for p in itertools.product(("user", "assistant"), repeat=2)]
    own = [["D"] if b in ("blank", "duplicate") else ["K", "Ruser", "Rassistant", "D"] for b in bad]
    for edits in itertools.product(*own):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, gap in enumerate(between):
                for g in gap:
                    cost, audit = cost + 3, audit + "I"
                    out.append((g[1:], ""))
                if i == len(rows):
                    break
                e, (_, role, text) = edits[i], rows[i]
                audit += e[0]
                cost += {"K": 0, "R": 3, "D": 4}[e[0]] + (3 if bad[i] == "truncated" and e != "D" else 0)
                if e != "D":
                    out.append((e[1:] if e[0] == "R" else role, text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                yield cost, audit, out


def by_strings(rows):
    """The cheapest and least script by a DP that holds whole strings and texts."""
    bad = faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def offer(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value
            return True
        return False

    def insert(heads):
        moved = True
        while moved:
            moved = False
            for s, (cost, audit, out) in list(heads.items()):
                for r in ("user", "assistant"):
                    if (s, r[0]) in step:
                        moved |= offer(heads, step[s, r[0]], (cost + 3, audit + "I", (*out, (r, ""))))

    for (_, role, text), b in zip(rows, bad):
        insert(best)
        new = {}
        more = 3 if b == "truncated" else 0
        for s, (cost, audit, out) in best.items():
            offer(new, s, (cost + 4, audit + "D", out))
            if b in ("blank", "duplicate"):
                continue
            if (s, role[:1]) in step:
                offer(new, step[s, role[:1]], (cost + more, audit + "K", (*out, (role, text))))
            for r in ("user", "assistant"):
                if (s, r[0]) in step:
                    offer(new, step[s, r[0]], (cost + 3 + more, audit + "R", (*out, (r, text))))
        best = new
    insert(best)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    turns = [t for t, _, _ in rows if t is not None]
    bad = faults(rows)
    cost, audit, out = by_strings(rows)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"),
            sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damaged(conv, rows):
    """The stated damage, row by row; then the stated order."""
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def some(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "user", "assistant"]
    texts = ["Yes.", "No!", "why", "", " \t", "Sure?  ", "a b c.", "same.", "café…"]
    return [(i, rng.choice(roles), rng.choice(texts) + (f" {i}." if rng.random() < 0.5 else "")) for i in range(n)]


def test_against_every_script():
    rng = random.Random(4)
    for n in (0, 1, 2, 3):
        for _ in range(12 if n < 3 else 8):
            rows = some(rng, n)
            cost, audit, out = min(every_script(rows), key=lambda x: x[:2])
            got = C.repaired(rows)
            assert (got[5], got[6]) == (cost, audit)
            assert got[7] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_against_whole_strings():
    rng = random.Random(5)
    for n in range(60):
        rows = some(rng, n)
        assert C.repaired(rows) == expected(rows)


def test_prefixes_are_compared_as_strings(monkeypatch):
    """Also when every hash collides."""
    rng = random.Random(6)
    for mod in (C._MOD, 3):
        monkeypatch.setattr(C, "_MOD", mod)
        for _ in range(200):
            base = "".join(rng.choice("DIKR") for _ in range(rng.randint(0, 40)))
            a, b = (base + "".join(rng.choice("DIKR") for _ in range(rng.randint(0, 20))) for _ in range(2))
            root = C.Prefix(None, None)
            shared = C._add(root, base)
            x, y = C._add(shared, a[len(base):]), C._add(rng.choice([shared, C._add(root, base)]), b[len(base):])
            assert "".join(x.symbols()) == a
            assert x.depth == len(a) and all(x.cut(d).depth == d for d in range(len(a) + 1))
            assert C.less(x, y) == (a < b)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def check(df, rows, here=None):
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    want = sorted(str((c, *expected(damaged(c, r)))) for c, r in by.items())
    damage = C.damage(df)
    assert multiset(C.repair(damage, here=F.col("here"))) == want


@pytest.mark.parametrize("block", [4096, 3])
def test_tables(spark, monkeypatch, block):
    """Short conversations, one of a third of all rows, nulls, ties, repeated rows; the
    cut conversations in blocks of three rows too."""
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(7)
    rows = [(c, *r) for c in range(60) for r in some(rng, rng.randint(1, 9))]
    rows += [(999, *r) for r in some(rng, 200)]
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", None), (70, None, "user", "a."), (70, None, "assistant", "b."), (70, 5, None, "c."),
             (71, 3, "user", "tie."), (71, 3, "assistant", "tie."), (71, 3, "assistant", "tie."), (72, 0, "", "No role."), (73, 9, "user", "x" * 300_000 + ".")]
    rng.shuffle(rows)
    check(table(spark, rows).repartition(5), rows)


def test_every_conversation_cut(spark, monkeypatch):
    """All of them by the second way: as many partitions as the sort can make."""
    monkeypatch.setattr(C, "BLOCK", 4)
    rng = random.Random(8)
    rows = [(c, *r) for c in range(2) for r in some(rng, 150)]
    check(table(spark, rows), rows)
    dup = [(1, i // 50, "user", "the same.") for i in range(300)] + [(2, 0, "user", "One?"), (2, 1, "assistant", "Two.")]
    check(table(spark, dup), dup)


def test_empty_dropped_and_clashing_names(spark):
    assert C.repair(table(spark, [])).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Lost."), (5000, 1, "user", "Kept?"), (5000, 2, "assistant", "Yes.")]
    df = table(spark, rows)
    for c in ("at", "n", "here", "block", "fault", "_key", "_tie", "_part", "cost", "audit"):
        df = df.withColumn(c, F.lit("own"))
    check(df, rows)
    got = C.repair(C.damage(df), here=F.col("here")).where(F.col("conv_id") == gone).first()
    assert tuple(got)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
