"""Repair of the structure of conversations by a persistent audit DP.

A conversation's roles must read ``(s?(ua)+)?``.  Rows may be kept, given another role
or deleted, and empty rows inserted; the cheapest list of edits wins, of equally cheap
ones the least by ASCII.  The DP walks the rows with one best edit prefix per state.
Prefixes are linked nodes that share their beginnings, with binary-lifting ancestors
and rolling hashes: a tie is settled by searching the longest common prefix; where
hashes agree on different nodes, the symbols themselves are compared.

Rows are dealt by ranges of (conversation, turn), so most conversations stand whole in
a partition and are done there in one pass.  Those that stand in more than one (at most
one less than there are partitions), among them any very long one, are cut into blocks
of ``BLOCK`` rows: each block gives its best edits from every state to every other, a
second DP of the same kind chains the blocks, and only the digest of the repaired text,
which is one sequential function of it, reads such a conversation in a single stream.

No two different edit lists for the same rows and of the same cost begin one another
(the longer one would cost more by its insertions), so prefixes can be compared as soon
as they meet, and blocks by their own lists alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.common import join_on
from ..operators.ranking import dealt, numbered
from .common import keep, partitions, prepare, released

BLOCK = 4096  # rows of a block of a conversation that is cut

# Costs of the edits and what truncated rows add when they stay.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

NONE, SYSTEM, USER, WHOLE = range(4)  # nothing yet; after s; after u; after a
STATES = range(4)
#: The state after 0, 1, 2 insertions.
INSERTED = {NONE: (NONE, USER, WHOLE), SYSTEM: (SYSTEM, USER, WHOLE), USER: (USER, WHOLE), WHOLE: (WHOLE, USER)}
ENDS = {NONE: 0, SYSTEM: 2, USER: 1, WHOLE: 0}  # insertions that end a conversation rightly

OK, BLANK, DUPLICATE, CUT = range(4)  # a row's first fault
SPACES = " \t\n\v\f\r"

RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


# ------------------------------------------------------------ persistent prefixes

_MOD = (1 << 61) - 1
_BASE = 1_000_003_197


class Prefix:
    """An edit prefix: its last symbol and the prefix before it.  ``up[k]`` is the
    prefix 2**k symbols shorter; ``hash`` is a rolling hash of all symbols."""

    __slots__ = ("symbol", "depth", "hash", "up")

    def __init__(self, before: "Prefix | None", symbol, code: int = 0):
        self.symbol = symbol
        if before is None:
            self.depth, self.hash, self.up = 0, 1, []
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * _BASE + code + 1) % _MOD
        up = [before]
        k = 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = up

    def cut(self, depth: int) -> "Prefix":
        node, rest = self, self.depth - depth
        while rest:
            k = rest.bit_length() - 1
            node, rest = node.up[k], rest - (1 << k)
        return node

    def symbols(self) -> list:
        out, node = [], self
        while node.up:
            out.append(node.symbol)
            node = node.up[0]
        return out[::-1]


def same(a: Prefix, b: Prefix) -> bool:
    """Whether two prefixes of one depth hold the same symbols, by the symbols."""
    while a is not b:
        if a.symbol != b.symbol:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Prefix, b: Prefix) -> bool:
    """Whether ``a`` stands before ``b``; a beginning of the other stands before it."""
    depth = min(a.depth, b.depth)
    x, y = a.cut(depth), b.cut(depth)
    if x.hash == y.hash:
        if same(x, y):
            return a.depth < b.depth
        return a.symbols() < b.symbols()  # hashes collide
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if not same(x.up[0], y.up[0]):
        return a.symbols() < b.symbols()  # hashes collide
    return x.symbol < y.symbol


# ------------------------------------------------------------------ the row DP

@cache
def moves(initial: str, fault: int) -> tuple[tuple[int, int, str, int], ...]:
    """The cheapest edits of a row from each state to each other: ``(from, to, symbols,
    cost)``, insertions standing before the row's own edit.  An insertion before a
    deletion is never least: after it, it costs the same and reads less."""
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(a: int, b: int, cost: int, symbols: str) -> None:
        if (a, b) not in best or (cost, symbols) < best[a, b]:
            best[a, b] = cost, symbols

    for a in STATES:
        offer(a, a, DELETE, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        for n, mid in enumerate(INSERTED[a]):
            cost = n * INSERT + (TRUNCATED if fault == CUT else 0)
            to, own = (WHOLE, "a") if mid == USER else (USER, "u")
            offer(a, to, cost + REROLE, "I" * n + "R")
            if initial == own:
                offer(a, to, cost, "I" * n + "K")
            if initial == "s" and mid == NONE:
                offer(a, SYSTEM, cost, "I" * n + "K")
    return tuple((a, b, s, c) for (a, b), (c, s) in best.items())


Heads = list  # per state: None or (cost, Prefix)


def _add(node: Prefix, symbols: str) -> Prefix:
    for s in symbols:
        node = Prefix(node, s, ord(s))
    return node


def row_step(heads: Heads, initial: str, fault: int) -> Heads:
    """The best prefix of every state after one more row."""
    new: Heads = [None] * 4
    for a, b, symbols, cost in moves(initial, fault):
        head = heads[a]
        if head is None:
            continue
        total, old = head[0] + cost, new[b]
        if old is None or total < old[0]:
            new[b] = (total, head[1], symbols)
        elif total == old[0] and less(_add(head[1], symbols), _add(old[1], old[2])):
            new[b] = (total, head[1], symbols)
    return [h and (h[0], _add(h[1], h[2])) for h in new]


def ended(heads: Heads) -> tuple[int, Prefix]:
    """The best of the prefixes once each is ended rightly: cost and prefix."""
    best = None
    for state in STATES:
        if heads[state] is None:
            continue
        n = ENDS[state]
        cost, node = heads[state][0] + n * INSERT, _add(heads[state][1], "I" * n)
        if best is None or cost < best[0] or (cost == best[0] and less(node, best[1])):
            best = cost, node
    return best


def start() -> Heads:
    return [(0, Prefix(None, None)), None, None, None]


def first_fault(role: str, text: str, seen: set) -> int:
    bare = text.rstrip(SPACES)
    if not bare:
        return BLANK
    if (role, text) in seen:
        return DUPLICATE
    seen.add((role, text))
    return CUT if bare[-1] not in ".!?" else OK


class Repaired:
    """The digest of repaired rows, fed with their edits in order."""

    def __init__(self):
        self.sha, self.state, self.empty = hashlib.sha256(), NONE, True

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def insert(self, n: int) -> None:
        for _ in range(n):
            self._line("assistant" if self.state == USER else "user", "")
            self.state = WHOLE if self.state == USER else USER

    def edit(self, symbols: str, role: str, text: str) -> None:
        """Insertions and the own edit of a row."""
        self.insert(len(symbols) - 1)
        if symbols[-1] == "R":
            role = "assistant" if self.state == USER else "user"
        if symbols[-1] != "D":
            self._line(role, text)
            self.state = {"s": SYSTEM, "u": USER, "a": WHOLE}[role[0]]


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def pieces(audit: str) -> Iterator[str]:
    """An edit list cut behind each row's own edit; insertions at its end come last."""
    begin = 0
    for i, s in enumerate(audit):
        if s != "I":
            yield audit[begin : i + 1]
            begin = i + 1
    if begin < len(audit):
        yield audit[begin:]


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The result columns of a whole conversation: ``(turn, role, text)`` in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen: set = set()
    faults = [first_fault(role, text, seen) for _, role, text in rows]
    heads = start()
    for (_, role, _), fault in zip(rows, faults):
        heads = row_step(heads, role[:1], fault)
    cost, node = ended(heads)
    audit, out = "".join(node.symbols()), Repaired()
    parts = pieces(audit)
    for _, role, text in rows:
        out.edit(next(parts), role, text)
    out.insert(len(next(parts, "")))
    return (gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal_pairs("".join(r[1][:1] or " " for r in rows)), cost, audit,
            out.sha.hexdigest())


# ---------------------------------------------------------------- Spark passes

def _runs(batches: Iterable[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """``(key, rows behind the key columns)`` of neighbouring rows of one key."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, run in groupby(rows, lambda r: r[:keys]):
        yield key, (r[keys:] for r in run)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _mapped(df: DataFrame, columns: str, run) -> DataFrame:
    """``mapInArrow`` of a generator of rows; the first column keeps its type."""
    key = df.schema.fields[0]
    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "longs": pa.list_(pa.int64()), "strings": pa.list_(pa.string())}[t])
                       for n, t in (c.split() for c in columns.split(", "))])
    ddl = f"`{key.name}` {key.dataType.simpleString()}, " + columns.replace("longs", "array<long>").replace("strings", "array<string>")

    def batches(given):
        first = next(given, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field(0), *arrow])

        def again():
            yield first
            yield from given

        yield from _batched(run(again()), schema)

    return df.mapInArrow(released(batches), ddl)


_LONGS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(batches) -> Iterator[tuple]:
    """Results of conversations that stand whole in a partition."""
    for (conv,), rows in _runs(batches):
        yield (conv, *repaired([r[:3] for r in rows if r[3]]))


def _block(batches) -> Iterator[tuple]:
    """Best edits of a block from every state to every other, and its illegal pairs."""
    for (conv, block), rows in _runs(batches, 2):
        steps = [(initial, fault) for _, initial, fault in rows]
        costs, audits = [], []
        for a in STATES:
            heads: Heads = [None] * 4
            heads[a] = 0, Prefix(None, None)
            for initial, fault in steps:
                heads = row_step(heads, initial, fault)
            costs += [h and h[0] for h in heads]
            audits += [h and "".join(h[1].symbols()) for h in heads]
        initials = "".join(i or " " for i, _ in steps)
        yield conv, block, costs, audits, initials[0] + initials[-1], illegal_pairs(initials)


def _code(symbol: str) -> int:
    return int.from_bytes(hashlib.blake2b(symbol.encode(), digest_size=7).digest(), "big")


def _chain(batches) -> Iterator[tuple]:
    """The edits of every block of a conversation, and in a row of block -1 its cost
    and illegal pairs: the same DP with a block's edit list as one symbol."""
    for (conv,), blocks in _runs(batches):
        heads, last, illegal = start(), "", 0
        for _, costs, audits, ends, inner in blocks:
            illegal += inner + (illegal_pairs(last + ends[0]) if last else 0)
            last = ends[1]
            new: Heads = [None] * 4
            for a in STATES:
                for b in STATES:
                    if heads[a] is None or costs[4 * a + b] is None:
                        continue
                    total, symbol = heads[a][0] + costs[4 * a + b], audits[4 * a + b]
                    if new[b] is not None and total > new[b][0]:
                        continue
                    node = Prefix(heads[a][1], symbol, _code(symbol))
                    if new[b] is None or total < new[b][0] or less(node, new[b][1]):
                        new[b] = total, node
            heads = new
        cost, node = ended(heads)
        symbols = node.symbols()
        while symbols and symbols[-1] == "I":
            symbols.pop()
        for i, s in enumerate(symbols):
            yield conv, i, s, None, None
        yield conv, -1, None, cost, illegal


def _streamed(batches) -> Iterator[tuple]:
    """Edit list and digest of a conversation from its rows and their edits, in order."""
    for (conv,), rows in _runs(batches):
        out, audit = Repaired(), []
        for _, role, text, piece in rows:
            out.edit(piece, role, text)
            audit.append(piece)
        rest = ENDS[out.state]
        out.insert(rest)
        yield conv, "".join(audit) + "I" * rest, out.sha.hexdigest()


def _fault(first: Column) -> Column:
    bare = F.rtrim(F.translate("text", SPACES[1:], " " * 5))
    return (F.when(bare == "", BLANK).when(~first, DUPLICATE)
            .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(OK))


def _cut_conversations(rows: DataFrame, conv: str) -> DataFrame:
    """Results of the conversations of ``rows`` (all their rows), block by block."""
    spark = rows.sparkSession
    parts = partitions(spark)
    placed = numbered(rows.where("here"), [conv], ["turn", "role", "_key"])
    first = placed.groupBy(conv, "role", "_key").agg(F.min("at").alias("at")).select(conv, "at", F.lit(True).alias("_first"))
    placed = keep(join_on(placed, first, [conv, "at"], "left")
                  .select(conv, F.floor(F.col("at") / BLOCK).alias("block"), "at", "turn", "role", "text",
                          F.substring("role", 1, 1).alias("initial"), _fault(F.coalesce("_first", F.lit(False))).cast("long").alias("fault")))
    light = placed.select(conv, "block", "at", "initial", "fault").repartition(parts, conv, "block").sortWithinPartitions(conv, "block", "at")
    blocks = _mapped(light, "block long, costs longs, audits strings, ends string, inner long", _block)
    chain = keep(_mapped(blocks.repartition(parts, conv).sortWithinPartitions(conv, "block"), "block long, audit string, cost long, illegal long", _chain))
    edits = (chain.where("block >= 0").select(conv, "block", F.posexplode(F.regexp_extract_all("audit", F.lit("(I*[DKR])"), F.lit(1))).alias("_i", "piece"))
             .select(conv, (F.col("block") * BLOCK + F.col("_i")).alias("at"), "piece"))
    lines = join_on(placed.select(conv, "at", "role", "text"), edits, [conv, "at"])
    texts = lines.select(conv, "at", "role", F.when(~F.col("piece").endswith("D"), F.col("text")).alias("text"), "piece")
    told = _mapped(texts.repartition(parts, conv).sortWithinPartitions(conv, "at"), "audit string, repaired_sha256 string", _streamed)
    count = lambda f: F.count_if(F.col("fault") == f)
    stats = placed.groupBy(conv).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), count(BLANK).alias("blank"),
                                     count(DUPLICATE).alias("duplicate"), count(CUT).alias("truncated"))
    out = rows.select(conv).distinct()
    for part in (stats, chain.where("block = -1").select(conv, "cost", "illegal"), told):
        out = join_on(out, part, [conv], "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.select(conv, *[F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in RESULT])


def repair(rows: DataFrame, conv: str = "conv_id", here: Column | None = None) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256)``, a row per conversation of ``rows (conv, turn, role, text)``.

    Rows of which ``here`` is not true are not looked at; a conversation of none but
    such has zeros, no edits and the digest of nothing.  A null role or text is one
    space, a null conversation one of its own.  Rows stand in the order of turn (null
    first), role and SHA-256 of the text; repeated rows stay, as duplicates.  Other
    columns play no part; an empty table gives an empty one."""
    prepare(rows.sparkSession)
    given = rows.select(conv, F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce(here if here is not None else F.lit(True), F.lit(False)).alias("here"))
    if conv in ("turn", "role", "text", "here"):
        raise ValueError("the conversation needs a column of its own name")
    order = ["turn", "role", "_key"]
    laid = dealt(given.withColumn("_key", F.sha2("text", 256)), [conv], order)
    # conversations of several partitions: fewer than there are partitions
    split = keep(laid.groupBy(conv).agg(F.count_distinct("_part").alias("_c")).where("_c > 1").select(conv))
    shape = split.withColumn("_split", F.lit(True))
    marked = join_on(laid, F.broadcast(shape), [conv], "left")
    whole = (marked.where("_split is null").sortWithinPartitions(conv, *[F.col(c).asc_nulls_first() for c in order])
             .select(conv, "turn", "role", "text", "here"))
    done = _mapped(whole, _LONGS, _whole)
    if split.isEmpty():
        return done
    return done.unionByName(_cut_conversations(marked.where("_split").drop("_split"), conv))


def damage(rows: DataFrame) -> DataFrame:
    """``conversations (conv_id, turn, role, text)`` with known damage by the crc32 of
    ``conv_id:turn`` (null: a space) modulo 20, and ``here``: false for dropped rows."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                      F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                      (kind != 0).alias("here"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_twice"))
    return out.select("conv_id", "turn", "role", "text", "here", F.explode("_twice")).drop("col")
