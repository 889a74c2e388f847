"""Leaf-wise gradient boosting over histograms, and trees as a table (M1-M3, M8, M9).

A tree grows best-first: of all open leaves the one whose best split gains most is split
next, until it has ``leaves`` leaves.  Splits are searched in histograms (rows and
residual sums per bin of every input); a split measures its smaller child and gets the
other by subtraction.

Residuals, targets and leaf values are whole multiples of one unit, small enough to keep
the targets' precision and large enough that every sum of them is an exact double.  So
histograms merge to the same bits in any order, and the trees do not depend on how the
rows are dealt, on retries, or on the engine that adds them up.

Rows are held as blocks (a binary of bins and one of residuals per block), dealt to as
many partitions as ``ROWS_PER_TASK`` asks.  A *round* measures all leaves that may be
split next in one Spark aggregation; the driver holds histograms (leaves x inputs x
bins) and trees, never rows.  A table that needs one partition has nothing to merge, and
its rounds run one after another within that task, by the same code.

A fitted model is a table ``(tree, node, input, threshold, low, high, value, rows,
gain)``: rows with ``input <= threshold`` go to ``low``; a leaf has no input.  ``walk``
predicts by one join a level with that table.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import ensure_checkpoint_dir

BINS = 255  # of an input, at most
ROWS_PER_TASK = 2_000_000  # of a training partition
BLOCK_ROWS = 1 << 18
REFRESH = 10  # trees between two writings of the residuals, where there are several partitions
BITS = 52  # of the sums of residuals
WIDE = 1 << 20  # more than a tree has nodes

NODES = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()), T.StructField("input", T.IntegerType()),
                      T.StructField("threshold", T.DoubleType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()),
                      T.StructField("value", T.DoubleType()), T.StructField("rows", T.LongType()), T.StructField("gain", T.DoubleType())])


@dataclass
class Tree:
    """Nodes by number; ``input`` -1 is a leaf.  ``value`` counts units."""

    input: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    low: list[int] = field(default_factory=lambda: [-1])
    high: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, at: "Split") -> tuple[int, int]:
        low = len(self.input)
        self.input[node], self.bin[node], self.gain[node] = at.input, at.bin, at.gain
        self.low[node], self.high[node] = low, low + 1
        for name, empty in (("input", -1), ("bin", -1), ("low", -1), ("high", -1), ("value", 0.0), ("rows", 0), ("gain", 0.0)):
            getattr(self, name).extend([empty, empty])
        return low, low + 1

    def places(self, bins: np.ndarray) -> dict[int, np.ndarray]:
        """Row numbers of every node."""
        at = {0: np.arange(len(bins))}
        for node in range(len(self.input)):
            if self.input[node] >= 0:
                rows = at[node]
                left = bins[rows, self.input[node]] <= self.bin[node]
                at[self.low[node]], at[self.high[node]] = rows[left], rows[~left]
        return at

    def apply(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for node, rows in self.places(bins).items():
            if self.input[node] < 0:
                out[rows] = self.value[node]
        return out


@dataclass
class Split:
    gain: float
    input: int
    bin: int


@dataclass(frozen=True)
class Settings:
    trees: int
    leaves: int
    min_rows: int
    step: float


Histogram = np.ndarray  # (2, inputs, BINS): rows, residual sums


def histogram(bins: np.ndarray, residual: np.ndarray, rows: np.ndarray) -> Histogram:
    inputs = bins.shape[1]
    at = (bins[rows].astype(np.int64) + np.arange(inputs) * BINS).ravel()
    n = np.bincount(at, minlength=inputs * BINS).astype(float)
    g = np.bincount(at, weights=np.repeat(residual[rows], inputs), minlength=inputs * BINS)
    return np.stack([n, g]).reshape(2, inputs, BINS)


def best_split(h: Histogram, min_rows: int) -> Split | None:
    """The split of most gain (of equal ones the first input, then the lowest bin), if
    both sides hold ``min_rows`` rows and something is gained."""
    n, g = np.cumsum(h[0], axis=1), np.cumsum(h[1], axis=1)
    rows, total = n[0, -1], g[0, -1]
    low, high = n[:, :-1], rows - n[:, :-1]
    fits = (low >= min_rows) & (high >= min_rows)
    if not fits.any():
        return None
    left, right = g[:, :-1], total - g[:, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left * left / low + right * right / high - total * total / rows
    gain = np.where(fits, gain, -np.inf)
    at = int(np.argmax(gain))
    i, b = divmod(at, gain.shape[1])
    return Split(float(gain[i, b]), i, b) if gain[i, b] > 0 else None


Measure = Callable[[Tree, list[int]], dict[int, Histogram]]


def grow(measure: Measure, leaves: int, min_rows: int, step: float) -> Tree:
    """One tree, best-first.  ``measure`` gives histograms of nodes of a tree; a round
    asks for the smaller child of every leaf that may still be split."""
    tree, hist = Tree(), measure(Tree(), [0])
    found: dict[int, Split] = {}
    queue: list[tuple[float, int]] = []
    shape = Tree()  # the tree with children of leaves that may be split looked at ahead
    final: dict[int, int] = {0: 0}  # node of the shape: node of the tree

    def offer(node: int) -> None:
        split = best_split(hist[node], min_rows)
        if split is not None:
            found[node] = split
            heapq.heappush(queue, (-split.gain, final[node], node))

    offer(0)
    open_leaves = 1
    while queue and open_leaves < leaves:
        if shape.low[queue[0][2]] < 0:
            # no more than the leaves still allowed can be split, so look at no others
            ahead = [node for _, _, node in heapq.nsmallest(leaves - open_leaves, queue) if shape.low[node] < 0]
            pairs, small = [], []
            for node in ahead:
                pair = shape.split(node, found[node])
                h, s = hist[node], found[node]
                few = h[0, s.input, : s.bin + 1].sum() * 2 <= h[0, s.input].sum()
                pairs.append((node, *(pair if few else pair[::-1])))
                small.append(pairs[-1][1])
            if open_leaves + 1 < leaves:
                hist.update(measure(shape, small))
                for node, a, b in pairs:
                    hist[b] = hist[node] - hist[a]
            else:  # the last split: its children are leaves, their sums are known
                for node, a, b in pairs:
                    s, h = found[node], hist[node]
                    part = np.zeros_like(h)
                    part[:, s.input, : s.bin + 1] = h[:, s.input, : s.bin + 1]
                    rest = np.zeros_like(h)
                    rest[:, s.input, s.bin + 1 :] = h[:, s.input, s.bin + 1 :]
                    low = shape.low[node]
                    hist[low], hist[low + 1] = part[:, s.input : s.input + 1], rest[:, s.input : s.input + 1]
        _, own, node = heapq.heappop(queue)
        pair = tree.split(own, found[node])
        for child, name in zip((shape.low[node], shape.high[node]), pair):
            final[child] = name
            if open_leaves + 1 < leaves:
                offer(child)
        open_leaves += 1
        hist.pop(node)
    for node, name in final.items():
        if node in hist:
            n, g = hist[node][0, 0].sum(), hist[node][1, 0].sum()
            tree.rows[name] = int(n)
            # leaf values are whole units
            tree.value[name] = float(np.floor(step * g / n + 0.5)) if n else 0.0
    for name in reversed(range(len(tree.input))):
        if tree.input[name] >= 0:
            tree.rows[name] = tree.rows[tree.low[name]] + tree.rows[tree.high[name]]
    return tree


def boost(bins: np.ndarray, residual: np.ndarray, settings: Settings) -> list[Tree]:
    """All trees over rows that stand in one place; ``residual`` is used up."""
    out = []
    for _ in range(settings.trees):
        at: dict[int, np.ndarray] = {0: np.arange(len(bins))}

        def measure(shape: Tree, nodes: list[int]) -> dict[int, Histogram]:
            for node in range(len(shape.input)):
                if shape.input[node] >= 0 and shape.low[node] not in at:
                    rows = at[node]
                    left = bins[rows, shape.input[node]] <= shape.bin[node]
                    at[shape.low[node]], at[shape.high[node]] = rows[left], rows[~left]
            return {n: histogram(bins, residual, at[n]) for n in nodes}

        tree = grow(measure, settings.leaves, settings.min_rows, settings.step)
        residual -= tree.apply(bins)
        out.append(tree)
    return out


# ------------------------------------------------------------- rows as blocks

_BLOCKS = "bins binary, residual binary"


def bin_bounds(frame: DataFrame, inputs: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of the bins of each input but the last: values of its own at even
    ranks, each once."""
    shares = [i / bins for i in range(1, bins)]
    row = frame.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 100_000).alias(c) for c in inputs],
                    *[F.max(F.col(c).cast("double")).alias(f"{c}__top") for c in inputs]).first()
    return [np.array(sorted({v for v in row[c] or [] if v < row[f"{c}__top"]})) for c in inputs]


def _binned(values: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, v, side="left") for v, b in zip(values, bounds)], axis=1).astype(np.uint8)


def blocks(frame: DataFrame, inputs: list[str], target: str, bounds: list[np.ndarray], base: float, unit: float) -> DataFrame:
    """The rows as blocks: bins, and residuals of ``base`` in units."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def full():
            bins, y = (np.concatenate(x) for x in zip(*held))
            return pa.record_batch({"bins": pa.array([bins.tobytes()], pa.binary()), "residual": pa.array([y.tobytes()], pa.binary())})

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append((_binned(cols[:-1], bounds), np.floor(cols[-1] / unit + 0.5) - base))
            size += len(cols[-1])
            if size >= BLOCK_ROWS:
                yield full()
                held, size = [], 0
        if size:
            yield full()

    return frame.select(*[F.col(c).cast("double") for c in inputs], F.col(target).cast("double").alias("_target")).mapInArrow(run, _BLOCKS)


def _read(batch: pa.RecordBatch, inputs: int):
    for b, r in zip(batch.column(0), batch.column(1)):
        yield np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, inputs), np.frombuffer(r.as_buffer(), np.float64).copy()


def _as_rows(trees: list[Tree], first: int = 0) -> list[tuple]:
    return [(first + t, n, *(getattr(x, name)[n] for name in ("input", "bin", "low", "high", "value", "rows", "gain")))
            for t, x in enumerate(trees) for n in range(len(x.input))]


def _from_rows(rows) -> list[Tree]:
    out: list[Tree] = []
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        if r[0] == len(out):
            out.append(Tree([], [], [], [], [], [], []))
        for name, v in zip(("input", "bin", "low", "high", "value", "rows", "gain"), r[2:]):
            getattr(out[-1], name).append(v)
    return out


def _fit_here(table: DataFrame, inputs: int, settings: Settings) -> list[Tree]:
    """All trees within the one task that holds all rows."""

    def run(batches):
        parts = [x for batch in batches for x in _read(batch, inputs)]
        if not parts:
            return
        trees = boost(np.concatenate([b for b, _ in parts]), np.concatenate([r for _, r in parts]), settings)
        cols = list(zip(*_as_rows(trees)))
        kinds = [pa.int32()] * 6 + [pa.float64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["tree", "node", "input", "bin", "low", "high", "value", "rows", "gain"])

    made = table.coalesce(1).mapInArrow(run, "tree int, node int, input int, bin int, low int, high int, value double, rows long, gain double")
    return _from_rows(made.collect())  # trees x (2 leaves - 1) nodes


def _fit_apart(table: DataFrame, inputs: int, settings: Settings) -> list[Tree]:
    """All trees by rounds of one aggregation each; residuals are written anew every
    ``REFRESH`` trees and follow from the trees in between."""
    done: list[Tree] = []
    written = table.checkpoint()
    since = 0
    for t in range(settings.trees):
        late = done[since:]

        def measure(shape: Tree, nodes: list[int], late=late, written=written) -> dict[int, Histogram]:
            def run(batches):
                total: dict[int, Histogram] = {}
                for batch in batches:
                    for bins, residual in _read(batch, inputs):
                        for tree in late:
                            residual -= tree.apply(bins)
                        at = shape.places(bins)
                        for n in nodes:
                            h = histogram(bins, residual, at[n])
                            total[n] = total[n] + h if n in total else h
                for n, h in total.items():
                    flat = np.flatnonzero(h[0])
                    yield pa.record_batch({"node": pa.array(np.full(len(flat), n), pa.int32()), "at": pa.array(flat, pa.int32()),
                                           "n": pa.array(h[0].ravel()[flat]), "g": pa.array(h[1].ravel()[flat])})

            parts = written.mapInArrow(run, "node int, at int, n double, g double").groupBy("node", "at").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
            out = {n: np.zeros((2, inputs * BINS)) for n in nodes}
            for r in parts.collect():  # nodes x inputs x bins at most
                out[r["node"]][:, r["at"]] = r["n"], r["g"]
            return {n: h.reshape(2, inputs, BINS) for n, h in out.items()}

        done.append(grow(measure, settings.leaves, settings.min_rows, settings.step))
        if len(done) - since == REFRESH and t + 1 < settings.trees:
            def refreshed(batches, late=done[since:]):
                for batch in batches:
                    left = []
                    for bins, residual in _read(batch, inputs):
                        for tree in late:
                            residual -= tree.apply(bins)
                        left.append(residual.tobytes())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary())], ["bins", "residual"])

            written, since = written.mapInArrow(refreshed, _BLOCKS).checkpoint(), len(done)
    return done


# -------------------------------------------------------------------- the model

@dataclass
class Boosted:
    """Trees as a table: ``value`` of a leaf in the target's own unit, ``base`` the mean."""

    nodes: DataFrame
    inputs: list[str]
    base: float

    def predict(self, frame: DataFrame, name: str = "prediction") -> DataFrame:
        return walk(frame, self.nodes, self.inputs, self.base, name)

    def save(self, path: str) -> None:
        self.nodes.withColumn("base", F.lit(self.base)).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, inputs: list[str]) -> "Boosted":
        table = spark.read.parquet(path)
        first = table.select("base").first()
        return cls(table.drop("base"), list(inputs), first[0] if first else 0.0)


def fit(frame: DataFrame, inputs: list[str], target: str = "y", trees: int = 300, leaves: int = 31, min_rows: int = 15, step: float = 0.05,
        rows_per_task: int | None = None) -> Boosted:
    """Fit squared-error trees on ``frame``, whose inputs and target are finite numbers.

    The table is read a few times (ranges, bins, blocks); boosting passes over the
    blocks, which a lost executor's successor reads from the checkpoint folder.  No
    rows give a model of no trees that predicts 0."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    settings = Settings(trees, leaves, min_rows, step)
    rows_per_task = rows_per_task or ROWS_PER_TASK
    y = F.col(target).cast("double")
    held = frame.persist(StorageLevel.DISK_ONLY)  # only a lost block is made anew
    try:
        n, low, high = held.agg(F.count(F.lit(1)), F.min(y), F.max(y)).first()
        if not n:
            return Boosted(spark.createDataFrame([], NODES), list(inputs), 0.0)
        # residuals stay within twice the range of the targets, so no sum of n of them reaches 2 ** BITS units
        reach = max(abs(low), abs(high), high - low, 1e-9) * 2 * n
        unit = 2.0 ** -(BITS - int(np.ceil(np.log2(reach))) - 1)
        total = held.agg(F.sum(F.floor(y / unit + 0.5).cast("double"))).first()[0]
        base = float(np.floor(total / n + 0.5))
        bounds = bin_bounds(held, inputs)
        parts = -(-n // rows_per_task)
        table = blocks(held.coalesce(1) if parts == 1 else held.repartition(parts), inputs, target, bounds, base, unit)
        grown = (_fit_here if parts == 1 else _fit_apart)(table, len(inputs), settings)
    finally:
        held.unpersist()
    rows = []
    for tree, node, i, b, lo, hi, value, count, gain in _as_rows(grown):
        leaf = i < 0
        rows.append((tree, node, None if leaf else i, None if leaf else float(bounds[i][b]), None if leaf else lo, None if leaf else hi,
                     value * unit if leaf else None, count, None if leaf else gain * unit * unit))
    return Boosted(spark.createDataFrame(rows, NODES), list(inputs), base * unit)


def depth(nodes: DataFrame) -> int:
    """Steps from a root to the deepest leaf (as many rows as the table are read)."""
    steps: dict[tuple[int, int], int] = {}
    for tree, node, low, high in sorted(nodes.where("input is not null").select("tree", "node", "low", "high").collect()):
        here = steps.get((tree, node), 0)  # a child's number is above its parent's
        steps[tree, low] = steps[tree, high] = here + 1
    return max(steps.values(), default=0)


def walk(frame: DataFrame, nodes: DataFrame, inputs: list[str], base: float, name: str = "prediction") -> DataFrame:
    """``frame`` with the trees' prediction, by one join a level.

    Every row meets every tree (as many as the model has); a level is a map-side join
    with the table of nodes, which is bounded by trees x leaves.  Leaf values are whole
    units, so their sum is exact and the same in any order."""
    ensure_checkpoint_dir(frame.sparkSession)
    levels = depth(nodes)
    trees = nodes.agg(F.max("tree")).first()[0]
    if trees is None:
        return frame.withColumn(name, F.lit(base))
    # ids are written with the rows, so that both sides of the last join hold the same
    x = frame.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    key = lambda tree, node: F.col(tree).cast("long") * WIDE + F.col(node)
    inner = F.broadcast(nodes.select(key("tree", "node").alias("_key"), "input", "threshold", "low", "high", "value"))
    here = x.select("_id", F.array(*[F.col(c).cast("double") for c in inputs]).alias("_x"),
                    F.explode(F.sequence(F.lit(0), F.lit(int(trees)))).alias("_tree"), F.lit(0).alias("_node"), F.lit(None).cast("double").alias("_value"))
    for _ in range(levels + 1):
        met = here.withColumn("_at", key("_tree", "_node")).join(inner, F.col("_at") == F.col("_key"), "left")
        to = F.when(F.element_at("_x", F.col("input") + 1) <= F.col("threshold"), F.col("low")).otherwise(F.col("high"))
        here = met.select("_id", "_x", "_tree", F.when(F.col("input").isNotNull(), to).alias("_node"), F.coalesce("_value", "value").alias("_value"))
    summed = here.groupBy("_id").agg(F.sum("_value").alias("_sum"))
    return x.join(summed, "_id").select(*frame.columns, (F.col("_sum") + F.lit(base)).alias(name))
