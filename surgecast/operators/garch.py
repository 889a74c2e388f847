"""GARCH(1,1) volatility of many residual series at once (M5).

The variance follows ``s[t] = omega + alpha e[t-1]^2 + beta s[t-1]``, an affine map of
the variance before, and so do its derivatives. Affine maps compose, so a series is cut
into blocks: every block is reduced to its map, the maps are chained (level by level, so
that nothing grows with a series but the number of blocks), and with its start known each
block adds up its own likelihood and gradient. A series of any length is spread over as
many tasks as it has blocks; no row holds a series.

The likelihood is maximised for all series at once: a grid over alpha + beta < 1, then
Newton steps within the bounds, one evaluation a step, which tries several step lengths
and, at each, takes the curvature from gradients nearby.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import GARCH_MIN_RESIDUALS
from ..session import ensure_checkpoint_dir, written
from .common import attach, join_on
from .ranking import ALL, ranked

BLOCK = 512  # residuals of a block, and maps chained in one row
#: Where the search starts: at the best point of every band of alphas and betas.
ALPHAS = ((0.005, 0.02), (0.05, 0.12, 0.3, 0.7))
BETAS = ((0.0, 0.2), (0.4, 0.6), (0.75, 0.85), (0.92, 0.97))
SPAN = 256  # numbers of points that a start may use
LIMIT = 0.9999  # of alpha + beta
TRACE = 1e-3  # an alpha below it is none: the variance is constant
LEAST = 1e-6  # of omega, in units of the sample variance
STEPS = 25  # at most; most series need fewer than ten
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.005)  # of a step, tried together
NEAR = 1e-5  # distance of the gradients that give the curvature
DONE = 1e-7  # a step this small ends the search: what is left is far smaller

PARAMS = ("w", "a", "b")  # omega in units of the sample variance, alpha, beta


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))


def _struct(**named: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in named.items()) + ")"


def _let(body: str, **named: str) -> str:
    """``body`` with names for values, each made once."""
    for name, value in reversed(named.items()):
        body = f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return body


# SQL text, so that one parsed expression stands for hundreds of calls. ``q`` is a point
# (w, a, b), ``st`` the state of a period: variance and derivatives, squared residual.
_ADVANCED = {"s": "q.w + q.a * st.x + q.b * st.s", "sw": "1 + q.b * st.sw", "sa": "st.x + q.b * st.sa", "sb": "st.s + q.b * st.sb"}
_NONE = dict.fromkeys(("s", "sw", "sa", "sb"), "0")
_BEGIN = _struct(**{**_NONE, "s": "1"})

#: What a block makes of a start at zero; of any start ``s`` it makes ``b**n s`` more.
_BLOCK_MAP = f"aggregate(xs, {_struct(x='before', **_NONE)}, (st, x) -> {_struct(x='x', **_ADVANCED)})"

#: The state behind a block: its map ``m.m`` applied to the state ``st`` before it.
_CHAINED = _struct(**{c: f"pow(b, m.n) * st.{c} + m.m.{c}" for c in ("s", "sw", "sa")}, sb="pow(b, m.n) * st.sb + m.n * pow(b, m.n - 1) * st.s + m.m.sb")
_WHOLE_MAP = f"aggregate(_maps, {_struct(**_NONE)}, (st, m) -> {_CHAINED})"
_STATES = f"aggregate(_maps, array(start), (done, m) -> concat(done, transform(array(element_at(done, -1)), st -> {_CHAINED})))"

SUMS = ("ll", "gw", "ga", "gb")


def _evaluated(start: str) -> str:
    """Likelihood and gradient of the residuals ``xs`` behind ``before``, from a start."""
    pulled = {f"g{c}": f"st.g{c} + 0.5 * (x / v.s - 1) / v.s * v.s{c}" for c in PARAMS}
    added = _struct(x="x", **{c: f"v.{c}" for c in _NONE}, ll="st.ll - 0.5 * (ln(v.s) + x / v.s)", **pulled)
    begin = _struct(x="before", **{c: f"{start}.{c}" for c in _NONE}, **dict.fromkeys(SUMS, "0"))
    return f"aggregate(xs, {begin}, (st, x) -> {_let(added, v=_struct(**_ADVANCED))})"


def _directed() -> str:
    """Newton's step (w, a, b) from a state ``o``: the gradient by the curvature, made
    definite by a floor of its pivots. A parameter at its bound that is pulled outwards
    stays there."""
    held = {c: f"(o.{c} <= {LEAST if c == 'w' else 0} AND o.g{c} <= 0)" for c in PARAMS}
    m = {(i, j): f"IF({held[i]} OR {held[j]}, {int(i == j)}D, -(o.h{i}{j} + o.h{j}{i}) / 2)" for n, i in enumerate(PARAMS) for j in PARAMS[n:]}
    y = {c: f"IF({held[c]}, 0D, o.g{c})" for c in PARAMS}
    floor = lambda d: f"greatest(abs({d}), 1e-6D)"
    return _let(_struct(w="y1 / d1 - l2 * x2 - l3 * x3", a="x2", b="x3"), d1=floor(m["w", "w"]), l2=f"{m['w', 'a']} / d1", l3=f"{m['w', 'b']} / d1",
                d2=floor(f"{m['a', 'a']} - l2 * l2 * d1"), l32=f"({m['a', 'b']} - l3 * l2 * d1) / d2",
                d3=floor(f"{m['b', 'b']} - l3 * l3 * d1 - l32 * l32 * d2"), y1=y["w"], y2=f"{y['a']} - l2 * y1",
                y3=f"{y['b']} - l3 * y1 - l32 * y2", x3="y3 / d3", x2="y2 / d2 - l32 * x3")


def _tried() -> str:
    """Points of a step from a state ``o``: one of every length, within the bounds."""
    at = {c: f"o.{c} + l * d.{c}" for c in PARAMS}
    one = _let(_struct(w=f"greatest({at['w']}, {LEAST}D)", a="na", b=f"least(greatest({at['b']}, 0D), {LIMIT}D - na)"),
               na=f"least(greatest({at['a']}, 0D), {LIMIT}D)")
    return _let(f"transform(array({', '.join(f'{x}D' for x in LENGTHS)}), l -> {one})", d=_directed())


def _grid() -> str:
    def band(alphas, betas) -> str:
        inside = [(a, b) for b in betas for a in alphas if a + b < 1]
        return "array(" + ", ".join(_struct(w=f"{1 - a - b!r}D", a=f"{a!r}D", b=f"{b!r}D") for a, b in inside) + ")"

    return "array(" + ", ".join(band(alphas, betas) for betas in BETAS for alphas in ALPHAS) + ")"


def _near(c: str | None) -> str:
    return _struct(**{k: f"p.{k} + {NEAR}D" if k == c else f"p.{k}" for k in PARAMS})


_CURVED = {f"h{i}{c}": f"(e{j}.g{i} - e0.g{i}) / {NEAR}D" for j, c in enumerate(PARAMS, 1) for i in PARAMS}
_FINITE = "IF(isnan(e0.ll) OR e0.ll IS NULL, -1e300D, e0.ll)"


def _met() -> str:
    """The state at a point ``p`` of a series that is one block."""
    at = {f"e{j}": _let(_let(_evaluated("z"), z=_BEGIN), q=_near(c)) for j, c in enumerate((None, *PARAMS))}
    return _let(_struct(ll=_FINITE, **{c: f"p.{c}" for c in PARAMS}, **{c: f"e0.{c}" for c in ("gw", "ga", "gb", "s", "x")}, **_CURVED), **at)


def _stepped(old: str, new: str) -> str:
    """The better of two states with ``done``: the search is over once nothing is better or moves."""
    moved = "greatest(" + ", ".join(f"abs({new}.{c} - {old}.{c})" for c in PARAMS) + ")"
    fields = lambda of, done: "named_struct(" + ", ".join(f"'{c}', {of}.{c}" for c in _FIELDS) + f", 'done', {done})"
    return f"IF(coalesce({new}.ll > {old}.ll, false), {fields(new, f'{moved} < {DONE}D')}, {fields(old, 'true')})"


_FIELDS = ("ll", *PARAMS, "gw", "ga", "gb", "s", "x", *_CURVED)
_BEST = "array_max(transform({points}, p -> {met}))"


_OPEN = "named_struct(" + ", ".join(f"'{c}', n.{c}" for c in _FIELDS) + ", 'done', false)"


#: What a state counts in the choice between starts: where shocks leave no trace it counts
#: as the constant variance that it then stands for.
_WORTH = f"IF(o.a < {TRACE}, -n_resid / 2D, o.ll)"


def _searched() -> str:
    """The whole search over a series of one block, which needs no other row."""
    begin = _let(_OPEN, n=_BEST.format(points="band", met=_met()))
    step = _let(_stepped("o", "n"), n=_BEST.format(points=_tried(), met=_met()))
    ends = f"transform({_grid()}, band -> aggregate(sequence(1, {STEPS}), {begin}, (o, i) -> IF(o.done, o, {step})))"
    return f"array_max(transform({ends}, o -> named_struct('worth', {_WORTH}, 'o', o))).o"


def _starts(maps: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """``(keys, p, block, start)`` from ``(keys, p, b, block, n, m)``: the state before every
    block. Up to ``BLOCK`` maps are chained in one row; more make maps of their own,
    whose starts come from the level above."""
    group = [*keys, "p"]
    runs = (maps.groupBy(*group, F.floor(F.col("block") / BLOCK).alias("run"))
            .agg(F.array_sort(F.collect_list(F.struct("block", "n", "m"))).alias("_maps"), F.first("b").alias("b")))
    if blocks <= BLOCK:
        runs = runs.withColumn("start", F.expr(_struct(**{**_NONE, "s": "1"})))
    else:
        size = F.expr("aggregate(_maps, CAST(0 AS DOUBLE), (n, m) -> n + m.n)")
        above = _starts(runs.select(*group, "b", F.col("run").alias("block"), size.alias("n"), F.expr(_WHOLE_MAP).alias("m")), keys, -(-blocks // BLOCK))
        runs = join_on(runs, above.withColumnRenamed("block", "run"), [*group, "run"])
    pairs = F.expr(f"explode(zip_with(_maps, slice({_STATES}, 1, size(_maps)), (m, st) -> named_struct('block', m.block, 'start', st))) AS _z")
    return runs.select(*group, pairs).select(*group, "_z.block", "_z.start")


def evaluate(series: DataFrame, points: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """Log likelihood and gradient at ``points (keys, p, q)``: ``(keys, p, q, e)`` with
    the sums, and the final variance and squared residual.

    ``series (keys, block, xs, before)`` are blocks of squared residuals in units of
    the sample variance, with the one before them."""
    at = join_on(series, points, keys)
    maps = at.select(*keys, "p", F.expr("q.b AS b"), "block", F.expr("CAST(size(xs) AS DOUBLE) AS n"), F.expr(f"{_BLOCK_MAP} AS m"))
    begun = join_on(at, _starts(maps, keys, blocks), [*keys, "p", "block"])
    done = begun.select(*keys, "p", "q", "block", F.expr(f"{_evaluated('start')} AS _e"))
    last = [F.expr(f"max_by(_e.{c}, block) AS {c}") for c in ("s", "x")]
    summed = done.groupBy(*keys, "p", "q").agg(*[F.expr(f"sum(_e.{c}) AS {c}") for c in SUMS], *last)
    return summed.select(*keys, "p", "q", F.struct(*SUMS, "s", "x").alias("e"))


def _nearby(at: DataFrame, keys: list[str], blocks: int, series: DataFrame) -> DataFrame:
    """The best of the points ``at (keys, g, ps)`` of every series and start, as a state ``n``."""
    each = at.select(*keys, "g", F.expr("posexplode(ps) AS (k, p)"))
    four = "array(" + ", ".join(_near(c) for c in (None, *PARAMS)) + ")"
    points = (each.select(*keys, "g", "k", F.expr(f"posexplode(transform(array(p), p -> {four})[0]) AS (j, q)"))
              .select(*keys, F.expr(f"g * {SPAN} + k * 4 + j AS p"), "q"))
    values = evaluate(series, points, keys, blocks)
    own = [F.expr(f"max(IF(p % 4 = {j}, e, NULL)) AS e{j}") for j in range(4)]
    rows = values.groupBy(*keys, F.expr("floor(p / 4) AS k")).agg(*own, F.expr("max(IF(p % 4 = 0, q, NULL)) AS p"))
    state = _struct(ll=_FINITE, **{c: f"p.{c}" for c in PARAMS}, **{c: f"e0.{c}" for c in ("gw", "ga", "gb", "s", "x")}, **_CURVED)
    return rows.select(*keys, F.expr(f"CAST(floor(k * 4 / {SPAN}) AS INT) AS g"), F.expr(f"{state} AS n")).groupBy(*keys, "g").agg(F.max("n").alias("n"))


def _chained_search(series: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """The search over series of several blocks, all at once: a round of jobs a step."""
    each = [*keys, "g"]
    begin = series.select(*keys).distinct().select("*", F.expr(f"posexplode({_grid()}) AS (g, ps)"))
    state = written(_nearby(begin, keys, blocks, series).select(*each, F.expr(f"{_OPEN} AS o")), "garch")
    for _ in range(STEPS):
        nxt = _nearby(state.where("NOT o.done").select(*each, F.expr(f"{_tried()} AS ps")), keys, blocks, series)
        step = f"IF(o.done, o, {_stepped('o', 'n')})"
        state = written(join_on(state, nxt, each, "left").select(*each, F.expr(f"{step} AS o")), "garch")
        if state.where("NOT o.done").isEmpty():
            break
    sizes = series.select(*keys, "n_resid").distinct()
    return join_on(state, sizes, keys).groupBy(*keys).agg(F.expr(f"max_by(o, struct({_WORTH} AS worth, o)) AS o"))


def fitted(series: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """``(keys, o)``: the state of the greatest likelihood found. A series of one block is
    searched where it stands; longer ones together, block by block."""
    short = series.where("n_resid <= " + str(BLOCK)).select(*keys, F.expr(f"{_searched()} AS o"))
    if longest <= BLOCK:
        return short
    return short.unionByName(_chained_search(series.where("n_resid > " + str(BLOCK)), keys, -(-longest // BLOCK)))


def garch_sigma(resid: DataFrame, series_cols=(), resid_col: str = "resid", order_col: str = "TimePeriod",
                fallback: DataFrame | None = None, fallback_col: str = "resid_sigma",
                min_resid: int = GARCH_MIN_RESIDUALS) -> DataFrame:
    """One-step GARCH(1,1) volatility of each series' residuals, in ``order_col`` order.

    De-meaned residuals, Gaussian likelihood, started at the sample variance. Where the
    best alpha is under ``TRACE``, the variance is taken as constant. Series
    with fewer than ``min_resid``, non-finite or all-equal residuals get the fallback
    sigma."""
    ensure_checkpoint_dir(resid.sparkSession)
    # keys get names of their own, which no parameter has
    keys = [f"_key{i}" for i in range(len(series_cols))] or [ALL]
    own = [F.col(c).alias(k) for c, k in zip(series_cols, keys)] or [F.lit(0).alias(ALL)]
    rows = resid.select(*own, F.col(order_col).alias("_t"), F.col(resid_col).cast("double").alias("_r"))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_resid"), F.count_if(~F.coalesce(_finite(F.col("_r")), F.lit(False))).alias("_bad"),
                                    F.avg("_r").alias("_mu"), F.var_pop("_r").alias("_v0"))
    stats = stats.checkpoint()
    good = stats.where((F.col("n_resid") >= min_resid) & (F.col("_bad") == 0) & (F.col("_v0") > 0))
    longest = good.agg(F.max("n_resid")).first()[0]
    out = stats.select(*keys, "n_resid")
    shape = "alpha double, beta double, omega double, loglik double, _gs double"
    if longest is None:
        for f in shape.split(", "):
            out = out.withColumn(f.split()[0], F.lit(None).cast("double"))
    else:
        placed = ranked(join_on(rows, good.select(*keys, "n_resid", "_mu", "_v0"), keys), keys, ["_t", "_r"])
        x = F.pow(F.col("_r") - F.col("_mu"), 2) / F.col("_v0")
        cut = (placed.select(*keys, "n_resid", F.floor(F.col("at") / BLOCK).alias("block"), "at", x.alias("x")).groupBy(*keys, "n_resid", "block")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("xs")))
        if longest > BLOCK:  # a block meets the last residual of the one before
            cut = written(cut, "garch-blocks")
            ends = cut.select(*keys, (F.col("block") + 1).alias("block"), F.element_at("xs", -1).alias("before"))
            series = written(join_on(cut, ends, [*keys, "block"], "left").withColumn("before", F.coalesce("before", F.lit(1.0))), "garch-series")
        else:
            series = cut.withColumn("before", F.lit(1.0))
        best = join_on(fitted(series, keys, longest), good.select(*keys, "n_resid", "_v0"), keys).checkpoint()
        v0, flat = F.col("_v0"), F.col("o.a") < TRACE
        ahead = F.expr("o.w + o.a * o.x + o.b * o.s")
        shift = 0.5 * F.col("n_resid") * F.log(v0)  # of the likelihood, by the unit
        found = best.select(*keys, F.when(flat, 0.0).otherwise(F.col("o.a")).alias("alpha"), F.when(flat, 0.0).otherwise(F.col("o.b")).alias("beta"),
                            (v0 * F.when(flat, 1.0).otherwise(F.col("o.w"))).alias("omega"),
                            (F.when(flat, -0.5 * F.col("n_resid")).otherwise(F.col("o.ll")) - shift).alias("loglik"),
                            F.sqrt(v0 * F.when(flat, 1.0).otherwise(ahead)).alias("_gs"))
        out = join_on(out, found, keys, "left")
    out = out.select(*[F.col(k).alias(c) for c, k in zip(series_cols, keys)], *[c for c in out.columns if c not in keys])
    if fallback is not None:
        out = attach(out, fallback.select(*series_cols, F.col(fallback_col).alias("_fb")), series_cols, how="left")
    else:
        out = out.withColumn("_fb", F.lit(None).cast("double"))
    fits = F.col("_gs").isNotNull() & _finite(F.col("_gs")) & (F.col("_gs") > 0)
    return out.select(*series_cols, "n_resid", "alpha", "beta", "omega", "loglik", F.when(fits, F.col("_gs")).otherwise(F.col("_fb")).alias("garch_sigma"),
                      F.when(fits, F.lit("garch")).otherwise(F.lit("fallback")).alias("sigma_source"))
