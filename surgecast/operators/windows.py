"""Blocked windows over regular series.

A window per series would put a whole series in one task. Here every series is
cut into blocks of ``block_size`` consecutive periods on the absolute period
index, and the last ``lookback`` rows of each block are copied into the next
block as a halo. The window then partitions by ``(series_cols, _blk)``, so a
long (or hot) series is spread over many tasks and each task holds at most
``block_size + lookback`` rows. Halo rows only feed lags/frames and are dropped.

Positional lags equal index lags because the inputs are gap-filled (every
period between a series' first and last period is present).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import join_on

IDX = "_idx"
BLK = "_blk"
HALO = "_halo"

DEFAULT_BLOCK = 4096


def with_blocks(df: DataFrame, lookback: int, block_size: int = DEFAULT_BLOCK, series_cols=()) -> DataFrame:
    """Add ``_blk`` and ``_halo``; rows near a block end are emitted twice."""
    if lookback > block_size:
        raise ValueError(f"lookback {lookback} exceeds block size {block_size}")
    B = F.lit(int(block_size))
    home = F.floor(F.col(IDX) / B)
    if lookback <= 0:
        blocks = F.array(home)
    else:
        tail = F.pmod(F.col(IDX), B) >= F.lit(block_size - lookback)
        blocks = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    out = (df.withColumn(BLK, F.explode(blocks))
             .withColumn(HALO, F.col(BLK) != F.floor(F.col(IDX) / B)))
    # Hash on (series, block) explicitly: a child partitioned on the series key
    # alone would also satisfy the window's clustering and keep every block of a
    # series (or, without a key, the whole table) in one task.
    return out.repartition(*series_cols, BLK)


def block_window(series_cols) -> Window:
    return Window.partitionBy(*series_cols, BLK).orderBy(IDX)


GAP = "_gap"


def gap_column(series_cols) -> Column:
    """Periods since the row before, for ``drop_halo`` to check."""
    return (F.col(IDX) - F.lag(IDX, 1).over(block_window(series_cols))).alias(GAP)


def drop_halo(df: DataFrame) -> DataFrame:
    """The rows of the blocks themselves. Lags count rows, so a missing or doubled
    period would shift them unseen: it is an error (fill gaps first)."""
    regular = F.when(F.col(GAP) != 1, F.raise_error(F.lit("a series has missing or repeated periods")).cast("boolean")).otherwise(F.lit(True))
    return df.filter(regular & ~F.col(HALO)).drop(HALO, GAP)


def ema_block_size(spans) -> int:
    """Largest block for which q^-B of the fastest-decaying span stays finite
    (q^-B <= e^600 < 1.8e308) in the in-block cumulative sum."""
    q = 1.0 - 2.0 / (min(spans) + 1.0)
    return max(8, int(600.0 / -math.log(q)))


def ema_carry_terms(span: int, block_size: int) -> int:
    """Number of previous blocks whose weight q^(k*B) is still above the
    smallest double; older blocks carry weight that rounds to exactly 0.0."""
    q = 1.0 - 2.0 / (span + 1.0)
    return max(1, math.ceil(745.0 / (block_size * -math.log(q))) + 1)


def ema_local(value: Column, span: int, series_cols, block_size: int) -> Column:
    """In-block part of the EMA numerator, sum_{k in block, k<=t} q^(t-k) x_k.

    Evaluated on the halo-blocked frame; halo rows contribute nothing.
    """
    q = 1.0 - 2.0 / (span + 1.0)
    j = (F.col(IDX) - F.col(BLK) * F.lit(block_size)).cast("double")
    w = block_window(series_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = F.when(~F.col(HALO), value.cast("double") * F.pow(F.lit(q), -j))
    return F.pow(F.lit(q), j) * F.sum(scaled).over(w)


def ema_summary(blocked: DataFrame, value, series_cols, spans, block_size: int) -> DataFrame:
    """Per (series, block): carry-in numerators C_b for every span, and the series start t0.

    T_b, the EMA numerator at the end of block b, is a plain grouped sum
    sum_k q^(end_b - k) x_k over the block's own rows (exponent < B, so it stays
    finite), read from the blocked input rather than from the window output, so
    the big window is evaluated once. The carry into block b is
    C_b = sum_k q^(B (b-1-k)) T_k over the last K earlier blocks, K chosen so that
    older weights underflow to exactly 0.0. The summary holds n_periods / B rows
    per series.
    """
    # Halo rows are skipped inside the aggregates (not filtered first), so this
    # branch reads the very same (series, block) shuffle as the window.
    own = ~F.col(HALO)
    end = (F.col(BLK) + 1) * F.lit(block_size) - 1
    tails = []
    for i, span in enumerate(spans):
        q = 1.0 - 2.0 / (span + 1.0)
        term = value.cast("double") * F.pow(F.lit(q), (end - F.col(IDX)).cast("double"))
        tails.append(F.sum(F.when(own, term)).alias(f"_T{i}"))
    summ = blocked.groupBy(*series_cols, BLK).agg(F.min(F.when(own, F.col(IDX))).alias("_first"), *tails)
    K = max(ema_carry_terms(s, block_size) for s in spans)
    w = Window.partitionBy(*series_cols).orderBy(BLK).rowsBetween(-K, -1)
    hist = F.collect_list(F.struct(F.col(BLK).alias("b"),
                                   *[F.col(f"_T{i}").alias(f"t{i}") for i in range(len(spans))])).over(w)

    def carry_fn(i: int, q: float):
        def add(acc, h):
            dist = (F.lit(block_size) * (F.col(BLK) - 1 - h["b"])).cast("double")
            return acc + h[f"t{i}"] * F.pow(F.lit(q), dist)
        return add

    carries = [F.aggregate(F.col("_hist"), F.lit(0.0), carry_fn(i, 1.0 - 2.0 / (span + 1.0))).alias(f"_C{i}")
               for i, span in enumerate(spans)]
    return (summ.select(*series_cols, BLK, hist.alias("_hist"),
                        F.min("_first").over(Window.partitionBy(*series_cols)).alias("_t0"))
                .select(*series_cols, BLK, "_t0", *carries))


def finish_ema(df: DataFrame, summary: DataFrame, series_cols, spans, local_cols, out_cols,
               block_size: int) -> DataFrame:
    """EMA_t = (L_t + q^(j+1) C_b) / ((1 - q^(t - t0 + 1)) / (1 - q))  (adjust=True)."""
    out = join_on(df, summary, [*series_cols, BLK])
    exprs = []
    for i, span in enumerate(spans):
        q = 1.0 - 2.0 / (span + 1.0)
        alpha = 1.0 - q
        j = (F.col(IDX) - F.col(BLK) * F.lit(block_size)).cast("double")
        num = F.col(local_cols[i]) + F.pow(F.lit(q), j + 1) * F.col(f"_C{i}")
        den = (F.lit(1.0) - F.pow(F.lit(q), (F.col(IDX) - F.col("_t0") + 1).cast("double"))) / F.lit(alpha)
        exprs.append((num / den).alias(out_cols[i]))
    keep = [c for c in out.columns if c not in set(local_cols) | {"_t0"} and not c.startswith("_C")]
    return out.select(*keep, *exprs)
