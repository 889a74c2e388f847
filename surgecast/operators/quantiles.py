"""Exact order statistics of groups of any size.

A group is never gathered. Its rank is sought by ranges: bounds from a mergeable sketch
cut the values that still come into question, one count per range tells which range
holds the rank, and only that range is cut again. A value that is itself a bound is a
range of its own, so values that many rows share end the search at once; any other
range holds about a hundredth of the rows before. What is left in the end, ``SMALL``
rows at most, is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written
from .common import join_on

CUTS = 255  # bounds of a round
SMALL = 100_000  # rows that are sorted in one place
ACCURACY = 5_000  # of the sketch that gives the bounds: it moves work, not results


def _ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bounds`` of values still in question."""
    shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", shares, ACCURACY))).alias("_bounds"))


def order_statistics(values: DataFrame, ranks: DataFrame, group_cols) -> DataFrame:
    """``(group..., k, value)``: the value of rank ``k`` (from 0, NaN last) of every row of
    ``ranks (group..., k, m)``, ``m`` being the group's rows in ``values (group..., _v)``."""
    keys = [*group_cols, "k"]
    none = F.lit(None).cast("double")
    open_ = written(ranks.select(*keys, "m", F.lit(0).cast("long").alias("below"), none.alias("low"), none.alias("high"), none.alias("value")), "ranks")
    while (open_.where("value IS NULL").agg(F.max("m")).first()[0] or 0) > SMALL:
        left = open_.where(f"value IS NULL AND m > {SMALL}")
        rows = _in_question(values, left, group_cols).select(*keys, "_v")
        bounds = written(_ranges(rows, keys), "ranges")
        # an even number is what lies between two bounds, an odd one a bound itself
        below = F.size(F.filter("_bounds", lambda b: b < F.col("_v")))
        number = below * 2 + F.array_contains("_bounds", F.col("_v")).cast("int")
        counts = join_on(rows, bounds, keys).groupBy(*keys, number.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_at"))  # at most 2 x CUTS + 1 rows a rank
        counts = join_on(counts.withColumn("_upto", upto), left.drop("m"), keys)
        hit = counts.where((F.col("_upto") > F.col("k") - F.col("below")) & (F.col("_upto") - F.col("_n") <= F.col("k") - F.col("below")))
        i = F.floor(F.col("_at") / 2).cast("int")
        bound = lambda n: F.get("_bounds", n)
        hit = join_on(hit, bounds, keys)
        found = hit.select(*keys, F.col("_n").alias("m"), (F.col("below") + F.col("_upto") - F.col("_n")).alias("below"),
                           F.when((F.col("_at") % 2 == 0) & (i > 0), bound(i - 1)).otherwise(F.col("low")).alias("low"),
                           F.coalesce(F.when(F.col("_at") % 2 == 0, bound(i)), "high").alias("high"),
                           F.when(F.col("_at") % 2 == 1, bound(i)).alias("value"))
        open_ = written(open_.where(f"value IS NOT NULL OR m <= {SMALL}").unionByName(found), "ranks")
    rest = open_.where("value IS NULL")
    held = _in_question(values, rest, group_cols).groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_vs"), F.first("below").alias("below"))
    last = held.select(*keys, F.get("_vs", (F.col("k") - F.col("below")).cast("int")).alias("value"))
    return open_.where("value IS NOT NULL").select(*keys, "value").unionByName(last)


def _in_question(values: DataFrame, ranks: DataFrame, group_cols) -> DataFrame:
    """Values that may still be the one of a rank."""
    both = join_on(values, ranks, list(group_cols))
    v = F.col("_v")
    return both.where((F.col("low").isNull() | (v > F.col("low"))) & (F.col("high").isNull() | (v < F.col("high"))))


def exact_quantile(df: DataFrame, value_col: str, q: float, group_cols=()) -> DataFrame:
    """``(group..., n, value)``: the ``q`` quantile by linear interpolation between the two
    nearest values, and how many values there are; groups without any have a null."""
    # groups get names of their own, which nothing else here has
    keys = [f"_g{i}" for i in range(max(1, len(group_cols)))]
    own = [F.col(c).alias(k) for c, k in zip(group_cols, keys)] or [F.lit(0).alias(keys[0])]
    values = df.select(*own, F.col(value_col).cast("double").alias("_v"))
    sizes = values.groupBy(*(keys if group_cols else [])).agg(F.count("_v").alias("n"))
    if not group_cols:  # one row, also of an empty table
        sizes = sizes.withColumn(keys[0], F.lit(0))
    sizes = written(sizes.select(*keys, "n", (F.lit(float(q)) * (F.col("n") - 1)).alias("_p")), "quantile-sizes")
    ends = F.explode(F.array_distinct(F.array(F.floor("_p"), F.ceil("_p")))).alias("k")
    ranks = sizes.where("n > 0").select(*keys, ends, F.col("n").alias("m"))
    both = join_on(sizes, order_statistics(values.where("_v IS NOT NULL"), ranks, keys), keys, "left")
    pair = both.groupBy(*keys, "n", "_p").agg(F.min_by("value", "k").alias("_low"), F.max_by("value", "k").alias("_high"))
    share = F.col("_p") - F.floor("_p")
    value = F.when(share == 0, F.col("_low")).otherwise((1 - share) * F.col("_low") + share * F.col("_high"))
    return pair.select(*[F.col(k).alias(c) for c, k in zip(group_cols, keys)], "n", value.alias("value"))
