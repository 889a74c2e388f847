"""Places of rows within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir
from .common import join_on

ALL = "_all"  # the group of a table that has no group columns


def dealt(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows``, written, dealt by ranges of (group, order), nulls first, with the
    partition ``_part``. A large group stands in several partitions, in order; ``_tie``
    splits rows that are alike in all of ``order``."""
    ensure_checkpoint_dir(rows.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    return (rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("_tie"))
                .withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows of ``dealt`` with ``at`` (gapless from 0 within the group) and ``n`` (the
    group's rows). Only counts of (partition, group) are added up."""
    if not group:
        return numbered(rows.withColumn(ALL, F.lit(0)), [ALL], order).drop(ALL)
    counts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
                           F.sum("_c").over(Window.partitionBy(*group)).alias("n"))
    here = Window.partitionBy(*group, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order], "_tie")
    out = join_on(rows.withColumn("_row", F.row_number().over(here)), counts, [*group, "_part"])
    names = [c for c in rows.columns if c not in ("_tie", "_part")]
    return out.select(*names, (F.col("_before") + F.col("_row") - 1).alias("at"), "n")


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``at`` and ``n``; rows alike in all of ``order`` are interchangeable."""
    return numbered(dealt(rows, group, order), group, order)
