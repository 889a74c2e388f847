"""Writers (S5, S7, S9, S11): overwrite sinks and the keyed upsert of the forecast log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.common import join_on
from ..session import scratch_path
from .files import path_exists


def write_aggregate(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite an aggregate table; re-running the same input gives the same files."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def write_offline_features(df: DataFrame, path: str) -> None:
    """Offline feature store, partitioned by granularity and month (S7); only the
    partitions that ``df`` holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("granularity", "month").parquet(path)


def one_per_key(rows: DataFrame, key_cols, order_col: str | None = None) -> DataFrame:
    """One row per key: the latest by ``order_col``, ties (or no order) by the row's
    own values, so that the choice does not depend on the partitioning."""
    others = [c for c in rows.columns if c not in key_cols]
    if not others:
        return rows.distinct()
    rank = F.struct(*([F.col(order_col)] if order_col in others else []), F.to_json(F.struct(*others), {"ignoreNullFields": "false"}))
    best = rows.groupBy(*key_cols).agg(F.max_by(F.struct(*others), rank).alias("_r"))
    return best.select(*key_cols, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*rows.columns)


def upsert_merge(existing: DataFrame | None, rows: DataFrame, key_cols, order_col: str | None = None) -> DataFrame:
    """Rows replace existing records with the same key (null equals null); the rest
    are kept (J4, U0). Of several rows with one key in a batch one stays. With
    ``order_col`` a row replaces only what is not newer by that column."""
    rows = one_per_key(rows, key_cols, order_col)
    if existing is None:
        return rows
    if order_col is None:
        keep = join_on(existing, rows.select(*key_cols), key_cols, "left_anti")
        return keep.unionByName(rows, allowMissingColumns=True)
    both = existing.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in key_cols]
    best = both.groupBy(*key_cols).agg(F.max_by(F.struct(*others), F.struct(order_col, "_new")).alias("_r"))
    return best.select(*key_cols, *[F.col(f"_r.{c}").alias(c) for c in others if c != "_new"])


def read_table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The current table, or None when the path is missing or holds no data files."""
    from pyspark.errors import AnalysisException

    if not path_exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def upsert_log(spark: SparkSession, rows: DataFrame, path: str, key_cols=("TimePeriod",),
               ts_col: str = "TimePeriod", partition_col: str | None = "month", key_buckets: int = 64,
               order_col: str | None = None) -> None:
    """Idempotent keyed upsert into a partitioned Parquet table.

    * ``partition_col='month'`` (keys containing the period): partitions are the
      month of ``ts_col``;
    * ``partition_col=None`` (entity keys, e.g. one row per client): partitions
      are ``key_buckets`` hash buckets of the key;
    * ``order_col``: an older row never replaces a newer one.

    The batch is written once to the shared folder (it may be expensive, and it is
    read several times). Only partitions it touches are read and rewritten: their
    list, bounded by the months or buckets of the batch, prunes the scan. The
    merged content is staged, then written over exactly those partitions. The
    table is never read and overwritten by one job, and re-running a batch gives
    the same table. Staged files are removed.
    """
    if partition_col:
        part = partition_col
        rows = rows.withColumn(part, F.date_format(F.col(ts_col).cast("timestamp_ntz"), "yyyy-MM"))
    else:
        part = "key_bucket"
        rows = rows.withColumn(part, F.pmod(F.xxhash64(*key_cols), F.lit(key_buckets)).cast("int"))
    stage = scratch_path(spark, "upsert-stage")
    try:
        rows.write.parquet(f"{stage}/batch")
        batch = spark.read.schema(rows.schema).parquet(f"{stage}/batch")
        touched = [r[0] for r in batch.select(part).distinct().collect()]
        if not touched:  # e.g. an empty micro-batch: nothing to merge
            return
        existing = read_table_or_none(spark, path)
        if existing is None:
            merged, columns = upsert_merge(None, batch, [*key_cols], order_col), batch.columns
        else:
            hit = F.col(part).isin([t for t in touched if t is not None])
            if None in touched:
                hit = hit | F.col(part).isNull()
            merged, columns = upsert_merge(existing.where(hit), batch, [*key_cols], order_col), existing.columns
        merged.write.partitionBy(part).parquet(f"{stage}/merged")
        staged = spark.read.option("basePath", f"{stage}/merged").schema(merged.schema).parquet(f"{stage}/merged")
        (staged.select(*columns, *[c for c in merged.columns if c not in columns]).write.mode("overwrite")
               .option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path))
    finally:
        remove_path(spark, stage)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder on whatever file system holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_summary(df: DataFrame, path: str) -> None:
    """Append a run summary (drift report) to a Parquet table."""
    df.write.mode("append").parquet(path)


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete snapshots under ``path``, in order."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    folders = [s.getPath() for s in system.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("snapshot-")]
    whole = [f for f in folders if system.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(f.getName().rsplit("-", 1)[1]) for f in whole)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest complete snapshot of a small table, or None."""
    known = _snapshots(spark, path)
    return spark.read.parquet(f"{path}/snapshot-{known[-1]:09d}") if known else None


def write_snapshot(spark: SparkSession, df: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """Replace a small table as a whole: the new state is written beside the old one and
    counts from the moment it is complete, so a crash leaves the old state. The last
    ``keep`` snapshots stay."""
    known = _snapshots(spark, path)
    number = known[-1] + 1 if known else 0
    df.write.mode("overwrite").parquet(f"{path}/snapshot-{number:09d}")  # what a crash left half done is replaced
    for old in known[: max(0, len(known) + 1 - keep)]:
        remove_path(spark, f"{path}/snapshot-{old:09d}")
    return read_snapshot(spark, path)
