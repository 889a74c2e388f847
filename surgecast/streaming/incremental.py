"""Structured Streaming jobs.

* hourly demand with a watermark for late events, or with late events as corrections (T1);
* keyed upsert of each micro-batch into a log/online table (T2);
* per-client requests per minute above a limit (T3).

The same transformation functions run on batch DataFrames, where the watermark
is a no-op, so batch and stream results agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import RATE_LIMIT_PER_MINUTE
from ..operators.common import join_on
from ..session import scratch_path, written
from ..sources.sinks import read_table_or_none, upsert_log


def hourly_counts(events: DataFrame, ts_col: str = "ts", series_cols=(), watermark: str = "1 hour") -> DataFrame:
    """Tumbling 1-hour counts per series; events later than the watermark are dropped."""
    t = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    agg = t.groupBy(F.window(F.col(ts_col), "1 hour").alias("w"), *series_cols).agg(F.count(F.lit(1)).alias("Volume"))
    return agg.select(*series_cols, F.col("w.start").cast("timestamp").alias("TimePeriod"), "Volume")


def rate_breaches(requests: DataFrame, client_col: str = "user_id", ts_col: str = "ts",
                  limit: int = RATE_LIMIT_PER_MINUTE, watermark: str = "1 minute") -> DataFrame:
    """(client, minute, n) where a client sent more than ``limit`` requests in a minute."""
    t = requests.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    agg = t.groupBy(F.window(F.col(ts_col), "1 minute").alias("w"), F.col(client_col)).agg(F.count(F.lit(1)).alias("n"))
    return agg.filter(F.col("n") > F.lit(limit)).select(client_col, F.col("w.start").cast("timestamp").alias("minute"), "n")


def _stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """File stream over a directory; a single-file path becomes its directory
    plus a file-name filter (the file source watches directories)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    if path.endswith(".parquet"):
        directory, name = path.rsplit("/", 1)
        return r.option("pathGlobFilter", name).parquet(directory)
    return r.parquet(path)


def run_hourly_stream(spark: SparkSession, source_path: str, ts_col: str = "ts", series_cols=(),
                      out_path: str | None = None, checkpoint: str | None = None,
                      watermark: str = "1 hour", output_mode: str = "update", max_files: int | None = None) -> str:
    """Run T1 over everything available (``availableNow``). Returns out_path.

    ``update`` (default): each micro-batch emits only the windows it changed and
    upserts them on (series, hour) into the month-partitioned hourly table;
    window state older than the watermark is dropped, so state stays bounded on
    an endless stream while the table always holds every hour's latest count.
    ``complete``: the whole result is rewritten each batch (state is never
    dropped; only for short-lived streams).
    """
    schema = spark.read.parquet(source_path).schema
    out_path = out_path or scratch_path(spark, "stream-hourly-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-hourly-ckpt")
    src = _stream(spark, source_path, schema, max_files).select(ts_col, *series_cols)
    counts = hourly_counts(src, ts_col, series_cols, watermark)

    if output_mode == "update":
        def sink(batch: DataFrame, _batch_id: int) -> None:
            upsert_log(spark, batch, out_path, [*series_cols, "TimePeriod"], "TimePeriod", "month")
    elif output_mode == "complete":
        def sink(batch: DataFrame, _batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out_path)
    else:
        raise ValueError("output_mode must be 'update' or 'complete'")

    q = (counts.writeStream.outputMode(output_mode).foreachBatch(sink)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def run_counted_stream(spark: SparkSession, source_path: str, ts_col: str = "ts", series_cols=(), root: str | None = None,
                       watermark: str = "1 hour") -> tuple[str, str]:
    """Hourly counts that late events correct (T1): returns the paths of the hourly table
    ``(series..., TimePeriod, Volume)`` and of the contributions ``(series..., TimePeriod,
    n, n_late, batch, month)``, where ``n_late`` of ``n`` came behind the watermark.

    Every micro-batch writes what it adds to each hour, as its own partitions of the
    contributions, and how far its events reach. An event is late if it is older than
    the furthest event of earlier batches less ``watermark``; it is counted like others,
    in an hour that may have been reported. The hours that a batch touches are then added
    up from all contributions and upserted. Both writes replace what an interrupted run
    of the same batch left, so a batch counts once. There is no state beyond the tables,
    and what is read again is the contributions of the months that a batch touches."""
    root = root or scratch_path(spark, "counted")
    hourly, parts, marks = f"{root}/hourly", f"{root}/contributions", f"{root}/marks"
    schema = spark.read.parquet(source_path).schema
    src = _stream(spark, source_path, schema).select(F.col(ts_col).cast("timestamp").alias("_t"), *series_cols).where("_t IS NOT NULL")
    hour = F.date_trunc("hour", "_t").alias("TimePeriod")
    keys = [*series_cols, "TimePeriod"]

    def sink(batch: DataFrame, number: int) -> None:
        before = read_table_or_none(spark, marks)
        seen = None if before is None else before.where(F.col("batch") < number).agg(F.max("reach")).first()[0]
        late = F.lit(False) if seen is None else F.col("_t") < F.lit(seen) - F.expr(f"INTERVAL {watermark}")
        counts = (batch.groupBy(*series_cols, hour).agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("n_late"), F.max("_t").alias("_reach"))
                  .withColumn("batch", F.lit(number).cast("long")).withColumn("month", F.date_format("TimePeriod", "yyyy-MM")))
        counts = written(counts, "counted-batch")
        reach = counts.agg(F.max("_reach").alias("reach")).withColumn("batch", F.lit(number).cast("long")).where("reach IS NOT NULL")
        months = [r[0] for r in counts.select("month").distinct().collect()]  # as many as the batch touches
        if not months:
            return
        replace = {"partitionOverwriteMode": "dynamic"}
        counts.drop("_reach").write.mode("overwrite").options(**replace).partitionBy("month", "batch").parquet(parts)
        whole = spark.read.schema(counts.drop("_reach").schema).parquet(parts).where(F.col("month").isin(months))
        touched = join_on(whole, counts.select(*keys).distinct(), keys, "left_semi")
        upsert_log(spark, touched.groupBy(*keys).agg(F.sum("n").alias("Volume")), hourly, keys, "TimePeriod", "month")
        reach.write.mode("overwrite").options(**replace).partitionBy("batch").parquet(marks)

    q = src.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return hourly, parts


def run_upsert_stream(spark: SparkSession, source_path: str, transform, key_cols, target_path: str | None = None,
                      checkpoint: str | None = None, ts_col: str = "TimePeriod",
                      partition_col: str | None = "month", max_files: int | None = None) -> str:
    """Run T2: every micro-batch is transformed and upserted on ``key_cols`` into
    ``target_path`` (only touched partitions rewritten). A row of an earlier
    ``ts_col`` that comes late does not replace a later one."""
    schema = spark.read.parquet(source_path).schema
    target_path = target_path or scratch_path(spark, "stream-upsert-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-upsert-ckpt")

    def sink(batch: DataFrame, _batch_id: int) -> None:
        upsert_log(spark, transform(batch), target_path, key_cols, ts_col, partition_col, order_col=ts_col)

    q = (_stream(spark, source_path, schema, max_files).writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return target_path


def run_rate_breach_stream(spark: SparkSession, source_path: str, client_col: str = "user_id", ts_col: str = "ts",
                           limit: int = RATE_LIMIT_PER_MINUTE, out_path: str | None = None,
                           checkpoint: str | None = None, watermark: str = "1 minute", max_files: int | None = None) -> str:
    """Run T3 as a stream: per-client minute counts with a watermark (state behind it
    is dropped). Each micro-batch upserts the breaches it changed on (client,
    minute), so the last minutes are there too."""
    schema = spark.read.parquet(source_path).schema
    out_path = out_path or scratch_path(spark, "stream-rate-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-rate-ckpt")
    src = _stream(spark, source_path, schema, max_files).select(client_col, ts_col)
    breaches = rate_breaches(src, client_col, ts_col, limit, watermark)

    def sink(batch: DataFrame, _batch_id: int) -> None:
        upsert_log(spark, batch, out_path, [client_col, "minute"], "minute", "month")

    q = (breaches.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
