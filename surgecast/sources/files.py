"""Scans (S1-S4, S6, S8, S10)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampType

AGGREGATE_SCHEMA = StructType([StructField("TimePeriod", TimestampType(), False),
                               StructField("Volume", LongType(), False)])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


def scan_raw(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str | None = None) -> DataFrame:
    """Raw event file by extension: Parquet, else CSV with header (S2). Raises
    FileNotFoundError when nothing is there; no silent source fallback (S3)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Raw data not found at '{path}'")
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", "true").csv(path)
    return reader.format(fmt).load(path)


def jdbc_reader(spark: SparkSession, url: str, table: str, column: str, lower, upper, num_partitions: int,
                properties: dict | None = None):
    """Partitioned warehouse read of the event-time column (S1): Spark issues
    ``num_partitions`` range queries on ``column``; later filters push down."""
    r = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
         .option("partitionColumn", column).option("lowerBound", str(lower))
         .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r


def month_bounds(first: str, last: str):
    """[first-01, month after last) as timestamp strings."""
    y0, m0 = map(int, first.split("-"))
    y1, m1 = map(int, last.split("-"))
    m1 += 1
    if m1 == 13:
        y1, m1 = y1 + 1, 1
    return f"{y0:04d}-{m0:02d}-01 00:00:00", f"{y1:04d}-{m1:02d}-01 00:00:00"


def months_of_file(path: str) -> tuple[str, str] | None:
    """The month, or first and last month, that a file name carries (``trips_2024-01``,
    ``trips_2024-01_2024-03``); None without one."""
    found = re.findall(r"(?<!\d)(\d{4}-(?:0[1-9]|1[0-2]))(?!\d)", path.rstrip("/").rsplit("/", 1)[-1])
    return (found[0], found[-1]) if found else None


def monthly_union(spark: SparkSession, sources) -> DataFrame:
    """Union of one time column from several files, each kept inside its own months
    (S4, F5, U0). ``sources``: (path, ts_col) or (path, ts_col, first, last month).
    Without months those in the file's name hold; a file with neither is an error.
    None as the last month leaves the end open. Each bound is a half-open range on
    the scanned column and pushes down."""
    out = None
    for path, ts_col, *months in sources:
        months = months or months_of_file(path)
        if not months:
            raise ValueError(f"no month in the name of {path}")
        lo, hi = month_bounds(months[0], months[1] or months[0])
        df = spark.read.parquet(path).select(F.col(ts_col).alias("TimePeriod"))
        t = df.schema["TimePeriod"].dataType.simpleString()
        df = df.filter(F.col("TimePeriod") >= F.lit(lo).cast(t))
        if months[1]:
            df = df.filter(F.col("TimePeriod") < F.lit(hi).cast(t))
        out = df if out is None else out.unionByName(df)
    return out


def read_source(spark: SparkSession, source: dict) -> DataFrame:
    """Raw events from the source that is asked for (S1-S3); never another one.

    ``{"kind": "files", "path": ..., "format": optional}`` or ``{"kind": "jdbc",
    "url", "table", "column", "lower", "upper", "partitions", "properties"}``.
    """
    kind = source.get("kind")
    if kind == "files":
        return scan_raw(spark, source["path"], fmt=source.get("format"))
    if kind == "jdbc":
        return jdbc_reader(spark, source["url"], source["table"], source["column"], source["lower"], source["upper"],
                           source["partitions"], source.get("properties")).load()
    raise ValueError(f"unknown source kind {kind!r}: files or jdbc")


def read_aggregate(spark: SparkSession, path: str, fmt: str = "parquet", value_type=LongType()) -> DataFrame:
    """Typed aggregate read with an explicit schema."""
    schema = StructType([StructField("TimePeriod", TimestampType(), True), StructField("Volume", value_type, True)])
    if fmt == "csv":
        return spark.read.schema(schema).option("header", "true").csv(path)
    return spark.read.schema(schema).parquet(path)


def read_feature_view(spark: SparkSession, path: str, fields, ts_field: str = "TimePeriod") -> DataFrame:
    """Feature-view source: the declared timestamp plus declared DOUBLE fields."""
    schema = StructType([StructField(ts_field, TimestampType(), True)] +
                        [StructField(f, DoubleType(), True) for f in fields])
    return spark.read.schema(schema).parquet(path)
