"""Session, checkpoint and table helpers of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

ARROW_ROWS = 1000  # rows handed to a Python task at once; texts may be long


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows and bytes and make sure of the shared
    checkpoint folder (read from the session; set only where it is unset)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    ensure_checkpoint_dir(spark)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def keep(df: DataFrame) -> DataFrame:
    """The table, computed once and written to the shared checkpoint folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(text: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; when a partition is done, its worker hands freed
    memory back. Workers serve many tasks and stages, and would keep their peak."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its own counsel
                pass

    return wrapped
