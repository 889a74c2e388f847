"""Output conventions shared by every registered query: naive UTC timestamps and
doubles rounded to 6 dp (plus 0.0, so -0.0 and 0.0 hash alike)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, TimestampType

DP = 6


def tidy(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), DP) + F.lit(0.0)
        elif isinstance(f.dataType, TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(expr: str) -> str:
    """SQL side of the same rounding rule."""
    return f"(round(CAST({expr} AS DOUBLE), {DP}) + 0.0)"
