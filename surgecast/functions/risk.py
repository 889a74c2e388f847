"""Value-at-risk expressions.

The band is the ``confidence`` quantile of Normal(max(0, point), sigma) draws
clipped at zero. Every evaluation uses the same 10,000 standard-normal draws
(seed 42), so the quantile is ``max(0, max(0, point) + sigma * z_q)`` where
``z_q`` is the quantile of that one fixed draw. ``z_q`` is a constant computed
once on the driver (10,000 numbers, independent of the data size).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

from ..config import N_SIMULATIONS, VAR_SEED


@lru_cache(maxsize=64)
def standard_quantile(confidence: float, n_simulations: int = N_SIMULATIONS, seed: int = VAR_SEED) -> float:
    import numpy as np

    z = np.random.default_rng(seed).normal(loc=0.0, scale=1.0, size=n_simulations)
    return float(np.quantile(z, confidence))


def clip0(col: Column) -> Column:
    """At least 0; a missing value stays missing."""
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), col.cast("double")))


def var_expr(point: Column, sigma: Column, confidence: float = 0.99) -> Column:
    """Closed-form Monte-Carlo VaR of one forecast (M7); no band without a point or a sigma."""
    z = standard_quantile(float(confidence))
    s = F.when(sigma.isNotNull(), F.greatest(sigma.cast("double"), F.lit(1e-9)))
    return clip0(clip0(point) + s * F.lit(z))


def band_columns(point: Column, sigma: Column, confidence: float = 0.99) -> list[Column]:
    """Point (clipped, 2 dp), buffer (2 dp) and capacity = ceil(unrounded buffer) (M8)."""
    p = clip0(point)
    buf = var_expr(p, sigma, confidence)
    return [
        F.round(p, 2).alias("Point_Forecast"),
        F.round(buf, 2).alias("Safety_Buffer_99"),
        F.ceil(buf).cast("long").alias("Capacity_Target"),
    ]
