"""Intervals of proportions, sample sizes and small scalar helpers, as Column functions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantiles at 0.975 and 0.8.
Z95, Z80 = 1.959963984540054, 0.8416212335729143


def share(k: Column, n: Column) -> Column:
    """k / n, 0 where n is 0."""
    return F.when(n > 0, k / n).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(low, high) of the Wilson score interval; within 1e-9 of 0 or 1 it is that; (0, 0) of no rows."""
    p, m = k / F.nullif(n, F.lit(0)), n.cast("double")
    denominator = 1 + z * z / m
    centre, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    low, high = (centre - half) / denominator, (centre + half) / denominator
    low = F.when(low < 1e-9, 0.0).otherwise(low)
    high = F.when(high > 1 - 1e-9, 1.0).otherwise(high)
    return F.when(n > 0, F.struct(low.alias("low"), high.alias("high"))).otherwise(F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high")))


def overlap(a: Column, b: Column) -> Column:
    """Whether two closed intervals meet."""
    return (a["high"] >= b["low"]) & (b["high"] >= a["low"])


def sample_size(p1: Column, p2: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Rows per group that tell two proportions apart (normal approximation); -1 where they are equal."""
    if not 0 < alpha < 1 or not 0 < power < 1:
        raise ValueError("alpha and power lie between 0 and 1")
    za = Z95 if abs(alpha - 0.05) < 1e-9 else NormalDist().inv_cdf(1 - alpha / 2)
    zb = Z80 if abs(power - 0.8) < 1e-9 else NormalDist().inv_cdf(power)
    mean = (p1 + p2) / 2
    root = za * F.sqrt(2 * mean * (1 - mean)) + zb * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    need = F.greatest(F.lit(1), F.ceil(root * root / F.nullif((p1 - p2) * (p1 - p2), F.lit(0.0))))
    return F.when(F.abs(p1 - p2) < 1e-12, F.lit(-1)).otherwise(need).cast("long")


def kappa_of(observed: float, expected: float) -> float:
    """Chance-corrected agreement; NaN where chance agreement is total."""
    return math.nan if expected >= 1 - 1e-12 else (observed - expected) / (1 - expected)
