"""Small-sample statistics as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson_low(correct: Column, total: Column, z: float = Z) -> Column:
    centre, half = _wilson(correct, total, z)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))


def wilson_high(correct: Column, total: Column, z: float = Z) -> Column:
    centre, half = _wilson(correct, total, z)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))


def _wilson(correct: Column, total: Column, z: float) -> tuple[Column, Column]:
    n = F.when(total > 0, total.cast("double"))
    share = correct / n
    scale = 1 + z * z / n
    centre = (share + z * z / (2 * n)) / scale
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / scale
    return centre, half


def laplace(correct: Column, total: Column) -> Column:
    """Rule of succession: 0.5 with no data, never 0 or 1."""
    return (correct + 1) / (total + 2)


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))
