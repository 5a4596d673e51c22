"""Statistical functions: columns, and kernels on plain numbers for results that are already aggregated."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval in [0, 1]; NULL for n = 0."""
    n = F.nullif(n, F.lit(0))
    p = k / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = (centre - half) / scale, (centre + half) / scale
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), low)), F.when(n.isNotNull(), F.least(F.lit(1.0), high))


def rule_of_three(n: Column) -> Column:
    """Upper bound of a rate of which no case was seen in n."""
    return 3.0 / F.nullif(n, F.lit(0))


def permutation_p(at_least: Column, replicates: Column) -> Column:
    return (at_least + 1) / (replicates + 1)


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def mann_whitney_p(u: float, n1: int, n0: int, tie_sum: float) -> float:
    """Two-sided p of U by the normal approximation, with continuity and tie correction; tie_sum: sum of t**3 - t."""
    n = n1 + n0
    variance = n1 * n0 / 12 * ((n + 1) - tie_sum / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    z = (abs(u - n1 * n0 / 2) - 0.5) / math.sqrt(variance)
    return min(1.0, 2 * normal_tail(z))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(odds ratio, two-sided p) of the table [[a, b], [c, d]]; the odds are infinite for b*c = 0."""
    odds = math.inf if b * c == 0 and a * d else (a * d / (b * c) if b * c else math.nan)
    row, column, n = a + b, a + c, a + b + c + d

    def log_choose(x: int, y: int) -> float:
        return math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)

    def log_p(x: int) -> float:
        return log_choose(row, x) + log_choose(n - row, column - x) - log_choose(n, column)

    seen = log_p(a)
    low, high = max(0, row + column - n), min(row, column)
    total = math.fsum(math.exp(p) for x in range(low, high + 1) if (p := log_p(x)) <= seen + 1e-7)
    return odds, min(1.0, total)
