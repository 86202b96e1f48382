"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two intervals with different quantiles are in use, and they are not interchangeable.
Z_REPORT, Z_ABLATION = 1.959963984540054, 1.96


def _wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    p = k / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), middle - spread), F.least(F.lit(1.0), middle + spread)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The report's interval: nothing observed is (0, 1)."""
    n = n.cast("double")
    low, high = _wilson(k.cast("double"), F.nullif(n, F.lit(0.0)), Z_REPORT)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 1.0).otherwise(high)


def wilson_ablation(k: Column, n: Column) -> tuple[Column, Column]:
    """The ablation's interval: nothing observed is (0, 0), rounded to three places."""
    n = n.cast("double")
    low, high = _wilson(k.cast("double"), F.when(n > 0, n), Z_ABLATION)
    return F.when(n <= 0, 0.0).otherwise(F.round(low, 3)), F.when(n <= 0, 0.0).otherwise(F.round(high, 3))


def p95(values: Column) -> Column:
    """The value at place min(n - 1, max(0, round_half_even(.95 n + .5) - 1)) of the sorted values."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    place = F.least(n - 1, F.greatest(F.lit(0), F.bround(0.95 * n + 0.5).cast("int") - 1))
    return F.when(n > 0, F.get(ordered, place))
