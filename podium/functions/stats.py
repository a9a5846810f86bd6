"""Guarded correlation and interval expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_PAIRS = 3
Z95 = 1.96
MIN_INTERVAL_N = 4


def pearson(x: Column, y: Column, min_pairs: int = MIN_PAIRS) -> Column:
    """Pairwise-complete correlation; null with too few pairs or no variation on a side.

    ``corr`` itself fails on a constant side, so it is built from one-pass moments of
    the pairs that are complete; min = max is the exact test for "no variation".
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    scale = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return F.when((F.count(a) >= min_pairs) & varied, F.try_divide(F.covar_pop(a, b), scale))


def fisher_bound(r: Column, n: Column, side: int) -> Column:
    ok = (n >= MIN_INTERVAL_N) & (F.abs(r) < 1)
    margin = F.lit(Z95) / F.sqrt(F.when(ok, n - 3).cast("double"))
    return F.when(ok, F.tanh(F.atanh(F.when(ok, r)) + F.lit(side) * margin))
