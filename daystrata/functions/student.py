"""Two-sided Student-t tail probability for whole degrees of freedom, as a column expression.

The tail is a finite trigonometric sum then: with theta = atan(t / sqrt(n)), the central area is sin(theta) times a sum of
even powers of cos(theta) for even n, and (2 / pi) (theta + sin(theta) times a sum of odd powers) for odd n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_sided_p(t: Column, dof: Column) -> Column:
    """NULL if t or the degrees of freedom are missing or below 1; 0 for an infinite t."""
    t, dof = (F.col(c) if isinstance(c, str) else c for c in (t, dof))
    n = dof.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(n.cast("double")))
    cos, odd = F.cos(theta), n % 2 == 1
    terms = F.when(odd, (n - 1) / 2).otherwise(n / 2).cast("int")
    # each term is the one before it times cos^2 and a ratio of neighbours
    ratio = lambda k: F.when(odd, (2.0 * k) / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
    first = F.when(odd, cos).otherwise(F.lit(1.0))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * cos * cos * ratio(k)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    ks = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
    series = F.when(terms > 0, F.aggregate(ks, start, step, lambda s: s["sum"])).otherwise(0.0)
    area = F.when(odd, (theta + F.sin(theta) * series) * (2 / math.pi)).otherwise(F.sin(theta) * series)
    p = F.greatest(F.lit(0.0), 1 - area)
    return F.when(t.isNull() | F.isnan(t) | (n < 1) | n.isNull(), None).when(F.abs(t) == float("inf"), 0.0).otherwise(p)
