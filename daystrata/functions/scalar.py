"""Row-level column expressions. All stay inside whole-stage codegen."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daystrata.spec import RISK_LEVELS, RISK_RANK

HASH_MULTIPLIER = 2654435761
HASH_MODULUS = 4294967296


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the source files; Spark compares NaN as the greatest value."""
    fixed = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
             for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixed) if fixed else df


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den, or ``empty`` when the denominator is zero or null."""
    return F.when(den != 0, num / F.when(den != 0, den)).otherwise(F.lit(empty).cast("double"))


def season_code(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), 0).when(month.isin(3, 4, 5), 1)
            .when(month.isin(6, 7, 8, 9), 2).otherwise(3))


def season_name(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
            .when(month.isin(6, 7, 8, 9), "monsoon").otherwise("autumn"))


def report_season(month: Column) -> Column:
    """Season names of the exploratory reports (same months, other words)."""
    return (F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Pre-Monsoon")
            .when(month.isin(6, 7, 8, 9), "Monsoon").otherwise("Post-Monsoon"))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def risk_level(p: Column) -> Column:
    """Level name of a probability; NULL when it is missing, NaN or outside [0, 1]."""
    level = reduce(lambda c, lv: c.when(p >= lv[1], lv[0]), sorted(RISK_LEVELS, key=lambda x: -x[1]),
                   F.when(p.isNull() | F.isnan(p) | (p < 0) | (p > 1), None))
    return level


def risk_score(p: Column) -> Column:
    return F.round(p * 100, 1)


def risk_rank(level: Column) -> Column:
    return reduce(lambda c, kv: c.when(level == kv[0], kv[1]), list(RISK_RANK.items())[1:],
                  F.when(level == "LOW", 0))


def mix(key: Column, seed: int = 42) -> Column:
    """Multiplicative hash of an integer key to [0, 2^32), the same in any SQL engine.

    Two rounds, folding the high half into the low one between them, so that
    consecutive keys spread over the whole range.
    """
    a = F.pmod(F.pmod(key, F.lit(HASH_MODULUS)) * F.lit(HASH_MULTIPLIER % 2**31) + F.lit(seed), F.lit(HASH_MODULUS))
    b = F.pmod(a + F.floor(a / 65536), F.lit(HASH_MODULUS))
    return F.pmod(b * F.lit(1103515245) + F.lit(12345), F.lit(HASH_MODULUS)).cast("bigint")


def mix_sql(key: str, seed: int = 42) -> str:
    """The same hash as SQL text."""
    a = f"((({key}) % {HASH_MODULUS} * {HASH_MULTIPLIER % 2**31} + {seed}) % {HASH_MODULUS})"
    b = f"(({a} + {a} // 65536) % {HASH_MODULUS})"
    return f"(({b} * 1103515245 + 12345) % {HASH_MODULUS})"


def bin_of(value: Column, edges: Column) -> Column:
    """1-based histogram bin over all edges: half-open bins, the last one closed; 0 below the first edge, NULL above the last."""
    passed = F.size(F.filter(edges, lambda e: value >= e))
    return F.when(value > F.element_at(edges, -1), None).otherwise(F.least(passed, F.size(edges) - 1))
