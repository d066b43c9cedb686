"""Lag, rolling, trend, anomaly and calendar features.

Offsets are positions within an entity, not calendar days. Rolling means, maxima,
minima and slopes over at most seven previous rows are plain arithmetic on lag
columns: the window operator only delivers offsets and one 30-row frame, the
rest is generated code. That is about half the time of one sliding aggregate per
column, provided the JVM compiles the generated method: see ``daystrata.session``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daystrata.functions.scalar import cyclic, season_code
from daystrata.spec import PanelSpec


def entity_window(spec: PanelSpec):
    return Window.partitionBy(spec.entity).orderBy(spec.date)


def _lag(name: str, k: int) -> str:
    return f"_{name}_{k}"


def lag_slope(name: str, width: int) -> Column:
    """Least-squares slope over the previous ``width`` rows; nulls are skipped but keep
    their position; NULL with fewer than two values."""
    points = [(width - k, F.col(_lag(name, k))) for k in range(1, width + 1)]
    present = [(x, y, y.isNotNull().cast("double"), F.coalesce(y, F.lit(0.0))) for x, y in points]
    n = reduce(add, [p for _, _, p, _ in present])
    sx = reduce(add, [p * x for x, _, p, _ in present])
    sxx = reduce(add, [p * (x * x) for x, _, p, _ in present])
    sy = reduce(add, [y for _, _, _, y in present])
    sxy = reduce(add, [y * x for x, _, _, y in present])
    det = n * sxx - sx * sx
    return F.when((n >= 2) & (F.col("_row") >= width), (n * sxy - sx * sy) / F.when(det != 0, det))


def rolling(name: str, width: int) -> dict[str, Column]:
    past = [F.col(_lag(name, k)) for k in range(1, width + 1)]
    full = reduce(lambda a, b: a & b, [c.isNotNull() for c in past])
    return {
        f"{name}_roll{width}_mean": reduce(add, past) / width,
        f"{name}_roll{width}_max": F.when(full, F.greatest(*past)),
        f"{name}_roll{width}_min": F.when(full, F.least(*past)),
    }


def calendar(spec: PanelSpec) -> dict[str, Column]:
    d = F.col(spec.date)
    month_sin, month_cos = cyclic(F.month(d), 12)
    doy_sin, doy_cos = cyclic(F.dayofyear(d), 365.25)
    return {"month": F.month(d), "day_of_year": F.dayofyear(d), "season_code": season_code(F.month(d)),
            "month_sin": month_sin, "month_cos": month_cos, "doy_sin": doy_sin, "doy_cos": doy_cos}


def build(df: DataFrame, spec: PanelSpec, live: bool = False) -> DataFrame:
    """All features and the next-row target of a labelled panel, in one window sort.

    ``live`` replaces the lagged label by the lagged qualifying flag, which is all
    that is known for the newest rows.
    """
    w = entity_window(spec)
    depth = max(*spec.rolls, *spec.slopes)
    before = w.rowsBetween(-spec.z_window, -1)
    dep = F.col(spec.departure)
    deep = set(spec.variables) | {spec.value}
    offsets = {_lag(v, k): F.lag(v, k).over(w) for v in sorted(deep)
               for k in sorted(set(range(1, depth + 1)) | set(spec.lags))}
    staged = df.withColumns({
        **offsets,
        **{f"{spec.departure}_lag{k}": F.lag(dep, k).over(w) for k in spec.lags},
        f"{spec.label}_lag1": (F.coalesce(F.lag(spec.qualifying).over(w), F.lit(0)) if live
                               else F.lag(spec.label, 1).over(w)),
        spec.target: F.lead(spec.label, 1).over(w) if spec.label in df.columns else F.lit(None).cast("int"),
        "_row": F.row_number().over(w),
        "_rows": F.count(F.lit(1)).over(Window.partitionBy(spec.entity)),
        "_z_n": F.count(dep).over(before), "_z_mean": F.avg(dep).over(before),
        "_z_std": F.stddev_samp(dep).over(before),
    })
    v = F.col(spec.value)
    derived: dict[str, Column] = {}
    for name in spec.variables:
        derived |= {f"{name}_lag{k}": F.col(_lag(name, k)) for k in spec.lags}
        for width in spec.rolls:
            derived |= rolling(name, width)
    derived |= {f"{spec.alias}_delta_{k}d": v - F.col(_lag(spec.value, k)) for k in (1, 3, 7)}
    derived |= {f"{spec.alias}_slope_{k}d": lag_slope(spec.value, k) for k in spec.slopes}
    derived[f"{spec.departure}_zscore"] = F.when(
        F.col("_z_n") >= spec.z_min, (dep - F.col("_z_mean")) / F.when(F.col("_z_std") != 0, F.col("_z_std")))
    derived |= calendar(spec)
    if "region_type" in df.columns:
        derived["is_coastal"] = F.col("region_type").isin(*spec.coastal_types).cast("int")
    out = staged.withColumns(derived)
    return out.drop(*offsets, "_z_n", "_z_mean", "_z_std")


def trim(features: DataFrame, head: int = 7, tail: int = 1, undefined: int = 3) -> DataFrame:
    """Drop the rows whose windows are incomplete: the first ``head`` + ``undefined``
    and the last ``tail`` of each entity."""
    return (features.filter((F.col("_row") > head + undefined) & (F.col("_row") <= F.col("_rows") - tail))
            .drop("_row", "_rows"))


def centred_mean(df: DataFrame, spec: PanelSpec, width: int = 365, least: int = 300) -> DataFrame:
    half = width // 2
    frame = entity_window(spec).rowsBetween(-half, half)
    return df.withColumn("centred_mean", F.when(F.count(spec.value).over(frame) >= least,
                                                F.avg(spec.value).over(frame)))


def ordinals(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumns({"row_ordinal": F.row_number().over(entity_window(spec)) - 1,
                           "entity_rows": F.count(F.lit(1)).over(Window.partitionBy(spec.entity))})


def sequences(df: DataFrame, spec: PanelSpec, columns: list[str], length: int) -> DataFrame:
    """Per row the last ``length`` rows of its entity as an array of float arrays,
    oldest first; rows with a shorter past are left out.

    Built on the whole panel and filtered by split afterwards, the first rows of a
    later split reach into the earlier one for inputs (never for labels).
    """
    frame = entity_window(spec).rowsBetween(-(length - 1), 0)
    row = F.array(*[F.col(c).cast("float") for c in columns])
    return (df.withColumn("sequence", F.collect_list(row).over(frame))
            .filter(F.size("sequence") == length))


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row with mean and population standard deviation per column (below 1e-8 -> 1)."""
    aggs = []
    for c in columns:
        std = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}__mean"), F.when(std < 1e-8, 1.0).otherwise(std).alias(f"{c}__std")]
    return train.agg(*aggs)


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    fitted = scaler.select(F.struct(*scaler.columns)).scalar()
    scaled = df.withColumn("_fit", fitted).withColumns(
        {c: (F.col(c) - F.col(f"_fit.{c}__mean")) / F.col(f"_fit.{c}__std") for c in columns})
    return scaled.drop("_fit")
