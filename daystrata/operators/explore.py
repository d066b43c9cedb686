"""Exploratory aggregations over a panel.

Groups of one entity (or finer) are bounded by the calendar, so ``percentile`` is
exact and small there. Whole-table quantiles use the bucketed operator instead.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daystrata.functions.scalar import ratio, report_season
from daystrata.functions.student import two_sided_p
from daystrata.operators.prefix import exact_quantiles
from daystrata.spec import PanelSpec

MONTHS = list(range(1, 13))
SEASONS = ["Winter", "Pre-Monsoon", "Monsoon", "Post-Monsoon"]


def long_form(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    casted = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(keys, columns, "column", "value")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean, median, sample std and missing percent per column."""
    long = long_form(df, [], columns)
    stats = long.groupBy("column").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        (F.count_if(F.col("value").isNull()) * 100.0 / F.count(F.lit(1))).alias("missing_pct"))
    return stats.join(exact_quantiles(long, "value", {"median": 0.5}, ["column"]), "column", "left")


def entity_summary(df: DataFrame, spec: PanelSpec, columns: list[str]) -> DataFrame:
    aggs = [f(c).alias(f"{c}_{n}") for c in columns
            for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min), ("sum", F.sum))]
    return df.groupBy(spec.entity).agg(*aggs)


def annual(df: DataFrame, spec: PanelSpec, column: str) -> DataFrame:
    return df.groupBy(spec.entity, F.year(spec.date).alias("year")).agg(
        F.avg(column).alias("mean"), F.max(column).alias("max"), F.min(column).alias("min"),
        F.sum(column).alias("total"))


def annual_trend(df: DataFrame, spec: PanelSpec, column: str, p_value: bool = True) -> DataFrame:
    """Least-squares trend of the annual mean, maximum and minimum per entity."""
    yearly = annual(df, spec, column).unpivot([spec.entity, "year"], ["mean", "max", "min"], "metric", "value")
    fit = yearly.groupBy(spec.entity, "metric").agg(
        F.regr_slope("value", "year").alias("slope"), F.regr_intercept("value", "year").alias("intercept"),
        F.regr_r2("value", "year").alias("r2"), F.count("value").alias("n"))
    if not p_value:
        return fit
    dof = F.col("n") - 2
    t = F.when(F.col("r2") < 1, F.sqrt(F.col("r2") * dof / (1 - F.col("r2")))).otherwise(F.lit(float("inf")))
    return fit.withColumn("p", two_sided_p(t, dof))


def monthly_pivot(df: DataFrame, spec: PanelSpec, column: str, how: str = "median") -> DataFrame:
    agg = F.percentile(column, F.lit(0.5)) if how == "median" else F.avg(column)
    wide = df.groupBy(spec.entity).pivot("month", MONTHS) if "month" in df.columns else (
        df.withColumn("month", F.month(spec.date)).groupBy(spec.entity).pivot("month", MONTHS))
    return wide.agg(agg).select(spec.entity, *[F.col(str(m)).alias(f"m{m:02d}") for m in MONTHS])


def top_months(df: DataFrame, spec: PanelSpec, column: str, k: int = 3) -> DataFrame:
    """The k months with the highest median per entity; earlier month first on ties."""
    med = df.groupBy(spec.entity, F.month(spec.date).alias("month")).agg(
        F.percentile(column, F.lit(0.5)).alias("median"))
    w = Window.partitionBy(spec.entity).orderBy(F.desc("median"), "month")
    return med.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def seasonal_pivot(df: DataFrame, spec: PanelSpec, column: str) -> DataFrame:
    wide = (df.withColumn("season", report_season(F.month(spec.date)))
            .groupBy(spec.entity).pivot("season", SEASONS).agg(F.avg(column)))
    return wide.select(spec.entity, *[F.col(f"`{s}`").alias(s.lower().replace("-", "_")) for s in SEASONS])


def quantile_table(df: DataFrame, spec: PanelSpec, column: str) -> DataFrame:
    q = F.percentile(column, F.array(*[F.lit(x) for x in (0.05, 0.5, 0.95, 0.99)]))
    return df.groupBy(spec.entity).agg(q.alias("_q")).select(
        spec.entity, *[F.col("_q")[i].alias(n) for i, n in enumerate(("p05", "median", "p95", "p99"))])


def zero_frequency(df: DataFrame, spec: PanelSpec, column: str) -> DataFrame:
    return df.groupBy(spec.entity).agg(
        F.count_if(F.col(column) == 0).alias("zeros"),
        (F.count_if(F.col(column) == 0) * 100.0 / F.count(column)).alias("zero_pct"))


def correlations(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair (upper triangle), one aggregation.

    A pair uses the rows where both values are present.
    """
    pairs = list(combinations(columns, 2))
    both = {(a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs}
    wide = df.groupBy(*(by or [])).agg(*[
        F.corr(F.when(both[p], F.col(p[0])), F.when(both[p], F.col(p[1]))).alias(f"{p[0]}|{p[1]}") for p in pairs])
    long = wide.unpivot(by or [], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(*(by or []), F.substring_index("pair", "|", 1).alias("a"),
                       F.substring_index("pair", "|", -1).alias("b"), "r",
                       (F.abs("r") > 0.7).alias("strong"))


def exceedance(df: DataFrame, spec: PanelSpec, column: str, limit: float, by: list[Column]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(column).alias("days"), F.count_if(F.col(column) >= limit).alias("hot_days"),
        (F.count_if(F.col(column) >= limit) * 100.0 / F.count(column)).alias("hot_pct"))


def hottest_day(df: DataFrame, spec: PanelSpec, column: str) -> DataFrame:
    """Date of the maximum, the first one on ties."""
    order = F.struct(F.col(column).alias("v"), (-F.unix_date(spec.date)).alias("d"))
    known = df.filter(F.col(column).isNotNull())
    return known.groupBy(spec.entity).agg(F.max_by(spec.date, order).alias(spec.date), F.max(column).alias(column))


def iqr_outliers(df: DataFrame, spec: PanelSpec, column: str) -> DataFrame:
    """Counts outside q1 - 1.5 iqr and q3 + 1.5 iqr per entity."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    fences = df.groupBy(spec.entity).agg(q.alias("_q")).select(
        spec.entity, (F.col("_q")[0] - 1.5 * (F.col("_q")[1] - F.col("_q")[0])).alias("low_fence"),
        (F.col("_q")[1] + 1.5 * (F.col("_q")[1] - F.col("_q")[0])).alias("high_fence"))
    x = df.join(fences, spec.entity)
    return x.groupBy(spec.entity).agg(
        F.first("low_fence").alias("low_fence"), F.first("high_fence").alias("high_fence"),
        F.count_if(F.col(column) < F.col("low_fence")).alias("low"),
        F.count_if(F.col(column) > F.col("high_fence")).alias("high"),
        (F.count_if(F.col(column) > F.col("high_fence")) * 100.0 / F.count(column)).alias("high_pct"))


def group_comparison(df: DataFrame, flag: Column, columns: list[str]) -> DataFrame:
    long = long_form(df.withColumn("_flag", flag.cast("int")), ["_flag"], columns)
    return long.groupBy("column").agg(
        F.avg(F.when(F.col("_flag") == 1, F.col("value"))).alias("mean_1"),
        F.stddev_samp(F.when(F.col("_flag") == 1, F.col("value"))).alias("std_1"),
        F.avg(F.when(F.col("_flag") == 0, F.col("value"))).alias("mean_0"),
        F.stddev_samp(F.when(F.col("_flag") == 0, F.col("value"))).alias("std_0"))


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the extremes; the last bin is closed."""
    known = df.filter(F.col(column).isNotNull())
    ends = known.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    x = known.withColumn("_ends", ends)
    lo, hi = F.col("_ends.lo"), F.col("_ends.hi")
    width = (hi - lo) / bins
    spot = F.when(hi > lo, F.floor((F.col(column) - lo) / F.when(hi > lo, width))).otherwise(0)
    return (x.select(*(by or []), F.least(spot, F.lit(bins - 1)).alias("bin"), lo.alias("_lo"), width.alias("_w"))
            .groupBy(*(by or []), "bin").agg(F.count(F.lit(1)).alias("n"),
                                             F.first(F.col("_lo") + F.col("_w") * F.col("bin")).alias("left_edge")))


def five_numbers(df: DataFrame, column: str, by: list[Column]) -> DataFrame:
    names = ("minimum", "q1", "median", "q3", "maximum")
    q = F.percentile(column, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    wide = df.groupBy(*by).agg(q.alias("_q"))
    keys = [c for c in wide.columns if c != "_q"]
    return wide.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def class_balance(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Totals, positives, percent and imbalance ratio for each key set and its totals (rollup)."""
    wide = df.rollup(*keys).agg(*_balance(label), *[F.grouping(k).alias(f"_all_{k}") for k in keys])
    # a NULL key is a key; only the totals are called "all"
    return wide.withColumns({k: F.when(F.col(f"_all_{k}") == 1, "all").otherwise(F.col(k).cast("string")) for k in keys}).drop(
        *[f"_all_{k}" for k in keys])


def _balance(label: str) -> list[Column]:
    total, pos = F.count(label), F.sum(label)
    neg = F.count(label) - F.sum(label)
    return [total.alias("total"), pos.alias("positives"), neg.alias("negatives"),
            (pos * 100.0 / total).alias("positive_pct"), ratio(neg.cast("double"), pos, None).alias("imbalance")]


def yearly_counts(df: DataFrame, spec: PanelSpec, flag: str, years: list[int]) -> DataFrame:
    wide = df.groupBy(spec.entity).pivot("year", years) if "year" in df.columns else (
        df.withColumn("year", F.year(spec.date)).groupBy(spec.entity).pivot("year", years))
    return wide.agg(F.sum(flag)).select(
        spec.entity, *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"y{y}") for y in years])


def map_summary(df: DataFrame, spec: PanelSpec, probability: str, label: str) -> DataFrame:
    return df.groupBy(spec.entity).agg(
        F.round(F.avg(probability), 4).alias("avg_probability"), F.round(F.max(probability), 4).alias("max_probability"),
        F.sum(label).alias("label_days"), F.count(F.lit(1)).alias("days"),
        F.round(F.sum(label) * 100.0 / F.count(F.lit(1)), 1).alias("label_pct"))


def entity_stats(df: DataFrame, spec: PanelSpec, label: str) -> DataFrame:
    return df.groupBy(spec.entity).agg(
        F.count(F.lit(1)).alias("days"), F.sum(label).alias("label_days"),
        F.min(spec.date).alias("first_date"), F.max(spec.date).alias("last_date"))


def window_counts(df: DataFrame, spec: PanelSpec, label: str, windows: dict[str, tuple[str, str]],
                  by: list[str] | None = None) -> DataFrame:
    """Rows and positives per named date window, one pass (windows may overlap)."""
    aggs = []
    for name, (a, b) in windows.items():
        inside = F.col(spec.date).between(F.lit(a).cast("date"), F.lit(b).cast("date"))
        aggs += [F.count_if(inside).alias(f"{name}_rows"),
                 F.coalesce(F.sum(F.when(inside, F.col(label))), F.lit(0)).alias(f"{name}_positives")]
    return df.groupBy(*(by or [])).agg(*aggs)


def value_cap(df: DataFrame, column: str, q: float = 0.95) -> DataFrame:
    """Rows at or below an exact whole-table quantile."""
    cap = exact_quantiles(df, column, {"cap": q}).scalar()
    return df.filter(F.col(column) <= cap)


def available_dates(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Sorted distinct dates per entity with their range (at most one per calendar day)."""
    return df.groupBy(spec.entity).agg(
        F.sort_array(F.collect_set(spec.date)).alias("dates"), F.min(spec.date).alias("first_date"),
        F.max(spec.date).alias("last_date"), F.count_distinct(spec.date).alias("n_dates"))


def trend_series(df: DataFrame, spec: PanelSpec, columns: list[str], label: str) -> DataFrame:
    return df.select(spec.entity, spec.date, *[F.round(c, 4).alias(c) for c in columns],
                     F.coalesce(F.col(label), F.lit(0)).alias(label))


def point_lookup(df: DataFrame, spec: PanelSpec, wanted: DataFrame) -> DataFrame:
    """(entity, date) requests with their row, or found = false and the available range."""
    e, d = spec.entity, spec.date
    span = df.join(wanted.select(e).distinct(), e, "left_semi").groupBy(e).agg(
        F.min(d).alias("first_date"), F.max(d).alias("last_date"))
    hit = df.withColumn("found", F.lit(True))
    return (wanted.join(hit, [e, d], "left").join(span, e, "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))
