"""Population stability index against a per entity, month and feature baseline.

A baseline group holds one entity's days of one calendar month: bounded by the
length of the history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daystrata.functions.scalar import bin_of
from daystrata.spec import PSI_FLOOR, PSI_LEVELS, PSI_MIN_ROWS, PSI_OUTER, PanelSpec

KEYS = ("month", "feature")


def long_rows(df: DataFrame, spec: PanelSpec, features: list[str]) -> DataFrame:
    """(entity, month, feature, value) of the complete rows; text is coerced, NaN is missing."""
    number = {c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in features}
    rows = df.select(spec.entity, F.to_date(spec.date).alias(spec.date), *[e.alias(c) for c, e in number.items()])
    complete = rows.na.drop(subset=[spec.date, *features]).withColumn("month", F.month(spec.date))
    return complete.unpivot([spec.entity, spec.date, "month"], features, "feature", "value")


def _bin_counts(placed: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` and the counts of the bins; out-of-range values count for no bin."""
    cells = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n"))
    inside = F.when(F.col("bin") > 0, F.struct("bin", "_n"))
    return cells.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.sum(F.when(F.col("bin") > 0, F.col("_n")).otherwise(0)).alias("_in"),
        F.map_from_entries(F.collect_list(inside)).alias("_c"))  # at most one entry per bin


def baseline(df: DataFrame, spec: PanelSpec, features: list[str], bins: int = 10) -> DataFrame:
    """(entity, month, feature, edges, proportions): deduplicated quantile edges with open
    outer bins; a constant group gets one unit-wide bin around its value."""
    keys = [spec.entity, *KEYS]
    long = long_rows(df, spec, features)
    # integer positions: a cut that falls on a value is that value, whatever q * (n - 1) rounds to
    ordered = long.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("_s"))
    ordered = ordered.withColumn("_last", F.size("_s") - 1)

    def cut(i: int) -> Column:
        low = F.get("_s", F.expr(f"{i} * _last div {bins}").cast("int"))
        high = F.get("_s", F.least(F.expr(f"{i} * _last div {bins} + 1").cast("int"), F.col("_last")))
        return low + (high - low) * (F.expr(f"{i} * _last % {bins}") / F.lit(float(bins)))

    q = ordered.select(*keys, "_s", F.array_distinct(F.array(*[cut(i) for i in range(bins + 1)])).alias("_q"))
    inner = F.slice("_q", 2, F.size("_q") - 2)
    spread = F.concat(F.array(F.lit(-PSI_OUTER)), inner, F.array(F.lit(PSI_OUTER)))
    point = F.array(F.col("_q")[0] - 0.5, F.col("_q")[0] + 0.5)
    edges = F.when(F.size("_q") < 2, point).when(F.size("_q") == 2, F.array(F.lit(-PSI_OUTER), F.lit(PSI_OUTER))).otherwise(spread)
    q = q.select(*keys, "_s", edges.alias("edges"))
    # the group's sorted values are at hand: no second look at the rows
    last = F.size("edges") - 1
    inside = lambda i: F.size(F.filter("_s", lambda v: (v >= F.get("edges", i - 1)) & ((v < F.get("edges", i)) | ((i == last) & (v <= F.get("edges", i))))))
    counts = q.withColumn("_n", F.transform(F.sequence(F.lit(1), last), inside))
    total = F.greatest(F.aggregate("_n", F.lit(0), lambda a, x: a + x), F.lit(1))
    return counts.select(*keys, "edges", F.transform("_n", lambda n: n / total).alias("proportions"))


def level(psi: Column) -> Column:
    steps = reduce(lambda c, s: c.when(psi < s[0], s[1]), PSI_LEVELS, F.when(psi.isNull(), "unavailable"))
    return steps.otherwise("high_drift")


def psi(observed: Column, expected: Column) -> Column:
    term = lambda o, e: ((F.greatest(o, F.lit(PSI_FLOOR)) - F.greatest(e, F.lit(PSI_FLOOR)))
                         * F.ln(F.greatest(o, F.lit(PSI_FLOOR)) / F.greatest(e, F.lit(PSI_FLOOR))))
    return F.aggregate(F.zip_with(observed, expected, term), F.lit(0.0), lambda a, x: a + x)


def month_psi(recent: DataFrame, base: DataFrame, spec: PanelSpec, features: list[str]) -> DataFrame:
    """PSI per entity, month and feature, with the baseline's own number of bins; NULL where it lacks the month.

    Rows meet the edges to find their bin, counts meet the baseline again for its shares: no arrays are carried with the counts.
    """
    keys = [spec.entity, *KEYS]
    placed = (long_rows(recent, spec, features).join(base.select(*keys, "edges"), keys, "left")
              .select(*keys, F.coalesce(bin_of(F.col("value"), F.col("edges")), F.lit(0)).alias("bin")))
    share = lambda i: F.coalesce(F.try_element_at("_c", i), F.lit(0)) / F.greatest(F.col("_in"), F.lit(1))
    counted = _bin_counts(placed, keys).join(base.select(*keys, "edges", "proportions"), keys, "left")
    shares = counted.withColumn("shares", F.transform(F.sequence(F.lit(1), F.size("edges") - 1), share))
    return shares.select(*keys, "rows", F.when(F.col("proportions").isNotNull(), psi(F.col("shares"), F.col("proportions"))).alias("psi"))


def feature_drift(months: DataFrame, spec: PanelSpec) -> DataFrame:
    """Row-weighted mean over the months, with the months that had no reference."""
    known = F.when(F.col("psi").isNotNull(), F.col("rows"))
    x = months.groupBy(spec.entity, "feature").agg(
        (F.sum(F.col("psi") * F.col("rows")) / F.sum(known)).alias("psi"), F.sum("rows").alias("rows"),
        F.sort_array(F.collect_list(F.when(F.col("psi").isNull(), F.col("month")))).alias("missing_months"))
    return x.withColumn("level", level(F.col("psi")))


def assess(recent: DataFrame, base: DataFrame, spec: PanelSpec, features: list[str], today: str | None = None) -> DataFrame:
    """One row per entity: status, sample size (complete rows), overall PSI and level,
    drifting features. Too short a history gets a status instead of a level."""
    rows = recent.filter(F.col(spec.date) <= F.lit(today).cast("date")) if today else recent
    by_feature = feature_drift(month_psi(rows, base, spec, features), spec)
    overall = by_feature.groupBy(spec.entity).agg(
        F.avg("psi").alias("psi"), F.max("rows").alias("size"),
        F.count_if(F.col("level").isin("drift_detected", "high_drift")).alias("drifting"))
    every = rows.select(spec.entity).distinct().join(overall, spec.entity, "left")
    size = F.coalesce("size", F.lit(0))
    enough = size >= PSI_MIN_ROWS
    return every.select(
        spec.entity, F.when(enough, "available").otherwise("insufficient_history").alias("status"), size.alias("sample_size"),
        F.when(enough, F.round("psi", 4)).alias("overall_psi"), F.when(enough, level(F.col("psi"))).alias("level"),
        F.when(enough, F.col("drifting")).otherwise(0).alias("drifting"))
