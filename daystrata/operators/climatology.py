"""Day-of-year normals, departures and qualifying days.

Every window here is over at most 366 (or 396) rows of one entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daystrata.spec import PanelSpec

DAYS = 366


def baseline(df: DataFrame, spec: PanelSpec, start: str, end: str) -> DataFrame:
    return df.filter(F.col(spec.date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def doy_means(df: DataFrame, spec: PanelSpec, start: str, end: str) -> DataFrame:
    """Mean value per entity and day of year over the baseline period."""
    return (baseline(df, spec, start, end)
            .groupBy(spec.entity, F.dayofyear(spec.date).alias("doy"))
            .agg(F.avg(spec.value).alias("mean")).filter("mean IS NOT NULL"))


def fill_days(means: DataFrame, spec: PanelSpec) -> DataFrame:
    """All days 1..366: linear between known days, nearest value beyond the ends.

    Each known day emits itself and the unknown days up to the next known one,
    so no dense skeleton has to be joined.
    """
    w = Window.partitionBy(spec.entity).orderBy("doy")
    nxt, nxt_mean = F.lead("doy").over(w), F.lead("mean").over(w)
    first = F.when(F.lag("doy").over(w).isNull(), 1).otherwise(F.col("doy"))
    known = means.select("*", nxt.alias("_next"), nxt_mean.alias("_next_mean"), first.alias("_first"))
    spread = known.select("*", F.explode(F.sequence(F.col("_first"), F.coalesce(F.col("_next") - 1, F.lit(DAYS))))
                          .alias("_day"))
    inside = (F.col("_day") > F.col("doy")) & F.col("_next").isNotNull()
    step = (F.col("_next_mean") - F.col("mean")) * (F.col("_day") - F.col("doy")) / (F.col("_next") - F.col("doy"))
    return spread.select(spec.entity, F.col("_day").alias("doy"),
                         F.when(inside, F.col("mean") + step).otherwise(F.col("mean")).alias("mean"))


def circular_mean(dense: DataFrame, spec: PanelSpec, half: int = 15) -> DataFrame:
    """Centred mean over 2*half+1 days of year, wrapping at the year end."""
    wraps = F.array_compact(F.array(
        F.lit(0), F.when(F.col("doy") <= half, DAYS), F.when(F.col("doy") > DAYS - half, -DAYS)))
    ring = dense.select(spec.entity, "mean", "doy", F.explode(wraps).alias("_wrap"))
    ring = ring.select(spec.entity, "mean", (F.col("doy") + F.col("_wrap")).alias("doy"))
    w = Window.partitionBy(spec.entity).orderBy("doy").rangeBetween(-half, half)
    return (ring.select(spec.entity, "doy", F.avg("mean").over(w).alias(spec.normal))
            .filter(F.col("doy").between(1, DAYS)))


def curves(df: DataFrame, spec: PanelSpec, start: str, end: str, half: int = 15) -> DataFrame:
    """``fill_days`` and ``circular_mean`` of the baseline as one row per entity: its normals of the days 1..366 as an array.

    Rows meet once, at their entity; the same sums are taken in the same order as by the row-wise forms.
    """
    means = doy_means(df.repartition(spec.entity), spec, start, end)
    known = means.groupBy(spec.entity).agg(F.sort_array(F.collect_list(F.struct("doy", "mean"))).alias("_known"))

    def let(value, body):  # evaluated once, however often the body names it
        return F.transform(F.array(value), body)[0]

    def fill(days):
        def stretch(day, i):
            after = F.get(days, i + 1)
            first = F.when(i == 0, 1).otherwise(day["doy"])
            step = lambda d: (after["mean"] - day["mean"]) * (d - day["doy"]) / (after["doy"] - day["doy"])
            return F.transform(F.sequence(first, F.coalesce(after["doy"] - 1, F.lit(DAYS))), lambda d: F.when(
                (d > day["doy"]) & after["doy"].isNotNull(), day["mean"] + step(d)).otherwise(day["mean"]))
        return F.flatten(F.transform(days, stretch))

    def smooth(ring):
        width = 2 * half + 1
        return F.transform(F.sequence(F.lit(1), F.lit(DAYS)), lambda d: F.aggregate(
            F.slice(ring, d, width), F.lit(0.0), lambda a, x: a + x) / width)

    wrap = lambda dense: F.concat(F.slice(dense, DAYS - half + 1, half), dense, F.slice(dense, 1, half))
    dense = let(F.col("_known"), fill)
    return known.select(spec.entity, let(let(dense, wrap), smooth).alias("curve"))


def normals(df: DataFrame, spec: PanelSpec, start: str, end: str, half: int = 15) -> DataFrame:
    """Smoothed normals table (entity, doy, normal)."""
    return curves(df, spec, start, end, half).select(spec.entity, F.posexplode("curve").alias("doy", spec.normal)).withColumn("doy", F.col("doy") + 1)


def pooled_normals(df: DataFrame, spec: PanelSpec, start: str, end: str, half: int = 15) -> DataFrame:
    """Mean and percentile of all baseline day values within ``half`` days of each day of year.

    Every row is shuffled once, to its entity: values are listed by day of year (as many as the baseline has years), and
    each target day puts the lists around it together.
    """
    value = F.col(spec.value).cast("double")
    rows = baseline(df, spec, start, end).filter(F.col(spec.value).isNotNull()).select(
        spec.entity, F.dayofyear(spec.date).alias("doy"), value.alias("_v"))
    days = rows.repartition(spec.entity).groupBy(spec.entity, "doy").agg(F.collect_list("_v").alias("_v"))
    whole = days.groupBy(spec.entity).agg(F.map_from_entries(F.collect_list(F.struct("doy", "_v"))).alias("_m"))
    none = F.array().cast("array<double>")
    around = lambda d: F.flatten(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda o: F.coalesce(
        F.try_element_at("_m", F.pmod(d + o - 1, F.lit(DAYS)) + 1), none)))
    ring = F.transform(F.sequence(F.lit(1), F.lit(DAYS)), lambda d: F.struct(d.alias("doy"), F.array_sort(around(d)).alias("_v")))
    pooled = whole.select(spec.entity, F.inline(ring)).filter(F.size("_v") > 0)
    at = (F.size("_v") - 1) * F.lit(spec.relative.quantile)
    low, high = (F.get("_v", f(at).cast("int")) for f in (F.floor, F.ceil))
    return pooled.select(spec.entity, "doy", (F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.size("_v")).alias(spec.normal),
                         (low + (high - low) * (at - F.floor(at))).alias("p90"), F.size("_v").cast("bigint").alias("pooled_days"))


def nearest_normals(table: DataFrame, spec: PanelSpec, reach: int = 14, default: float = 35.0) -> DataFrame:
    """Complete a normals table: each missing day takes the nearest known day
    (later before earlier at the same distance, both modulo 366), else a default."""
    # order of the offsets 0, +1, -1, +2, -2, ... is the rank of a candidate
    offsets = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(o).alias("off"))
                        for r, o in enumerate([0] + [s * k for k in range(1, reach + 1) for s in (1, -1)])])
    source = table.select(spec.entity, "doy", spec.normal, F.explode(offsets).alias("_c"))
    # day d looks at d + off, so a known day serves the target known - off
    target = F.pmod(F.col("doy") - F.col("_c.off") - 1, F.lit(DAYS)) + 1
    best = (source.groupBy(spec.entity, target.alias("doy"))
            .agg(F.min_by(spec.normal, F.col("_c.rank")).alias(spec.normal), F.min("_c.rank").alias("rank")))
    days = (table.select(spec.entity).distinct()
            .withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(DAYS)))))
    return (days.join(best, [spec.entity, "doy"], "left")
            .withColumn(spec.normal, F.coalesce(F.col(spec.normal), F.lit(default))))


def attach(df: DataFrame, table: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add the normal (and any further columns of the table) and the departure.

    No broadcast hint: the table grows with the entities, AQE decides by its size.
    """
    joined = df.withColumn("_doy", F.dayofyear(spec.date)).join(
        table.withColumnRenamed("doy", "_doy"), [spec.entity, "_doy"], "left").drop("_doy")
    return joined.withColumn(spec.departure, F.col(spec.value) - F.col(spec.normal))


def attach_curves(df: DataFrame, table: DataFrame, spec: PanelSpec) -> DataFrame:
    """As ``attach``, from the ``curves``: the join is by entity, as all that follows, so the panel is not dealt out by day first."""
    joined = df.join(table, spec.entity, "left").withColumn(spec.normal, F.get("curve", F.dayofyear(spec.date) - 1)).drop("curve")
    return joined.withColumn(spec.departure, F.col(spec.value) - F.col(spec.normal))


def qualifying_absolute(df: DataFrame, spec: PanelSpec, zone: str = "region_type") -> DataFrame:
    """0/1 flag by fixed thresholds; coastal entities have their own and no override."""
    v, dep, rule = F.col(spec.value), F.col(spec.departure), spec.rule
    coastal = F.col(zone).isin(*spec.coastal_types)
    inland = ((v >= rule.plains_value) & (dep >= rule.departure)) | (v >= rule.override)
    shore = (v >= rule.coastal_value) & (dep >= rule.departure)
    return df.withColumn(spec.qualifying, F.coalesce(F.when(coastal, shore).otherwise(inland), F.lit(False)).cast("int"))


def qualifying_relative(df: DataFrame, spec: PanelSpec, p90: str = "p90") -> DataFrame:
    """0/1 flag: above the local percentile, at least the floor, in season."""
    v, rule = F.col(spec.value), spec.relative
    hot = (v > F.col(p90)) & (v >= rule.floor) & F.month(spec.date).between(rule.first_month, rule.last_month)
    return df.withColumn(spec.qualifying, F.coalesce(hot, F.lit(False)).cast("int"))
