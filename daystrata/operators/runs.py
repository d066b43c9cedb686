"""Runs of qualifying rows with a minimum length (gaps and islands).

Windows are per entity. A panel has one row per entity and date, so an entity
holds at most as many rows as the calendar has days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daystrata.spec import PanelSpec


def islands(df: DataFrame, spec: PanelSpec, flag: str) -> DataFrame:
    """Number the stretches of equal flag values per entity."""
    w = Window.partitionBy(spec.entity).orderBy(spec.date)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    return (df.withColumn("_change", change)
            .withColumn("_island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def label_runs(df: DataFrame, spec: PanelSpec, min_run: int | None = None) -> DataFrame:
    """Add label, event_id (1.. per entity, 0 = none), event_start, event_end, event_length
    and ``label_known``: the run had reached the minimum length by this row, without
    looking ahead. A null flag is no qualifying day.

    Whether a run is long enough shows within ``least - 1`` rows of each of its rows, so labels, numbers and starts need
    only the order by date, which the features share; the end and length of an event are a second sort.
    """
    least = min_run or spec.rule.min_run
    w = Window.partitionBy(spec.entity).orderBy(spec.date)
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(spec.entity, "event_id")
    hot = lambda flag: F.coalesce((flag == 1).cast("int"), F.lit(0))
    near = {f"_{name}{k}": hot(f(spec.qualifying, k).over(w))
            for name, f in (("before", F.lag), ("after", F.lead)) for k in range(1, max(least, 2))}

    def beside(name):
        """Qualifying rows next to this one without a gap, ``least - 1`` at most."""
        n = F.lit(0)
        for k in range(least - 1, 0, -1):
            n = F.col(f"_{name}{k}") * (n + 1)
        return n

    now = hot(F.col(spec.qualifying)) == 1
    member = F.col(spec.label) == 1
    x = df.withColumns(near)
    x = x.withColumns({spec.label: (now & (beside("before") + beside("after") + 1 >= least)).cast("int"),
                       "_known": (now & (beside("before") + 1 >= least)).cast("int")})
    x = x.withColumn("_opens", member & (F.col("_before1") == 0))
    x = x.withColumns({"event_id": F.when(member, F.sum(F.col("_opens").cast("int")).over(upto)).otherwise(0).cast("int"),
                       "event_start": F.when(member, F.max(F.when(F.col("_opens"), F.col(spec.date))).over(upto))})
    return (x.withColumns({
        "event_end": F.when(member, F.max(spec.date).over(whole)),
        "event_length": F.when(member, F.count(F.lit(1)).over(whole)).otherwise(0).cast("int"),
        "label_known": F.col("_known"),
    }).drop("_known", "_opens", *near))


def event_table(labelled: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per event with its peak departure."""
    return (labelled.filter("event_id > 0").groupBy(spec.entity, "event_id")
            .agg(F.min("event_start").alias("event_start"), F.max("event_end").alias("event_end"),
                 F.max("event_length").alias("event_length"), F.max(spec.departure).alias("peak_departure")))


def event_stats(labelled: DataFrame, spec: PanelSpec) -> DataFrame:
    """Events, durations and isolated qualifying days per entity, zero-event entities kept.

    An event is counted at its first row, so one aggregation serves all columns.
    """
    opens = (F.col("event_id") > 0) & (F.col(spec.date) == F.col("event_start"))
    length = F.when(opens, F.col("event_length"))
    return labelled.groupBy(spec.entity).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(spec.qualifying).alias("qualifying_days"), F.sum(spec.label).alias("label_days"),
        F.count_if(opens).alias("events"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_length"),
        (F.sum(spec.qualifying) - F.sum(spec.label)).alias("isolated_days"))


def examples(labelled: DataFrame, spec: PanelSpec) -> DataFrame:
    """Representative days per entity: a normal January day, the first isolated
    qualifying day, and start, middle and end of the longest event (first on ties)."""
    d, e = F.col(spec.date), spec.entity
    base = labelled.groupBy(e).agg(
        F.min(F.when((F.month(d) == 1) & (F.col(spec.qualifying) == 0), d)).alias("normal"),
        F.min(F.when((F.col(spec.qualifying) == 1) & (F.col(spec.label) == 0), d)).alias("isolated"),
        F.max_by(F.struct("event_start", "event_end", "event_length", "event_id"),
                 F.when(F.col("event_id") > 0, F.struct("event_length", (-F.col("event_id")).alias("i")))).alias("top"))
    # the middle of a run is a position, not a date: rows may miss days
    w = Window.partitionBy(e, "event_id").orderBy(spec.date)
    members = labelled.filter("event_id > 0").select(
        e, "event_id", spec.date, (F.row_number().over(w) - 1).alias("_pos"))
    middle = (base.select(e, "top.event_id", "top.event_length").join(members, [e, "event_id"])
              .filter(F.col("_pos") == F.floor(F.col("event_length") / 2)).select(e, d.alias("middle")))
    wide = base.join(middle, e, "left").select(
        e, "normal", "isolated", F.col("top.event_start").alias("start"), "middle", F.col("top.event_end").alias("end"))
    return (wide.unpivot([e], ["normal", "isolated", "start", "middle", "end"], "kind", spec.date)
            .filter(d.isNotNull()))


def longest_run(df: DataFrame, spec: PanelSpec, flag: str) -> DataFrame:
    """Longest stretch of flag = 1 per entity (0 when there is none)."""
    sizes = islands(df, spec, flag).groupBy(spec.entity, "_island", flag).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(spec.entity).agg(
        F.coalesce(F.max(F.when(F.col(flag) == 1, F.col("_n"))), F.lit(0)).alias("longest_run"))


def live_label_lag(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Yesterday's qualifying flag stands in for yesterday's label (0 on the first row)."""
    w = Window.partitionBy(spec.entity).orderBy(spec.date)
    return df.withColumn(f"{spec.label}_lag1", F.coalesce(F.lag(spec.qualifying).over(w), F.lit(0)))
