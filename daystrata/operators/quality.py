"""Panel quality checks. Each returns rows; nothing is collected.

Date checks use one window per entity. Instead of laying a dense calendar beside
the panel, a gap emits the dates it hides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daystrata.spec import PanelSpec


def _order(spec: PanelSpec):
    return Window.partitionBy(spec.entity).orderBy(spec.date)


def row_counts(df: DataFrame, spec: PanelSpec, low: int, high: int) -> DataFrame:
    """Rows per entity and whether they lie in [low, high]."""
    n = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("ok", F.col("rows").between(low, high))


def wrong_types(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column, expected, found) of the schema differences; needs no job."""
    have = dict(df.dtypes)
    return [(c, t, have.get(c, "absent")) for c, t in expected.items() if have.get(c) != t]


def invalid_flags(df: DataFrame, column: str) -> DataFrame:
    """Rows whose 0/1 column holds anything else."""
    return df.agg(F.count_if(~F.col(column).isin(0, 1)).alias("invalid"), F.count(F.lit(1)).alias("rows"))


def date_gaps(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Consecutive dates that are not one day apart."""
    prev = F.lag(spec.date).over(_order(spec))
    x = df.select(spec.entity, prev.alias("previous"), spec.date)
    return x.withColumn("days", F.datediff(spec.date, "previous")).filter("days <> 1")


def missing_dates(df: DataFrame, spec: PanelSpec, start: str, end: str) -> DataFrame:
    """Dates of the expected range that an entity of the panel lacks: its gaps, its two ends, or the whole range if it has
    no row in it."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    d = F.col(spec.date)
    here = F.when(d.between(first, last), d)
    prev = F.lag(d, 1).over(_order(spec))
    gap = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<date>"))
    inner = df.filter(here.isNotNull()).select(spec.entity, d, prev.alias("_prev")).filter(F.datediff(d, "_prev") > 1).select(
        spec.entity, F.explode(gap(F.date_add("_prev", 1), F.date_sub(d, 1))).alias(spec.date))
    ends = df.groupBy(spec.entity).agg(F.min(here).alias("_a"), F.max(here).alias("_z"))
    outer = F.when(F.col("_a").isNull(), gap(first, last)).otherwise(
        F.concat(gap(first, F.date_sub("_a", 1)), gap(F.date_add("_z", 1), last)))
    return inner.union(ends.select(spec.entity, F.explode(outer).alias(spec.date)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Total rows and how many repeat an earlier identical row (hash partial aggregation)."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return per_row.agg(F.sum("_copies").alias("rows"), F.sum(F.col("_copies") - 1).alias("duplicates"))


def null_profile(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Null count and percent per column (and group), one aggregation, long form."""
    by = by or []
    n = F.count(F.lit(1)).alias("_rows")
    wide = df.groupBy(*by).agg(n, *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = wide.unpivot([*by, "_rows"], columns, "column", "nulls")
    return long.select(*by, "column", "nulls", (F.col("nulls") * 100.0 / F.col("_rows")).alias("null_pct"))


def null_matrix(df: DataFrame, columns: list[str], by: str, values: list) -> DataFrame:
    """Columns down, entities across (``values`` fixes the pivot columns)."""
    long = null_profile(df, columns, [by])
    return long.groupBy("column").pivot(by, values).agg(F.first("nulls"))


def null_status(df: DataFrame, columns: list[str], by: list[str] | None = None, warn_pct: float = 1.0) -> DataFrame:
    """FAIL for an entirely null column, WARN above ``warn_pct``, else PASS."""
    p = F.col("null_pct")
    return null_profile(df, columns, by).withColumn(
        "status", F.when(p == 100, "FAIL").when(p > warn_pct, "WARN").otherwise("PASS"))


def range_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values below, above and negative, with the extremes, per column."""
    aggs = []
    for c, (lo, hi) in bounds.items():
        v = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(v < lo).alias("below"), F.count_if(v > hi).alias("above"),
                             F.count_if(v < 0).alias("negative"), F.min(v).alias("min"), F.max(v).alias("max")))
    return df.agg(F.array(*aggs).alias("_r")).select(F.inline("_r"))


def metadata_check(df: DataFrame, expected: DataFrame, key: str, text: list[str], numbers: list[str],
                   tolerance: float = 0.001) -> DataFrame:
    """Metadata columns are constant per entity and equal to the registry."""
    aggs = [x for c in [*text, *numbers] for x in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))]
    seen = df.groupBy(key).agg(*aggs)
    joined = seen.join(expected.select(key, *[F.col(c).alias(f"{c}__want") for c in [*text, *numbers]]), key, "left")
    good = [(F.col(f"{c}__lo") == F.col(f"{c}__hi")) & (F.col(f"{c}__lo") == F.col(f"{c}__want")) for c in text]
    good += [(F.abs(F.col(f"{c}__lo") - F.col(f"{c}__want")) <= tolerance)
             & (F.abs(F.col(f"{c}__hi") - F.col(f"{c}__want")) <= tolerance) for c in numbers]
    names = F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(c)) for g, c in zip(good, [*text, *numbers])]))
    return joined.select(key, (F.size(names) == 0).alias("ok"), names.alias("wrong"))


def identical_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Largest absolute difference; nulls have to coincide as well."""
    diff = F.max(F.abs(F.col(a) - F.col(b)))
    odd = F.count_if(F.col(a).isNull() != F.col(b).isNull())
    return df.agg(diff.alias("max_diff"), odd.alias("null_mismatch")).withColumn(
        "identical", (F.coalesce("max_diff", F.lit(0.0)) == 0) & (F.col("null_mismatch") == 0))


def date_ranges(df: DataFrame, spec: PanelSpec, start: str, end: str) -> DataFrame:
    r = df.groupBy(spec.entity).agg(F.min(spec.date).alias("first_date"), F.max(spec.date).alias("last_date"))
    return r.withColumn("ok", (F.col("first_date") == F.lit(start).cast("date")) & (F.col("last_date") == F.lit(end).cast("date")))


def strictly_increasing(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Dates per entity never repeat. Rows of a table carry no order of their own, so this is
    what chronological storage amounts to."""
    return df.groupBy(spec.entity).agg(
        (F.count(F.lit(1)) - F.count_distinct(spec.date)).alias("ties")).withColumn("ok", F.col("ties") == 0)


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A column is constant when min = max; no distinct count is needed."""
    entries = [F.struct(F.lit(c).alias("column"), F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("constant")) for c in columns]
    return df.agg(F.array(*entries).alias("_r")).select(F.inline("_r"))


def target_check(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """target(T) must equal label(T+1) within the entity."""
    nxt = F.lead(spec.label).over(_order(spec))
    x = df.withColumn("_next", nxt)
    return x.agg(F.count_if(F.col("_next").isNotNull() & (F.col(spec.target) != F.col("_next"))).alias("mismatches"),
                 F.count_if(F.col("_next").isNotNull()).alias("checked"))


def boundary_check(df: DataFrame, spec: PanelSpec, lags: list[str]) -> DataFrame:
    """Null lags on the first kept row of each entity (there must be none)."""
    first = df.withColumn("_rn", F.row_number().over(_order(spec))).filter("_rn = 1")
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in lags])
    return first.select(spec.entity, spec.date, missing.alias("null_lags"))


def null_positions(df: DataFrame, spec: PanelSpec, column: str) -> DataFrame:
    """How many nulls a column has per entity and the last position of one."""
    x = df.withColumn("_rn", F.row_number().over(_order(spec)))
    null = F.col(column).isNull()
    return x.groupBy(spec.entity).agg(F.count_if(null).alias("nulls"), F.max(F.when(null, F.col("_rn"))).alias("last_position"))


def split_leakage(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per entity: splits follow each other in time. ``ok`` is false on any overlap."""
    bounds = [f.alias(f"{s}_{n}") for s in ("train", "val", "test") for n, f in (
        ("min", F.min(F.when(F.col("split") == s, F.col(spec.date)))), ("max", F.max(F.when(F.col("split") == s, F.col(spec.date)))))]
    x = df.groupBy(spec.entity).agg(*bounds)
    ok = F.coalesce(F.col("train_max") < F.col("val_min"), F.lit(True)) & F.coalesce(F.col("val_max") < F.col("test_min"), F.lit(True))
    return x.withColumn("ok", ok)


def global_split_order(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Over all entities: the ranges of the splits, in order and apart. ``ok`` is NULL for a split without rows."""
    d = F.col(spec.date)
    bounds = [f.alias(f"{s}_{n}") for s in ("train", "val", "test") for n, f in (
        ("min", F.min(F.when(F.col("split") == s, d))), ("max", F.max(F.when(F.col("split") == s, d))))]
    x = df.agg(*bounds)
    pairs = [("train", "val"), ("val", "test"), ("train", "test")]
    rows = [F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later"), F.col(f"{a}_max").alias("last_earlier"),
                     F.col(f"{b}_min").alias("first_later"), (F.col(f"{a}_max") < F.col(f"{b}_min")).alias("ok")) for a, b in pairs]
    return x.select(F.inline(F.array(*rows)))


def null_context(df: DataFrame, spec: PanelSpec, column: str, source: str, window: int) -> DataFrame:
    """Each null of ``column`` with count, mean and deviation of ``source`` in the ``window`` rows before it: why it is null."""
    before = _order(spec).rowsBetween(-window, -1)
    x = df.select(spec.entity, spec.date, column, F.count(source).over(before).alias("window_n"),
                  F.avg(source).over(before).alias("window_mean"), F.stddev_samp(source).over(before).alias("window_std"))
    return x.filter(F.col(column).isNull()).drop(column)


def split_overlap(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Keys that occur in more than one split."""
    k = df.groupBy(spec.entity, spec.date).agg(F.count_distinct("split").alias("splits"))
    return k.filter("splits > 1")


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (with multiplicity) that only one of two tables holds."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    both = count(a, "_a").join(count(b, "_b"), keys, "full")
    diff = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    return both.select(*keys, diff.alias("surplus")).filter("surplus <> 0")


def label_integrity(labelled: DataFrame, spec: PanelSpec, min_run: int) -> DataFrame:
    """Counts of impossible label states; all zero on a sound table."""
    q, y, e = F.col(spec.qualifying), F.col(spec.label), F.col("event_id")
    rows = labelled.agg(F.count_if((y == 1) & (q != 1)).alias("label_not_qualifying"),
                        F.count_if((y == 1) & (e <= 0)).alias("label_without_event"),
                        F.count_if((y == 0) & (e > 0)).alias("event_without_label"))
    events = labelled.filter("event_id > 0").groupBy(spec.entity, "event_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("event_length").alias("_len"))
    sizes = events.agg(F.count_if(F.col("_n") < min_run).alias("too_short"),
                       F.count_if(F.col("_n") != F.col("_len")).alias("wrong_length"))
    return rows.withColumn("_s", sizes.select(F.struct("too_short", "wrong_length")).scalar()).select(
        *rows.columns, "_s.too_short", "_s.wrong_length")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive checksum of a table: equal before and after a job that must not touch it.

    The first 15 hex digits of each row's MD5 are summed, so any engine can check it.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").cast("string").alias("checksum"))


def checklist(df: DataFrame, spec: PanelSpec, contract: list[str], low: int, high: int) -> DataFrame:
    """Final pass/fail table of the model input, from two aggregations. Contract columns that are absent fail
    ``feature_count`` (its value is how many are present); the others are still checked."""
    present = [c for c in contract if c in df.columns]
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in present], F.lit(False))
    good = F.coalesce(F.col(spec.target).isin(0, 1), F.lit(False)) if spec.target in df.columns else F.lit(False)
    per_key = df.groupBy(spec.entity, spec.date).agg(
        F.count(F.lit(1)).alias("_n"), F.max(null).alias("_null"), F.max(~good).alias("_bad"))
    facts = per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") > 1).alias("dup"),
                        F.count_if(F.col("_null")).alias("nulls"), F.count_if(F.col("_bad")).alias("bad"))
    entries = [("row_count_in_range", F.col("rows").between(low, high), F.col("rows")),
               ("unique_keys", F.col("dup") == 0, F.col("dup")), ("complete_features", F.col("nulls") == 0, F.col("nulls")),
               ("binary_target", F.col("bad") == 0, F.col("bad")),
               ("feature_count", F.lit(len(present) == len(contract)), F.lit(len(present)).cast("bigint"))]
    rows = [F.struct(F.lit(n).alias("check"), ok.alias("ok"), v.cast("bigint").alias("value")) for n, ok, v in entries]
    return facts.select(F.inline(F.array(*rows)))


def leakage(df: DataFrame, spec: PanelSpec, cutoffs: Column, compute, columns: list[str], history: int | None = None) -> DataFrame:
    """Recompute features on the panel cut off after sampled dates and compare row T.

    ``cutoffs`` marks the rows T to audit; each audited row gets all rows of its entity up
    to T as a separate group, or the last ``history`` ones if no feature looks back
    further. The cost is audited rows x history. ``compute(panel, keys)`` builds the features for a frame whose entity
    column is replaced by the (entity, T) pair. A difference means the feature at T
    depends on later rows.
    """
    ahead = _order(spec).rowsBetween(0, Window.unboundedFollowing if history is None else history - 1)
    # each row learns which audited dates have it in their history: a short list of dates
    cuts = F.collect_list(F.when(cutoffs, F.col(spec.date))).over(ahead)
    own = [c for c in df.columns if c != spec.entity]
    cut = df.withColumn("_cuts", cuts).withColumn("_t", F.explode("_cuts")).select(
        F.struct(F.col(spec.entity).alias("e"), F.col("_t").alias("t")).alias(spec.entity), *own)
    at_t = compute(cut).filter(F.col(spec.date) == F.col(f"{spec.entity}.t"))
    seen = at_t.select(F.col(f"{spec.entity}.e").alias(spec.entity), spec.date, *[F.col(c).alias(f"_cut_{c}") for c in columns])
    both = compute(df).select(spec.entity, spec.date, *columns).join(seen, [spec.entity, spec.date])
    close = lambda c: F.col(c).eqNullSafe(F.col(f"_cut_{c}")) | (F.abs(F.col(c) - F.col(f"_cut_{c}")) < 1e-9)
    entries = [F.struct(F.lit(c).alias("column"), F.count_if(~F.coalesce(close(c), F.lit(False))).alias("differences"),
                        F.count(F.lit(1)).alias("audited")) for c in columns]
    return both.agg(F.array(*entries).alias("_r")).select(F.inline("_r"))
