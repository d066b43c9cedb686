"""Bootstrap intervals.

The resampling itself is numpy on bounded batches; Spark spreads the rows, adds
the partial sums per draw and ranks the scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daystrata.functions.scalar import ratio
from daystrata.operators.metrics import rates
from daystrata.operators.prefix import with_bucket
from daystrata.operators.splits import hash_index
from daystrata.spec import PanelSpec

METRICS = ("f1", "precision", "recall", "brier")


def slots_in_range(seed: int, draw: int, rows: int, width: int, block: int) -> int:
    """How many of the ``rows`` picks of a draw fall into a block of ``width`` positions.

    Halving the range and drawing a binomial at each split gives the blocks jointly
    multinomial counts that add up to ``rows``, and every task can compute its own
    count without seeing the others.
    """
    low, high, picks = 0, -(-rows // width), rows
    while high - low > 1 and picks:
        mid = (low + high) // 2
        left = (mid - low) * width
        whole = min(high * width, rows) - low * width
        part = np.random.default_rng([seed, draw, low, high]).binomial(picks, left / whole)
        low, high, picks = (low, mid, part) if block < mid else (mid, high, picks - part)
    return int(picks)


def draw_sums(df: DataFrame, key: Column, threshold: float, draws: int, seed: int, width: int = 65536) -> DataFrame:
    """Confusion counts and squared error per draw of n rows with replacement."""
    rows = df.filter(F.col("p").isNotNull() & F.col("label").isNotNull()).select(
        key.cast("bigint").alias("_key"), F.col("label").cast("int").alias("label"), "p")
    placed = hash_index(rows, "_key", seed, "_at").withColumn("_n", rows.agg(F.count(F.lit(1))).scalar())

    def resample(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_at")
        y, p = block["label"].to_numpy(), block["p"].to_numpy()
        n, number = int(block["_n"].iloc[0]), int(block["_at"].iloc[0]) // width
        hit = p >= threshold
        cells = np.stack([(y == 1) & hit, (y == 0) & hit, (y == 0) & ~hit, (y == 1) & ~hit, (p - y) ** 2]).astype(float)
        out = []
        for d in range(draws):
            k = slots_in_range(seed, d, n, width, number)
            picks = np.random.default_rng([seed, d, number]).integers(0, len(y), k)
            out.append(cells @ np.bincount(picks, minlength=len(y)))
        sums = pd.DataFrame(out, columns=["tp", "fp", "tn", "fn", "se"])
        return sums.assign(draw=range(draws))[["draw", "tp", "fp", "tn", "fn", "se"]]

    parts = placed.groupBy(F.floor(F.col("_at") / width).alias("_block")).applyInPandas(
        lambda pdf: resample(pdf), "draw int, tp double, fp double, tn double, fn double, se double")
    return parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "se")])


def iid_interval(df: DataFrame, key: Column, threshold: float, draws: int = 500, seed: int = 42) -> DataFrame:
    """95 % percentile interval of F1, precision, recall and Brier; one-class draws are skipped."""
    d = rates(draw_sums(df, key, threshold, draws, seed))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    d = d.withColumn("brier", F.col("se") / n).filter("tp + fn > 0 AND fp + tn > 0")
    long = d.select("draw", *[F.round(m, 4).alias(m) for m in METRICS]).unpivot(["draw"], list(METRICS), "metric", "value")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("metric").agg(F.round(q[0], 4).alias("lower"), F.round(q[1], 4).alias("upper"),
                                      F.count(F.lit(1)).alias("draws"))


#: Rows of one score range, and draws that a task weighs at once.
RANGE_ROWS, DRAWS_AT_ONCE = 20_000, 50


def _block_weights(part: pd.DataFrame, size: int, draws: range, seed: int) -> np.ndarray:
    """How often each row is in a draw (draws down, rows across).

    A draw takes max(1, n // size) blocks of consecutive rows of every entity, cut at its end. Their starts follow from
    seed, draw and entity alone, so any task knows the weight of any row.
    """
    out = np.zeros((len(draws), len(part)), np.int64)
    at, n, own = (part[c].to_numpy(np.int64) for c in ("_at", "_n", "_seed"))
    for e in np.unique(own):
        mine = np.flatnonzero(own == e)
        rows = int(n[mine[0]])
        for i, d in enumerate(draws):
            starts = np.sort(np.random.default_rng([seed, d, int(e)]).integers(0, rows, max(1, rows // size)))
            out[i, mine] = np.searchsorted(starts, at[mine], "right") - np.searchsorted(starts, at[mine] - size, "right")
    return out


def block_metrics(df: DataFrame, spec: PanelSpec, p: str, threshold: float, size: int, draws: int, seed: int) -> DataFrame:
    """(draw, f1, average_precision) of the score ``p`` under block resampling; draws without positives are left out.

    Rows are cut into score ranges once. Every range adds up its weights for each draw; with the sums of the ranges above,
    it then knows its share of the average precision. Only sums are shuffled: ranges x draws rows, no resampled row.
    """
    own = Window.partitionBy(spec.entity).orderBy(spec.date)  # at most a calendar
    rows = df.filter(F.col("p_ref").isNotNull() & F.col("p_cmp").isNotNull() & F.col("label").isNotNull()).select(
        F.col("label").cast("int").alias("label"), F.col(p).alias("p"), F.abs(F.xxhash64(spec.entity)).alias("_seed"),
        (F.row_number().over(own) - 1).cast("bigint").alias("_at"), F.count(F.lit(1)).over(Window.partitionBy(spec.entity)).alias("_n"))
    rows = with_bucket(rows, "p", buckets=max(2, -(-rows.count() // RANGE_ROWS)))

    def chunks():
        return (range(d, min(d + DRAWS_AT_ONCE, draws)) for d in range(0, draws, DRAWS_AT_ONCE))

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        y, hit = part["label"].to_numpy() == 1, part["p"].to_numpy() >= threshold
        cells = np.stack([y, ~y, y & hit, ~y & hit]).astype(np.int64)
        found = [_block_weights(part, size, c, seed) @ cells.T for c in chunks()]
        out = pd.DataFrame(np.concatenate(found), columns=["pos", "neg", "tp", "fp"]).assign(draw=range(draws), _bucket=part["_bucket"].iloc[0])
        return out[["_bucket", "draw", "pos", "neg", "tp", "fp"]]

    def area(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p", ascending=False)
        score, y = part["p"].to_numpy(), part["label"].to_numpy() == 1
        last = np.append(np.flatnonzero(np.diff(score)), len(score) - 1) if len(score) else np.empty(0, np.int64)
        above = above.sort_values("draw")
        parts = []
        for c in chunks():
            w = _block_weights(part, size, c, seed)
            tp, all_ = np.cumsum(w * y, axis=1)[:, last], np.cumsum(w, axis=1)[:, last]  # ties are one step
            step = np.diff(tp, axis=1, prepend=0)
            tp = tp + above["tp0"].to_numpy()[c.start:c.stop, None]
            all_ = all_ + (above["tp0"] + above["fp0"]).to_numpy()[c.start:c.stop, None]
            parts.append((step * tp / np.maximum(all_, 1)).sum(axis=1))
        return pd.DataFrame({"draw": range(draws), "area": np.concatenate(parts)})

    totals = rows.groupBy("_bucket").applyInPandas(sums, "_bucket double, draw int, pos bigint, neg bigint, tp bigint, fp bigint")
    higher = Window.partitionBy("draw").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    above = totals.select("_bucket", "draw", F.coalesce(F.sum("pos").over(higher), F.lit(0)).alias("tp0"), F.coalesce(F.sum("neg").over(higher), F.lit(0)).alias("fp0"))
    shares = rows.groupBy("_bucket").cogroup(above.groupBy("_bucket")).applyInPandas(area, "draw int, area double")
    counts = totals.groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("pos", "tp", "fp")])
    f1 = ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos"))
    return (counts.join(shares.groupBy("draw").agg(F.sum("area").alias("area")), "draw").filter("pos > 0")
            .select("draw", f1.alias("f1"), (F.col("area") / F.col("pos")).alias("average_precision")))


def paired_block_interval(df: DataFrame, spec: PanelSpec, size: int = 14, draws: int = 1000, seed: int = 42,
                          threshold_ref: float = 0.70, threshold_cmp: float = 0.50) -> DataFrame:
    """Interval of the F1 and average-precision difference (cmp - ref) under block resampling; both scores see the same draws."""
    def side(name: str, threshold: float) -> DataFrame:
        m = block_metrics(df, spec, f"p_{name}", threshold, size, draws, seed)
        return m.select("draw", F.col("f1").alias(f"f1_{name}"), F.col("average_precision").alias(f"ap_{name}"))

    d = side("ref", threshold_ref).join(side("cmp", threshold_cmp), "draw").select(
        "draw", (F.col("f1_cmp") - F.col("f1_ref")).alias("f1"), (F.col("ap_cmp") - F.col("ap_ref")).alias("pr_auc"))
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return (d.unpivot(["draw"], ["f1", "pr_auc"], "metric", "value").filter("value IS NOT NULL").groupBy("metric")
            .agg(F.round(F.avg("value"), 5).alias("mean_diff"), F.round(q[0], 5).alias("lower"),
                 F.round(q[1], 5).alias("upper"), F.count(F.lit(1)).alias("draws"))
            .withColumn("includes_zero", (F.col("lower") <= 0) & (F.col("upper") >= 0)))


def ensemble(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population spread of the score over runs, per row."""
    return df.groupBy(*keys).agg(F.avg("p").alias("p"), F.stddev_pop("p").alias("spread"), F.count("p").alias("runs"))


def mean_threshold(runs: DataFrame) -> DataFrame:
    """The decision threshold of an ensemble: the mean of the runs' own ones (a table with one ``threshold`` per run)."""
    return runs.agg(F.avg("threshold").alias("threshold"), F.count("threshold").alias("runs"))


def ensemble_spread(rows: DataFrame) -> DataFrame:
    """Average and 95th percentile of the row spreads."""
    from daystrata.operators.prefix import exact_quantiles
    p95 = exact_quantiles(rows, "spread", {"p95": 0.95}).scalar()
    return rows.agg(F.avg("spread").alias("mean_spread"), F.count(F.lit(1)).alias("n")).withColumn("p95_spread", p95)
