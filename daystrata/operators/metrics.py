"""Binary-classifier metrics over (group..., label, p) tables.

Threshold metrics are one aggregation. Rank metrics collapse equal scores first
and then use bucketed running sums, so a group of any size stays distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daystrata.functions.scalar import ratio
from daystrata.operators.prefix import exact_quantiles, running_sums, stored, with_bucket


def confusion(label: Column, positive: Column) -> list[Column]:
    y = label == 1
    return [F.count_if(y & positive).alias("tp"), F.count_if(~y & positive).alias("fp"),
            F.count_if(~y & ~positive).alias("tn"), F.count_if(y & ~positive).alias("fn")]


def rates(df: DataFrame, beta: float = 2.0) -> DataFrame:
    """Precision, recall, F1, F-beta and accuracy from tp, fp, tn, fn (0 on zero division)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    b2 = beta * beta
    return df.withColumns({
        "precision": ratio(tp * 1.0, tp + fp), "recall": ratio(tp * 1.0, tp + fn),
        "f1": ratio(2.0 * tp, 2 * tp + fp + fn), "fbeta": ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp),
        "accuracy": ratio((tp + tn) * 1.0, tp + fp + tn + fn),
        "predicted_positives": tp + fp, "actual_positives": tp + fn})


def threshold_metrics(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    known = df.filter(F.col("p").isNotNull() & F.col("label").isNotNull())
    return rates(known.groupBy(*(by or [])).agg(*confusion(F.col("label"), F.col("p") >= threshold)))


def rank_table(df: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Per distinct score, from high to low: own and running positives and negatives, and
    the position of the score."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    # a filter on the score would be computed beside it, which scores twice: null scores are one row of each group
    tied = df.filter(F.col("label").isNotNull()).groupBy(*by, "p").agg(
        F.sum((F.col("label") * w).cast("bigint")).alias("pos"), F.sum(((1 - F.col("label")) * w).cast("bigint")).alias("neg"))
    # stored: the passes that cut buckets, and those over the result, do not score or scan again
    return running_sums(with_bucket(stored(tied).filter("p IS NOT NULL"), "p"), [F.desc("p")],
                        {"tp": F.col("pos"), "fp": F.col("neg"), "point": F.lit(1)}, by, descending=True).drop("_bucket")


def rank_metrics(df: DataFrame, by: list[str] | None = None, weight: str | None = None,
                 threshold: float | None = None) -> DataFrame:
    """Average precision (step sum) and ROC area (ties count half); NULL with one class.

    With a ``threshold`` the F1 there comes from the same pass.
    """
    by = by or []
    t = rank_table(df, by, weight)
    ap = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    # positives of a tie beat the negatives below it and half of those in it
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") * 0.5)
    p, n = F.sum("pos"), F.sum("neg")
    both = (p > 0) & (n > 0)
    extra = []
    if threshold is not None:
        above = F.col("p") >= threshold
        hits, called = F.sum(F.when(above, F.col("pos")).otherwise(0)), F.sum(F.when(above, F.col("pos") + F.col("neg")).otherwise(0))
        extra.append(ratio(2.0 * hits, called + p).alias("f1"))
    return t.groupBy(*by).agg(*extra, p.alias("positives"), n.alias("negatives"),
                              F.when(both, ap / F.when(p > 0, p)).alias("average_precision"),
                              F.when(both, wins / F.when(both, p * n)).alias("roc_auc"))


#: Scores that are packed together: of positive and of negative rows, between two cuts.
PACKED = "bucket int, positives bigint, negatives bigint, pos binary, neg binary"


def pack_scores(label: np.ndarray, p: np.ndarray, cuts: np.ndarray) -> Iterator[tuple]:
    """Rows of ``PACKED``: the scores cut into buckets from low to high."""
    sides = [np.sort(p[label == 1]), np.sort(p[label == 0])]
    at = [np.concatenate([[0], np.searchsorted(s, cuts, side="right"), [len(s)]]) for s in sides]
    for b in range(len(cuts) + 1):
        pos, neg = (s[i[b]:i[b + 1]] for s, i in zip(sides, at))
        if len(pos) or len(neg):
            yield b, len(pos), len(neg), pos.tobytes(), neg.tobytes()


def packed_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Average precision (as in ``rank_metrics``) of each group of ``by`` (integers) from packed scores, which are read twice: for
    the totals of the buckets, and for the sums inside them."""
    totals = df.groupBy(*by, "bucket").agg(F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "bucket", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("tp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("fp"))

    def part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pos, neg = (np.frombuffer(b"".join(rows[c]), np.float64) for c in ("pos", "neg"))
        score, n = np.unique(pos, return_counts=True)
        score, n = score[::-1], n[::-1]  # from high to low; only scores of positives count
        tp = rows["tp"].iloc[0] + n.cumsum()
        fp = rows["fp"].iloc[0] + len(neg) - np.searchsorted(np.sort(neg), score, side="left")
        return pd.DataFrame([(*key[:-1], float((n * (tp / (tp + fp))).sum()))], columns=[*by, "_part"])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    parts = df.join(offsets, [*by, "bucket"]).groupBy(*by, "bucket").applyInPandas(part, ", ".join([*(f"{c} {types[c]}" for c in by), "_part double"]))
    sizes = totals.groupBy(*by).agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    ap = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_sum") / F.col("_p"))
    return parts.groupBy(*by).agg(F.sum("_part").alias("_sum")).join(sizes, by).select(*by, ap.alias("average_precision"))


def curve_points(df: DataFrame, keep: int = 200, by: list[str] | None = None) -> DataFrame:
    """ROC and precision-recall points, one per distinct score, thinned to every
    max(1, n // keep)-th point in descending score order."""
    by = by or []
    numbered = rank_table(df, by)
    size = numbered.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"), F.count(F.lit(1)).alias("_k"))
    if by:
        x = numbered.join(size, by)
    else:
        x = numbered.withColumn("_s", size.select(F.struct("_P", "_N", "_k")).scalar()).select("*", "_s.*")
    step = F.greatest(F.lit(1), F.expr(f"_k div {keep}"))
    return x.filter((F.col("point") - 1) % step == 0).select(
        *by, F.col("p").alias("threshold"), ratio(F.col("fp") * 1.0, F.col("_N"), None).alias("fpr"),
        ratio(F.col("tp") * 1.0, F.col("_P"), None).alias("tpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def nearest_point(points: DataFrame, threshold: float) -> DataFrame:
    """The curve point whose threshold is closest (the smaller one on ties)."""
    order = F.struct(F.abs(F.col("threshold") - threshold).alias("d"), F.col("threshold"))
    return points.agg(*[F.min_by(c, order).alias(c) for c in ("threshold", "fpr", "tpr", "precision")])


def brier(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))).alias("brier"))


def calibration_error(df: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error over fixed bins, the last one closed, missing scores dropped."""
    by = by or []
    edges = [i * (1.0 / bins) for i in range(bins)]
    known = df.filter(F.col("p").isNotNull() & ~F.isnan("p") & F.col("p").between(0, 1))
    spot = reduce(lambda a, b: a + b, [(F.col("p") >= e).cast("int") for e in edges])
    cells = known.groupBy(*by, spot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("rate"))
    return cells.groupBy(*by).agg(
        (F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def calibration_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """Quantile bins: mean score and positive rate of the non-empty ones."""
    names = {f"q{i}": i / bins for i in range(1, bins)}  # the inner edges decide the bin
    edges = exact_quantiles(df, "p", names).select(F.array_distinct(F.array(*names)).alias("e")).scalar()
    spot = F.size(F.filter(F.col("_edges"), lambda e: e < F.col("p")))
    placed = df.filter(F.col("p").isNotNull()).withColumn("_edges", edges)
    return placed.groupBy(spot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("rate"))


def sweep(df: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Threshold table in one scan: a row adds to the count of thresholds it passes,
    and a running sum over that (at most len + 1) cell turns cells into confusion counts."""
    by = by or []
    levels = sorted(thresholds)
    passed = reduce(lambda a, b: a + b, [(F.col("p") >= t).cast("int") for t in levels])
    cells = (df.filter(F.col("p").isNotNull()).groupBy(*by, passed.alias("_k"))
             .agg(F.sum("label").alias("_p"), F.sum(1 - F.col("label")).alias("_n")))
    # one row per group holds the len + 1 cell sums; thresholds are then unrolled from it
    at = lambda col, i, above: F.sum(F.when((F.col("_k") > i) if above else (F.col("_k") <= i), F.col(col)).otherwise(0))
    entries = [F.struct(F.lit(t).alias("threshold"), at("_p", i, True).alias("tp"), at("_n", i, True).alias("fp"),
                        at("_n", i, False).alias("tn"), at("_p", i, False).alias("fn")) for i, t in enumerate(levels)]
    wide = cells.groupBy(*by).agg(F.array(*entries).alias("_rows"))
    return rates(wide.select(*by, F.inline("_rows")))


def percent_sweep(df: DataFrame, low: int, high: int, by: list[str] | None = None) -> DataFrame:
    """Threshold table of all whole percents from ``low`` to ``high``, however many, at the cost of one count.

    A row adds to the cell of the highest percent that it reaches; the (at most 102) cells of a group are then summed from
    above. The cell is settled by comparison with the thresholds themselves, as p * 100 may be rounded across one.
    """
    by = by or []
    guess = F.floor(F.col("p") * 100)
    cell = guess + (F.col("p") >= (guess + 1) / 100.0).cast("int") - (F.col("p") < guess / 100.0).cast("int")
    cells = (df.filter(F.col("p").isNotNull() & ~F.isnan("p")).groupBy(*by, F.greatest(F.least(cell, F.lit(high)), F.lit(low - 1)).cast("int").alias("_k"))
             .agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")))
    wide = cells.groupBy(*by).agg(F.collect_list(F.struct("_k", "p", "n")).alias("_cells"))

    def total(k: Column, name: str, above: bool) -> Column:
        part = F.filter("_cells", lambda c: (c["_k"] >= k) if above else (c["_k"] < k))
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda s, c: s + F.coalesce(c[name], F.lit(0)))

    rows = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.struct(
        (k / 100.0).alias("threshold"), total(k, "p", True).alias("tp"), total(k, "n", True).alias("fp"),
        total(k, "n", False).alias("tn"), total(k, "p", False).alias("fn")))
    return rates(wide.select(*by, F.inline(rows)))


def best_threshold(table: DataFrame, rule: str = "f1_precision", by: list[str] | None = None,
                   floor: float = 0.25) -> DataFrame:
    """Pick one threshold per group of a sweep table.

    f1_precision: highest F1, then precision, then the lowest threshold.
    f1_first: highest F1, the lowest threshold on ties; 0.5 where no threshold has an F1 above zero.
    recall_floor: among precision >= floor the highest recall, then F-beta, precision
    and the lowest threshold; when none qualifies, the same order over all.
    """
    low = (-F.col("threshold")).alias("t")
    order = {
        "f1_precision": F.struct("f1", "precision", low),
        "f1_first": F.struct("f1", low),
        "recall_floor": F.struct((F.col("precision") >= floor).alias("ok"), "recall", "fbeta", "precision", low),
    }[rule]
    threshold = F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.5) if rule == "f1_first" else F.col("threshold")
    keep = [threshold.alias("threshold"), "precision", "recall", "f1"]
    picked = table.groupBy(*(by or [])).agg(F.max_by(F.struct(*keep), order).alias("_b"))
    return picked.select(*(by or []), "_b.*")


def grouped_report(df: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Threshold and rank metrics per group; NULL instead of a score when there is no positive."""
    m = threshold_metrics(df, threshold, by).join(rank_metrics(df, by), by)
    hidden = {c: F.when(F.col("actual_positives") > 0, F.col(c)) for c in ("precision", "recall", "f1", "average_precision")}
    return m.withColumns(hidden)


def generalisation(val: DataFrame, test: DataFrame, key: str, names: list[str], band: float = 0.01) -> DataFrame:
    """Test minus validation per metric and a verdict on the F1 change."""
    t = test.select(key, *[F.col(n).alias(f"{n}_test") for n in names])
    v = val.select(key, *[F.col(n).alias(f"{n}_val") for n in names])
    x = t.join(v, key).withColumns({f"{n}_delta": F.round(F.col(f"{n}_test") - F.col(f"{n}_val"), 4) for n in names})
    d = F.col(f"{names[0]}_delta")
    return x.withColumn("verdict", F.when(d > band, "IMPROVED").when(d < -band, "DEGRADED").otherwise("STABLE"))


def best_configuration(table: DataFrame, key: str, order: list[str]) -> DataFrame:
    return table.agg(F.max_by(F.struct(key, *order), F.struct(*order, key)).alias("_b")).select("_b.*")


def tracked_summary(df: DataFrame) -> DataFrame:
    """Logged and matched forecasts with precision and recall; status when nothing matched."""
    seen = F.col("observed_signal").isNotNull()
    hit = (F.col("prediction") == 1) & seen
    c = df.agg(F.count(F.lit(1)).alias("logged"), F.count_if(seen).alias("matched"),
               F.count_if(hit & (F.col("observed_signal") == 1)).alias("_tp"), F.count_if(hit).alias("_pp"),
               F.count_if(F.col("observed_signal") == 1).alias("_ap"),
               F.count_if(seen & (F.col("observed_signal") == F.col("prediction"))).alias("_same"))
    some = F.col("matched") > 0
    return c.select(
        "logged", "matched", F.when(some, "available").otherwise("not_enough_data").alias("status"),
        F.when(some, F.round(ratio(F.col("_tp") * 1.0, F.col("_pp")), 4)).alias("precision"),
        F.when(some, F.round(ratio(F.col("_tp") * 1.0, F.col("_ap")), 4)).alias("recall"),
        F.when(some, F.round(ratio(F.col("_same") * 1.0, F.col("matched")), 4)).alias("proxy_accuracy"))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation of two columns with tie-averaged ranks."""
    from daystrata.operators.prefix import average_ranks
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ra = average_ranks(known, a, out="_ra").select(a, "_ra")
    rb = average_ranks(known, b, out="_rb").select(b, "_rb")
    pairs = known.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n")).join(ra, a).join(rb, b)
    # correlation of weighted pairs from power sums around the common mean rank
    m = known.agg(((F.count(F.lit(1)) + 1) / 2).alias("m")).scalar()
    x = pairs.withColumn("_m", m)
    da, db = F.col("_ra") - F.col("_m"), F.col("_rb") - F.col("_m")
    w = F.col("_n")
    return x.agg((F.sum(w * da * db) / F.sqrt(F.sum(w * da * da) * F.sum(w * db * db))).alias("rho"),
                 F.sum("_n").alias("n"))


def top_overlap(df: DataFrame, key: str, a: str, b: str, k: int = 5) -> DataFrame:
    """Keys among the k largest of both columns (two bounded top-k sorts)."""
    top = lambda c: df.orderBy(F.desc(c), key).limit(k).select(key)
    return top(a).intersect(top(b))
