"""Queries: evaluation metrics over the score tables."""

from pyspark.sql import functions as F

from daystrata.operators import metrics as mt
from daystrata.operators import resample as rs
from daystrata.plans.bindings import ORDERS, doc_scores, orders_daily, scored
from daystrata.plans.registry import query

CONF = """count(*) FILTER (label = 1 AND p >= {0}) AS tp, count(*) FILTER (label = 0 AND p >= {0}) AS fp,
    count(*) FILTER (label = 0 AND p < {0}) AS tn, count(*) FILTER (label = 1 AND p < {0}) AS fn"""
RATES = """tp, fp, tn, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1,
    CASE WHEN 5 * tp + 4 * fn + fp = 0 THEN 0 ELSE 5.0::DOUBLE * tp / (5 * tp + 4 * fn + fp) END AS fbeta,
    (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy, tp + fp AS predicted_positives, tp + fn AS actual_positives"""
RATE_COLS = ("tp:i fp:i tn:i fn:i precision:f recall:f f1:f fbeta:f accuracy:f predicted_positives:i"
             " actual_positives:i")


def _rank_sql(source: str, by: str = "") -> str:
    part, keys = (f"PARTITION BY {by} " if by else ""), (f"{by}, " if by else "")
    group = f"GROUP BY {by}" if by else ""
    return f"""
    WITH s AS (SELECT {keys} p, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY {keys} p),
    c AS (SELECT *, sum(pos) OVER ({part}ORDER BY p DESC) AS tp, sum(neg) OVER ({part}ORDER BY p DESC) AS fp FROM s)
    SELECT {keys} sum(pos) AS positives, sum(neg) AS negatives,
           CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos) END AS average_precision,
           CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos) + neg * pos * 0.5::DOUBLE)
             / (sum(pos) * sum(neg)) END AS roc_auc FROM c {group}"""


@query("i1_i3_threshold_metrics", RATE_COLS, f"SELECT {RATES} FROM (SELECT {CONF.format(0.7)} FROM scored)", ("scored",))
def _(spark, sf):
    return mt.threshold_metrics(scored(spark, sf), 0.7)


@query("i4_i5_rank_metrics", "positives:i negatives:i average_precision:f roc_auc:f", _rank_sql("scored"), ("scored",))
def _(spark, sf):
    return mt.rank_metrics(scored(spark, sf))


@query("i4_i5_tied_scores", "entity:s positives:i negatives:i average_precision:f roc_auc:f",
       _rank_sql("doc_scores", "entity"), ("doc_scores",))
def _(spark, sf):
    return mt.rank_metrics(doc_scores(spark, sf), ["entity"])


@query("i6_curve_points", "threshold:f fpr:f tpr:f precision:f", """
    WITH s AS (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY p),
    c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
            row_number() OVER (ORDER BY p DESC) AS point, count(*) OVER () AS k, sum(pos) OVER () AS tot_p,
            sum(neg) OVER () AS tot_n FROM s)
    SELECT p AS threshold, fp::DOUBLE / tot_n AS fpr, tp::DOUBLE / tot_p AS tpr, tp::DOUBLE / (tp + fp) AS precision
    FROM c WHERE (point - 1) % greatest(1, k // 200) = 0""", ("scored",))
def _(spark, sf):
    return mt.curve_points(scored(spark, sf))


@query("i7_brier", "entity:s brier:f", "SELECT entity, avg((p - label) * (p - label)) AS brier FROM scored GROUP BY 1",
       ("scored",))
def _(spark, sf):
    return mt.brier(scored(spark, sf), ["entity"])


_BINS = " + ".join(f"CASE WHEN p >= {i * 0.1!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(10))


@query("i8_calibration_error", "ece:f", f"""
    SELECT sum(n * abs(rate - mean_p)) / sum(n) AS ece FROM (
      SELECT {_BINS} AS bin, count(*) AS n, avg(p) AS mean_p, avg(label) AS rate FROM scored GROUP BY 1)""", ("scored",))
def _(spark, sf):
    return mt.calibration_error(scored(spark, sf))


@query("i9_entity_metrics", "entity:s tp:i fp:i fn:i precision:f recall:f f1:f average_precision:f", f"""
    WITH c AS (SELECT entity, {CONF.format(0.7)} FROM doc_scores GROUP BY 1), r AS (SELECT entity, {RATES} FROM c),
    k AS ({_rank_sql('doc_scores', 'entity')})
    SELECT r.entity, tp, fp, fn, CASE WHEN tp + fn > 0 THEN precision END AS precision,
           CASE WHEN tp + fn > 0 THEN recall END AS recall, CASE WHEN tp + fn > 0 THEN f1 END AS f1, average_precision
    FROM r JOIN k ON k.entity = r.entity""", ("doc_scores",))
def _(spark, sf):
    return mt.grouped_report(doc_scores(spark, sf), 0.7, ["entity"])


@query("i10_yearly_metrics", "year:i " + RATE_COLS, f"SELECT year, {RATES} FROM (SELECT year, {CONF.format(0.7)} FROM scored GROUP BY 1)",
       ("scored",))
def _(spark, sf):
    return mt.threshold_metrics(scored(spark, sf), 0.7, ["year"])


@query("i11_calibration_curve", "bin:i n:i mean_p:f rate:f", """
    WITH d AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM doc_scores)
    SELECT len(list_filter(q, lambda c: c < p)) AS bin, count(*) AS n, avg(p) AS mean_p, avg(label) AS rate
    FROM doc_scores, d GROUP BY 1""", ("doc_scores",))
def _(spark, sf):
    return mt.calibration_curve(doc_scores(spark, sf))


# Thresholds of the published sweep.
SWEEP = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9]
_GRID = f"(SELECT unnest([{', '.join(f'{t!r}::DOUBLE' for t in SWEEP)}]) AS t)"
_SWEEP_SQL = f"""
    sw AS (SELECT t AS threshold, {RATES} FROM (SELECT t, {CONF.format('t')} FROM scored, {_GRID} GROUP BY 1))"""


@query("i12_threshold_sweep", "threshold:f " + RATE_COLS, f"WITH {_SWEEP_SQL} SELECT * FROM sw", ("scored",))
def _(spark, sf):
    return mt.sweep(scored(spark, sf), SWEEP)


# The whole percents that the rules choose from.
FINE, RECALL_FIRST = (5, 94), (10, 90)


def _percent_sql(low, high, rows="scored", by=""):
    grid = f"(SELECT unnest(range({low}, {high + 1})) / 100.0::DOUBLE AS t)"
    return f"SELECT {by} t AS threshold, {RATES} FROM (SELECT {by} t, {CONF.format('t')} FROM {rows}, {grid} GROUP BY ALL)"


@query("i12_percent_sweep", "threshold:f " + RATE_COLS, _percent_sql(*FINE), ("scored",))
def _(spark, sf):
    return mt.percent_sweep(scored(spark, sf), *FINE)


@query("i13_best_threshold", "rule:s threshold:f precision:f recall:f f1:f", f"""
    WITH {_SWEEP_SQL}, fine AS ({_percent_sql(*FINE)}), rf AS ({_percent_sql(*RECALL_FIRST)}),
    a AS (SELECT 'f1_precision' AS rule, * FROM sw ORDER BY f1 DESC, precision DESC, threshold LIMIT 1),
    b AS (SELECT 'f1_first' AS rule, * FROM fine ORDER BY f1 DESC, threshold LIMIT 1),
    c AS (SELECT 'recall_floor' AS rule, * FROM rf
          ORDER BY precision >= 0.25 DESC, recall DESC, fbeta DESC, precision DESC, threshold LIMIT 1)
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""", ("scored",))
def _(spark, sf):
    rows = scored(spark, sf)
    tables = {"f1_precision": mt.sweep(rows, SWEEP), "f1_first": mt.percent_sweep(rows, *FINE), "recall_floor": mt.percent_sweep(rows, *RECALL_FIRST)}
    picks = [mt.best_threshold(t, r).withColumn("rule", F.lit(r)) for r, t in tables.items()]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


# The draws are random; what the data fix: the metrics, how many draws count, and that an interval holds the measured value.
@query("i14_bootstrap_interval", "metric:s holds:b draws:i", """
    SELECT unnest(['f1', 'precision', 'recall', 'brier']) AS metric, TRUE AS holds, 500 AS draws""")
def _(spark, sf):
    d = doc_scores(spark, sf)
    point = mt.threshold_metrics(d, 0.3).select("f1", "precision", "recall").withColumn("brier", mt.brier(d).select("brier").scalar())
    point = point.unpivot([], ["f1", "precision", "recall", "brier"], "metric", "value")
    i = rs.iid_interval(d, F.col("doc_id"), 0.3, draws=500).join(point, "metric")
    return i.select("metric", F.col("value").between(F.col("lower") - 1e-4, F.col("upper") + 1e-4).alias("holds"), "draws")


def two_models(spark, sf):
    """A daily panel with two scores for one label."""
    o = orders_daily(spark, sf)
    return o.select("entity", "date", (F.col("v") >= 270).cast("int").alias("label"),
                    (F.col("v") / (F.col("v") + 256.0)).alias("p_ref"),
                    ((F.col("v") * 0.7 + F.col("n") * 20) / (F.col("v") * 0.7 + F.col("n") * 20 + 256.0)).alias("p_cmp"))


@query("i15_block_bootstrap", "metric:s holds:b draws:i", "SELECT unnest(['f1', 'pr_auc']) AS metric, TRUE AS holds, 1000 AS draws")
def _(spark, sf):
    d = two_models(spark, sf)
    sides = []
    for name, threshold in (("ref", 0.51), ("cmp", 0.5)):
        s = d.select("label", F.col(f"p_{name}").alias("p"))
        sides.append((mt.threshold_metrics(s, threshold).select("f1").scalar(), mt.rank_metrics(s).select("average_precision").scalar()))
    (f1_ref, ap_ref), (f1_cmp, ap_cmp) = sides
    point = F.when(F.col("metric") == "f1", f1_cmp - f1_ref).otherwise(ap_cmp - ap_ref)
    i = rs.paired_block_interval(d, ORDERS, draws=1000, threshold_ref=0.51).withColumn("value", point)
    return i.select("metric", F.col("value").between(F.col("lower") - 0.01, F.col("upper") + 0.01).alias("holds"), "draws")


@query("i16_model_comparison", "model:s " + RATE_COLS, " UNION ALL ".join(
    f"SELECT '{m}' AS model, {RATES} FROM (SELECT {CONF.format(t)} FROM scored)"
    for m, t in (("strict", 0.8), ("default", 0.7), ("loose", 0.5))), ("scored",))
def _(spark, sf):
    s = scored(spark, sf)
    parts = [mt.threshold_metrics(s, t).withColumn("model", F.lit(m)) for m, t in (("strict", 0.8), ("default", 0.7), ("loose", 0.5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("i19_generalisation", "entity:s f1_delta:f recall_delta:f verdict:s", f"""
    WITH m AS (SELECT year, entity, {RATES} FROM (SELECT year, entity, {CONF.format(0.7)} FROM scored GROUP BY 1, 2)),
    d AS (SELECT v.entity, round(t.f1 - v.f1, 4) AS f1_delta, round(t.recall - v.recall, 4) AS recall_delta
          FROM m v JOIN m t ON t.entity = v.entity WHERE v.year = 1999 AND t.year = 2000)
    SELECT *, CASE WHEN f1_delta > 0.01 THEN 'IMPROVED' WHEN f1_delta < -0.01 THEN 'DEGRADED' ELSE 'STABLE' END AS verdict
    FROM d""", ("scored",))
def _(spark, sf):
    m = mt.threshold_metrics(scored(spark, sf), 0.7, ["year", "entity"])
    return mt.generalisation(m.filter("year = 1999"), m.filter("year = 2000"), "entity", ["f1", "recall"])


@query("i20_best_configuration", "year:i f1:f precision:f", f"""
    SELECT year, f1, precision FROM (SELECT year, {RATES} FROM (SELECT year, {CONF.format(0.7)} FROM scored GROUP BY 1))
    ORDER BY f1 DESC, precision DESC, year DESC LIMIT 1""", ("scored",))
def _(spark, sf):
    return mt.best_configuration(mt.threshold_metrics(scored(spark, sf), 0.7, ["year"]), "year", ["f1", "precision"])


@query("i21_nearest_point", "threshold:f fpr:f tpr:f precision:f", """
    WITH s AS (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM doc_scores GROUP BY p),
    c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
            row_number() OVER (ORDER BY p DESC) AS point, count(*) OVER () AS k, sum(pos) OVER () AS tot_p,
            sum(neg) OVER () AS tot_n FROM s)
    SELECT p AS threshold, fp::DOUBLE / tot_n AS fpr, tp::DOUBLE / tot_p AS tpr, tp::DOUBLE / (tp + fp) AS precision
    FROM c WHERE (point - 1) % greatest(1, k // 200) = 0 ORDER BY abs(p - 0.3::DOUBLE), p LIMIT 1""", ("doc_scores",))
def _(spark, sf):
    return mt.nearest_point(mt.curve_points(doc_scores(spark, sf)), 0.3)


@query("h12_rank_correlation", "rho:f n:i", """
    WITH k AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem),
    r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra,
                 rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM k)
    SELECT corr(ra, rb) AS rho, count(*) AS n FROM r""")
def _(spark, sf):
    from daystrata.plans.bindings import table
    return mt.rank_correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("h12_top_overlap", "entity:i", """
    WITH s AS (SELECT l_suppkey AS entity, sum(l_quantity) AS a, count(*) AS b FROM lineitem GROUP BY 1)
    SELECT entity FROM (SELECT entity FROM s ORDER BY a DESC, entity LIMIT 20)
    INTERSECT SELECT entity FROM (SELECT entity FROM s ORDER BY b DESC, entity LIMIT 20)""")
def _(spark, sf):
    from daystrata.plans.bindings import table
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(
        F.sum("l_quantity").alias("a"), F.count(F.lit(1)).alias("b"))
    return mt.top_overlap(s, "entity", "a", "b", 20)


_ENSEMBLE = """
    runs AS (SELECT l_orderkey, l_linenumber, p, l_orderkey % 1 AS r FROM scored UNION ALL
             SELECT l_orderkey, l_linenumber, p * 0.5, 1 FROM scored UNION ALL SELECT l_orderkey, l_linenumber, p * 0.9, 2 FROM scored),
    rows AS (SELECT l_orderkey, l_linenumber, avg(p) AS p, stddev_pop(p) AS spread, count(p) AS runs FROM runs GROUP BY 1, 2)"""


def _ensemble(spark, sf):
    s = scored(spark, sf).select("l_orderkey", "l_linenumber", "p")
    runs = s.withColumn("p", F.explode(F.array(F.col("p"), F.col("p") * 0.5, F.col("p") * 0.9)))
    return rs.ensemble(runs, ["l_orderkey", "l_linenumber"])


@query("h7_ensemble", "l_orderkey:i l_linenumber:i p:f spread:f runs:i", f"WITH {_ENSEMBLE} SELECT * FROM rows", ("scored",))
def _(spark, sf):
    return _ensemble(spark, sf)


@query("h7_ensemble_spread", "mean_spread:f n:i p95_spread:f", f"""
    WITH {_ENSEMBLE} SELECT avg(spread) AS mean_spread, count(*) AS n, quantile_cont(spread, 0.95) AS p95_spread FROM rows""",
       ("scored",))
def _(spark, sf):
    return rs.ensemble_spread(_ensemble(spark, sf))


_RUNS = """
    runs AS (SELECT l_orderkey, l_linenumber, label, p AS p, 0 AS run FROM scored UNION ALL
             SELECT l_orderkey, l_linenumber, label, p * 0.5, 1 FROM scored UNION ALL SELECT l_orderkey, l_linenumber, label, p * 0.9, 2 FROM scored)"""


def _runs(spark, sf):
    p = F.col("p")
    return scored(spark, sf).select("l_orderkey", "l_linenumber", "label", F.posexplode(F.array(p, p * 0.5, p * 0.9)).alias("run", "p"))


@query("h7_run_thresholds", "run:i threshold:f f1:f", f"""
    WITH {_RUNS}, t AS ({_percent_sql(*FINE, "runs", "run,")})
    SELECT run, CASE WHEN max(f1) > 0 THEN arg_max(threshold, (f1, -threshold)) ELSE 0.5 END AS threshold, max(f1) AS f1 FROM t GROUP BY 1""",
       ("scored",))
def _(spark, sf):
    return mt.best_threshold(mt.percent_sweep(_runs(spark, sf), *FINE, by=["run"]), "f1_first", by=["run"])


@query("h7_ensemble_at_mean_threshold", "threshold:f runs:i " + RATE_COLS, f"""
    WITH {_RUNS}, t AS ({_percent_sql(*FINE, "runs", "run,")}),
    b AS (SELECT run, CASE WHEN max(f1) > 0 THEN arg_max(threshold, (f1, -threshold)) ELSE 0.5 END AS threshold FROM t GROUP BY 1),
    m AS (SELECT avg(threshold) AS threshold, count(*) AS runs FROM b),
    e AS (SELECT avg(p) AS p, max(label) AS label FROM runs GROUP BY l_orderkey, l_linenumber)
    SELECT threshold, runs, {RATES} FROM (SELECT threshold, runs, {CONF.format('threshold')} FROM e, m GROUP BY ALL)""", ("scored",))
def _(spark, sf):
    """The ensemble judged at the mean of its runs' own thresholds."""
    runs = _runs(spark, sf)
    chosen = rs.mean_threshold(mt.best_threshold(mt.percent_sweep(runs, *FINE, by=["run"]), "f1_first", by=["run"]))
    rows = runs.groupBy("l_orderkey", "l_linenumber").agg(F.avg("p").alias("p"), F.max("label").alias("label"))
    judged = rows.withColumn("t", chosen.select("threshold").scalar())
    counts = judged.agg(*mt.confusion(F.col("label"), F.col("p") >= F.col("t")))
    return mt.rates(counts).join(chosen, F.lit(True))  # one row each
