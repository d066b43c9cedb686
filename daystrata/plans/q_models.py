"""Queries: model training, scoring and explanation; sources; streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from daystrata.functions.scalar import mix_sql
from daystrata.operators import features as ft
from daystrata.operators import metrics as mt
from daystrata.operators import ml
from daystrata.operators import splits as sp
from daystrata.plans import panels
from daystrata.plans.bindings import SCHEMAS, SUPPLIER, events_daily, supplier_daily, table
from daystrata.plans.registry import query
from daystrata.spec import DECISION_THRESHOLD
from daystrata.sources import files as fs
from daystrata.streaming import live as lv

INPUTS = ["v", "departure", "qualifying", "v_lag1", "v_roll7_mean", "departure_zscore", "month_sin", "month_cos", "is_coastal"]


#: Trees of the models that only serve a report (importances, explanations, folds, grid); H2 and H3 use the full settings.
REPORT_TREES, GRID_TREES, GRID_ROUNDS = 100, 30, 10
#: Rows of a task of the boosting, at least.
BOOSTED_ROWS = 25_000


def _key():
    return F.col("entity") * 100000 + F.unix_date("date")


def _model_rows(spark, sf):
    # training reads its rows many times: write them once
    return fs.materialise(panels.splits_by_year(ft.trim(panels.featured(spark, sf))).select(
        "entity", "date", "split", "target", "label_lag1", *INPUTS), "features")


def _dealt(rows):
    # a fit reads its rows many times: write them once, in even shares of all cores
    return fs.materialise(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "entity", "date"), "dealt")


def _train_test(spark, sf):
    """All rows of the training years and all of the test years."""
    rows = _model_rows(spark, sf)
    return _dealt(rows.filter("split = 'train'")), rows.filter("split = 'test'")


# What holds for any sound model: every row scored once, probabilities in [0, 1], labels at the threshold, and a ranking that
# is better than chance (the average precision of a random order is the share of positives).
CHECKS = "rows:i keys:i outside:i mislabelled:i better:b"
_ROWS = "SELECT {0} FROM trimmed WHERE year(date) {1}"
_CHECK_SQL = _ROWS.format("count(*) AS rows, sum(entity * 100000 + (date - DATE '1970-01-01')) AS keys, 0 AS outside, 0 AS mislabelled, TRUE AS better",
                          "> 2000")


def _checked(scored):
    scored = fs.materialise(scored.select(_key().alias("key"), F.col("target").alias("label"), "p", "prediction_label"), "scores")
    ap = mt.rank_metrics(scored.select("label", "p")).select("average_precision").scalar()
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("key").alias("keys"), F.count_if(~F.coalesce(F.col("p").between(0, 1), F.lit(False))).alias("outside"),
        F.count_if((F.col("p") >= DECISION_THRESHOLD).cast("int") != F.col("prediction_label")).alias("mislabelled"),
        F.avg("label").alias("share")).withColumn("better", ap > F.col("share"))


@query("h1_h4_logistic", CHECKS, _CHECK_SQL, ("trimmed",))
def _(spark, sf):
    tr, te = _train_test(spark, sf)
    scaler = ft.fit_scaler(tr, INPUTS)
    n = tr.count()
    model = ml.train(ft.apply_scaler(tr, scaler, INPUTS), INPUTS, ml.logistic(1.0 / n))
    return _checked(ml.score(model, ft.apply_scaler(te, scaler, INPUTS)))


@query("h2_h5_forest", CHECKS, _CHECK_SQL, ("trimmed",))
def _(spark, sf):
    tr, te = _train_test(spark, sf)
    model = ml.train(sp.add_weights(tr, "target"), INPUTS, ml.forest(weight="weight"))
    ml.score_table(model, te, path := fs.scratch_folder(spark, "scores"), ["entity", "date", "target"])
    return _checked(spark.read.parquet(path))


@query("h3_boosting", CHECKS, _CHECK_SQL, ("trimmed",))
def _(spark, sf):
    tr, te = _train_test(spark, sf)
    # hundreds of short jobs, one after the other: few tasks each where rows are few
    tasks = min(spark.sparkContext.defaultParallelism, max(2, tr.count() // BOOSTED_ROWS))
    return _checked(ml.score(ml.train(tr.coalesce(tasks), INPUTS, ml.boosted()), te))


_GRID_SETS = {"today": INPUTS[:3], "all": INPUTS}


@query("h6_experiment_grid", "model:s features:s strategy:s rows:i positives:i bounded:b", """
    SELECT m AS model, f AS features, s AS strategy, n AS rows, pos AS positives, TRUE AS bounded
    FROM (SELECT count(*) AS n, count(*) FILTER (target = 1) AS pos FROM trimmed WHERE year(date) = 2000),
         (SELECT unnest(['logistic', 'forest', 'boosted']) AS m), (SELECT unnest(['today', 'all']) AS f), (SELECT unnest(['plain', 'under', 'weighted']) AS s)""",
       ("trimmed",))
def _(spark, sf):
    rows = _model_rows(spark, sf)
    grid = ml.experiment_grid(
        _dealt(rows.filter("split = 'train'")), rows.filter("split = 'val'"), _GRID_SETS,
        {"logistic": lambda: ml.logistic(1e-4, "weight"), "forest": lambda: ml.forest(GRID_TREES, 10, weight="weight"),
         "boosted": lambda: ml.boosted(GRID_ROUNDS, 5, "weight")},
        {"plain": lambda d: d.withColumn("weight", F.lit(1.0)), "under": lambda d: sp.undersample(d, "target", _key(), 2).withColumn("weight", F.lit(1.0)),
         "weighted": lambda d: sp.add_weights(d, "target")})
    unit = [F.col(c).between(0, 1) for c in ("f1", "precision", "recall", "average_precision")]
    return grid.withColumns({"rows": F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), "positives": F.col("tp") + F.col("fn"),
                             "bounded": unit[0] & unit[1] & unit[2] & unit[3]})


@query("h8_rule_baselines", "entity:i date:d p_persistence:f p_rule:f", """
    SELECT entity, date, coalesce(label_lag1, 0) AS p_persistence, qualifying AS p_rule FROM featured""", ("featured",))
def _(spark, sf):
    return ml.rule_baselines(panels.featured(spark, sf), "label_lag1", "qualifying")


def _forest(tr):
    return ml.train(tr, INPUTS, ml.forest(REPORT_TREES, 10))


_FEATURES = "(SELECT unnest([" + ", ".join(f"'{c}'" for c in INPUTS) + "]) AS feature)"


@query("h9_importances", "feature:s ranked:b total:f", f"SELECT feature, TRUE AS ranked, 1.0 AS total FROM {_FEATURES}")
def _(spark, sf):
    r = ml.importances(_forest(_train_test(spark, sf)[0]), INPUTS)
    order = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    return r.select("feature", (F.col("rank") == F.row_number().over(order)).alias("ranked"), F.sum("importance").over(Window.partitionBy()).alias("total"))


@query("h10_row_explanations", "entity:i date:d n:i own_values:b in_order:b", _ROWS.format(
    "entity, date, 5 AS n, TRUE AS own_values, TRUE AS in_order", "> 2000"), ("trimmed",))
def _(spark, sf):
    tr, te = _train_test(spark, sf)
    e = ml.row_explanations(te, ml.importances(_forest(tr), INPUTS), ["entity", "date"], INPUTS).join(te, ["entity", "date"])
    own = F.create_map(*[x for c in INPUTS for x in (F.lit(c), F.col(c).cast("double"))])
    x = F.col("explanation")
    return e.select("entity", "date", F.size(x).alias("n"), F.forall(x, lambda i: i["value"].eqNullSafe(own[i["feature"]])).alias("own_values"),
                    (F.transform(x, lambda i: i["rank"]) == F.sequence(F.lit(1), F.lit(5))).alias("in_order"))


@query("h11_permutation_importance", "feature:s possible:b", f"SELECT feature, TRUE AS possible FROM {_FEATURES}")
def _(spark, sf):
    tr, te = _train_test(spark, sf)
    drops = ml.permutation_importance(_forest(tr), te, _key(), INPUTS)
    return drops.select("feature", F.col("drop").between(-1, 1).alias("possible"))


@query("h11_permuted_column", "doc_id:i n_chars:i moved:i", f"""
    WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY {mix_sql('doc_id')}, doc_id) - 1 AS slot, count(*) OVER () AS n FROM documents)
    SELECT r.doc_id, r.n_chars, o.n_chars AS moved FROM r JOIN r o ON (o.slot * 7 + 5) % r.n = r.slot""")
def _(spark, sf):
    slotted = fs.materialise(sp.hash_index(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 42, "_slot"), "slots")
    return ml.permuted(slotted, slotted.count(), ["n_chars"], (7, 5)).select("doc_id", "n_chars", F.col("_moved_n_chars").alias("moved"))


@query("g7_fold_report", "fold:i rows:i positives:i", f"""
    WITH x AS (SELECT target, row_number() OVER (ORDER BY date, entity) - 1 AS pos, count(*) OVER () AS n FROM trimmed),
    f AS (SELECT target, least(3, CASE WHEN pos < n - 3 * (n // 4) THEN 0 ELSE (pos - (n - 3 * (n // 4))) // (n // 4) + 1 END) AS fold FROM x)
    SELECT fold, count(*) AS rows, count(*) FILTER (target = 1) AS positives FROM f WHERE fold > 0 GROUP BY 1""", ("trimmed",))
def _(spark, sf):
    rows = sp.time_folds(_model_rows(spark, sf), SUPPLIER)
    report = ml.folds_report(rows, 3, INPUTS, lambda: ml.forest(REPORT_TREES // 2, 10, keep_nodes=True), 0.5)
    return report.withColumns({"rows": F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), "positives": F.col("tp") + F.col("fn")})


# ---- sources ---------------------------------------------------------------------------------


@query("a5_payload_rows", "entity:i date:d v:f qty:f", """
    SELECT entity, date, v, qty FROM (SELECT *, count(*) OVER (PARTITION BY entity, year(date), quarter(date)) AS k FROM supplier_daily)
    WHERE k BETWEEN 20 AND 60""", ("supplier_daily",))
def _(spark, sf):
    chunk = F.year("date") * 10 + F.quarter("date")
    texts = fs.payload_of(supplier_daily(spark, sf), "entity", "date", ["v", "qty"], chunk)
    return fs.payload_rows(fs.parse_payloads(texts, "payload", ["v", "qty"], (20, 60)), ["entity"], ["v", "qty"])


@query("a6_payload_guard", "entity:i chunk:i", """
    SELECT entity, year(date) * 10 + quarter(date) AS chunk FROM supplier_daily GROUP BY 1, 2 HAVING count(*) NOT BETWEEN 20 AND 60""",
       ("supplier_daily",))
def _(spark, sf):
    chunk = F.year("date") * 10 + F.quarter("date")
    texts = fs.payload_of(supplier_daily(spark, sf), "entity", "date", ["v", "qty"], chunk)
    return fs.rejected_payloads(fs.parse_payloads(texts, "payload", ["v", "qty"], (20, 60)))


@query("a3_b8_combine", "source:s n:i", """
    SELECT 'orders' AS source, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def _(spark, sf):
    o = fs.with_metadata(table(spark, sf, "orders").select("o_orderkey"), {"source": "orders"})
    li = fs.with_metadata(table(spark, sf, "lineitem").select("l_orderkey"), {"source": "lineitem"})
    return fs.combine([o, li]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ---- live and streaming ----------------------------------------------------------------------


@query("l1_l3_newest_features", "entity:i date:d v:f v_lag7:f v_roll7_mean:f departure_zscore:f label_lag1:i", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS back,
                 coalesce(lag(qualifying) OVER (PARTITION BY entity ORDER BY date), 0) AS live_lag FROM featured)
    SELECT entity, date, v, v_lag7, v_roll7_mean, departure_zscore, live_lag AS label_lag1 FROM r WHERE back <= 7""", ("featured",))
def _(spark, sf):
    return lv.newest_features(panels.qualified(spark, sf), SUPPLIER)


@query("l2_l4_forecast_rows", "entity:i date:d kind:s horizon:i", """
    WITH f AS (SELECT entity, date, v, row_number() OVER (PARTITION BY entity ORDER BY date) - 1 AS horizon FROM supplier_daily
               WHERE date >= DATE '2001-10-20')
    SELECT entity, date, CASE WHEN date > DATE '2001-10-20' THEN 'forecast' ELSE 'today' END AS kind, horizon FROM f WHERE v <= 90""",
       ("supplier_daily",))
def _(spark, sf):
    f = lv.forecast_rows(supplier_daily(spark, sf), SUPPLIER, "2001-10-20")
    return lv.loggable(f.withColumn("probability", F.when(F.col("v") <= 90, F.col("v") / 100)))


@query("l13_stream_daily_totals", "user_id:i date:d total:f n:i", """
    SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS total, count(*) AS n FROM events GROUP BY 1, 2""")
def _(spark, sf):
    s = lv.file_stream(spark, sf, SCHEMAS["events"].replace("timestamp_ntz", "timestamp"), pattern="events.parquet")
    out, ckpt = fs.scratch_folder(spark, "totals"), fs.scratch_folder(spark, "totals-state")
    lv.upsert_batches(lv.daily_totals(s, ["user_id"], "ts", F.col("value"), "40 days"), out, ckpt)
    return lv.latest(spark.read.parquet(out), ["user_id", "date"])


@query("l12_stream_dedupe", "entity:i date:d", """
    SELECT DISTINCT user_id AS entity, CAST(ts AS DATE) AS date FROM events""")
def _(spark, sf):
    s = lv.file_stream(spark, sf, SCHEMAS["events"].replace("timestamp_ntz", "timestamp"), pattern="events.parquet")
    days = s.select(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), "ts")
    out, ckpt = fs.scratch_folder(spark, "dedupe"), fs.scratch_folder(spark, "dedupe-state")
    lv.upsert_batches(lv.deduplicated(days, ["entity", "date"], "ts", "40 days"), out, ckpt, mode="append")
    return spark.read.parquet(out).select("entity", "date")
