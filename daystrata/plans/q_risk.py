"""Queries: drift, risk, rules, batch analysis, alerts, tracked outcomes."""

from pyspark.sql import functions as F

from daystrata.functions.scalar import risk_level, risk_score
from daystrata.operators import drift as dr
from daystrata.operators import metrics as mt
from daystrata.operators import rules as rl
from daystrata.plans import panels
from daystrata.plans.analysis import analyse, as_document
from daystrata.plans.bindings import CTES, NEEDS, SUPPLIER, scored, supplier_daily, supplier_dim, table
from daystrata.plans.registry import query
from daystrata.sources.files import materialise, scratch_folder
from daystrata.streaming import alerts as al
from daystrata.streaming import live
from daystrata.streaming import outbox as ob

FEATS = ["v", "qty", "disc"]
CTES["drift_long"], NEEDS["drift_long"] = """
    SELECT entity, date, month(date) AS month, unnest(['v', 'qty', 'disc']) AS feature, unnest([v, qty, disc]) AS value
    FROM supplier_daily""", ("supplier_daily",)
CTES["drift_edges"], NEEDS["drift_edges"] = f"""
    SELECT entity, month, feature, CASE WHEN len(q) < 2 THEN [q[1] - 0.5::DOUBLE, q[1] + 0.5::DOUBLE]
             ELSE list_concat(list_concat([-1e308::DOUBLE], q[2:len(q) - 1]), [1e308::DOUBLE]) END AS edges
    FROM (SELECT entity, month, feature, list_sort(list_distinct(list_transform(range(0, 11), lambda i:
            s[i * (n - 1) // 10 + 1] + (s[least(i * (n - 1) // 10 + 2, n)] - s[i * (n - 1) // 10 + 1])
              * (i * (n - 1) % 10 / 10.0::DOUBLE)))) AS q
          FROM (SELECT entity, month, feature, list_sort(list(value)) AS s, count(*) AS n
                FROM drift_long WHERE year(date) <= 1999 GROUP BY 1, 2, 3))""", ("drift_long",)
_PLACED = """SELECT l.*, edges, CASE WHEN value <= edges[len(edges)]
    THEN least(len(list_filter(edges, lambda e: e <= value)), len(edges) - 1) ELSE 0 END AS bin
    FROM drift_long l JOIN drift_edges USING (entity, month, feature)"""
CTES["drift_base"], NEEDS["drift_base"] = f"""
    SELECT entity, month, feature, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY entity, month, feature) AS share,
           any_value(len(edges)) - 1 AS n_bins
    FROM ({_PLACED} WHERE year(date) <= 1999) WHERE bin > 0 GROUP BY 1, 2, 3, 4""", ("drift_edges",)
CTES["drift_months"], NEEDS["drift_months"] = f"""
    SELECT g.entity, g.month, g.feature, any_value(g.n) AS n_rows,
           sum((greatest(coalesce(o.share, 0), 1e-6) - greatest(coalesce(b.share, 0), 1e-6))
               * ln(greatest(coalesce(o.share, 0), 1e-6) / greatest(coalesce(b.share, 0), 1e-6))) AS psi
    FROM (SELECT entity, month, feature, n, unnest(range(1, len(edges))) AS bin FROM (
            SELECT entity, month, feature, any_value(edges) AS edges, count(*) AS n FROM ({_PLACED} WHERE year(date) > 1999)
            GROUP BY 1, 2, 3)) g
    LEFT JOIN drift_base b USING (entity, month, feature, bin)
    LEFT JOIN (SELECT entity, month, feature, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY entity, month, feature) AS share
               FROM ({_PLACED} WHERE year(date) > 1999) WHERE bin > 0 GROUP BY 1, 2, 3, 4) o USING (entity, month, feature, bin)
    GROUP BY 1, 2, 3""", ("drift_base",)
_LEVEL = """CASE WHEN {0} IS NULL THEN 'unavailable' WHEN {0} < 0.1 THEN 'stable' WHEN {0} < 0.2 THEN 'monitor'
    WHEN {0} < 0.25 THEN 'drift_detected' ELSE 'high_drift' END"""
CTES["drift_features"], NEEDS["drift_features"] = f"""
    SELECT entity, feature, psi, n_rows, {_LEVEL.format('psi')} AS level FROM (
      SELECT entity, feature, sum(psi * n_rows) / sum(n_rows) AS psi, sum(n_rows) AS n_rows FROM drift_months GROUP BY 1, 2)""", (
    "drift_months",)


def _reference(spark, sf):
    return dr.baseline(supplier_daily(spark, sf).filter(F.year("date") <= 1999), SUPPLIER, FEATS)


def _recent(spark, sf):
    return supplier_daily(spark, sf).filter(F.year("date") > 1999)


@query("k1_drift_baseline", "entity:i month:i feature:s n_bins:i first_share:f last_share:f inner:f", """
    SELECT e.entity, e.month, e.feature, len(edges) - 1 AS n_bins, coalesce(a.share, 0) AS first_share,
           coalesce(z.share, 0) AS last_share, edges[2] AS inner
    FROM drift_edges e
    LEFT JOIN drift_base a ON a.entity = e.entity AND a.month = e.month AND a.feature = e.feature AND a.bin = 1
    LEFT JOIN drift_base z ON z.entity = e.entity AND z.month = e.month AND z.feature = e.feature AND z.bin = len(edges) - 1""",
       ("drift_base",))
def _(spark, sf):
    return _reference(spark, sf).select(
        "entity", "month", "feature", F.size("proportions").alias("n_bins"), F.col("proportions")[0].alias("first_share"),
        F.element_at("proportions", -1).alias("last_share"), F.col("edges")[1].alias("inner"))


@query("k2_month_psi", "entity:i month:i feature:s rows:i psi:f",
       "SELECT entity, month, feature, n_rows AS rows, psi FROM drift_months", ("drift_months",))
def _(spark, sf):
    return dr.month_psi(_recent(spark, sf), _reference(spark, sf), SUPPLIER, FEATS)


@query("k3_feature_drift", "entity:i feature:s psi:f rows:i level:s",
       "SELECT entity, feature, psi, n_rows AS rows, level FROM drift_features", ("drift_features",))
def _(spark, sf):
    return dr.feature_drift(dr.month_psi(_recent(spark, sf), _reference(spark, sf), SUPPLIER, FEATS), SUPPLIER)


# The whole table, and its first months only: then some entities have fewer rows than an assessment needs.
TODAY, UNTIL = "2001-12-31", "2000-06-01"
for _name in ("drift_months", "drift_features"):
    CTES[f"{_name}_short"] = CTES[_name].replace("year(date) > 1999", f"year(date) > 1999 AND date <= DATE '{UNTIL}'").replace(
        "FROM drift_months", "FROM drift_months_short")
NEEDS["drift_months_short"], NEEDS["drift_features_short"] = ("drift_base",), ("drift_months_short",)


def _assessed_sql(today, features):
    return f"""
    SELECT DATE '{today}' AS today, entity, CASE WHEN coalesce(n, 0) >= 30 THEN 'available' ELSE 'insufficient_history' END AS status,
           coalesce(n, 0) AS sample_size, CASE WHEN n >= 30 THEN round(psi, 4) END AS overall_psi, CASE WHEN n >= 30 THEN {_LEVEL.format('psi')} END AS level,
           CASE WHEN n >= 30 THEN drifting ELSE 0 END AS drifting
    FROM (SELECT DISTINCT entity FROM supplier_daily WHERE year(date) > 1999 AND date <= DATE '{today}')
    LEFT JOIN (SELECT entity, max(n_rows) AS n, avg(psi) AS psi, count(*) FILTER (level IN ('drift_detected', 'high_drift')) AS drifting
               FROM {features} GROUP BY 1) USING (entity)"""


@query("k4_k6_drift_assessment", "today:d entity:i status:s sample_size:i overall_psi:f level:s drifting:i",
       f"{_assessed_sql(TODAY, 'drift_features')} UNION ALL {_assessed_sql(UNTIL, 'drift_features_short')}", ("drift_features", "drift_features_short"))
def _(spark, sf):
    # both days look at the same rows and the same reference: write them once
    recent, reference = materialise(_recent(spark, sf).select("entity", "date", *FEATS), "recent"), materialise(_reference(spark, sf), "reference")
    both = [dr.assess(recent, reference, SUPPLIER, FEATS, today=t).withColumn("today", F.lit(t).cast("date")) for t in (TODAY, UNTIL)]
    return both[0].unionByName(both[1])


_RISK = "CASE WHEN {0} >= 0.8 THEN 'EXTREME' WHEN {0} >= 0.6 THEN 'HIGH' WHEN {0} >= 0.3 THEN 'MODERATE' ELSE 'LOW' END"


@query("r1_r2_risk", "l_orderkey:i l_linenumber:i level:s score:f", f"""
    SELECT l_orderkey, l_linenumber, {_RISK.format('p')} AS level, round(p * 100, 1) AS score
    FROM (SELECT l_orderkey, l_linenumber, CAST(floor(p * 1024) AS BIGINT) / 1024.0::DOUBLE AS p FROM scored)""", ("scored",))
def _(spark, sf):
    s = scored(spark, sf).withColumn("p", F.floor(F.col("p") * 1024) / 1024.0)
    return s.select("l_orderkey", "l_linenumber", risk_level(F.col("p")).alias("level"), risk_score(F.col("p")).alias("score"))


#: Sample wording; an application brings its own.
MESSAGES = {(level, c): f"Sample {i} for {level}: {c.lower()}" for level, names in rl.ADVICE_CATEGORIES.items() for i, c in enumerate(names, 1)}


@query("j5_recommendations", "level:s ordinal:i category:s message:s n:i", f"""
    WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {i}, '{c}', '{MESSAGES[k, c]}')" for k, v in rl.ADVICE_CATEGORIES.items() for i, c in enumerate(v, 1))})
               AS t(level, ordinal, category, message)), s AS (SELECT {_RISK.format('p')} AS level FROM scored)
    SELECT t.level, ordinal, category, message, count(*) AS n FROM s JOIN t USING (level) GROUP BY 1, 2, 3, 4""", ("scored",))
def _(spark, sf):
    s = scored(spark, sf).select(risk_level(F.col("p")).alias("level"))
    return rl.recommend(s, MESSAGES, "level").groupBy("level", "ordinal", "category", "message").agg(F.count(F.lit(1)).alias("n"))


# A weather-like view of the feature table: degrees from the scaled panel values.
WEATHER = {"zone": "region_type", "tmax": "tmax", "tmin": "tmin", "roll7": "roll7", "departure": "dep", "zscore": "z"}
CTES["weather"], NEEDS["weather"] = """
    SELECT entity, date, region_type, v / 2 AS tmax, qty * 0.625::DOUBLE AS tmin, v_roll7_mean / 2 AS roll7,
           departure / 2 AS dep, departure_zscore AS z, (v + qty) * 3 / 512 AS p, qualifying, label_lag1, disc = 5 AS broken
    FROM featured""", ("featured",)
_RULES = {
    "RULE_01": "tmax >= CASE WHEN region_type = 'coastal' THEN 40 ELSE 45 END",
    "RULE_02": "tmax >= 40 AND roll7 >= 37", "RULE_03": "tmin >= 28",
    "RULE_04": "tmax >= 40 AND dep >= 4.5 AND z >= 1.5", "RULE_05": "p >= 0.6", "RULE_06": "p >= 0.6",
    "RULE_07": "p >= 0.3 OR tmax >= 35"}
_SEV = """CASE WHEN RULE_01 OR p >= 0.8 THEN 'CRITICAL' WHEN RULE_02 OR RULE_03 OR RULE_04 OR RULE_05 THEN 'WARNING'
    WHEN RULE_07 THEN 'INFO' END"""
CTES["ruled"], NEEDS["ruled"] = ("SELECT *, " + ", ".join(f"coalesce({c}, FALSE) AS {r}" for r, c in _RULES.items())
                                 + " FROM weather"), ("weather",)


def weather(spark, sf):
    x = panels.featured(spark, sf)
    return x.select("entity", "date", "region_type", (F.col("v") / 2).alias("tmax"), (F.col("qty") * 0.625).alias("tmin"),
                    (F.col("v_roll7_mean") / 2).alias("roll7"), (F.col("departure") / 2).alias("dep"),
                    F.col("departure_zscore").alias("z"), ((F.col("v") + F.col("qty")) * 3 / 512).alias("p"),
                    "qualifying", "label_lag1", (F.col("disc") == 5).alias("broken"))


_HITS = ", ".join(f"CASE WHEN {r} THEN '{r}' END" for r in _RULES)


_NOTES = {
    "RULE_01": "tmax >= 45 (coastal 40)", "RULE_02": "tmax >= 40 and 7-day mean >= 37", "RULE_03": "tmin >= 28",
    "RULE_04": "tmax >= 40, departure >= 4.5 and z-score >= 1.5", "RULE_05": "risk level is HIGH or EXTREME",
    "RULE_06": "risk level is HIGH or EXTREME", "RULE_07": "probability >= 0.3 or tmax >= 35"}
_NOTED = ", ".join(f"CASE WHEN {r} THEN '{n}' END" for r, n in _NOTES.items())


@query("r4_r12_expert_rules", "entity:i date:d triggered:s triggered_count:i highest:s notes:s", f"""
    SELECT entity, date, concat_ws(',', {_HITS}) AS triggered,
           {' + '.join(f'{r}::INT' for r in _RULES)} AS triggered_count, {_SEV} AS highest, concat_ws(';', {_NOTED}) AS notes FROM ruled""", ("ruled",))
def _(spark, sf):
    w = rl.assess_risk(weather(spark, sf), "p")
    rules = rl.absolute_rules(*[F.col(WEATHER[k]) for k in ("zone", "tmax", "tmin", "roll7", "departure", "zscore")],
                              F.col("risk_level"), F.col("p"))
    s = rl.summarise(w.withColumn("rules", rules))
    return s.select("entity", "date", F.array_join("triggered_ids", ",").alias("triggered"), "triggered_count",
                    F.col("highest_severity").alias("highest"), F.array_join(rl.fired(F.col("rules"))["threshold_note"], ";").alias("notes"))


@query("r13_relative_rules", "rule_id:s severity:s description:s n:i", """
    SELECT rule_id, severity, description, count(*) AS n FROM (
      SELECT 'EU_01' AS rule_id, 'WARNING' AS severity,
             'Above local hot-day percentile: fires if the day qualifies by the local percentile.' AS description FROM weather WHERE qualifying = 1
      UNION ALL SELECT 'EU_02', 'CRITICAL', 'Persistent local heat: fires if the day qualifies and the day before was labelled.'
        FROM weather WHERE qualifying = 1 AND coalesce(label_lag1, 0) <> 0
      UNION ALL SELECT 'EU_03', 'WARNING', 'Unusually warm conditions: fires if departure >= 3.' FROM weather WHERE dep >= 3.0
      UNION ALL SELECT 'EU_04', CASE WHEN p >= 0.8 THEN 'CRITICAL' ELSE 'WARNING' END,
        'Model risk overlay: fires if probability >= 0.6 (critical from 0.8).' FROM weather WHERE p >= 0.6)
    GROUP BY 1, 2, 3""", ("weather",))
def _(spark, sf):
    w = weather(spark, sf)
    r = rl.relative_rules(F.col("qualifying"), F.col("label_lag1"), F.col("tmax"), F.lit(40.0), F.col("dep"), F.col("p"))
    return (w.select(F.inline(rl.fired(r))).groupBy("rule_id", "severity", "description").agg(F.count(F.lit(1)).alias("n")))


def _analysed(spark, sf):
    w = weather(spark, sf).withColumns({
        "valid": ~F.col("broken"), "errors": F.when(F.col("broken"), F.array(F.lit("missing_value:disc"))).otherwise(
            F.array().cast("array<string>")), "warnings": F.array().cast("array<string>")})
    return analyse(w, F.col("p"), WEATHER, MESSAGES)


@query("r14_batch_analysis", "entity:i date:d valid:b risk_level:s risk_score:f prediction:i n_advice:i triggered:s n_warnings:i", f"""
    SELECT entity, date, NOT broken AS valid, CASE WHEN NOT broken THEN {_RISK.format('p')} END AS risk_level,
           CASE WHEN NOT broken THEN round(p * 100, 1) END AS risk_score, CASE WHEN NOT broken THEN (p >= 0.7)::INT END AS prediction,
           CASE WHEN broken THEN NULL WHEN p >= 0.8 THEN 7 WHEN p >= 0.6 THEN 6 WHEN p >= 0.3 THEN 5 ELSE 3 END AS n_advice,
           CASE WHEN NOT broken THEN concat_ws(',', {_HITS}) END AS triggered,
           CASE WHEN broken THEN 0 ELSE {' + '.join(f'{r}::INT' for r in list(_RULES)[:6])} END AS n_warnings FROM ruled""", ("ruled",))
def _(spark, sf):
    a = _analysed(spark, sf)
    return a.withColumns({"n_advice": F.when(F.col("recommendations").isNotNull(), F.size("recommendations")),
                          "triggered": F.array_join("triggered_ids", ","), "n_warnings": F.size("warnings")})


_DOCUMENT = ("valid string, risk_level string, risk_score string, prediction string, errors array<string>,"
             " recommendations array<struct<category: string>>, rules array<struct<triggered: boolean>>")


@query("r14_documents", "entity:i date:d valid:s risk_level:s risk_score:s prediction:s n_errors:i n_advice:i n_fired:i", f"""
    SELECT entity, date, CASE WHEN broken THEN 'false' ELSE 'true' END AS valid, CASE WHEN NOT broken THEN {_RISK.format('p')} END AS risk_level,
           CASE WHEN NOT broken THEN CAST(round(p * 100, 1) AS VARCHAR) END AS risk_score, CASE WHEN NOT broken THEN CAST((p >= 0.7)::INT AS VARCHAR) END AS prediction,
           broken::INT AS n_errors, CASE WHEN broken THEN NULL WHEN p >= 0.8 THEN 7 WHEN p >= 0.6 THEN 6 WHEN p >= 0.3 THEN 5 ELSE 3 END AS n_advice,
           CASE WHEN NOT broken THEN {' + '.join(f'{r}::INT' for r in _RULES)} END AS n_fired FROM ruled""", ("ruled",))
def _(spark, sf):
    # the text is read back once, whole; a field by its own path would parse it again
    d = as_document(_analysed(spark, sf), ["entity", "date"]).select("entity", "date", F.from_json("document", _DOCUMENT).alias("d"))
    return d.select("entity", "date", "d.valid", "d.risk_level", "d.risk_score", "d.prediction", F.array_size("d.errors").alias("n_errors"),
                    F.array_size("d.recommendations").alias("n_advice"), F.array_size(F.filter("d.rules", lambda r: r["triggered"])).alias("n_fired"))


# Alerts: nations as entities, customers as subscribers, orders as delivery history.
def _forecasts(spark, sf):
    n = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("nation"))
    f = (supplier_daily(spark, sf).filter("date >= DATE '2001-10-01'").join(n, "entity")
         .groupBy("nation", "date").agg(F.max(F.col("v") / 128).alias("probability")))
    return f.select(F.col("nation").alias("entity"), "date", risk_level(F.col("probability")).alias("level"), "probability")


def _subscriptions(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("entity"), F.concat(F.lower("c_name"), F.lit("@mail.org")).alias("email"),
        F.when(F.col("c_acctbal") > 8000, "EXTREME").when(F.col("c_acctbal") > 4000, "HIGH").otherwise("MODERATE").alias("minimum_level"),
        F.when(F.col("c_acctbal") < 0, "hi").otherwise("en").alias("language"))


def _deliveries(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter("o_orderstatus IN ('F', 'O')").select(
        F.col("o_custkey").alias("subscription_id"), F.expr("date_add(DATE '2001-10-01', cast(o_orderkey % 31 as int))").alias("date"),
        F.when(F.col("o_totalprice") > 250000, "EXTREME").otherwise("HIGH").alias("level"),
        F.when(F.col("o_orderstatus") == "F", "sent").otherwise("failed").alias("status"),
        F.expr("cast(o_orderkey % 8 as int)").alias("attempts"),
        F.expr("timestamp_seconds(1001912400 - o_orderkey % 4000 * 60)").alias("created_at"))


_ALERT_SQL = f"""
    fc AS (SELECT s_nationkey AS entity, date, max(v / 128) AS probability FROM supplier_daily d JOIN supplier s ON s.s_suppkey = d.entity
           WHERE date >= DATE '2001-10-01' GROUP BY 1, 2),
    f AS (SELECT *, {_RISK.format('probability')} AS level FROM fc),
    sub AS (SELECT c_custkey AS id, c_nationkey AS entity, CASE WHEN c_acctbal > 8000 THEN 3 WHEN c_acctbal > 4000 THEN 2 ELSE 1 END AS least
            FROM customer),
    cand AS (SELECT id AS subscription_id, f.entity, date, level, probability,
               CASE level WHEN 'LOW' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS rk
             FROM f JOIN sub ON sub.entity = f.entity AND CASE level WHEN 'LOW' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END >= least)"""


@query("j7_alert_candidates", "subscription_id:i entity:i date:d level:s probability:f",
       f"WITH {_ALERT_SQL} SELECT * FROM cand", ("supplier_daily",))
def _(spark, sf):
    return al.candidates(_forecasts(spark, sf), _subscriptions(spark, sf))


_DUE_SQL = f"""
    WITH {_ALERT_SQL},
    dl AS (SELECT o_custkey AS subscription_id, DATE '2001-10-01' + CAST(o_orderkey % 31 AS INT) AS date,
             CASE WHEN o_totalprice > 250000 THEN 'EXTREME' ELSE 'HIGH' END AS level,
             CASE WHEN o_orderstatus = 'F' THEN 'sent' ELSE 'failed' END AS status, o_orderkey % 8 AS attempts,
             1001912400 - o_orderkey % 4000 * 60 AS made FROM orders WHERE o_orderstatus IN ('F', 'O')),
    fl AS (SELECT subscription_id, date, level, arg_max(attempts, made) AS attempts, max(made) AS made FROM dl WHERE status = 'failed' GROUP BY 1, 2, 3),
    td AS (SELECT subscription_id, count(*) AS n FROM dl WHERE status = 'sent' AND (made + 19800) // 86400 = (1001912400 + 19800) // 86400 GROUP BY 1),
    op AS (SELECT c.*, coalesce(td.n, 0) AS n FROM cand c ANTI JOIN (SELECT * FROM dl WHERE status = 'sent') s
             ON s.subscription_id = c.subscription_id AND s.date = c.date AND s.level = c.level
           LEFT JOIN fl ON fl.subscription_id = c.subscription_id AND fl.date = c.date AND fl.level = c.level
           LEFT JOIN td ON td.subscription_id = c.subscription_id
           WHERE fl.made IS NULL OR 1001912400 >= fl.made + least(60, pow(2, fl.attempts)) * 60)
    SELECT subscription_id, date, level, slot FROM (
      SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY date, rk) + n AS slot FROM op) WHERE slot <= 2"""
_NOW = 1001912400  # 2001-10-01 05:00 UTC, mid-morning local time


@query("j8_l6_l9_due_alerts", "subscription_id:i date:d level:s slot:i", _DUE_SQL, ("supplier_daily",))
def _(spark, sf):
    cand = al.candidates(_forecasts(spark, sf), _subscriptions(spark, sf))
    return al.due(cand, _deliveries(spark, sf), F.timestamp_seconds(F.lit(_NOW)))


@query("l6_l9_alert_stream", "subscription_id:i date:d level:s slot:i", _DUE_SQL, ("supplier_daily",))
def _(spark, sf):
    """The same alerts from a stream: reports arrive first, then the forecasts and a beat that moves the watermark past now."""
    folder, now = scratch_folder(spark, "alerts"), F.timestamp_seconds(F.lit(_NOW))
    told = ob.events(al.candidates(_forecasts(spark, sf), _subscriptions(spark, sf)).limit(0), _deliveries(spark, sf), now)
    asked = ob.events(al.candidates(_forecasts(spark, sf), _subscriptions(spark, sf)), _deliveries(spark, sf).limit(0), now)
    schema = asked.schema.fields
    blocks = _subscriptions(spark, sf).count() // 64 + 1
    beat = spark.range(1).select(*[(F.timestamp_seconds(F.lit(_NOW + 3 * 86400 + 1)) if f.name == "at" else F.lit(None).cast(f.dataType)).alias(f.name)
                                   for f in schema])
    for arriving in (told, asked.unionByName(beat)):
        arriving.write.mode("append").parquet(f"{folder}/in")
        # the second run goes on from the checkpoint
        stream = live.file_stream(spark, f"{folder}/in", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
        ob.run_outbox(stream, f"{folder}/out", f"{folder}/state", blocks=blocks)
    return spark.read.schema(ob.DUE).parquet(f"{folder}/out")


_TEXTS = {"en": "{level} in {city} on {date}, {probability}", "hi": "{city}, {date}: {level} / {probability}"}


def _texts(spark):
    """Sample wording: as many tips as the level is high."""
    rows = [(lang, level, text, [f"{lang} tip {i}" for i in range(1, 2 * k + 1)], f"{lang} sample disclaimer", f"{lang} leave: {{link}}")
            for lang, text in _TEXTS.items() for k, level in enumerate(("LOW", "MODERATE", "HIGH", "EXTREME"))]
    return spark.createDataFrame(rows, al.TEXT_COLUMNS)


@query("l10_alert_texts", "subscription_id:i date:d subject:s summary:s n_tips:i body:s", f"""
    WITH {_ALERT_SQL},
    x AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'hi' ELSE 'en' END AS lang, CAST(round(probability * 100) AS INT) || '%' AS pr,
            CASE level WHEN 'LOW' THEN 0 WHEN 'MODERATE' THEN 2 WHEN 'HIGH' THEN 4 ELSE 6 END AS n FROM cand JOIN customer ON c_custkey = subscription_id),
    y AS (SELECT *, CASE WHEN lang = 'hi' THEN entity || ', ' || CAST(date AS VARCHAR) || ': ' || level || ' / ' || pr
                    ELSE level || ' in ' || entity || ' on ' || CAST(date AS VARCHAR) || ', ' || pr END AS summary,
            array_to_string(list_transform(range(1, n + 1), lambda i: '- ' || lang || ' tip ' || i), chr(10)) AS tips FROM x)
    SELECT subscription_id, date, level || ' heat risk for ' || entity AS subject, summary, n AS n_tips,
           summary || chr(10) || tips || chr(10) || lang || ' sample disclaimer' || chr(10) || lang || ' leave: /unsubscribe?id=' || subscription_id AS body
    FROM y""", ("supplier_daily",))
def _(spark, sf):
    # a third language has no texts of its own
    subs = _subscriptions(spark, sf).withColumn("language", F.when((F.col("language") == "en") & (F.col("id") % 3 == 0), "xx").otherwise(F.col("language")))
    return al.render(al.candidates(_forecasts(spark, sf), subs), _texts(spark)).withColumn("n_tips", F.size("tips"))


@query("l11_current_subscriptions", "email:s entity:i since:s minimum_level:s token:s", """
    WITH al AS (SELECT 'user' || user_id || '@mail.org' AS email, user_id % 5 AS entity, ts, event_type,
                  CASE WHEN value > 90 THEN 'UNKNOWN' WHEN value > 50 THEN 'EXTREME' ELSE 'HIGH' END AS lv, user_id
                FROM events WHERE event_type IN ('signup', 'click', 'error')),
    ch AS (SELECT * FROM al WHERE event_type <> 'signup' OR (lv <> 'UNKNOWN' AND user_id % 11 <> 0)),
    e AS (SELECT email, entity, max(ts) AS ended FROM ch WHERE event_type = 'error' GROUP BY 1, 2),
    l AS (SELECT ch.* FROM ch LEFT JOIN e USING (email, entity) WHERE ended IS NULL OR ts > ended),
    s AS (SELECT email, entity, min(ts) FILTER (event_type = 'signup') AS since, max(ts) FILTER (event_type = 'click') AS conf,
            arg_max(lv, ts) FILTER (event_type = 'signup') AS minimum_level FROM l GROUP BY 1, 2)
    SELECT email, entity, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, minimum_level, sha256('|' || email || '|' || entity) AS token
    FROM s WHERE since IS NOT NULL AND conf > since""")
def _(spark, sf):
    e = table(spark, sf, "events").filter("event_type IN ('signup', 'click', 'error')")
    changes = e.select(
        F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@mail.org")).alias("email"), (F.col("user_id") % 5).alias("entity"), "ts",
        F.when(F.col("event_type") == "signup", "subscribe").when(F.col("event_type") == "click", "confirm").otherwise("unsubscribe").alias("action"),
        F.when(F.col("value") > 90, "UNKNOWN").when(F.col("value") > 50, "EXTREME").otherwise("HIGH").alias("minimum_level"),
        F.when(F.col("user_id") % 11 == 0, "tlh").otherwise("en").alias("language"))
    return al.current_subscriptions(changes).withColumn("since", F.date_format("since", "yyyy-MM-dd HH:mm:ss"))


# Forecast log against later observations: orders as forecasts, the daily panel as outcome.
def _forecast_log(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("date"), (F.col("l_quantity") / 50).alias("probability"),
        (F.col("l_quantity") >= 35).cast("int").alias("prediction"))


def _observed(spark, sf):
    # the last weeks are not observed yet
    return supplier_daily(spark, sf).filter("date < DATE '2001-05-01'").select("entity", "date", F.col("v").alias("observed"))


def _thresholds(spark, sf):
    # only the coastal entities have a threshold of their own
    return supplier_dim(spark, sf).filter("region_type = 'coastal'").select("entity", F.lit(37.0).alias("threshold"))


def _tracked(spark, sf):
    return live.match_outcomes(_forecast_log(spark, sf), _observed(spark, sf), "2001-06-01", _thresholds(spark, sf))


_TRACK = """
    t AS (SELECT l.entity, l.date, prediction, o.v AS observed, CASE WHEN o.v IS NULL THEN NULL
            WHEN o.v >= CASE WHEN region_type = 'coastal' THEN 37 ELSE 40 END THEN 1 ELSE 0 END AS observed_signal
          FROM (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_quantity >= 35 THEN 1 ELSE 0 END AS prediction
                FROM lineitem) l
          LEFT JOIN (SELECT * FROM supplier_daily WHERE date < DATE '2001-05-01') o ON o.entity = l.entity AND o.date = l.date
          JOIN supplier_dim m ON m.entity = l.entity WHERE l.date < DATE '2001-06-01')"""


@query("j6_l5_outcomes", "entity:i date:d prediction:i observed:f observed_signal:i", f"WITH {_TRACK} SELECT * FROM t",
       ("supplier_daily", "supplier_dim"))
def _(spark, sf):
    return _tracked(spark, sf)


@query("j6_l5_outcome_stream", "entity:i date:d prediction:i observed:f observed_signal:i", f"WITH {_TRACK} SELECT * FROM t",
       ("supplier_daily", "supplier_dim"))
def _(spark, sf):
    """The same outcomes from two file streams; a beat on both moves the watermark past the last day before today."""
    folder = scratch_folder(spark, "outcomes")
    sides = {"log": _forecast_log(spark, sf), "seen": _observed(spark, sf)}
    for first in (True, False):
        streams = []
        for name, rows in sides.items():
            beat = {"entity": F.lit(-len(name)), "date": F.lit("2001-06-03")}  # of no entity, another one on each side
            arriving = rows if first else spark.range(1).select(*[beat.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
            arriving.write.mode("append").parquet(f"{folder}/{name}")
            streams.append(live.file_stream(spark, f"{folder}/{name}", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)))
        live.run_outcomes(*streams, _thresholds(spark, sf), f"{folder}/out", f"{folder}/state", delay="36 hours")
    return spark.read.parquet(f"{folder}/out")


@query("i17_i18_tracked_summary", "logged:i matched:i status:s precision:f recall:f proxy_accuracy:f", f"""
    WITH {_TRACK} SELECT count(*) AS logged, count(observed_signal) AS matched, 'available' AS status,
      round(count(*) FILTER (prediction = 1 AND observed_signal = 1)::DOUBLE / count(*) FILTER (prediction = 1 AND observed_signal IS NOT NULL), 4) AS precision,
      round(count(*) FILTER (prediction = 1 AND observed_signal = 1)::DOUBLE / count(*) FILTER (observed_signal = 1), 4) AS recall,
      round(count(*) FILTER (prediction = observed_signal)::DOUBLE / count(observed_signal), 4) AS proxy_accuracy FROM t""",
       ("supplier_daily", "supplier_dim"))
def _(spark, sf):
    return mt.tracked_summary(_tracked(spark, sf))
