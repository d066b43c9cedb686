"""Queries: exploratory aggregations and lookups."""

from pyspark.sql import functions as F

from daystrata.operators import explore as ex
from daystrata.plans import panels
from daystrata.plans.bindings import ORDERS, SUPPLIER, doc_scores, orders_daily, scored, supplier_daily, supplier_dim, table
from daystrata.plans.registry import query

VARS = list(SUPPLIER.variables)
LONG = "(SELECT entity, date, unnest(['v', 'qty', 'disc', 'tax']) AS \"column\", unnest([v, qty, disc, tax]) AS value FROM supplier_daily)"


@query("f1_column_profile", "column:s min:f max:f mean:f median:f std:g missing_pct:f", f"""
    SELECT "column", min(value) AS min, max(value) AS max, avg(value) AS mean, quantile_cont(value, 0.5) AS median,
           stddev_samp(value) AS std, count(*) FILTER (value IS NULL) * 100.0 / count(*) AS missing_pct
    FROM {LONG} GROUP BY 1""", ("supplier_daily",))
def _(spark, sf):
    return ex.column_profile(supplier_daily(spark, sf), VARS)


@query("f2_entity_summary", "entity:i v_mean:f v_max:f v_min:f v_sum:f qty_mean:f qty_max:f qty_min:f qty_sum:f", """
    SELECT entity, avg(v) AS v_mean, max(v) AS v_max, min(v) AS v_min, sum(v) AS v_sum,
           avg(qty) AS qty_mean, max(qty) AS qty_max, min(qty) AS qty_min, sum(qty) AS qty_sum
    FROM supplier_daily GROUP BY 1""", ("supplier_daily",))
def _(spark, sf):
    return ex.entity_summary(supplier_daily(spark, sf), SUPPLIER, ["v", "qty"])


@query("f3_f10_annual", "entity:i year:i mean:f max:f min:f total:f", """
    SELECT entity, year(date) AS year, avg(v) AS mean, max(v) AS max, min(v) AS min, sum(v) AS total
    FROM supplier_daily GROUP BY 1, 2""", ("supplier_daily",))
def _(spark, sf):
    return ex.annual(supplier_daily(spark, sf), SUPPLIER, "v")


TREND_SQL = """
    WITH y AS (SELECT entity, year(date) AS year, avg(v) AS a, max(v) AS b, min(v) AS c FROM supplier_daily GROUP BY 1, 2),
    l AS (SELECT entity, year, 'mean' AS metric, a AS value FROM y UNION ALL SELECT entity, year, 'max', b FROM y
          UNION ALL SELECT entity, year, 'min', c FROM y)
    SELECT entity, metric, regr_slope(value, year) AS slope, regr_r2(value, year) AS r2, count(value) AS n
    FROM l GROUP BY 1, 2"""


@query("f4_annual_trend", "entity:i metric:s slope:f r2:f n:i", TREND_SQL, ("supplier_daily",))
def _(spark, sf):
    return ex.annual_trend(supplier_daily(spark, sf), SUPPLIER, "v", p_value=False)


@query("f4_annual_trend_p", "entity:i metric:s slope:f intercept:f r2:f p:f", """
    WITH y AS (SELECT entity, year(date)::DOUBLE AS year, avg(v) AS mean, max(v) AS max, min(v) AS min FROM supplier_daily GROUP BY 1, 2),
    l AS (SELECT entity, year, 'mean' AS metric, mean AS value FROM y UNION ALL SELECT entity, year, 'max', max FROM y
          UNION ALL SELECT entity, year, 'min', min FROM y),
    f AS (SELECT entity, metric, regr_slope(value, year) AS slope, regr_intercept(value, year) AS intercept,
            regr_r2(value, year) AS r2, count(value) - 2 AS n FROM l GROUP BY 1, 2),
    a AS (SELECT *, atan(sqrt(r2 / (1 - r2))) AS th FROM f),
    s AS (SELECT *, CASE WHEN n % 2 = 0
            THEN sin(th) * list_sum(list_transform(range(0, n // 2), lambda k: pow(cos(th), 2 * k) * gamma(k + 0.5) / (sqrt(pi()) * gamma(k + 1.0))))
            ELSE (th + sin(th) * coalesce(list_sum(list_transform(range(0, (n - 1) // 2),
                 lambda k: pow(cos(th), 2 * k + 1) * sqrt(pi()) * gamma(k + 1.0) / (2 * gamma(k + 1.5)))), 0)) * 2 / pi() END AS area
          FROM a WHERE n > 0)
    SELECT entity, metric, slope, intercept, r2, greatest(0, 1 - area) AS p FROM s""", ("supplier_daily",))
def _(spark, sf):
    return ex.annual_trend(supplier_daily(spark, sf), SUPPLIER, "v")


def _pivot(fn):
    months = ", ".join(f"{fn.format(f'CASE WHEN month(date) = {m} THEN v END')} AS m{m:02d}" for m in range(1, 13))
    return f"SELECT entity, {months} FROM supplier_daily GROUP BY 1"


M_COLS = "entity:i " + " ".join(f"m{m:02d}:f" for m in range(1, 13))


@query("f5_monthly_median", M_COLS, _pivot("quantile_cont({}, 0.5)"), ("supplier_daily",))
def _(spark, sf):
    return ex.monthly_pivot(supplier_daily(spark, sf), SUPPLIER, "v")


@query("f5_monthly_mean", M_COLS, _pivot("avg({})"), ("supplier_daily",))
def _(spark, sf):
    return ex.monthly_pivot(supplier_daily(spark, sf), SUPPLIER, "v", how="mean")


@query("f6_top_months", "entity:i month:i median:f rank:i", """
    WITH m AS (SELECT entity, month(date) AS month, quantile_cont(v, 0.5) AS median FROM supplier_daily GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY median DESC, month) AS rank FROM m)
    WHERE rank <= 3""", ("supplier_daily",))
def _(spark, sf):
    return ex.top_months(supplier_daily(spark, sf), SUPPLIER, "v")


@query("f7_seasonal_mean", "entity:i winter:f pre_monsoon:f monsoon:f post_monsoon:f", """
    SELECT entity, avg(CASE WHEN month(date) IN (12, 1, 2) THEN v END) AS winter,
           avg(CASE WHEN month(date) IN (3, 4, 5) THEN v END) AS pre_monsoon,
           avg(CASE WHEN month(date) IN (6, 7, 8, 9) THEN v END) AS monsoon,
           avg(CASE WHEN month(date) IN (10, 11) THEN v END) AS post_monsoon FROM supplier_daily GROUP BY 1""",
       ("supplier_daily",))
def _(spark, sf):
    return ex.seasonal_pivot(supplier_daily(spark, sf), SUPPLIER, "v")


@query("f8_quantiles", "entity:i p05:f median:f p95:f p99:f", """
    SELECT entity, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.95) AS p95,
           quantile_cont(v, 0.99) AS p99 FROM supplier_daily GROUP BY 1""", ("supplier_daily",))
def _(spark, sf):
    return ex.quantile_table(supplier_daily(spark, sf), SUPPLIER, "v")


@query("f8_hot_group_quantiles", "entity:s p05:f median:f p95:f p99:f", """
    SELECT entity, quantile_cont(p, 0.05) AS p05, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.95) AS p95,
           quantile_cont(p, 0.99) AS p99 FROM scored GROUP BY 1""", ("scored",))
def _(spark, sf):
    from daystrata.operators.prefix import exact_quantiles
    return exact_quantiles(scored(spark, sf), "p", {"p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}, ["entity"])


@query("f9_zero_frequency", "entity:i zeros:i zero_pct:f", """
    SELECT entity, count(*) FILTER (tax = 0) AS zeros, count(*) FILTER (tax = 0) * 100.0 / count(tax) AS zero_pct
    FROM supplier_daily GROUP BY 1""", ("supplier_daily",))
def _(spark, sf):
    return ex.zero_frequency(supplier_daily(spark, sf), SUPPLIER, "tax")


_PAIRS = [("v", "qty"), ("v", "disc"), ("v", "tax"), ("qty", "disc"), ("qty", "tax"), ("disc", "tax")]


@query("f11_correlations", "a:s b:s r:f strong:b", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, abs(corr({a}, {b})) > 0.7 AS strong FROM supplier_daily"
    for a, b in _PAIRS), ("supplier_daily",))
def _(spark, sf):
    return ex.correlations(supplier_daily(spark, sf), VARS)


@query("f11_entity_correlations", "entity:i a:s b:s r:f strong:b", " UNION ALL ".join(
    f"SELECT entity, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, abs(corr({a}, {b})) > 0.7 AS strong"
    " FROM supplier_daily GROUP BY 1" for a, b in _PAIRS[:3]), ("supplier_daily",))
def _(spark, sf):
    return ex.correlations(supplier_daily(spark, sf), VARS, ["entity"]).filter("a = 'v'")


@query("f12_exceedance", "entity:i year:i days:i hot_days:i hot_pct:f", """
    SELECT entity, year(date) AS year, count(v) AS days, count(*) FILTER (v >= 60) AS hot_days,
           count(*) FILTER (v >= 60) * 100.0 / count(v) AS hot_pct FROM supplier_daily GROUP BY 1, 2""", ("supplier_daily",))
def _(spark, sf):
    return ex.exceedance(supplier_daily(spark, sf), SUPPLIER, "v", 60, [F.col("entity"), F.year("date").alias("year")])


@query("f13_hottest_day", "entity:i date:d v:f", """
    SELECT entity, date, v FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY v DESC, date) AS rn
    FROM supplier_daily) WHERE rn = 1""", ("supplier_daily",))
def _(spark, sf):
    return ex.hottest_day(supplier_daily(spark, sf), SUPPLIER, "v")


@query("f15_iqr_outliers", "entity:i low_fence:f high_fence:f low:i high:i high_pct:f", """
    WITH q AS (SELECT entity, quantile_cont(qty, 0.25) AS q1, quantile_cont(qty, 0.75) AS q3 FROM supplier_daily GROUP BY 1)
    SELECT s.entity, any_value(q1 - 1.5 * (q3 - q1)) AS low_fence, any_value(q3 + 1.5 * (q3 - q1)) AS high_fence,
           count(*) FILTER (qty < q1 - 1.5 * (q3 - q1)) AS low, count(*) FILTER (qty > q3 + 1.5 * (q3 - q1)) AS high,
           count(*) FILTER (qty > q3 + 1.5 * (q3 - q1)) * 100.0 / count(qty) AS high_pct
    FROM supplier_daily s JOIN q USING (entity) GROUP BY 1""", ("supplier_daily",))
def _(spark, sf):
    return ex.iqr_outliers(supplier_daily(spark, sf), SUPPLIER, "qty")


@query("f16_group_comparison", "column:s mean_1:f std_1:g mean_0:f std_0:g", f"""
    SELECT "column", avg(value) FILTER (hot) AS mean_1, stddev_samp(value) FILTER (hot) AS std_1,
           avg(value) FILTER (NOT hot) AS mean_0, stddev_samp(value) FILTER (NOT hot) AS std_0
    FROM (SELECT entity, date, v >= 60 AS hot, unnest(['v', 'qty', 'disc', 'tax']) AS "column",
                 unnest([v, qty, disc, tax]) AS value FROM supplier_daily) GROUP BY 1""", ("supplier_daily",))
def _(spark, sf):
    return ex.group_comparison(supplier_daily(spark, sf), F.col("v") >= 60, VARS)


@query("f17_histogram", "bin:i n:i left_edge:f", """
    WITH e AS (SELECT min(v) AS lo, max(v) AS hi FROM supplier_daily)
    SELECT bin, count(*) AS n, any_value(lo + (hi - lo) / 40 * bin) AS left_edge FROM (
      SELECT least(CAST(floor((v - lo) / ((hi - lo) / 40)) AS BIGINT), 39) AS bin, lo, hi FROM supplier_daily, e)
    GROUP BY 1""", ("supplier_daily",))
def _(spark, sf):
    return ex.histogram(supplier_daily(spark, sf), "v", 40)


@query("f17_class_histogram", "hot:i bin:i n:i", """
    WITH e AS (SELECT min(qty) AS lo, max(qty) AS hi FROM supplier_daily)
    SELECT hot, bin, count(*) AS n FROM (
      SELECT CASE WHEN v >= 60 THEN 1 ELSE 0 END AS hot,
             least(CAST(floor((qty - lo) / ((hi - lo) / 20)) AS BIGINT), 19) AS bin FROM supplier_daily, e)
    GROUP BY 1, 2""", ("supplier_daily",))
def _(spark, sf):
    return ex.histogram(supplier_daily(spark, sf).withColumn("hot", (F.col("v") >= 60).cast("int")), "qty", 20, ["hot"])


@query("f18_five_numbers", "entity:i month:i minimum:f q1:f median:f q3:f maximum:f", """
    SELECT entity, month(date) AS month, min(v) AS minimum, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
           quantile_cont(v, 0.75) AS q3, max(v) AS maximum FROM supplier_daily GROUP BY 1, 2""", ("supplier_daily",))
def _(spark, sf):
    return ex.five_numbers(supplier_daily(spark, sf), "v", [F.col("entity"), F.month("date").alias("month")])


@query("f19_class_balance", "split:s entity:s total:i positives:i negatives:i positive_pct:f imbalance:f", """
    SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split,
           CASE WHEN grouping(entity) = 1 THEN 'all' ELSE CAST(entity AS VARCHAR) END AS entity, count(label) AS total,
           sum(label) AS positives, count(label) - sum(label) AS negatives, sum(label) * 100.0 / count(label) AS positive_pct,
           CASE WHEN sum(label) > 0 THEN (count(label) - sum(label))::DOUBLE / sum(label) END AS imbalance
    FROM (SELECT label, CASE WHEN year(date) <= 1999 THEN 'train' WHEN year(date) <= 2000 THEN 'val' ELSE 'test' END AS split,
            CASE WHEN entity % 10 <> 3 THEN entity END AS entity FROM labelled) GROUP BY ROLLUP (split, entity)""", ("labelled",))
def _(spark, sf):
    # some entities are unknown
    rows = panels.splits_by_year(panels.labelled(spark, sf)).withColumn("entity", F.when(F.col("entity") % 10 != 3, F.col("entity")))
    return ex.class_balance(rows, "label", ["split", "entity"])


@query("f20_yearly_counts", "entity:i " + " ".join(f"y{y}:i" for y in range(1995, 2002)),
       "SELECT entity, " + ", ".join(f"coalesce(sum(label) FILTER (year(date) = {y}), 0) AS y{y}"
                                     for y in range(1995, 2002)) + " FROM labelled GROUP BY 1", ("labelled",))
def _(spark, sf):
    return ex.yearly_counts(panels.labelled(spark, sf), SUPPLIER, "label", list(range(1995, 2002)))


@query("f21_map_summary", "entity:s avg_probability:f max_probability:f label_days:i days:i label_pct:f", """
    SELECT entity, round(avg(p), 4) AS avg_probability, round(max(p), 4) AS max_probability, sum(label) AS label_days,
           count(*) AS days, round(sum(label) * 100.0::DOUBLE / count(*), 1) AS label_pct FROM scored GROUP BY 1""", ("scored",))
def _(spark, sf):
    return ex.map_summary(scored(spark, sf), ORDERS, "p", "label")


@query("f22_entity_comparison",
       "entity:s days:i label_days:i avg_p:f max_p:f tp:i fp:i fn:i f1:f", """
    SELECT entity, count(*) AS days, sum(label) AS label_days, avg(p) AS avg_p, max(p) AS max_p,
           count(*) FILTER (label = 1 AND p >= 0.7) AS tp, count(*) FILTER (label = 0 AND p >= 0.7) AS fp,
           count(*) FILTER (label = 1 AND p < 0.7) AS fn,
           2.0 * count(*) FILTER (label = 1 AND p >= 0.7) / (2 * count(*) FILTER (label = 1 AND p >= 0.7)
             + count(*) FILTER (label = 0 AND p >= 0.7) + count(*) FILTER (label = 1 AND p < 0.7)) AS f1
    FROM scored GROUP BY 1""", ("scored",))
def _(spark, sf):
    from daystrata.operators import metrics
    s = scored(spark, sf)
    m = metrics.threshold_metrics(s, 0.7, ["entity"])
    base = s.groupBy("entity").agg(F.count(F.lit(1)).alias("days"), F.sum("label").alias("label_days"),
                                   F.avg("p").alias("avg_p"), F.max("p").alias("max_p"))
    return base.join(m, "entity")


@query("f23_entity_stats", "entity:i days:i label_days:i first_date:d last_date:d", """
    SELECT entity, count(*) AS days, sum(label) AS label_days, min(date) AS first_date, max(date) AS last_date
    FROM labelled GROUP BY 1""", ("labelled",))
def _(spark, sf):
    return ex.entity_stats(panels.labelled(spark, sf), SUPPLIER, "label")


@query("f24_log_counts", "entity:s n:i", "SELECT event_type AS entity, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


_WINDOWS = {"early": ("1995-01-01", "1997-12-31"), "mid": ("1997-01-01", "1999-12-31"), "late": ("1999-06-01", "2001-12-31")}
_WSQL = ", ".join(
    f"count(*) FILTER (date BETWEEN DATE '{a}' AND DATE '{b}') AS {n}_rows,"
    f" coalesce(sum(label) FILTER (date BETWEEN DATE '{a}' AND DATE '{b}'), 0) AS {n}_positives"
    for n, (a, b) in _WINDOWS.items())
_WCOLS = " ".join(f"{n}_rows:i {n}_positives:i" for n in _WINDOWS)


@query("f25_window_counts", _WCOLS, f"SELECT {_WSQL} FROM labelled", ("labelled",))
def _(spark, sf):
    return ex.window_counts(panels.labelled(spark, sf), SUPPLIER, "label", _WINDOWS)


@query("f26_entity_window_counts", "entity:i " + _WCOLS, f"SELECT entity, {_WSQL} FROM labelled GROUP BY 1", ("labelled",))
def _(spark, sf):
    return ex.window_counts(panels.labelled(spark, sf), SUPPLIER, "label", _WINDOWS, ["entity"])


@query("b1_b2_projection", "entity:i date:d disc:f qty:f tax:f v:f",
       "SELECT entity, date, disc, qty, tax, v FROM supplier_daily", ("supplier_daily",))
def _(spark, sf):
    from daystrata.operators.contract import project
    return project(supplier_daily(spark, sf), sorted(VARS), ["entity", "date"])


@query("b4_date_range", "entity:i date:d v:f", """
    SELECT entity, date, v FROM supplier_daily WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-06-30'""", ("supplier_daily",))
def _(spark, sf):
    from daystrata.operators.climatology import baseline
    return baseline(supplier_daily(spark, sf), SUPPLIER, "1998-03-01", "1998-06-30")


@query("b5_point_lookup", "entity:i date:d found:b v:f first_date:d last_date:d", """
    WITH wanted AS (SELECT o_custkey AS entity, CAST(min(o_orderdate) AS DATE) AS date FROM orders GROUP BY 1),
    span AS (SELECT entity, min(date) AS first_date, max(date) AS last_date FROM supplier_daily GROUP BY 1)
    SELECT w.entity, w.date, s.v IS NOT NULL AS found, s.v, first_date, last_date FROM wanted w
    LEFT JOIN supplier_daily s ON s.entity = w.entity AND s.date = w.date LEFT JOIN span ON span.entity = w.entity""",
       ("supplier_daily",))
def _(spark, sf):
    wanted = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.to_date(F.min("o_orderdate")).alias("date"))
    return ex.point_lookup(supplier_daily(spark, sf), SUPPLIER, wanted)


@query("b6_available_dates", "entity:i dates:s first_date:d last_date:d n_dates:i", """
    SELECT entity, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS dates, min(date) AS first_date,
           max(date) AS last_date, count(DISTINCT date) AS n_dates FROM supplier_daily GROUP BY 1""", ("supplier_daily",))
def _(spark, sf):
    x = ex.available_dates(supplier_daily(spark, sf), SUPPLIER)
    return x.withColumn("dates", F.array_join(F.transform("dates", lambda d: d.cast("string")), ","))


@query("b7_trend_series", "entity:i date:d v:f v_roll7_mean:f label:i", """
    SELECT entity, date, round(v, 4) AS v, round(v_roll7_mean, 4) AS v_roll7_mean, coalesce(target, 0) AS label FROM featured""",
       ("featured",))
def _(spark, sf):
    x = panels.featured(spark, sf).drop("label").withColumnRenamed("target", "label")
    return ex.trend_series(x, SUPPLIER, ["v", "v_roll7_mean"], "label")


@query("b9_j3_region_filter", "entity:i date:d v:f region:s", """
    SELECT s.entity, date, v, region FROM supplier_daily s JOIN supplier_dim m USING (entity) WHERE region = 'EUROPE'""",
       ("supplier_daily", "supplier_dim"))
def _(spark, sf):
    dim = supplier_dim(spark, sf).filter("region = 'EUROPE'").select("entity", "region")
    return supplier_daily(spark, sf).join(dim, "entity")


@query("b14_value_cap", "entity:i date:d v:f", """
    SELECT entity, date, v FROM supplier_daily WHERE v <= (SELECT quantile_cont(v, 0.95) FROM supplier_daily)""",
       ("supplier_daily",))
def _(spark, sf):
    return ex.value_cap(supplier_daily(spark, sf), "v")
