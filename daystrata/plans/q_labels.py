"""Queries: climatology, labels and events."""

from pyspark.sql import functions as F

from daystrata.operators import climatology as cl
from daystrata.operators import runs
from daystrata.plans import panels
from daystrata.plans.bindings import BASE_END, BASE_START, ORDERS, SUPPLIER, orders_daily, supplier_daily
from daystrata.plans.registry import query


@query("d1_doy_means", "entity:i doy:i mean:f", "SELECT * FROM doy_means", ("doy_means",))
def _(spark, sf):
    return cl.doy_means(supplier_daily(spark, sf), SUPPLIER, BASE_START, BASE_END)


@query("d2_fill_days", "entity:i doy:i mean:f", "SELECT * FROM filled", ("filled",))
def _(spark, sf):
    return cl.fill_days(cl.doy_means(supplier_daily(spark, sf), SUPPLIER, BASE_START, BASE_END), SUPPLIER)


@query("d3_circular_normals", "entity:i doy:i normal:e", "SELECT * FROM normals", ("normals",))
def _(spark, sf):
    return cl.normals(supplier_daily(spark, sf), SUPPLIER, BASE_START, BASE_END)


@query("d4_d5_pooled_normals", "entity:s doy:i normal:f p90:f pooled_days:i", f"""
    SELECT entity, (dayofyear(date) + k - 1 + 366) % 366 + 1 AS doy, avg(v) AS normal,
           quantile_cont(v, 0.6) AS p90, count(*) AS pooled_days
    FROM orders_daily CROSS JOIN (SELECT unnest(range(-15, 16)) AS k)
    WHERE date BETWEEN DATE '{BASE_START}' AND DATE '{BASE_END}' GROUP BY 1, 2""", ("orders_daily",))
def _(spark, sf):
    return cl.pooled_normals(orders_daily(spark, sf), ORDERS, BASE_START, BASE_END)


@query("j1_d6_departure", "entity:i date:d v:e normal:e departure:e", "SELECT * FROM departed", ("departed",))
def _(spark, sf):
    return panels.departed(spark, sf)


# Stretches without normals: narrower and wider than the search reaches, and one across the turn of the year.
_HOLES = "doy BETWEEN 60 AND 63 OR doy BETWEEN 120 AND 145 OR doy BETWEEN 200 AND 260 OR doy >= 355 OR doy <= 10"


@query("j2_nearest_normals", "entity:i doy:i normal:f", f"""
    WITH known AS (SELECT entity, doy, mean FROM doy_means WHERE NOT ({_HOLES})),
    near AS (SELECT entity, (doy + o - 1 + 366) % 366 + 1 AS doy,
               arg_min(mean, CASE WHEN o = 0 THEN 0 WHEN o < 0 THEN -2 * o - 1 ELSE 2 * o END) AS mean
             FROM known, (SELECT unnest(range(-14, 15)) AS o) GROUP BY 1, 2)
    SELECT e.entity, d.doy, coalesce(mean, 35.0) AS normal FROM (SELECT DISTINCT entity FROM known) e
    CROSS JOIN (SELECT unnest(range(1, 367)) AS doy) d LEFT JOIN near n ON n.entity = e.entity AND n.doy = d.doy""", ("doy_means",))
def _(spark, sf):
    means = cl.doy_means(supplier_daily(spark, sf), SUPPLIER, BASE_START, BASE_END)
    means = means.filter(f"NOT ({_HOLES})")
    return cl.nearest_normals(means.withColumnRenamed("mean", SUPPLIER.normal), SUPPLIER)


@query("d7_qualifying_absolute", "entity:i date:d v:f qualifying:i", "SELECT * FROM qualified", ("qualified",))
def _(spark, sf):
    return panels.qualified(spark, sf)


@query("d8_relative_events", "entity:s date:d qualifying:i label:i event_id:i", f"""
    WITH pooled AS (
      SELECT entity, (dayofyear(date) + k - 1 + 366) % 366 + 1 AS doy, quantile_cont(v, 0.6) AS p90
      FROM orders_daily CROSS JOIN (SELECT unnest(range(-15, 16)) AS k)
      WHERE date BETWEEN DATE '{BASE_START}' AND DATE '{BASE_END}' GROUP BY 1, 2),
    q AS (SELECT o.entity, o.date,
            CASE WHEN o.v > p.p90 AND o.v >= 50 AND month(o.date) BETWEEN 3 AND 10 THEN 1 ELSE 0 END AS qualifying
          FROM orders_daily o LEFT JOIN pooled p ON p.entity = o.entity AND p.doy = dayofyear(o.date)),
    c AS (SELECT *, CASE WHEN qualifying = lag(qualifying) OVER (PARTITION BY entity ORDER BY date) THEN 0 ELSE 1 END AS ch
          FROM q),
    i AS (SELECT *, sum(ch) OVER (PARTITION BY entity ORDER BY date) AS isl FROM c),
    l AS (SELECT *, CASE WHEN qualifying = 1 AND count(*) OVER (PARTITION BY entity, isl) >= 3 THEN 1 ELSE 0 END AS label
          FROM i)
    SELECT entity, date, qualifying, label,
           CASE WHEN label = 1 THEN sum(label * ch) OVER (PARTITION BY entity ORDER BY date) ELSE 0 END AS event_id FROM l""",
       ("orders_daily",))
def _(spark, sf):
    panel = orders_daily(spark, sf)
    table = cl.pooled_normals(panel, ORDERS, BASE_START, BASE_END)
    flagged = cl.qualifying_relative(cl.attach(panel, table, ORDERS), ORDERS)
    return runs.label_runs(flagged, ORDERS, ORDERS.relative.min_run)


@query("d9_label_runs", "entity:i date:d label:i event_id:i event_start:d event_end:d event_length:i label_known:i",
       "SELECT * FROM labelled", ("labelled",))
def _(spark, sf):
    return panels.labelled(spark, sf)


EVENT_SQL = """
    SELECT entity, event_id, min(event_start) AS event_start, max(event_end) AS event_end,
           max(event_length) AS event_length, max(departure) AS peak_departure
    FROM labelled WHERE event_id > 0 GROUP BY 1, 2"""


@query("d10_event_table", "entity:i event_id:i event_start:d event_end:d event_length:i peak_departure:f", EVENT_SQL,
       ("labelled",))
def event_list(spark, sf):
    return runs.event_table(panels.labelled(spark, sf), SUPPLIER)


@query("d10_event_stats",
       "entity:i days:i qualifying_days:i label_days:i events:i mean_length:f max_length:i isolated_days:i", """
    SELECT p.*, coalesce(e.events, 0) AS events, coalesce(e.mean_length, 0) AS mean_length,
           coalesce(e.max_length, 0) AS max_length FROM (
      SELECT entity, count(*) AS days, sum(qualifying) AS qualifying_days, sum(label) AS label_days,
             sum(qualifying) - sum(label) AS isolated_days FROM labelled GROUP BY 1) p
    LEFT JOIN (SELECT entity, count(*) AS events, avg(len) AS mean_length, max(len) AS max_length FROM (
      SELECT entity, event_id, max(event_length) AS len FROM labelled WHERE event_id > 0 GROUP BY 1, 2) GROUP BY 1) e
    ON e.entity = p.entity""", ("labelled",))
def _(spark, sf):
    return runs.event_stats(panels.labelled(spark, sf), SUPPLIER)


@query("d11_d12_live_label_lag", "entity:i date:d label_lag1:i", """
    SELECT entity, date, coalesce(lag(qualifying) OVER (PARTITION BY entity ORDER BY date), 0) AS label_lag1
    FROM qualified""", ("qualified",))
def _(spark, sf):
    return runs.live_label_lag(panels.qualified(spark, sf), SUPPLIER)


@query("d13_examples", "entity:i kind:s date:d", """
    WITH ev AS (SELECT entity, event_id, event_start, event_end, event_length, date,
                  row_number() OVER (PARTITION BY entity, event_id ORDER BY date) - 1 AS pos
                FROM labelled WHERE event_id > 0),
    top AS (SELECT entity, event_id FROM (
              SELECT entity, event_id, row_number() OVER (PARTITION BY entity ORDER BY event_length DESC, event_id) AS rn
              FROM (SELECT DISTINCT entity, event_id, event_length FROM ev)) WHERE rn = 1),
    te AS (SELECT ev.* FROM ev JOIN top ON top.entity = ev.entity AND top.event_id = ev.event_id),
    picked AS (
      SELECT entity, 'normal' AS kind, min(date) AS date FROM labelled WHERE month(date) = 1 AND qualifying = 0 GROUP BY 1
      UNION ALL SELECT entity, 'isolated', min(date) FROM labelled WHERE qualifying = 1 AND label = 0 GROUP BY 1
      UNION ALL SELECT entity, 'start', min(event_start) FROM te GROUP BY 1
      UNION ALL SELECT entity, 'middle', date FROM te WHERE pos = event_length // 2
      UNION ALL SELECT entity, 'end', max(event_end) FROM te GROUP BY 1)
    SELECT * FROM picked""", ("labelled",))
def _(spark, sf):
    return runs.examples(panels.labelled(spark, sf), SUPPLIER)


@query("f14_longest_run", "entity:i longest_run:i", """
    WITH f AS (SELECT entity, date, CASE WHEN v >= 60 THEN 1 ELSE 0 END AS hot FROM supplier_daily),
    c AS (SELECT *, CASE WHEN hot = lag(hot) OVER (PARTITION BY entity ORDER BY date) THEN 0 ELSE 1 END AS ch FROM f),
    i AS (SELECT *, sum(ch) OVER (PARTITION BY entity ORDER BY date) AS isl FROM c),
    g AS (SELECT entity, isl, hot, count(*) AS n FROM i GROUP BY 1, 2, 3)
    SELECT entity, coalesce(max(CASE WHEN hot = 1 THEN n END), 0) AS longest_run FROM g GROUP BY 1""", ("supplier_daily",))
def _(spark, sf):
    return runs.longest_run(supplier_daily(spark, sf).withColumn("hot", (F.col("v") >= 60).cast("int")), SUPPLIER, "hot")
