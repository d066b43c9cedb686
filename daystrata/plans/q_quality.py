"""Queries: data-quality checks, record validation, leakage audits."""

from pyspark.sql import functions as F

from daystrata.operators import contract as ct
from daystrata.operators import features as ft
from daystrata.operators import quality as qa
from daystrata.operators import runs
from daystrata.operators import validate as vd
from daystrata.plans import panels
from daystrata.plans.bindings import ORDERS, SUPPLIER, events_daily, orders_daily, supplier_daily, supplier_dim, table
from daystrata.plans.registry import query
from daystrata.sources.stored import stored_order

VARS = list(SUPPLIER.variables)


def holed(spark, sf):
    """The supplier panel with some values missing."""
    p = supplier_daily(spark, sf)
    return p.withColumns({"disc": F.when(F.col("disc") != 0, F.col("disc")), "tax": F.when(F.col("tax") < 8, F.col("tax"))})


HOLED = """holed AS (SELECT entity, date, v, qty, CASE WHEN disc <> 0 THEN disc END AS disc,
    CASE WHEN tax < 8 THEN tax END AS tax FROM supplier_daily)"""


@query("c1_row_counts", "entity:i rows:i ok:b",
       "SELECT entity, count(*) AS rows, count(*) BETWEEN 520 AND 560 AS ok FROM supplier_daily GROUP BY 1", ("supplier_daily",))
def _(spark, sf):
    return qa.row_counts(supplier_daily(spark, sf), SUPPLIER, 520, 560)


@query("c2_invalid_flags", "invalid:i rows:i",
       "SELECT count(*) FILTER (quality + toxic NOT IN (0, 1)) AS invalid, count(*) AS rows FROM labels")
def _(spark, sf):
    return qa.invalid_flags(table(spark, sf, "labels").withColumn("flag", F.col("quality") + F.col("toxic")), "flag")


@query("c3_date_gaps", "entity:s previous:d date:d days:i", """
    SELECT * FROM (SELECT entity, lag(date) OVER (PARTITION BY entity ORDER BY date) AS previous, date,
           date - lag(date) OVER (PARTITION BY entity ORDER BY date) AS days FROM orders_daily) WHERE days <> 1""",
       ("orders_daily",))
def _(spark, sf):
    return qa.date_gaps(orders_daily(spark, sf), ORDERS)


# The whole month, and a short range in which some entities have no row.
_EXPECTED = (("2024-01-01", "2024-01-31"), ("2024-01-03", "2024-01-08"))


@query("c4_missing_dates", "since:d entity:i date:d", " UNION ALL ".join(f"""
    (SELECT DATE '{a}' AS since, entity, date FROM (SELECT DISTINCT entity FROM events_daily)
     CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '{a}', DATE '{z}', INTERVAL 1 DAY)) AS DATE) AS date)
     EXCEPT SELECT DATE '{a}', entity, date FROM events_daily)""" for a, z in _EXPECTED), ("events_daily",))
def _(spark, sf):
    panel = events_daily(spark, sf)
    both = [qa.missing_dates(panel, SUPPLIER, a, z).withColumn("since", F.lit(a).cast("date")) for a, z in _EXPECTED]
    return both[0].unionByName(both[1])


@query("c5_duplicate_keys", "l_orderkey:i l_linenumber:i copies:i", """
    SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    return qa.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c5_duplicate_rows", "rows:i duplicates:i", """
    SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_shipdate
      FROM lineitem)) AS duplicates FROM lineitem""")
def _(spark, sf):
    return qa.duplicate_rows(table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"))


def _null_sql(by: str = "") -> str:
    k, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"SELECT {k}'{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls,"
        f" count(*) FILTER ({c} IS NULL) * 100.0 / count(*) AS null_pct FROM holed {g}" for c in VARS)


@query("c6_null_profile", "column:s nulls:i null_pct:f", f"WITH {HOLED} {_null_sql()}", ("supplier_daily",))
def _(spark, sf):
    return qa.null_profile(holed(spark, sf), VARS)


@query("c6_entity_null_profile", "entity:i column:s nulls:i null_pct:f", f"WITH {HOLED} {_null_sql('entity')}", ("supplier_daily",))
def _(spark, sf):
    return qa.null_profile(holed(spark, sf), VARS, ["entity"])


PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}


@query("c6_null_matrix", "column:s " + " ".join(f"{n}:i" for n in PRIORITIES), """
    WITH x AS (SELECT entity, CASE WHEN v >= 250 THEN v END AS c, CASE WHEN n > 1 THEN n END AS k FROM orders_daily)
    """ + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(
        f"CASE WHEN count(*) FILTER (entity = '{v}') > 0 THEN count(*) FILTER (entity = '{v}' AND {c} IS NULL) END AS {n}"
        for n, v in PRIORITIES.items()) + " FROM x" for c in ("c", "k")), ("orders_daily",))
def _(spark, sf):
    p = orders_daily(spark, sf).withColumns({"c": F.when(F.col("v") >= 250, F.col("v")), "k": F.when(F.col("n") > 1, F.col("n"))})
    return qa.null_matrix(p, ["c", "k"], "entity", list(PRIORITIES.values())).withColumnsRenamed({v: k for k, v in PRIORITIES.items()})


BOUNDS = {"v": (5.0, 100.0), "qty": (1.5, 49.0), "disc": (0.0, 9.5)}


@query("c7_range_report", "column:s below:i above:i negative:i min:f max:f", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < {a}) AS below, count(*) FILTER ({c} > {b}) AS above,"
    f" count(*) FILTER ({c} < 0) AS negative, min({c}) AS min, max({c}) AS max FROM supplier_daily"
    for c, (a, b) in BOUNDS.items()), ("supplier_daily",))
def _(spark, sf):
    return qa.range_report(supplier_daily(spark, sf), BOUNDS)


@query("c8_metadata_check", "entity:i ok:b wrong:s", """
    WITH seen AS (SELECT m.entity, region_type, CASE WHEN s.v > 104.5 THEN latitude + 1 ELSE latitude END AS latitude
                  FROM supplier_daily s JOIN supplier_dim m USING (entity)),
    a AS (SELECT entity, min(latitude) AS lo, max(latitude) AS hi FROM seen GROUP BY 1)
    SELECT a.entity, abs(lo - latitude) <= 0.001 AND abs(hi - latitude) <= 0.001 AS ok,
           CASE WHEN abs(lo - latitude) <= 0.001 AND abs(hi - latitude) <= 0.001 THEN '' ELSE 'latitude' END AS wrong
    FROM a JOIN supplier_dim m ON m.entity = a.entity""", ("supplier_daily", "supplier_dim"))
def _(spark, sf):
    dim = supplier_dim(spark, sf)
    stored = supplier_daily(spark, sf).join(dim.select("entity", "region_type", "latitude"), "entity").withColumn(
        "latitude", F.when(F.col("v") > 104.5, F.col("latitude") + 1).otherwise(F.col("latitude")))
    r = qa.metadata_check(stored, dim, "entity", ["region_type"], ["latitude"])
    return r.withColumn("wrong", F.array_join("wrong", ","))


@query("c9_b3_identical_columns", "pair:s max_diff:f identical:b", """
    SELECT 'copy' AS pair, 0.0 AS max_diff, TRUE AS identical
    UNION ALL SELECT 'disc_tax', max(abs(disc - tax)), max(abs(disc - tax)) = 0 FROM supplier_daily""", ("supplier_daily",))
def _(spark, sf):
    p = supplier_daily(spark, sf)
    same = qa.identical_columns(p.withColumn("copy", F.col("v") * 1.0), "v", "copy").withColumn("pair", F.lit("copy"))
    return same.unionByName(qa.identical_columns(p, "disc", "tax").withColumn("pair", F.lit("disc_tax")))


@query("c10_date_ranges", "entity:s first_date:d last_date:d ok:b", """
    SELECT entity, min(date) AS first_date, max(date) AS last_date,
           min(date) = DATE '1995-01-01' AND max(date) = DATE '2001-08-01' AS ok FROM orders_daily GROUP BY 1""", ("orders_daily",))
def _(spark, sf):
    return qa.date_ranges(orders_daily(spark, sf), ORDERS, "1995-01-01", "2001-08-01")


@query("c11_strictly_increasing", "entity:i ties:i ok:b", """
    SELECT l_suppkey AS entity, count(*) - count(DISTINCT CAST(l_shipdate AS DATE)) AS ties,
           count(*) = count(DISTINCT CAST(l_shipdate AS DATE)) AS ok FROM lineitem GROUP BY 1""")
def _(spark, sf):
    raw = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("date"))
    return qa.strictly_increasing(raw, SUPPLIER)


# DuckDB numbers the rows of a scan in stored order.
@query("c11_stored_order", "entity:i n:i descents:i repeats:i ok:b", """
    WITH p AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, row_number() OVER () AS place FROM lineitem),
    s AS (SELECT *, lag(date) OVER (PARTITION BY entity ORDER BY place) AS before FROM p)
    SELECT entity, count(*) AS n, count(*) FILTER (date < before) AS descents, count(*) FILTER (date = before) AS repeats,
           count(*) FILTER (date <= before) = 0 AS ok FROM s GROUP BY 1""")
def _(spark, sf):
    return stored_order(table(spark, sf, "lineitem"), SUPPLIER, F.col("l_suppkey"), F.to_date("l_shipdate"), range_rows=5000)


@query("c12_constant_columns", "column:s constant:b", """
    SELECT 'v' AS "column", min(v) = max(v) AS constant FROM supplier_daily
    UNION ALL SELECT 'one', TRUE""", ("supplier_daily",))
def _(spark, sf):
    return qa.constant_columns(supplier_daily(spark, sf).withColumn("one", F.lit(1)), ["v", "one"])


@query("c13_c32_null_status", "entity:i column:s null_pct:f status:s", f"""
    WITH {HOLED}, p AS ({_null_sql('entity')})
    SELECT *, CASE WHEN null_pct = 100 THEN 'FAIL' WHEN null_pct > 1 THEN 'WARN' ELSE 'PASS' END AS status FROM p""",
       ("supplier_daily",))
def _(spark, sf):
    return qa.null_status(holed(spark, sf), VARS, ["entity"])


ALIASES = {"click": "click", "view": "view", "buy": "purchase", "purchase": "purchase", "signup": "signup"}


def _records(spark, sf):
    """Semi-structured records made from the event feed: padded names, text dates, JSON numbers."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "event_id", F.concat(F.lit(" "), F.upper("event_type")).alias("who"),
        F.when(F.col("value") < 1, F.lit("2024-13-01")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(k == "7", F.lit("n/a")).when(k == "8", F.lit("NaN")).otherwise(k).alias("k"),
        F.col("value").cast("string").alias("value"))


RECORDS = """
    rec AS (SELECT event_id, event_type, value, CAST(ts AS DATE) AS d, CAST(json_extract_string(props, '$.k') AS INT) AS k
            FROM events),
    chk AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS who,
              CASE WHEN value < 1 THEN NULL ELSE d END AS day FROM rec),
    cop AS (SELECT *, count(*) OVER (PARTITION BY who, day) AS copies FROM chk),
    val AS (SELECT event_id, who, day,
      (CASE WHEN who IS NULL THEN 1 ELSE 0 END) + (CASE WHEN day IS NULL THEN 1 ELSE 0 END) + (CASE WHEN k IN (7, 8) THEN 1 ELSE 0 END)
        AS n_errors,
      concat_ws(';', CASE WHEN who IS NULL THEN 'unknown_entity: ERROR' END, CASE WHEN day IS NULL THEN 'bad_date:2024-13-01' END,
        CASE WHEN k = 8 THEN 'missing_value:k' END, CASE WHEN k = 7 THEN 'not_numeric:k' END) AS errors,
      concat_ws(';', CASE WHEN (k > 90 AND k NOT IN (7, 8)) AND value > 100 THEN 'out_of_range:k,value'
                          WHEN k > 90 THEN 'out_of_range:k' WHEN value > 100 THEN 'out_of_range:value' END) AS warnings,
      CASE WHEN (k > 90) OR value > 100 THEN 1 ELSE 0 END AS n_warnings, copies
      FROM cop)"""


def _validated(spark, sf):
    return vd.validate(_records(spark, sf), "who", "day", ["k", "value"], aliases=ALIASES,
                       bounds={"k": (0.0, 90.0), "value": (0.0, 100.0)})


@query("c14_c20_record_validation", "event_id:i who:s day:d valid:b errors:s warnings:s", f"""
    WITH {RECORDS} SELECT event_id, who, day, n_errors = 0 AS valid, errors, warnings FROM val""")
def _(spark, sf):
    v = _validated(spark, sf)
    return v.select("event_id", F.col("entity_clean").alias("who"), F.col("date_clean").alias("day"), "valid",
                    F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


@query("c19_c21_batch_outcome", "rows:i valid_rows:i errors:i warnings:i valid:b", f"""
    WITH {RECORDS} SELECT count(*) AS rows, count(*) FILTER (n_errors = 0) AS valid_rows, sum(n_errors) AS errors,
           sum(n_warnings + CASE WHEN copies > 1 AND who IS NOT NULL AND day IS NOT NULL THEN 1 ELSE 0 END) AS warnings,
           sum(n_errors) = 0 AS valid FROM val""")
def _(spark, sf):
    return vd.batch_outcome(vd.flag_duplicates(_validated(spark, sf)))


@query("c21_quarantine", "event_id:i errors:s", f"WITH {RECORDS} SELECT event_id, errors FROM val WHERE n_errors > 0")
def _(spark, sf):
    _, bad = vd.route(_validated(spark, sf))
    return bad.select("event_id", F.array_join("errors", ";").alias("errors"))


@query("c22_contract_check", "severity:s finding:s columns:s", """
    SELECT 'error' AS severity, 'null' AS finding, string_agg(c, ',' ORDER BY c) AS columns FROM (
      SELECT 'disc' AS c, count(*) FILTER (disc = 0) AS n FROM supplier_daily UNION ALL
      SELECT 'tax', count(*) FILTER (tax >= 8) FROM supplier_daily) WHERE n > 0
    UNION ALL SELECT 'warning', 'extra', 'entity'
    UNION ALL SELECT 'warning', 'order', ''""", ("supplier_daily",))
def _(spark, sf):
    p = holed(spark, sf).drop("n")
    return ct.check(p, sorted(VARS)).withColumn("columns", F.array_join("columns", ","))


@query("b12_b13_null_diagnosis", "entity:i date:d missing:s", f"""
    WITH {HOLED} SELECT entity, date, concat_ws(',', CASE WHEN disc IS NULL THEN 'disc' END, CASE WHEN tax IS NULL THEN 'tax' END)
    AS missing FROM holed WHERE disc IS NULL OR tax IS NULL""", ("supplier_daily",))
def _(spark, sf):
    p = holed(spark, sf)
    x = p.withColumn("missing", F.array_join(ct.null_names(VARS, 5), ","))
    return x.filter("missing <> ''")


@query("b10_b12_complete_rows", "entity:i date:d v:f", f"""
    WITH {HOLED} SELECT entity, date, v FROM holed WHERE disc IS NOT NULL AND tax IS NOT NULL""", ("supplier_daily",))
def _(spark, sf):
    return ct.complete_rows(holed(spark, sf), VARS)


# Event runs look one row ahead when the minimum run is three: lagged labels leak, lagged flags do not.
def _audited(min_run):
    def compute(panel):
        # hist_label: yesterday's label; hist_known: the variant that waits for the run
        labelled = runs.label_runs(panel, ORDERS, min_run)
        x = ft.build(labelled, ORDERS)
        w = ft.entity_window(ORDERS)
        return x.withColumn("known_lag1", F.lag("label_known", 1).over(w))
    return compute


@query("c23_leakage_audit", "column:s differences:i audited:i", """
    WITH q AS (SELECT entity, date, v, CASE WHEN v >= 255 THEN 1 ELSE 0 END AS hot, row_number() OVER w AS rn,
                 lag(v, 7) OVER w AS lag7, avg(v) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll
               FROM orders_daily WINDOW w AS (PARTITION BY entity ORDER BY date)),
    c AS (SELECT *, CASE WHEN hot = lag(hot) OVER w THEN 0 ELSE 1 END AS change FROM q WINDOW w AS (PARTITION BY entity ORDER BY date)),
    i AS (SELECT *, sum(change) OVER (PARTITION BY entity ORDER BY date) AS island FROM c),
    s AS (SELECT *, row_number() OVER (PARTITION BY entity, island ORDER BY date) AS sofar, count(*) OVER (PARTITION BY entity, island) AS len FROM i),
    t AS (SELECT *, lag(hot = 1 AND len >= 3) OVER w AS label_lag1, lag(hot = 1 AND sofar >= 3) OVER w AS known_lag1,
            lag(hot) OVER w = 1 AND lag(sofar) OVER w + CASE WHEN change = 0 THEN 1 ELSE 0 END >= 3 AS cut_lag1
          FROM s WINDOW w AS (PARTITION BY entity ORDER BY date)),
    cut AS (SELECT a.entity, a.date, max(b.v) FILTER (b.rn = a.rn - 7) AS lag7, avg(b.v) FILTER (b.rn BETWEEN a.rn - 7 AND a.rn - 1) AS roll
            FROM t a JOIN t b ON b.entity = a.entity AND b.date <= a.date WHERE day(a.date) = 15 GROUP BY 1, 2),
    d AS (SELECT count(*) AS audited, count(*) FILTER (t.lag7 IS DISTINCT FROM cut.lag7) AS lag7,
            count(*) FILTER (t.rn > 7 AND abs(t.roll - cut.roll) > 1e-9) AS roll,
            count(*) FILTER (coalesce(label_lag1, FALSE) <> coalesce(cut_lag1, FALSE)) AS label FROM t JOIN cut USING (entity, date))
    SELECT 'v_lag7' AS "column", lag7 AS differences, audited FROM d UNION ALL SELECT 'v_roll7_mean', roll, audited FROM d
    UNION ALL SELECT 'label_lag1', label, audited FROM d UNION ALL SELECT 'known_lag1', 0, audited FROM d""", ("orders_daily",))
def _(spark, sf):
    p = orders_daily(spark, sf).withColumns({
        "qualifying": (F.col("v") >= 255).cast("int"), "normal": F.lit(250.0), "departure": F.col("v") - 250.0}).select(
        "entity", "date", "v", "qualifying", "normal", "departure")
    audit = F.dayofmonth("date") == 15
    return qa.leakage(p, ORDERS, audit, _audited(3), ["v_lag7", "v_roll7_mean", "label_lag1", "known_lag1"])


@query("c24_target_check", "mismatches:i checked:i", """
    SELECT count(*) FILTER (target <> nxt) AS mismatches, count(nxt) AS checked FROM (
      SELECT target, lead(label) OVER (PARTITION BY entity ORDER BY date) AS nxt FROM featured)""", ("featured",))
def _(spark, sf):
    return qa.target_check(panels.featured(spark, sf), SUPPLIER)


BOUNDARY = ["v_lag1", "v_lag7", "departure_lag7", "qty_lag3"]
_MISSING = " + ".join(f"({c} IS NULL)::INT" for c in BOUNDARY)


@query("c25_boundary_check", "stage:s entity:i date:d null_lags:i", " UNION ALL ".join(f"""
    SELECT '{t}' AS stage, entity, date, {_MISSING} AS null_lags FROM {t} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date) = 1"""
    for t in ("featured", "trimmed")), ("trimmed",))
def _(spark, sf):
    full = panels.featured(spark, sf)  # its first rows have no past, those of the trimmed table have
    parts = [qa.boundary_check(x, SUPPLIER, BOUNDARY).withColumn("stage", F.lit(n)) for n, x in (("featured", full), ("trimmed", ft.trim(full)))]
    return parts[0].union(parts[1])


@query("c26_null_positions", "entity:i nulls:i last_position:i", """
    SELECT entity, count(*) FILTER (departure_zscore IS NULL) AS nulls,
           max(CASE WHEN departure_zscore IS NULL THEN rn END) AS last_position FROM featured GROUP BY 1""", ("featured",))
def _(spark, sf):
    return qa.null_positions(panels.featured(spark, sf), SUPPLIER, "departure_zscore")


@query("c26_null_context", "entity:i date:d window_n:i window_mean:f window_std:f", """
    SELECT entity, date, window_n, window_mean, window_std FROM (
      SELECT entity, date, departure_zscore, count(departure) OVER w AS window_n, avg(departure) OVER w AS window_mean,
             stddev_samp(departure) OVER w AS window_std
      FROM featured WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
    WHERE departure_zscore IS NULL""", ("featured",))
def _(spark, sf):
    return qa.null_context(panels.featured(spark, sf), SUPPLIER, "departure_zscore", "departure", SUPPLIER.z_window)


CHECKED = ["v", "v_lag7", "departure_zscore", "not_there"]


@query("c28_checklist", "check:s ok:b value:i", """
    WITH x AS (SELECT * FROM featured UNION ALL SELECT * FROM featured WHERE entity % 10 = 0),
    k AS (SELECT entity, date, count(*) AS n, bool_or(v IS NULL OR v_lag7 IS NULL OR departure_zscore IS NULL) AS gap,
            bool_or(target IS NULL OR target NOT IN (0, 1)) AS bad FROM x GROUP BY 1, 2)
    SELECT 'row_count_in_range' AS "check", sum(n) BETWEEN 1 AND 1000 AS ok, sum(n) AS value FROM k
    UNION ALL SELECT 'unique_keys', count(*) FILTER (n > 1) = 0, count(*) FILTER (n > 1) FROM k
    UNION ALL SELECT 'complete_features', count(*) FILTER (gap) = 0, count(*) FILTER (gap) FROM k
    UNION ALL SELECT 'binary_target', count(*) FILTER (bad) = 0, count(*) FILTER (bad) FROM k
    UNION ALL SELECT 'feature_count', FALSE, 3""", ("featured",))
def _(spark, sf):
    x = panels.featured(spark, sf)  # untrimmed, some keys twice, one column absent
    return qa.checklist(x.union(x.filter("entity % 10 = 0")), SUPPLIER, CHECKED, 1, 1000)


_B = ", ".join(f"{f}(date) FILTER (split = '{s}') AS {s}_{f}" for s in ("train", "val", "test") for f in ("min", "max"))


@query("c29_split_leakage", "entity:i train_max:d val_min:d val_max:d test_min:d ok:b", f"""
    SELECT *, train_max < val_min AND val_max < test_min AS ok FROM (
      SELECT entity, {_B} FROM (SELECT *, CASE WHEN year(date) <= 1999 THEN 'train' WHEN year(date) <= 2000 THEN 'val'
             ELSE 'test' END AS split FROM supplier_daily) GROUP BY 1)""", ("supplier_daily",))
def _(spark, sf):
    return qa.split_leakage(panels.splits_by_year(supplier_daily(spark, sf)), SUPPLIER)


@query("c29_global_order", "earlier:s later:s last_earlier:d first_later:d ok:b", """
    WITH s AS (SELECT split, min(date) AS a, max(date) AS z FROM (
      SELECT date, CASE WHEN year(date) <= 1999 THEN 'train' WHEN year(date) <= 2000 OR (entity % 9 = 0 AND month(date) < 3) THEN 'val' ELSE 'test' END
        AS split FROM supplier_daily) GROUP BY 1)
    SELECT e.split AS earlier, l.split AS later, e.z AS last_earlier, l.a AS first_later, e.z < l.a AS ok FROM s e, s l
    WHERE (e.split, l.split) IN (('train', 'val'), ('val', 'test'), ('train', 'test'))""", ("supplier_daily",))
def _(spark, sf):
    # some entities change from validation to test later than others: apart for each entity, not over all
    late = (F.col("entity") % 9 == 0) & (F.month("date") < 3) & (F.year("date") == 2001)
    x = panels.splits_by_year(supplier_daily(spark, sf))
    return qa.global_split_order(x.withColumn("split", F.when(late, "val").otherwise(F.col("split"))), SUPPLIER)


@query("c29_split_overlap", "entity:i date:d splits:i", """
    SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, count(DISTINCT l_linestatus) AS splits FROM lineitem
    GROUP BY 1, 2 HAVING count(DISTINCT l_linestatus) > 1""")
def _(spark, sf):
    raw = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("date"),
                                              F.col("l_linestatus").alias("split"))
    return qa.split_overlap(raw, SUPPLIER)


@query("c30_j11_key_difference", "doc_id:i surplus:i", """
    SELECT doc_id, 1 AS surplus FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    return qa.key_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("c31_label_integrity",
       "label_not_qualifying:i label_without_event:i event_without_label:i too_short:i wrong_length:i", """
    WITH x AS (SELECT entity, CASE WHEN day(date) = 3 THEN 0 ELSE qualifying END AS qualifying, CASE WHEN day(date) = 1 THEN 0 ELSE label END AS label,
                 CASE WHEN day(date) = 4 THEN 0 ELSE event_id END AS event_id, event_length + (entity % 3 = 0)::INT AS event_length
               FROM labelled WHERE day(date) <> 2),
    e AS (SELECT entity, event_id, count(*) AS n, max(event_length) AS len FROM x WHERE event_id > 0 GROUP BY 1, 2)
    SELECT count(*) FILTER (label = 1 AND qualifying <> 1) AS label_not_qualifying, count(*) FILTER (label = 1 AND event_id <= 0) AS label_without_event,
           count(*) FILTER (label = 0 AND event_id > 0) AS event_without_label, (SELECT count(*) FILTER (n < 2) FROM e) AS too_short,
           (SELECT count(*) FILTER (n <> len) FROM e) AS wrong_length FROM x""", ("labelled",))
def _(spark, sf):
    day = F.dayofmonth("date")  # labels spoilt in every way
    x = panels.labelled(spark, sf).filter(day != 2).withColumns({
        "qualifying": F.when(day == 3, 0).otherwise(F.col("qualifying")), "label": F.when(day == 1, 0).otherwise(F.col("label")),
        "event_id": F.when(day == 4, 0).otherwise(F.col("event_id")), "event_length": F.col("event_length") + (F.col("entity") % 3 == 0).cast("int")})
    return qa.label_integrity(x, SUPPLIER, 2)


@query("a11_fingerprint", "rows:i checksum:s", """
    SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), l_orderkey, l_partkey, l_suppkey, l_linenumber,
      CAST(round(l_extendedprice * 100) AS BIGINT), coalesce(l_returnflag, '\\N'), CAST(l_shipdate AS DATE))), 1, 15) AS BIGINT)) AS VARCHAR) AS checksum
    FROM lineitem""")
def _(spark, sf):
    return qa.fingerprint(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("cents"), "l_returnflag",
        F.to_date("l_shipdate").alias("day")))
