"""Queries: features, sequences, scaling, splits and resampling."""

from pyspark.sql import functions as F

from daystrata.functions.scalar import mix_sql, season_name
from daystrata.operators import features as ft
from daystrata.operators import prefix
from daystrata.operators import splits as sp
from daystrata.operators.neighbours import nearest_rows
from daystrata.plans import panels
from daystrata.plans.bindings import NEEDS, ORDERS, SUPPLIER, CTES, orders_daily, supplier_daily, supplier_dim
from daystrata.plans.registry import query
from daystrata.sources.files import materialise, scratch_folder
from daystrata.sources.stored import side_by_side

VARS = SUPPLIER.variables
W = "(PARTITION BY entity ORDER BY date{})"


def _frame(n: int) -> str:
    return W.format(f" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")


def _feature_sql() -> str:
    """The same features with window aggregates over explicit frames."""
    w = W.format("")
    parts = [f"lag({v}, {k}) OVER {w} AS {v}_lag{k}" for v in VARS for k in SUPPLIER.lags]
    parts += [f"lag(departure, {k}) OVER {w} AS departure_lag{k}" for k in SUPPLIER.lags]
    parts.append(f"lag(label, 1) OVER {w} AS label_lag1")
    for v in VARS:
        for n in SUPPLIER.rolls:
            for name, fn in (("mean", "avg"), ("max", "max"), ("min", "min")):
                parts.append(f"CASE WHEN count({v}) OVER {_frame(n)} >= {n} THEN {fn}({v}) OVER {_frame(n)} END"
                             f" AS {v}_roll{n}_{name}")
    parts += [f"v - lag(v, {k}) OVER {w} AS v_delta_{k}d" for k in (1, 3, 7)]
    parts += [f"CASE WHEN rn >= {n} AND count(v) OVER {_frame(n)} >= 2 THEN regr_slope(v, rn) OVER {_frame(n)} END"
              f" AS v_slope_{n}d" for n in SUPPLIER.slopes]
    z = _frame(30)
    parts.append(f"CASE WHEN count(departure) OVER {z} >= 10 THEN (departure - avg(departure) OVER {z})"
                 f" / nullif(stddev_samp(departure) OVER {z}, 0) END AS departure_zscore")
    parts += ["month(date) AS month", "dayofyear(date) AS day_of_year",
              "CASE WHEN month(date) IN (12, 1, 2) THEN 0 WHEN month(date) <= 5 THEN 1"
              " WHEN month(date) <= 9 THEN 2 ELSE 3 END AS season_code",
              "sin(2 * pi() * month(date) / 12) AS month_sin", "cos(2 * pi() * month(date) / 12) AS month_cos",
              "sin(2 * pi() * dayofyear(date) / 365.25::DOUBLE) AS doy_sin",
              "cos(2 * pi() * dayofyear(date) / 365.25::DOUBLE) AS doy_cos",
              "CASE WHEN region_type = 'coastal' THEN 1 ELSE 0 END AS is_coastal", "entity::DOUBLE AS entity_code",
              f"lead(label, 1) OVER {w} AS target"]
    return (f"SELECT *, {', '.join(parts)} FROM (SELECT *, row_number() OVER {w} AS rn,"
            " count(*) OVER (PARTITION BY entity) AS n_rows FROM labelled)")


CTES["featured"], NEEDS["featured"] = _feature_sql(), ("labelled",)
CTES["trimmed"], NEEDS["trimmed"] = "SELECT * FROM featured WHERE rn > 10 AND rn < n_rows", ("featured",)
KEY = "(entity * 100000 + (date - DATE '1970-01-01'))"


def _slice(columns):
    def run(spark, sf):
        return panels.featured(spark, sf)
    return f"entity:i date:d {_digits(columns)}", run


def _digits(columns):
    """Normals (and what is made of them) are means of means: some lie halfway between two values of six digits."""
    return " ".join(f"{c}:{'e' if c == 'normal' or c.startswith('departure') and 'zscore' not in c else 'f'}" for c in columns)


for _name, _cols in {
    "e1_e3_lags": SUPPLIER.lag_names(), "e4_rolling": SUPPLIER.roll_names(), "e5_e6_trend": SUPPLIER.trend_names(),
    "e7_zscore": ["departure_zscore"], "e8_e10_calendar": SUPPLIER.calendar_names(), "e13_target": ["target"],
}.items():
    _decl, _run = _slice(_cols)
    query(_name, _decl, "SELECT * FROM featured", ("featured",))(_run)


@query("e21_feature_table", "entity:i date:d target:i " + _digits(SUPPLIER.contract()),
       "SELECT * FROM trimmed", ("trimmed",))
def feature_table(spark, sf):
    return ft.trim(panels.featured(spark, sf))


@query("e9_season", "date:d season:s", """
    SELECT DISTINCT date, CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'spring'
      WHEN month(date) <= 9 THEN 'monsoon' ELSE 'autumn' END AS season FROM orders_daily""", ("orders_daily",))
def _(spark, sf):
    return orders_daily(spark, sf).select("date").distinct().withColumn("season", season_name(F.month("date")))


@query("e11_e12_entity_codes", "entity:i code:i is_coastal:i", """
    SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS code,
           CASE WHEN region_type = 'coastal' THEN 1 ELSE 0 END AS is_coastal FROM supplier_dim""", ("supplier_dim",))
def _(spark, sf):
    dim = prefix.average_ranks(supplier_dim(spark, sf), "entity", out="rank")
    codes = dim.select("entity", (F.col("rank") - 1).alias("code"))
    return supplier_dim(spark, sf).join(codes, "entity").withColumn(
        "is_coastal", F.col("region_type").isin(*SUPPLIER.coastal_types))


@query("e14_e15_trim", "entity:i days:i first_date:d last_date:d",
       "SELECT entity, count(*) AS days, min(date) AS first_date, max(date) AS last_date FROM trimmed GROUP BY 1",
       ("trimmed",))
def _(spark, sf):
    return ft.trim(panels.featured(spark, sf)).groupBy("entity").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("e16_ordinals", "entity:i date:d row_ordinal:i entity_rows:i", f"""
    SELECT entity, date, row_number() OVER {W.format('')} - 1 AS row_ordinal,
           count(*) OVER (PARTITION BY entity) AS entity_rows FROM supplier_daily""", ("supplier_daily",))
def _(spark, sf):
    return ft.ordinals(supplier_daily(spark, sf), SUPPLIER)


@query("e17_centred_mean", "entity:s date:d centred_mean:f", """
    SELECT entity, date, CASE WHEN count(v) OVER f >= 300 THEN avg(v) OVER f END AS centred_mean FROM orders_daily
    WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)""", ("orders_daily",))
def _(spark, sf):
    return ft.centred_mean(orders_daily(spark, sf), ORDERS)


@query("e18_e19_sequences", "entity:i date:d length:i oldest_v:f newest_tax:f total:f", """
    SELECT * FROM (SELECT entity, date, count(*) OVER f AS length, first_value(v) OVER f AS oldest_v, tax AS newest_tax,
             sum(v + qty + disc + tax) OVER f AS total FROM supplier_daily
      WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
    WHERE length = 21 AND year(date) > 2000""", ("supplier_daily",))
def _(spark, sf):
    windows = ft.sequences(supplier_daily(spark, sf), SUPPLIER, list(VARS), 21)
    test = panels.splits_by_year(windows).filter("split = 'test'")  # inputs reach into the earlier split
    seq = F.col("sequence")
    return test.select("entity", "date", F.size(seq).alias("length"), seq[0][0].alias("oldest_v"),
                       F.element_at(seq, -1)[3].alias("newest_tax"),
                       F.aggregate(F.flatten(seq), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("e20_scaled", "entity:i date:d v:f qty:f disc:f tax:f", """
    SELECT entity, date, (s.v - m.vm) / m.vs AS v, (qty - qm) / qs AS qty, (disc - dm) / ds AS disc, (tax - tm) / ts AS tax
    FROM supplier_daily s CROSS JOIN (
      SELECT avg(v) AS vm, stddev_pop(v) AS vs, avg(qty) AS qm, stddev_pop(qty) AS qs, avg(disc) AS dm,
             stddev_pop(disc) AS ds, avg(tax) AS tm, stddev_pop(tax) AS ts FROM supplier_daily WHERE year(date) <= 1999) m""",
       ("supplier_daily",))
def _(spark, sf):
    panel = supplier_daily(spark, sf)
    scaler = ft.fit_scaler(panels.splits_by_year(panel).filter("split = 'train'"), list(VARS))
    return ft.apply_scaler(panel, scaler, list(VARS))


SPLIT_SQL = "CASE WHEN year(date) <= 1999 THEN 'train' WHEN year(date) <= 2000 THEN 'val' ELSE 'test' END"


@query("g1_split", "entity:i date:d split:s", f"SELECT entity, date, {SPLIT_SQL} AS split FROM supplier_daily",
       ("supplier_daily",))
def _(spark, sf):
    return panels.splits_by_year(supplier_daily(spark, sf))


@query("g2_a15_roles", "entity:i date:d v:f qty:f target:i region_type:s", """
    SELECT entity, date, v, qty, target, region_type FROM featured WHERE year(date) = 2000""", ("featured",))
def _(spark, sf):
    x, y, meta = sp.roles(panels.splits_by_year(panels.featured(spark, sf)), SUPPLIER, ["v", "qty"], "val")
    return sp.reassemble(x, y, meta, SUPPLIER)


@query("a15_positional", "entity:i date:d v:f qty:f target:i region_type:s", """
    SELECT entity, date, v, qty, target, region_type FROM featured WHERE year(date) = 2000""", ("featured",))
def _(spark, sf):
    """Three stored parts without a common key, put side by side by position."""
    prefix.ensure_checkpoint_dir(spark)
    rows = panels.featured(spark, sf).filter("year(date) = 2000").select("entity", "date", "v", "qty", "target", "region_type").checkpoint()
    folder, parts = scratch_folder(spark, "parts"), []
    for name, columns in (("meta", ["entity", "date", "region_type"]), ("x", ["v", "qty"]), ("y", ["target"])):
        rows.select(*columns).write.parquet(f"{folder}/{name}")  # the partitions of the checkpoint, in their order
        parts.append(spark.read.parquet(f"{folder}/{name}"))
    return side_by_side(parts)


def _label_rows(spark, sf):
    # resampling reads its rows several times: write them once
    return materialise(panels.labelled(spark, sf).select("entity", "date", "label"), "labels")


@query("g3_undersample", "entity:i date:d label:i", f"""
    WITH k AS (SELECT *, {mix_sql(KEY)} AS h FROM labelled),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, {KEY}) AS rn FROM k),
    c AS (SELECT least(2 * count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS m FROM k)
    SELECT entity, date, label FROM r WHERE label = 1 OR rn <= (SELECT m FROM c)""", ("labelled",))
def _(spark, sf):
    key = F.col("entity") * 100000 + F.unix_date("date")
    return sp.undersample(_label_rows(spark, sf), "label", key, ratio=2)


@query("g4_oversample", "entity:i date:d label:i copies:i", f"""
    WITH k AS (SELECT entity, date, label, {KEY} AS key, {mix_sql(KEY)} AS h FROM labelled),
    p AS (SELECT *, row_number() OVER (ORDER BY h, key) - 1 AS pos FROM k WHERE label = 1),
    d AS (SELECT h % (SELECT count(*) FROM p) AS pos FROM k WHERE label = 0)
    SELECT entity, date, label, 1 AS copies FROM k WHERE label = 0
    UNION ALL SELECT entity, date, label, count(*) FROM d JOIN p ON p.pos = d.pos GROUP BY 1, 2, 3""", ("labelled",))
def _(spark, sf):
    key = F.col("entity") * 100000 + F.unix_date("date")
    both = sp.oversample(_label_rows(spark, sf), "label", key)
    return both.groupBy("entity", "date", "label").agg(F.count(F.lit(1)).alias("copies"))


_SMOTE = ("v", "qty", "disc", "tax")


def _smote_rows(spark, sf):
    train = panels.splits_by_year(panels.labelled(spark, sf)).filter("split = 'train'")
    return materialise(train.select("entity", "date", "label", *_SMOTE), "smote")


@query("g5_neighbours", "key:i rank:i neighbour:i distance:f", f"""
    WITH p AS (SELECT {KEY} AS key, v, qty, disc, tax FROM labelled WHERE label = 1 AND year(date) <= 1999),
    t AS (SELECT a.key, min(((a.v - b.v) * (a.v - b.v) + (a.qty - b.qty) * (a.qty - b.qty) + (a.disc - b.disc) * (a.disc - b.disc)
                             + (a.tax - b.tax) * (a.tax - b.tax), b.key), 5) AS best FROM p a JOIN p b ON a.key <> b.key GROUP BY 1)
    SELECT key, r AS rank, best[r][2] AS neighbour, sqrt(best[r][1]) AS distance FROM t, range(1, 6) x(r) WHERE r <= len(best)""", ("labelled",))
def _(spark, sf):
    key = F.col("entity") * 100000 + F.unix_date("date")
    rows = _smote_rows(spark, sf).filter("label = 1").withColumn("key", key)
    found = nearest_rows(rows, "key", list(_SMOTE), 5).select("key", F.posexplode("neighbours").alias("rank", "n"))
    return found.select("key", (F.col("rank") + 1).alias("rank"), F.col("n.key").alias("neighbour"), F.col("n.distance").alias("distance"))


@query("g5_smote", "label:i draw:i base:i neighbour:i gap:f v:f qty:f disc:f tax:f", f"""
    WITH a AS (SELECT {KEY} AS key, label, v, qty, disc, tax FROM labelled WHERE year(date) <= 1999),
    p AS (SELECT *, row_number() OVER (ORDER BY {mix_sql('key')}, key) - 1 AS pos FROM a WHERE label = 1),
    n AS (SELECT x.key, min(((x.v - y.v) * (x.v - y.v) + (x.qty - y.qty) * (x.qty - y.qty) + (x.disc - y.disc) * (x.disc - y.disc)
                             + (x.tax - y.tax) * (x.tax - y.tax), y.key), 5) AS best FROM p x JOIN p y ON x.key <> y.key GROUP BY 1),
    d AS (SELECT t AS draw, {mix_sql('t')} % (SELECT count(*) FROM p) AS pos, {mix_sql('t', 43)} AS pick, {mix_sql('t', 44)} / 4294967296.0::DOUBLE AS gap
          FROM range((SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) FROM a)) r(t)),
    j AS (SELECT draw, gap, p.key AS base, best[pick % len(best) + 1][2] AS neighbour, p.v, p.qty, p.disc, p.tax
          FROM d JOIN p USING (pos) JOIN n ON n.key = p.key)
    SELECT label, NULL AS draw, NULL AS base, NULL AS neighbour, NULL AS gap, v, qty, disc, tax FROM a
    UNION ALL SELECT 1, draw, base, neighbour, gap, j.v + gap * (p.v - j.v), j.qty + gap * (p.qty - j.qty), j.disc + gap * (p.disc - j.disc),
      j.tax + gap * (p.tax - j.tax) FROM j JOIN p ON p.key = j.neighbour""", ("labelled",))
def _(spark, sf):
    key = F.col("entity") * 100000 + F.unix_date("date")
    return sp.smote(_smote_rows(spark, sf), "label", key, list(_SMOTE))


@query("g6_class_weights", "n:i positives:i weight_0:f weight_1:f ratio:f double_ratio:f capped_ratio:f", """
    SELECT count(*) AS n, sum(label) AS positives, count(*) / (2.0 * (count(*) - sum(label))) AS weight_0,
           count(*) / (2.0 * sum(label)) AS weight_1, (count(*) - sum(label)) / sum(label) AS ratio,
           2.0 * (count(*) - sum(label)) / sum(label) AS double_ratio,
           least((count(*) - sum(label)) / sum(label), 50.0) AS capped_ratio FROM labelled""", ("labelled",))
def _(spark, sf):
    return sp.class_weights(panels.labelled(spark, sf), "label")


@query("g7_time_folds", "entity:i date:d fold:i", """
    WITH o AS (SELECT entity, date, row_number() OVER (ORDER BY date, entity) - 1 AS spot, count(*) OVER () AS n
               FROM supplier_daily)
    SELECT entity, date, CASE WHEN spot < n - 3 * (n // 4) THEN 0 ELSE (spot - (n - 3 * (n // 4))) // (n // 4) + 1 END AS fold
    FROM o""", ("supplier_daily",))
def _(spark, sf):
    return sp.time_folds(supplier_daily(spark, sf).select("entity", "date"), SUPPLIER)


@query("g7_day_folds", "entity:i date:d fold:i", """
    WITH d AS (SELECT date, count(*) AS c FROM supplier_daily GROUP BY 1),
    s AS (SELECT date, coalesce(sum(c) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM d),
    t AS (SELECT count(*) AS m FROM supplier_daily)
    SELECT entity, date, CASE WHEN spot < m - 3 * (m // 4) THEN 0
      ELSE least((spot - (m - 3 * (m // 4))) // (m // 4) + 1, 3) END AS fold
    FROM supplier_daily JOIN s USING (date), t""", ("supplier_daily",))
def _(spark, sf):
    return sp.time_folds(supplier_daily(spark, sf).select("entity", "date"), SUPPLIER, whole_days=True)


@query("g8_development", "split:s n:i", f"""
    SELECT {SPLIT_SQL} AS split, count(*) AS n FROM supplier_daily WHERE year(date) <= 2000 GROUP BY 1""",
       ("supplier_daily",))
def _(spark, sf):
    return sp.development(panels.splits_by_year(supplier_daily(spark, sf))).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"))
