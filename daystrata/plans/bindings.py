"""Panels derived from the given tables, each as a DataFrame and as a SQL CTE.

Values are floored to multiples of 1/16, so that sums are exact in any order and
both engines agree to the last bit. Raw rows are reduced to the daily grain
first; partial aggregation makes a hot key cheap, and afterwards an entity has
at most one row per calendar day.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daystrata.spec import LabelRule, PanelSpec, RelativeRule

BASE_START, BASE_END = "1995-01-01", "1999-12-31"

SUPPLIER = PanelSpec(
    variables=("v", "qty", "disc", "tax"), current=("v", "qty", "disc", "tax"),
    rule=LabelRule(plains_value=70.0, departure=4.5, override=95.0, coastal_value=60.0, min_run=2),
    relative=RelativeRule(floor=50.0, first_month=3, last_month=10, quantile=0.6, min_run=3),
)
ORDERS = replace(SUPPLIER, variables=("v",), current=("v",), rule=LabelRule(255.0, 4.5, 300.0, 250.0, 2))
EVENTS = replace(SUPPLIER, variables=("v",), current=("v",), rule=LabelRule(60.0, 4.5, 150.0, 50.0, 2))


# Declared schemas: no footer-reading job per table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
                " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _whole(value):
    """Nearest integer of a non-negative double (``round`` would go through BigDecimal per row)."""
    return F.floor(value + 0.5)


def _cents(column: str):
    return _whole(F.col(column) * 100)


def _sixteenths(total, unit: int = 1):
    """floor(16 * mean / unit) / 16 by integer division."""
    return F.expr(f"({total}) div ({unit} * n)") / 16.0


def orders_daily(spark, sf) -> DataFrame:
    """entity = order priority, v = mean order price in thousands."""
    return (table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("entity"),
                                               F.to_date("o_orderdate").alias("date"))
            .agg(F.sum(_cents("o_totalprice")).alias("c"), F.count(F.lit(1)).alias("n"))
            .select("entity", "date", _sixteenths("c", 6250).alias("v"), "n"))


def supplier_daily(spark, sf) -> DataFrame:
    """entity = supplier; mean price in thousands, quantity, discount and tax percent."""
    return (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity"),
                                                 F.to_date("l_shipdate").alias("date"))
            .agg(F.sum(_cents("l_extendedprice")).alias("c"), F.sum(_whole(F.col("l_quantity"))).alias("q"),
                 F.sum(_cents("l_discount")).alias("d"), F.sum(_cents("l_tax")).alias("t"),
                 F.count(F.lit(1)).alias("n"))
            .select("entity", "date", _sixteenths("c", 6250).alias("v"), _sixteenths("q * 16").alias("qty"),
                    _sixteenths("d * 16").alias("disc"), _sixteenths("t * 16").alias("tax"), "n"))


def events_daily(spark, sf) -> DataFrame:
    """entity = user, v = sum of event values."""
    return (table(spark, sf, "events").groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"))
            .agg(F.sum(_cents("value")).alias("c"), F.count(F.lit(1)).alias("n"))
            .select("entity", "date", (F.expr("c * 4 div 25") / 16.0).alias("v"), "n"))


def supplier_dim(spark, sf) -> DataFrame:
    """Entity registry: name, region, zone, coordinates."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 x 5 rows
    return (table(spark, sf, "supplier").join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.col("n_name").alias("state"),
                    F.col("r_name").alias("region"),
                    F.when(F.col("r_name").isin("EUROPE", "ASIA"), "coastal").otherwise("plains").alias("region_type"),
                    (F.col("s_nationkey") * 1.5).alias("latitude"), (F.col("s_nationkey") * 2.5).alias("longitude")))


def scored(spark, sf) -> DataFrame:
    """Score table (entity, date, year, label, p): a mixture of quantity and price."""
    p = F.expr("(floor(l_quantity + 0.5) * 12000 + floor(l_extendedprice * 100 + 0.5) * 4 div 105)") / 1000000.0
    label = (F.col("l_quantity") >= 30) & (F.col("l_extendedprice") >= 30000) & (F.col("l_discount") >= 0.03)
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("entity"), F.to_date("l_shipdate").alias("date"),
        F.year("l_shipdate").alias("year"), label.cast("int").alias("label"), p.alias("p"),
        F.col("l_orderkey"), F.col("l_linenumber"))


def doc_scores(spark, sf) -> DataFrame:
    """Score table with ties: label = toxic, score = length of the document."""
    return (table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
            .select("doc_id", F.col("lang").alias("entity"), F.col("toxic").cast("int").alias("label"),
                    (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p")))


CTES: dict[str, str] = {
    "orders_daily": """
        SELECT entity, date, ((c // (6250 * n)) / 16.0)::DOUBLE AS v, n FROM (
          SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS date,
                 CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c, count(*) AS n
          FROM orders GROUP BY 1, 2)""",
    "supplier_daily": """
        SELECT entity, date, ((c // (6250 * n)) / 16.0)::DOUBLE AS v, ((q * 16 // n) / 16.0)::DOUBLE AS qty,
               ((d * 16 // n) / 16.0)::DOUBLE AS disc, ((t * 16 // n) / 16.0)::DOUBLE AS tax, n FROM (
          SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date,
                 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c,
                 CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS q,
                 CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d,
                 CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS t, count(*) AS n
          FROM lineitem GROUP BY 1, 2)""",
    "events_daily": """
        SELECT entity, date, ((c * 4 // 25) / 16.0)::DOUBLE AS v, n FROM (
          SELECT user_id AS entity, CAST(ts AS DATE) AS date,
                 CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c, count(*) AS n
          FROM events GROUP BY 1, 2)""",
    "supplier_dim": """
        SELECT s_suppkey AS entity, s_name AS name, n_name AS state, r_name AS region,
               CASE WHEN r_name IN ('EUROPE', 'ASIA') THEN 'coastal' ELSE 'plains' END AS region_type,
               s_nationkey * 1.5::DOUBLE AS latitude, s_nationkey * 2.5::DOUBLE AS longitude
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "scored": """
        SELECT l_returnflag AS entity, CAST(l_shipdate AS DATE) AS date, year(l_shipdate) AS year,
               CASE WHEN l_quantity >= 30 AND l_extendedprice >= 30000 AND l_discount >= 0.03 THEN 1 ELSE 0 END AS label,
               (CAST(round(l_quantity) AS BIGINT) * 12000
                + CAST(round(l_extendedprice * 100) AS BIGINT) * 4 // 105)::DOUBLE / 1000000.0::DOUBLE AS p,
               l_orderkey, l_linenumber
        FROM lineitem""",
    "doc_scores": """
        SELECT doc_id, lang AS entity, toxic AS label, n_chars::DOUBLE / (n_chars + 1000.0::DOUBLE) AS p
        FROM labels JOIN documents USING (doc_id)""",
    # climatology of the supplier panel: doy means -> all days -> circular mean
    "doy_means": f"""
        SELECT entity, dayofyear(date) AS doy, avg(v) AS mean FROM supplier_daily
        WHERE date BETWEEN DATE '{BASE_START}' AND DATE '{BASE_END}' GROUP BY 1, 2""",
    "filled": """
        SELECT e.entity, d.doy,
          CASE WHEN a.doy IS NULL THEN b.mean WHEN b.doy IS NULL THEN a.mean WHEN a.doy = b.doy THEN a.mean
               ELSE a.mean + (b.mean - a.mean) * (d.doy - a.doy)::DOUBLE / (b.doy - a.doy) END AS mean
        FROM (SELECT DISTINCT entity FROM doy_means) e
        CROSS JOIN (SELECT unnest(range(1, 367)) AS doy) d
        ASOF LEFT JOIN doy_means a ON a.entity = e.entity AND a.doy <= d.doy
        ASOF LEFT JOIN doy_means b ON b.entity = e.entity AND b.doy >= d.doy""",
    "normals": """
        SELECT entity, doy, avg(mean) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)
               AS normal, pos FROM (
          SELECT entity, doy, mean, doy AS pos FROM filled
          UNION ALL SELECT entity, doy, mean, doy - 366 FROM filled WHERE doy > 351
          UNION ALL SELECT entity, doy, mean, doy + 366 FROM filled WHERE doy <= 15)
        QUALIFY pos BETWEEN 1 AND 366""",
    "departed": """
        SELECT s.*, c.normal, s.v - c.normal AS departure, m.region_type, m.latitude, m.longitude
        FROM supplier_daily s LEFT JOIN normals c ON c.entity = s.entity AND c.doy = dayofyear(s.date)
        LEFT JOIN supplier_dim m ON m.entity = s.entity""",
    "qualified": """
        SELECT *, CASE WHEN CASE WHEN region_type = 'coastal' THEN v >= 60 AND departure >= 4.5
                                 ELSE (v >= 70 AND departure >= 4.5) OR v >= 95 END THEN 1 ELSE 0 END AS qualifying
        FROM departed""",
    "islanded": """
        SELECT *, sum(change) OVER (PARTITION BY entity ORDER BY date) AS island FROM (
          SELECT *, CASE WHEN qualifying = lag(qualifying) OVER (PARTITION BY entity ORDER BY date) THEN 0 ELSE 1 END
                 AS change FROM qualified)""",
    "sized": """
        SELECT *, count(*) OVER i AS len, min(date) OVER i AS first_day, max(date) OVER i AS last_day,
               count(*) OVER (PARTITION BY entity, island ORDER BY date) AS sofar
        FROM islanded WINDOW i AS (PARTITION BY entity, island)""",
    "labelled": """
        SELECT *, CASE WHEN label = 1 THEN serial ELSE 0 END AS event_id,
               CASE WHEN label = 1 THEN first_day END AS event_start, CASE WHEN label = 1 THEN last_day END AS event_end,
               CASE WHEN label = 1 THEN len ELSE 0 END AS event_length,
               CASE WHEN qualifying = 1 AND sofar >= 2 THEN 1 ELSE 0 END AS label_known
        FROM (SELECT *, sum(label * change) OVER (PARTITION BY entity ORDER BY date) AS serial FROM (
          SELECT *, CASE WHEN qualifying = 1 AND len >= 2 THEN 1 ELSE 0 END AS label FROM sized))""",
}
NEEDS: dict[str, tuple[str, ...]] = {
    "doy_means": ("supplier_daily",), "filled": ("doy_means",), "normals": ("filled",),
    "departed": ("supplier_daily", "normals", "supplier_dim"), "qualified": ("departed",), "islanded": ("qualified",),
    "sized": ("islanded",), "labelled": ("sized",),
}


def with_clause(names: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, ()):
            visit(need)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    return "WITH " + ", ".join(f"{n} AS ({' '.join(CTES[n].split())})" for n in order)
