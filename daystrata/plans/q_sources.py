"""Queries: what is written and read back."""

from pyspark.sql import functions as F

from daystrata.operators import climatology as cl
from daystrata.operators import splits as sp
from daystrata.plans import panels
from daystrata.plans.bindings import BASE_END, BASE_START, SUPPLIER, supplier_daily, supplier_dim, table
from daystrata.plans.q_quality import HOLED, holed
from daystrata.plans.registry import query
from daystrata.sources import files as fs
from daystrata.sources.commits import CommittedTable, promote_once

PANEL = "entity bigint, date date, v double, qty double"


class Crash(Exception):
    """A commit that breaks after its rows are written, before it is published."""


def _crash(staged):
    raise Crash(staged.schema)


def _broken(commit, *args, **named):
    try:
        commit(*args, check=_crash, **named)
    except Crash:
        return
    raise AssertionError("published a commit that its check refused")


@query("a1_csv_panel", "entity:i date:d v:f qty:f", "SELECT entity, date, v, qty FROM supplier_daily", ("supplier_daily",))
def _(spark, sf):
    path = fs.scratch_folder(spark, "csv")
    fs.write_csv(supplier_daily(spark, sf).select("entity", "date", "v", "qty"), path, "none")
    return fs.read_csv_panel(spark, path, PANEL)


@query("a2_gzip_csv", "entity:i date:d v:f disc:f tax:f", f"WITH {HOLED} SELECT entity, date, v, disc, tax FROM holed", ("supplier_daily",))
def _(spark, sf):
    """Missing values as NaN in one column and empty in the other; both come back as NULL."""
    path = fs.scratch_folder(spark, "gzip")
    rows = holed(spark, sf).select("entity", "date", "v", F.coalesce("disc", F.lit(float("nan"))).alias("disc"), "tax")
    fs.write_csv(rows, path)
    return fs.read_csv_panel(spark, path, "entity bigint, date date, v double, disc double, tax double")


@query("a4_panel_folders", "entity:i date:d region_type:s v:f", """
    SELECT s.entity, date, region_type, v FROM supplier_daily s JOIN supplier_dim d ON d.entity = s.entity""",
       ("supplier_daily", "supplier_dim"))
def _(spark, sf):
    path = fs.scratch_folder(spark, "panel")
    rows = supplier_daily(spark, sf).join(supplier_dim(spark, sf).select("entity", "region_type"), "entity")
    fs.write_panel(rows.select("entity", "date", "v", "region_type"), path, "region_type")
    return spark.read.schema("entity bigint, date date, v double, region_type string").parquet(path)


@query("a7_registry_codes", "entity:s code:i name:s region:s hidden:b suppliers:i", """
    SELECT 'n' || n_nationkey AS entity, row_number() OVER (ORDER BY n_name) - 1 AS code, n_name AS name, r_name AS region, TRUE AS hidden,
           (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    """The 25 nations as a JSON object in the order of their names; suppliers take their code from it."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fields = F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.lit("hidden").alias("model_status"))
    entry = F.concat(F.lit('"n'), F.col("n_nationkey").cast("string"), F.lit('": '), F.to_json(fields))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n_name", entry.alias("e")))), lambda x: x["e"])
    path = fs.scratch_folder(spark, "registry")
    nation.agg(F.concat(F.lit("{"), F.array_join(listed, ", "), F.lit("}")).alias("value")).write.text(path)
    registry = fs.read_registry(spark, path)
    suppliers = table(spark, sf, "supplier").groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("entity")).agg(
        F.count(F.lit(1)).alias("suppliers"))
    return registry.join(suppliers, "entity", "left").withColumns({
        "hidden": F.lit("model_status" not in registry.columns), "suppliers": F.coalesce("suppliers", F.lit(0))})


# Compared to four digits: means that lie half-way between two sixth digits go either way by the order of their sum.
@query("a8_saved_normals", "entity:i doy:i normal:g", "SELECT entity, doy, round(normal, 6) AS normal FROM normals", ("normals",))
def _(spark, sf):
    path = fs.scratch_folder(spark, "normals")
    fs.save_normals(cl.normals(supplier_daily(spark, sf), SUPPLIER, BASE_START, BASE_END), path)
    return spark.read.schema("entity bigint, doy int, normal double").parquet(path)


@query("a9_json_log", "entity:i date:d v:f times:i", """
    SELECT entity, date, v, CASE WHEN year(date) > 1999 THEN 2 ELSE 1 END AS times FROM supplier_daily""", ("supplier_daily",))
def _(spark, sf):
    """The log of all days, of the later ones once more, and of lines that are no JSON."""
    path, rows = fs.scratch_folder(spark, "log"), supplier_daily(spark, sf).select("entity", "date", "v")
    fs.append_log(rows, path)
    fs.append_log(rows.filter(F.year("date") > 1999), path)
    rows.select(F.concat(F.lit("{cut off at "), F.col("entity").cast("string")).alias("value")).write.mode("append").text(path)
    return fs.read_log(spark, path, "entity bigint, date date, v double").groupBy("entity", "date", "v").agg(F.count(F.lit(1)).alias("times"))


@query("a10_log", "entity:i commit:i n:i v:f", """
    WITH c AS (SELECT unnest([1, 2, 4]) AS commit)
    SELECT entity, commit, count(*) AS n, sum(v) AS v FROM supplier_daily, c WHERE (commit = 1) = (year(date) <= 1999) GROUP BY 1, 2""",
       ("supplier_daily",))
def _(spark, sf):
    """Early days, late days, late days logged again on purpose; one commit repeated, one broken and repeated, one left broken."""
    rows = supplier_daily(spark, sf).select("entity", "date", "v")
    log, early = CommittedTable(spark, fs.scratch_folder(spark, "commits")), F.year("date") <= 1999
    log.commit(rows.filter(early), 1)
    _broken(log.commit, rows, 2)
    log.commit(rows.filter(~early), 2)
    assert not log.commit(rows, 2)
    _broken(log.commit, rows, 3)
    log.commit(rows.filter(~early), 4)
    return log.read(rows.schema).groupBy("entity", "commit").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query("a13_promote", "entity:i refused:b n:i v:f", """
    SELECT s.entity, region_type = 'coastal' AS refused, count(*) AS n, sum(v + CASE region_type WHEN 'coastal' THEN 0 ELSE 1 END) AS v
    FROM supplier_daily s JOIN supplier_dim d ON d.entity = s.entity GROUP BY 1, 2""", ("supplier_daily", "supplier_dim"))
def _(spark, sf):
    """All entities staged with other values; those of the coast lack a column and keep their old rows."""
    rows = supplier_daily(spark, sf).select("entity", "date", "v", "disc")
    panel = CommittedTable(spark, fs.scratch_folder(spark, "promoted"))
    panel.commit(rows, 1)
    zone = supplier_dim(spark, sf).select("entity", "region_type")
    staged = rows.join(zone, "entity").select("entity", "date", (F.col("v") + 1).alias("v"), F.expr("if(region_type = 'coastal', null, disc)").alias("disc"))
    _broken(panel.commit, staged, 2)
    refused = promote_once(staged, panel, 2, SUPPLIER, ["v", "disc"])
    promote_once(staged.withColumn("v", F.col("v") * 2), panel, 2, SUPPLIER, ["v", "disc"])
    now = panel.current(rows.schema, "entity").groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    return now.join(refused, "entity", "left").withColumn("refused", F.col("null_columns").isNotNull())


@query("a14_splits", "split:s entity:i date:d v:f qty:f label:i", """
    SELECT CASE WHEN year(date) <= 1999 THEN 'train' WHEN year(date) <= 2000 THEN 'val' ELSE 'test' END AS split, entity, date, v, qty, label
    FROM labelled""", ("labelled",))
def _(spark, sf):
    """Features, target and keys of each split, read apart from one committed dataset and joined again."""
    rows = panels.splits_by_year(panels.labelled(spark, sf)).select("entity", "date", "split", "v", "qty", "label")
    saved = CommittedTable(spark, fs.scratch_folder(spark, "splits"))
    _broken(saved.commit, rows, 1, "split")
    saved.commit(rows, 1, "split")
    assert not saved.commit(rows.limit(0), 1, "split")
    back = saved.read(rows.schema)
    parts = [sp.reassemble(*sp.roles(back.withColumnRenamed("label", SUPPLIER.target), SUPPLIER, ["v", "qty"], s), SUPPLIER)
             .withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return fs.combine(parts).withColumnRenamed(SUPPLIER.target, "label")
