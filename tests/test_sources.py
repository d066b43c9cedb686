import gzip
import json

from conftest import days
from pyspark.sql import functions as F

from daystrata.sources import files as fs
from daystrata.spec import PanelSpec

SPEC = PanelSpec()


def test_csv_round_trip_with_nan(spark, tmp_path):
    path = tmp_path / "a.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("entity,date,v\na,2000-01-01,1.5\na,2000-01-02,nan\n")
    df = fs.read_csv_panel(spark, str(path), "entity string, date date, v double")
    assert [r.v for r in df.orderBy("date").collect()] == [1.5, None]
    fs.write_csv(df, str(tmp_path / "out"))
    assert fs.read_csv_panel(spark, str(tmp_path / "out"), df.schema.simpleString()[7:-1].replace(":", " ")).count() == 2


def test_payload_guard_and_rows(spark):
    good = {"daily": {"time": [str(d) for d in days(31)], "v": [float(i) for i in range(31)]}}
    short = {"daily": {"time": [str(d) for d in days(30)], "v": [0.0] * 30}}
    odd = {"daily": {"time": [str(d) for d in days(31)], "v": [0.0] * 30}}
    none = {"daily": {"time": [str(d) for d in days(31)]}}
    rows = [(i, json.dumps(p)) for i, p in enumerate((good, short, odd, none))] + [(9, "broken")]
    parsed = fs.parse_payloads(spark.createDataFrame(rows, "entity int, text string"), "text", ["v"])
    out = fs.payload_rows(parsed, ["entity"], ["v"]).orderBy("date").collect()
    assert len(out) == 31 and out[3].v == 3.0 and out[3].date == days(31)[3]
    assert sorted(r.entity for r in fs.rejected_payloads(parsed).collect()) == [1, 2, 3, 9]


def test_registry_keeps_file_order_and_hides_the_status(spark, tmp_path):
    path = tmp_path / "cities.json"
    path.write_text(json.dumps({"z": {"name": "Z", "lat": 1.0, "lon": 2.0, "model_status": "x", "dataset_region": "one"}, "a": {"name": "A"}}))
    r = fs.read_registry(spark, str(path)).orderBy("code").collect()
    assert [(x.entity, x.code) for x in r] == [("z", 0), ("a", 1)] and "model_status" not in r[0].asDict()


def test_log_appends_and_skips_bad_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("a", 0.5)], "entity string, p double")
    fs.append_log(df, path)
    fs.append_log(df, path)
    (tmp_path / "log" / "bad.json").write_text("{not json}\n")
    assert fs.read_log(spark, path, "entity string, p double").count() == 2
    rows = str(tmp_path / "rows")
    fs.append_rows(df, rows)
    fs.append_rows(df, rows)
    assert spark.read.parquet(rows).count() == 2


def test_promotion_replaces_good_entities_only(spark, tmp_path):
    path = str(tmp_path / "panel")
    schema = "entity string, date date, v double"
    d = days(1)[0]
    spark.createDataFrame([("a", d, 1.0), ("b", d, 1.0), ("c", d, 1.0)], schema).write.partitionBy("entity").parquet(path)
    staged = spark.createDataFrame([("a", d, 2.0), ("b", d, None)], schema)
    refused = fs.promote(staged, path, SPEC, ["v"]).collect()
    now = {r.entity: r.v for r in spark.read.schema(schema).parquet(path).collect()}
    assert now == {"a": 2.0, "b": 1.0, "c": 1.0} and [(r.entity, r.null_columns) for r in refused] == [("b", ["v"])]


def test_fingerprint_ignores_order(spark):
    from daystrata.operators.quality import fingerprint
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a, b = fingerprint(df).first(), fingerprint(df.orderBy(F.desc("id")).repartition(7)).first()
    assert a == b and fingerprint(df.withColumn("v", F.col("v") + 1)).first() != a


def test_normals_are_rounded_and_splits_partitioned(spark, tmp_path):
    fs.save_normals(spark.createDataFrame([("a", 1, 1.23456789)], "entity string, doy int, normal double"), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).first().normal == 1.234568
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "entity string, split string")
    fs.save_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'test'").first().entity == "b"


def test_bucketed_panel_needs_no_shuffle_for_windows(spark):
    from daystrata.operators import runs
    rows = [(e, d, 1.0, int(i % 3 > 0)) for e in "abcd" for i, d in enumerate(days(20))]
    df = spark.createDataFrame(rows, "entity string, date date, departure double, qualifying int")
    fs.save_bucketed(df, "panel_bucketed", SPEC, 4)
    out = runs.label_runs(spark.table("panel_bucketed"), SPEC, 2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 80
