import numpy as np
import pytest
from conftest import days
from pyspark.sql import functions as F

from daystrata.operators import contract as ct
from daystrata.operators import drift as dr
from daystrata.operators import quality as qa
from daystrata.operators import rules as rl
from daystrata.operators import validate as vd
from daystrata.functions.scalar import nan_to_null, risk_level
from daystrata.spec import PanelSpec

SPEC = PanelSpec()


def test_gaps_and_missing_dates(spark):
    d = days(8)
    rows = [("a", x) for x in (d[1], d[2], d[4], d[4], d[6])]
    df = spark.createDataFrame(rows, "entity string, date date")
    gaps = {(r.date, r.days) for r in qa.date_gaps(df, SPEC).collect()}
    assert gaps == {(d[4], 2), (d[4], 0), (d[6], 2)}
    lost = sorted(r.date for r in qa.missing_dates(df.distinct(), SPEC, str(d[0]), str(d[7])).collect())
    assert lost == [d[0], d[3], d[5], d[7]]
    assert [r.copies for r in qa.duplicate_keys(df, ["entity", "date"]).collect()] == [2]


def test_nan_is_missing(spark):
    df = nan_to_null(spark.createDataFrame([(1, float("nan")), (2, None), (3, 4.0)], "id int, v double"))
    assert df.filter("v >= 1").count() == 1 and df.filter("v IS NULL").count() == 2


def test_record_validation(spark):
    rows = [(" New Delhi ", "2024-05-20", "41.5", "10"), ("delhi", "2024-13-01", "41", "1"), ("mumbai", "2035-01-01", "60", "1"),
            ("paris", "2024-01-01", "x", None), ("lucknow", "2024-01-01", "NaN", "1")]
    df = spark.createDataFrame(rows, "city_key string, date string, temperature_2m_max string, precipitation_sum string")
    out = vd.validate(df, "city_key", "date", ["temperature_2m_max", "precipitation_sum"]).collect()
    assert [r.valid for r in out] == [True, False, True, False, False]
    assert out[0].entity_clean == "delhi"
    assert out[1].errors == ["bad_date:2024-13-01"]
    assert out[2].warnings == ["year_out_of_range:2035", "out_of_range:temperature_2m_max"]
    assert out[3].errors == ["unknown_entity:paris", "missing_value:precipitation_sum", "not_numeric:temperature_2m_max"]
    assert out[4].errors == ["missing_value:temperature_2m_max"]
    b = vd.batch_outcome(vd.validate(df, "city_key", "date", ["temperature_2m_max", "precipitation_sum"])).first()
    assert (b.rows, b.valid_rows, b.valid) == (5, 2, False)


def test_absent_column_stops_the_checks(spark):
    df = spark.createDataFrame([("delhi",)], "city_key string")
    r = vd.validate(df, "city_key", "date", ["temperature_2m_max"]).first()
    assert not r.valid and r.errors == ["missing_field:date,temperature_2m_max"]


def test_contract_findings(spark):
    df = spark.createDataFrame([(1.0, None, "x", 5.0)], "b double, a double, t string, z double")
    found = {(r.severity, r.finding): r.columns for r in ct.check(df, ["a", "b", "t"]).collect()}
    assert found == {("warning", "extra"): ["z"], ("warning", "order"): [], ("error", "not_numeric"): ["t"], ("error", "null"): ["a"]}
    assert [r.finding for r in ct.check(df, ["a", "q"]).collect()] == ["missing", "extra"]


def test_risk_levels(spark):
    p = [0.0, 0.29, 0.3, 0.59, 0.6, 0.79, 0.8, 1.0, -0.1, 1.1, float("nan")]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    assert [r[0] for r in df.select(risk_level(F.col("p"))).collect()] == [
        "LOW", "LOW", "MODERATE", "MODERATE", "HIGH", "HIGH", "EXTREME", "EXTREME", None, None, None]


@pytest.mark.parametrize("row, fired", [
    (("plains", 45.0, 20.0, 30.0, 0.0, 0.0, 0.1), {"RULE_01", "RULE_07"}),
    (("coastal", 40.0, 20.0, 30.0, 0.0, 0.0, 0.1), {"RULE_01", "RULE_07"}),
    (("plains", 40.0, 27.9, 37.0, 4.5, 1.5, 0.1), {"RULE_02", "RULE_04", "RULE_07"}),
    (("plains", 30.0, 28.0, None, None, None, 0.6), {"RULE_03", "RULE_05", "RULE_06", "RULE_07"}),
    (("plains", None, None, None, None, None, None), set()),
])
def test_rules(spark, row, fired):
    df = spark.createDataFrame([row], "zone string, tmax double, tmin double, roll7 double, dep double, z double, p double")
    df = rl.assess_risk(df, "p")
    r = rl.absolute_rules(*[F.col(c) for c in ("zone", "tmax", "tmin", "roll7", "dep", "z", "risk_level", "p")])
    out = rl.summarise(df.withColumn("rules", r)).first()
    assert set(out.triggered_ids) == fired and len(out.rules) == 7
    assert all((x.message != "") == x.triggered for x in out.rules)


def test_rule_severity(spark):
    df = rl.assess_risk(spark.createDataFrame([(0.8,), (0.6,), (0.35,), (0.1,)], "p double"), "p")
    none = F.lit(None).cast("double")
    r = rl.absolute_rules(F.lit("plains"), none, none, none, none, none, F.col("risk_level"), F.col("p"))
    out = rl.summarise(df.withColumn("rules", r)).collect()
    assert [x.highest_severity for x in out] == ["CRITICAL", "WARNING", "INFO", None]
    counts = rl.recommend(df, {}).groupBy("risk_level").count().collect()
    assert {x.risk_level: x["count"] for x in counts} == {"LOW": 3, "MODERATE": 5, "HIGH": 6, "EXTREME": 7}


def _drift_panel(spark, n, shift=None, start="2000-01-01", constant=False):
    rng = np.random.default_rng(1)
    rows = [("a", d, 7.0 if constant else float(rng.normal()) if shift is None else shift, float(i % 9)) for i, d in enumerate(days(n, start))]
    return spark.createDataFrame(rows, "entity string, date date, v double, w double")


def test_drift_levels(spark):
    base = dr.baseline(_drift_panel(spark, 1500), SPEC, ["v", "w"]).cache()
    short = dr.assess(_drift_panel(spark, 29, start="2005-01-01"), base, SPEC, ["v", "w"]).first()
    assert (short.status, short.sample_size, short.level) == ("insufficient_history", 29, None)
    moved = dr.assess(_drift_panel(spark, 35, 100.0, "2005-01-01"), base, SPEC, ["v", "w"]).first()
    assert moved.status == "available" and moved.level == "high_drift" and moved.drifting >= 1


def test_psi_against_numpy(spark):
    ref, new = _drift_panel(spark, 1500), _drift_panel(spark, 31, start="2005-01-01")
    base = dr.baseline(ref, SPEC, ["v"])
    got = dr.month_psi(new, base, SPEC, ["v"]).filter("month = 1").first().psi
    r = ref.filter("month(date) = 1").toPandas()["v"].to_numpy()
    n = new.filter("month(date) = 1").toPandas()["v"].to_numpy()
    edges = np.unique(np.quantile(r, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -1e308, 1e308
    e, o = np.histogram(r, edges)[0] / len(r), np.histogram(n, edges)[0] / len(n)
    e, o = np.clip(e, 1e-6, None), np.clip(o, 1e-6, None)
    assert got == pytest.approx(np.sum((o - e) * np.log(o / e)))


def test_constant_baseline_and_missing_month(spark):
    base = dr.baseline(_drift_panel(spark, 31, constant=True), SPEC, ["v"])
    b = base.first()
    assert list(b.edges) == [6.5, 7.5] and list(b.proportions) == [1.0]
    out = dr.feature_drift(dr.month_psi(_drift_panel(spark, 40, start="2005-02-01"), base, SPEC, ["v"]), SPEC).first()
    assert out.psi is None and out.level == "unavailable" and list(out.missing_months) == [2, 3]


@pytest.mark.parametrize("bins", [5, 20])
def test_psi_takes_the_bins_of_the_baseline(spark, bins):
    panel = _drift_panel(spark, 1500)
    base = dr.baseline(panel, SPEC, ["v", "w"], bins=bins).cache()
    assert base.filter("feature = 'v'").first().proportions.__len__() == bins
    assert all(abs(r.psi) < 1e-12 for r in dr.month_psi(panel, base, SPEC, ["v", "w"]).collect())
    assert {r.level for r in dr.feature_drift(dr.month_psi(panel, base, SPEC, ["v", "w"]), SPEC).collect()} == {"stable"}


def test_an_entity_outside_the_range_misses_every_date(spark):
    import datetime as dt
    from daystrata.operators import quality as qa
    d = lambda k: dt.date(2024, 1, k)
    df = spark.createDataFrame([("a", d(2)), ("a", d(4)), ("b", d(20)), ("c", d(1)), ("c", d(5))], "entity string, date date")
    got = {(r.entity, r.date.day) for r in qa.missing_dates(df, SPEC, "2024-01-01", "2024-01-05").collect()}
    assert got == {("a", 1), ("a", 3), ("a", 5), *(("b", k) for k in range(1, 6)), ("c", 2), ("c", 3), ("c", 4)}


def test_checklist_reports_absent_columns(spark):
    from daystrata.operators import quality as qa
    df = spark.createDataFrame([("a", "2024-01-01", 1.0, 0)], "entity string, date string, v double, target int")
    got = {r.check: (r.ok, r.value) for r in qa.checklist(df, SPEC, ["v", "gone"], 1, 5).collect()}
    assert got["feature_count"] == (False, 1) and got["complete_features"] == (True, 0) and got["unique_keys"] == (True, 0)


def test_null_keys_are_not_totals(spark):
    from daystrata.operators import explore as ex
    df = spark.createDataFrame([("train", None, 1), ("train", "x", 0)], "split string, entity string, label int")
    rows = [(r.split, r.entity, r.total) for r in ex.class_balance(df, "label", ["split", "entity"]).collect()]
    assert sorted(rows, key=str) == sorted([("train", None, 1), ("train", "x", 1), ("train", "all", 2), ("all", "all", 2)], key=str)


def test_student_tail(spark):
    from daystrata.functions.student import two_sided_p
    known = [(12.706204736, 1, 0.05), (4.30265273, 2, 0.05), (2.570581836, 5, 0.05), (2.228138852, 10, 0.05), (1.984467455, 98, 0.05), (0.0, 7, 1.0)]
    df = spark.createDataFrame([(t, n) for t, n, _ in known], "t double, n int")
    got = [r[0] for r in df.select(two_sided_p(F.col("t"), F.col("n"))).collect()]
    assert got == pytest.approx([p for *_, p in known], abs=1e-8)
    odd = spark.createDataFrame([(float("inf"), 3), (None, 3), (1.0, 0), (1.0, None)], "t double, n int")
    assert [r[0] for r in odd.select(two_sided_p(F.col("t"), F.col("n"))).collect()] == [0.0, None, None, None]


def test_all_bad_fields_are_named(spark):
    from daystrata.operators import validate as vd
    fields = [f"f{i}" for i in range(14)]
    df = spark.createDataFrame([("delhi", "2020-01-01", *[None] * 14)], "c string, d string, " + ", ".join(f"{f} string" for f in fields))
    errors = vd.validate(df, "c", "d", fields).first().errors
    assert errors == ["missing_value:" + ",".join(fields)]


def test_bins_are_counted_without_their_edges(spark):
    ref, new = _drift_panel(spark, 1500), _drift_panel(spark, 31, start="2005-01-01")
    out = dr.month_psi(new, dr.baseline(ref, SPEC, ["v", "w"]), SPEC, ["v", "w"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "first(edges" not in plan
    assert out.count() == 2 and out.filter("psi IS NULL").count() == 0
