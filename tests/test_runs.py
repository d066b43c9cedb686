from dataclasses import replace

import pytest
from conftest import days
from pyspark.sql import functions as F

from daystrata.operators import quality, runs
from daystrata.operators import features as ft
from daystrata.spec import PanelSpec

SPEC = PanelSpec()
FLAGS = [1, 1, 0, 1, 1, 1, 0, 1, 0, 1, 1, 1]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [("a", d, float(f), f, 1.0 * i) for i, (d, f) in enumerate(zip(days(12), FLAGS))]
    rows += [("b", d, 0.0, 0, 0.0) for d in days(12)]
    return spark.createDataFrame(rows, "entity string, date date, v double, qualifying int, departure double").repartition(3)


@pytest.mark.parametrize("least, labels, ids, lengths", [
    (2, [1, 1, 0, 1, 1, 1, 0, 0, 0, 1, 1, 1], [1, 1, 0, 2, 2, 2, 0, 0, 0, 3, 3, 3], [2, 2, 0, 3, 3, 3, 0, 0, 0, 3, 3, 3]),
    (3, [0, 0, 0, 1, 1, 1, 0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1, 0, 0, 0, 2, 2, 2], [0, 0, 0, 3, 3, 3, 0, 0, 0, 3, 3, 3]),
])
def test_minimum_run(panel, least, labels, ids, lengths):
    out = runs.label_runs(panel, SPEC, least).orderBy("entity", "date").collect()
    a = [r for r in out if r.entity == "a"]
    assert [r.label for r in a] == labels
    assert [r.event_id for r in a] == ids
    assert [r.event_length for r in a] == lengths
    assert all(r.label == 0 and r.event_start is None for r in out if r.entity == "b")


def test_known_label_waits_for_the_run(panel):
    a = runs.label_runs(panel, SPEC, 3).filter("entity = 'a'").orderBy("date").collect()
    assert [r.label_known for r in a] == [0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1]


def test_statistics_keep_entities_without_events(panel):
    s = {r.entity: r for r in runs.event_stats(runs.label_runs(panel, SPEC, 2), SPEC).collect()}
    assert (s["a"].events, s["a"].max_length, s["a"].isolated_days) == (3, 3, 1)
    assert (s["b"].events, s["b"].max_length, s["b"].mean_length) == (0, 0, 0.0)


def test_examples_pick_the_first_longest_event(panel):
    e = {r.kind: r.date for r in runs.examples(runs.label_runs(panel, SPEC, 2), SPEC).filter("entity = 'a'").collect()}
    d = days(12)
    assert e == {"normal": d[2], "isolated": d[7], "start": d[3], "middle": d[4], "end": d[5]}


def test_integrity(panel):
    r = quality.label_integrity(runs.label_runs(panel, SPEC, 2), SPEC, 2).first()
    assert set(r) == {0}


def test_leakage_audit_finds_the_lagged_label_only(spark):
    spec = replace(SPEC, variables=("v",))
    pattern = [1, 1, 1, 0, 1, 0, 1, 1, 0, 1, 1, 1, 1, 0, 0] * 4
    rows = [("a", d, float(20 + 7 * q + i % 5), q, 1.0, float(i % 5)) for i, (d, q) in enumerate(zip(days(60), pattern))]
    p = spark.createDataFrame(rows, "entity string, date date, v double, qualifying int, normal double, departure double")

    def compute(panel):
        x = ft.build(runs.label_runs(panel, spec, 3), spec)
        return x.withColumn("known_lag1", F.lag("label_known", 1).over(ft.entity_window(spec)))

    audit = F.col("date") >= F.lit(days(60)[45])
    columns = ["v_lag7", "v_roll7_mean", "v_slope_7d", "departure_zscore", "label_lag1", "known_lag1"]
    out = {r.column: r for r in quality.leakage(p, spec, audit, compute, columns).collect()}
    assert out["label_lag1"].differences > 0
    assert all(out[c].differences == 0 and out[c].audited == 15 for c in columns if c != "label_lag1")


def test_labels_need_one_sort(panel):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    labelled = runs.label_runs(panel, SPEC, 3)
    assert plan(labelled.select("entity", "date", "label", "event_id", "event_start", "label_known")).count("Sort [") == 1
    assert plan(labelled).count("Sort [") == 2


def test_a_null_flag_ends_a_run(spark):
    flags = [1, None, 1, 1, None, None, 1]
    rows = [("a", d, 0.0, f, 0.0) for d, f in zip(days(7), flags)]
    df = spark.createDataFrame(rows, "entity string, date date, v double, qualifying int, departure double")
    out = runs.label_runs(df, SPEC, 2).orderBy("date").collect()
    assert [(r.label, r.event_id, r.event_length) for r in out] == [(0, 0, 0), (0, 0, 0), (1, 1, 2), (1, 1, 2), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
