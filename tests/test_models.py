import numpy as np
import pytest
from pyspark.sql import functions as F

from daystrata.operators import ml
from daystrata.operators import splits as sp


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0.5).astype(int)
    data = [(i, float(a), float(b), float(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id bigint, a double, b double, c double, target int").cache()


@pytest.mark.parametrize("make", [lambda: ml.logistic(1 / 400), lambda: ml.forest(10, 4), lambda: ml.boosted(5, 3)])
def test_models_score_every_row(rows, make):
    out = ml.score(ml.train(rows, ["a", "b", "c"], make()), rows, 0.5)
    assert out.count() == 400 and out.filter("p < 0 OR p > 1").count() == 0
    assert out.filter("prediction_label = target").count() > 340
    assert set(rows.columns) <= set(out.columns)


def test_importances_and_explanations(rows):
    f = ["a", "b", "c"]
    model = ml.train(rows, f, ml.forest(10, 4))
    ranked = ml.importances(model, f)
    assert ranked.orderBy("rank").first().feature == "a"
    e = ml.row_explanations(rows, ranked, ["id"], f, 2).filter("id = 7").first()
    assert len(e.explanation) == 2 and e.explanation[0].feature == "a"
    assert e.explanation[0].value == rows.filter("id = 7").first().a


def test_permutation(rows):
    slotted = sp.hash_index(rows, "id", 42, "_slot")
    with pytest.raises(ValueError):
        ml.permuted(slotted, 400, ["a"], (10, 3))
    moved = ml.permuted(slotted, 400, ["a"], (7, 3)).orderBy("id").toPandas()
    moved["a"] = moved["_moved_a"]
    plain = rows.orderBy("id").toPandas()
    assert len(moved) == 400 and sorted(moved["a"]) == sorted(plain["a"]) and (moved["a"] != plain["a"]).mean() > 0.9
    assert (moved["b"] == plain["b"]).all()
    model = ml.train(rows, ["a", "b", "c"], ml.forest(10, 4))
    drop = {r.feature: r.drop for r in ml.permutation_importance(model, rows, F.col("id"), ["a", "b"], repeats=1).collect()}
    assert drop["a"] > 0.2 > abs(drop["b"])


def test_grid_scores_each_model_once(rows, monkeypatch):
    from daystrata.sources import files
    made, plans = files.materialise, []
    monkeypatch.setattr(files, "materialise", lambda df, name="table": plans.append(name) or made(df, name))
    grid = ml.experiment_grid(rows, rows, {"ab": ["a", "b"]}, {"m": lambda: ml.logistic(1 / 400)}, {"s": lambda d: d}).collect()
    assert len(grid) == 1 and grid[0].tp + grid[0].fp + grid[0].tn + grid[0].fn == 400 and grid[0].average_precision > 0.8
    assert plans == ["scores"]


def test_folds_are_trained_by_all_tasks(spark, monkeypatch):
    """Rows stored in order of time: an early block lies in one file, but every core trains on it, on all rows before the block."""
    stored = spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("key"), (F.col("id") / 1000).cast("int").alias("fold"), (F.col("id") * 7 % 50).cast("double").alias("x"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") * 7 % 50 > 30).cast("int")).alias("target"))
    sizes, inner = [], ml.train

    def watched(df, features, estimator):
        sizes.append([n for n in (len(p) for p in df.rdd.glom().collect()) if n])
        return inner(df, features, estimator)

    monkeypatch.setattr(ml, "train", watched)
    report = ml.folds_report(stored, 3, ["x"], lambda: ml.forest(5, 4, keep_nodes=True), 0.5).collect()
    assert [sum(s) for s in sizes] == [1000, 2000, 3000]
    assert all(len(s) >= 4 and max(s) < sum(s) / 2 for s in sizes)
    known = {r.fold: r.n for r in stored.filter("target IS NOT NULL").groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert {r.fold: r.tp + r.fp + r.tn + r.fn for r in report} == {k: known[k] for k in (1, 2, 3)}
    assert all(r.fp == r.fn == 0 for r in report)


def test_kept_nodes_grow_the_same_forest(rows):
    grown = [ml.train(rows, ["a", "b", "c"], ml.forest(5, 5, keep_nodes=kept)).stages[-1].toDebugString for kept in (False, True)]
    assert grown[0].split("\n")[1:] == grown[1].split("\n")[1:]


@pytest.mark.parametrize("name", ["h1_h4_logistic", "h6_experiment_grid", "h11_permutation_importance"])
def test_queries_train_on_all_rows_of_the_training_years(spark, monkeypatch, name):
    from daystrata.operators import features as ft
    from daystrata.plans import catalog, panels

    class Seen(Exception):
        pass

    def watched(df, features, estimator):
        raise Seen(df.count())

    monkeypatch.setattr(ml, "train", watched)
    sf = "/root/testdata/sf0.01"
    with pytest.raises(Seen) as seen:
        catalog.QUERIES[name](spark, sf).collect()
    whole = ft.trim(panels.featured(spark, sf)).filter("year(date) <= 1999").count()
    assert seen.value.args[0] == whole > 20_000
