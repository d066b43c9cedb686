import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from daystrata.operators import forests as fo
from daystrata.operators import ml


@pytest.fixture(scope="module")
def rows(spark):
    x = F.rand(1)
    return spark.range(0, 3000, 1, 3).select("id", x.alias("a"), F.rand(2).alias("b"), (F.col("id") % 3).cast("double").alias("c")).select(
        "*", (F.col("a") + F.col("b") * 0.2 > 0.7).cast("int").alias("target"), (1.0 + F.col("c")).alias("weight")).cache()


def test_spark_ml_sees_no_rows_of_a_forest(rows, monkeypatch):
    """A forest is grown from packed histograms; Spark ML's own pass over the rows, once for each tree and level, is gone."""
    seen, inner = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: seen.append(df.count()) or inner(self, df))
    model = ml.train(rows, ["a", "b", "c"], ml.forest(8, 4))
    assert seen == [2] and len(model.stages[-1].trees) == 8
    assert ml.score(model, rows, 0.5).filter("prediction_label = target").count() > 2850
    assert ml.importances(model, ["a", "b", "c"]).orderBy("rank").first().feature == "a"


def test_best_split_equals_all_splits_tried():
    rng = np.random.default_rng(3)
    count = rng.integers(0, 9, (5, 2, fo.BINS, 2)).astype(float)
    count[:, 1] = rng.permuted(count[:, 0], axis=1)  # another feature of the same rows
    weight = count * rng.uniform(0.5, 2, 2)
    gini = lambda w: 1 - sum((v / w.sum()) ** 2 for v in w)
    for node, got in enumerate(fo.best_splits(count, weight, 10)):
        tried = []
        for j in range(2):
            for b in range(fo.BINS - 1):
                l, r = weight[node, j, :b + 1].sum(0), weight[node, j, b + 1:].sum(0)
                if min(count[node, j, :b + 1].sum(), count[node, j, b + 1:].sum()) >= 10:
                    tried.append((gini(l + r) - (l.sum() * gini(l) + r.sum() * gini(r)) / (l + r).sum(), j, b, l))
        best = max(tried, key=lambda x: x[0])
        assert np.isclose(got[2], best[0]) and tuple(got[:2]) == best[1:3]
        assert np.allclose(got[6:8], best[3]) and np.allclose(got[3:5], weight[node, 0].sum(0)) and got[5] == count[node, 0].sum()


@pytest.mark.parametrize("weight", [None, "weight"])
def test_nodes_hold_the_drawn_rows(rows, weight, monkeypatch):
    monkeypatch.setattr(fo, "CHUNK", 500)
    trees, cuts = fo.grow(rows, ["a", "b", "c"], "target", weight, 4, 5, 10, 42)
    assert [len(c) for c in cuts] == [31, 31, 3]
    for t in range(4):
        split = np.flatnonzero(trees.feature[t] >= 0)
        assert 2700 < trees.count[t, 1] < 3300 and len(split)
        for h in split:
            assert trees.count[t, h] == trees.count[t, 2 * h] + trees.count[t, 2 * h + 1]
            assert np.allclose(trees.weight[t, h], trees.weight[t, 2 * h] + trees.weight[t, 2 * h + 1])
            assert min(trees.count[t, 2 * h], trees.count[t, 2 * h + 1]) >= 10 and trees.gain[t, h] > 0
        assert (trees.weight[t, 1].sum() > 1.5 * trees.count[t, 1]) == (weight is not None)
    monkeypatch.setattr(fo, "HELD", 1)  # one tree a job: the same trees
    again, _ = fo.grow(rows, ["a", "b", "c"], "target", weight, 4, 5, 10, 42)
    assert all(np.allclose(a, b) for a, b in zip(trees, again))


def test_scorer_gives_the_scores_of_the_model(rows, spark):
    model = ml.train(rows, ["a", "b", "c"], ml.forest(7, 9, leaf=1))
    x = ml.score(model, rows).toPandas()
    scorer = fo.Scorer(model.stages[-1])
    values = x[["a", "b", "c"]].to_numpy(float)
    assert (scorer.score(scorer.answers(values), len(x)) == x["p"].to_numpy()).all() and x["p"].nunique() > 50


def test_permutations_are_scored_without_a_row_for_each_variant(rows, monkeypatch):
    """Every row is scored once by the model; the variants (features x repeats) come packed, and rank as they did one by one."""
    monkeypatch.setattr(ml, "RANKED", 400)
    monkeypatch.setattr(ml, "PACK", 700)
    monkeypatch.setattr(ml, "SCORED", 300)
    f, sizes, inner = ["a", "b", "c"], [], ml.score
    monkeypatch.setattr(ml, "score", lambda model, df, *more: sizes.append(df.count()) or inner(model, df, *more))
    model = ml.train(rows, f, ml.forest(6, 5))
    some = rows.withColumn("target", F.when(F.col("id") % 10 > 0, F.col("target")))  # a null label ranks nowhere but lends its values
    fast = {r.feature: r.drop for r in ml.permutation_importance(model, some, F.col("id"), f, 2).collect()}
    assert sizes == [3000]
    monkeypatch.setattr(fo.Scorer, "DEEPEST", 0)  # one by one
    slow = {r.feature: r.drop for r in ml.permutation_importance(model, some, F.col("id"), f, 2).collect()}
    assert sizes == [3000, 3000, 18000] and fast.keys() == slow.keys() == set(f)
    assert all(np.isclose(fast[k], slow[k], rtol=0, atol=1e-12) for k in f) and fast["a"] > 0.1
