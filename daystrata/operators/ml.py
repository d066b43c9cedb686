"""Training, scoring and explanation with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daystrata.operators import forests
from daystrata.operators import metrics as mt
from daystrata.operators.splits import hash_index
from daystrata.spec import DECISION_THRESHOLD

#: Rows that are scored at a time and packed together, and scores of a bucket that are put in order together. No effect on a result.
SCORED, PACK, RANKED = 1 << 13, 1 << 17, 250_000

# The default settings of each model kind.


def logistic(strength: float, weight: str | None = None) -> LogisticRegression:
    """L2 with C = 1: ``strength`` is 1 / (sum of weights). Inputs are standardised beforehand."""
    m = LogisticRegression(labelCol="target", regParam=strength, elasticNetParam=0.0, standardization=False, maxIter=100)
    return m.setWeightCol(weight) if weight else m


def forest(trees: int = 300, depth: int = 10, leaf: int = 10, weight: str | None = None, keep_nodes: bool = False) -> RandomForestClassifier:
    """``keep_nodes`` is for a fit by Spark ML itself: every row keeps its node of each tree (4 bytes a tree, on disk where memory
    ends). ``train`` grows a forest by ``forests``, the same trees with it and without."""
    m = RandomForestClassifier(labelCol="target", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=42)
    if keep_nodes:
        m = m.setCacheNodeIds(True).setCheckpointInterval(-1)  # the lineage is as long as the trees are deep
    return m.setWeightCol(weight) if weight else m


def boosted(rounds: int = 300, depth: int = 5, weight: str | None = None) -> GBTClassifier:
    m = GBTClassifier(labelCol="target", maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=42)
    return m.setWeightCol(weight) if weight else m


def train(df: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    """Fit on complete rows; the assembler is part of the saved model."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    rows = assembler.transform(df.na.drop(subset=[*features, "target"]))
    if isinstance(estimator, RandomForestClassifier):
        return PipelineModel([assembler, forests.fit(rows, features, estimator)])
    return PipelineModel([assembler, estimator.fit(rows)])


def score(model: PipelineModel, df: DataFrame, threshold: float = DECISION_THRESHOLD, out: str = "p") -> DataFrame:
    """Probability and 0/1 prediction beside the input columns; rows with an input missing are refused by the model."""
    absent = [c for c in model.stages[0].getInputCols() if c not in df.columns]
    if absent:
        raise ValueError(f"model inputs are missing: {absent}")
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.withColumn("prediction_label", (F.col(out) >= threshold).cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction")


def score_table(model: PipelineModel, df: DataFrame, path: str, keys: Sequence[str], threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Score once, store keys, probability and prediction as Parquet, and return the stored rows. Empty input is an error."""
    if df.isEmpty():
        raise ValueError("nothing to score")
    score(model, df, threshold).select(*keys, "p", "prediction_label").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def rule_baselines(df: DataFrame, lagged: str, qualifying: str) -> DataFrame:
    """Persistence and same-day rule as scores."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    return df.withColumns({"p_persistence": clip(lagged), "p_rule": clip(qualifying)})


def experiment_grid(train_df: DataFrame, val_df: DataFrame, feature_sets: dict[str, Sequence[str]],
                    models: dict[str, Callable], strategies: dict[str, Callable[[DataFrame], DataFrame]],
                    threshold: float = 0.5) -> DataFrame:
    """Fit every combination and return one metric row each. The loop is over model
    configurations; every fit and every metric is a Spark job. A model scores its rows once for both metrics."""
    from daystrata.sources.files import materialise
    parts = []
    for s_name, strategy in strategies.items():
        data = strategy(train_df)
        for f_name, features in feature_sets.items():
            for m_name, make in models.items():
                scored = score(train(data, features, make()), val_df.na.drop(subset=list(features)), threshold)
                s = materialise(scored.select(F.col("target").alias("label"), "p"), "scores")
                row = mt.threshold_metrics(s, threshold)
                ap = mt.rank_metrics(s).select("average_precision").scalar()
                parts.append(row.withColumns({"model": F.lit(m_name), "features": F.lit(f_name), "strategy": F.lit(s_name),
                                              "average_precision": ap}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance, rank), one row per model input."""
    values = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))
    rows = [(f, v, i + 1) for i, (f, v) in enumerate(ranked)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double, rank int")


def row_explanations(df: DataFrame, ranked: DataFrame, keys: Sequence[str], features: Sequence[str], top: int = 5) -> DataFrame:
    """Per row the top features by importance with the row's own values, in rank order."""
    long = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(keys), list(features), "feature", "value")
    best = ranked.filter(F.col("rank") <= top)  # at most ``top`` rows
    hits = long.join(F.broadcast(best), "feature")
    item = F.struct("rank", "feature", "importance", "value")
    return hits.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("explanation"))


def _moves(slots: int, seed: int) -> tuple[int, int]:
    """A step coprime to the number of slots and an offset: slot -> (step * slot + offset) mod slots is a permutation."""
    rng = random.Random(seed)
    step = rng.randrange(1 << 18, 1 << 20)
    while math.gcd(step, slots) > 1:
        step += 1
    return step, rng.randrange(slots)


def permuted(slotted: DataFrame, slots: int, columns: Sequence[str], move: tuple[int, int], prefix: str = "_moved_") -> DataFrame:
    """Rows with ``_slot`` 0..slots-1 (see ``hash_index``), each beside the columns of another row: one join for all columns.
    ``move`` is a step coprime to ``slots`` and an offset."""
    step, offset = move
    if math.gcd(step, slots) != 1:
        raise ValueError("the step must be coprime to the number of rows")
    there = slotted.select(F.pmod(F.col("_slot") * step + offset, F.lit(slots)).alias("_slot"), *[F.col(c).alias(prefix + c) for c in columns])
    return slotted.join(there.hint("merge"), "_slot")  # a stored table is larger in memory than its files say


def permutation_importance(model: PipelineModel, df: DataFrame, key: Column, features: Sequence[str],
                           repeats: int = 5) -> DataFrame:
    """Drop of the average precision when one column is permuted, mean over the repeats.

    The rows are put into hash order once; every repeat is one join, from which the variants of all features are made.
    """
    from daystrata.sources.files import materialise
    inputs = model.stages[0].getInputCols()
    rows = df.select(F.col("target").alias("label"), key.cast("bigint").alias("_key"), *[F.col(c).cast("double").alias(c) for c in inputs])
    rows = materialise(hash_index(rows, "_key", 42, "_slot"), "slots")
    n = rows.count()
    tasks = df.sparkSession.sparkContext.defaultParallelism  # ordered rows lie in few files
    scored = materialise(score(model, rows.repartition(tasks, "_slot")).select("label", "p"), "scores")
    base = mt.rank_metrics(scored).select("average_precision").scalar()
    moved = [permuted(rows, n, list(features), _moves(n, 1000 + r)).withColumn("repeat", F.lit(r)) for r in range(repeats if n else 0)]
    stacked = reduce(DataFrame.unionByName, moved)
    forest = model.stages[-1]
    if isinstance(forest, RandomForestClassificationModel) and max(t.depth for t in forest.trees) <= forests.Scorer.DEEPEST:
        by = _forest_precision(forest, stacked, scored, n, inputs, features)
    else:
        def variant(f: str) -> Column:
            return F.struct(F.lit(f).alias("feature"), *[F.col(("_moved_" if c == f else "") + c).alias(c) for c in inputs])

        variants = stacked.select("label", "repeat", F.explode(F.array(*[variant(f) for f in features])).alias("v")).select("label", "repeat", "v.*")
        by = mt.rank_metrics(score(model, variants), ["feature", "repeat"])
    return by.groupBy("feature").agg(F.avg("average_precision").alias("_ap")).select("feature", (base - F.col("_ap")).alias("drop"))


def _forest_precision(forest: RandomForestClassificationModel, stacked: DataFrame, scored: DataFrame, n: int, inputs: Sequence[str],
                      features: Sequence[str]) -> DataFrame:
    """(feature, repeat, average_precision) of a forest on the rows of ``permuted``, with the moved value of one feature at a time.

    A row answers the conditions of all trees once; a variant changes those of one feature. Scores leave a task packed, in buckets
    cut at quantiles of the plain scores (any cuts are right).
    """
    from daystrata.sources.files import materialise
    spark, inputs = stacked.sparkSession, list(inputs)
    pieces = n // RANKED + 1
    cuts = scored.agg(F.percentile_approx("p", F.array(*[F.lit(i / pieces) for i in range(1, pieces + 1)]), 10_000)).first()[0] or []
    shared = spark.sparkContext.broadcast((forests.Scorer(forest), np.unique(np.array(cuts[:-1], np.float64))))
    names = [f"x{i}" for i in range(len(inputs))]
    at = [inputs.index(f) for f in features]

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, edges = shared.value
        held: dict[int, list[pd.DataFrame]] = {}

        def packed(repeat: int) -> pd.DataFrame:
            x = pd.concat(held.pop(repeat))
            label, out = x["label"].to_numpy(np.float64), [[] for _ in at]
            for i in range(0, len(x), SCORED):
                rows = x.iloc[i:i + SCORED]
                own, other = rows[names].to_numpy(np.float64), np.zeros((len(rows), len(names)))
                other[:, at] = rows[[f"m{j}" for j in range(len(at))]].to_numpy(np.float64)
                if np.isnan(own).any() or np.isnan(other).any():
                    raise ValueError("an input of the model is missing")
                bits = scorer.answers(own)
                for j, f in enumerate(at):
                    mine = [k for k, (g, _) in enumerate(scorer.conditions) if g == f]
                    plain = bits[mine]
                    bits[mine] = scorer.answers(other, f)
                    out[j].append(scorer.score(bits, len(rows)))
                    bits[mine] = plain
            made = [(j, repeat, *row) for j in range(len(at)) for row in mt.pack_scores(label, np.concatenate(out[j]), edges)]
            return pd.DataFrame(made, columns=["number", "repeat", "bucket", "positives", "negatives", "pos", "neg"])

        for b in batches:
            for repeat, rows in b.groupby("repeat"):
                held.setdefault(repeat, []).append(rows)
                if sum(map(len, held[repeat])) >= PACK:
                    yield packed(repeat)
        for repeat in list(held):
            yield packed(repeat)

    known = stacked.filter(F.col("label").isNotNull()).repartition(4 * spark.sparkContext.defaultParallelism, "_slot", "repeat")
    columns = [F.col(c).alias(x) for c, x in zip(inputs, names)] + [F.col(f"_moved_{f}").alias(f"m{j}") for j, f in enumerate(features)]
    scores = materialise(known.select("label", "repeat", *columns).mapInPandas(ranked, f"number int, repeat int, {mt.PACKED}"), "ranked")
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("number") + 1)
    return mt.packed_precision(scores, ["number", "repeat"]).select(name.alias("feature"), "repeat", "average_precision")


def folds_report(df: DataFrame, folds: int, features: Sequence[str], make: Callable, threshold: float) -> DataFrame:
    """Train on everything before each test block and measure on the block.

    Stored rows are often in order of time, where an early block fills few tasks and the other cores wait. So the rows are dealt
    once over all cores.
    """
    from daystrata.sources.files import materialise
    df = materialise(df.repartition(df.sparkSession.sparkContext.defaultParallelism, *df.columns), "dealt")
    parts = []
    for k in range(1, folds + 1):
        model = train(df.filter(F.col("fold") < k), features, make())
        test = score(model, df.filter(F.col("fold") == k).na.drop(subset=list(features)), threshold)
        m = mt.threshold_metrics(test.withColumnRenamed("target", "label"), threshold)
        parts.append(m.withColumn("fold", F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
