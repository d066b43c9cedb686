"""Random forests over many rows: all trees grow together, one level a job.

The same forest that Spark ML describes (bootstrap by Poisson counts, a random subset of the features for each node, Gini gain over at
most 32 bins, leaves merged where both predict the same), and a Spark ML model as its result. Rows are binned once and packed as bytes,
so a level is a few numpy passes over them: each task adds up the histograms of its rows, each tree's are summed in one task, and only
the chosen splits reach the driver (trees x nodes of a level). Cuts are quantiles of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daystrata.sources.files import materialise, scratch_folder

BINS = 32
#: Rows that are packed together, and bytes of histograms that a task holds at once. No effect on a tree but for the draws.
CHUNK, HELD = 1 << 17, 64 << 20
#: Counts of a bootstrap: the quantiles of Poisson(1) at the 65,536 values of two random bytes.
_BAG = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
_PACKED = "chunk bigint, rows binary, weights binary"


class Trees(NamedTuple):
    """Nodes of all trees in heap order (root 1, children 2h and 2h + 1): split feature (-1: none), last bin that goes left, gain,
    weights of both classes, drawn rows."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    weight: np.ndarray
    count: np.ndarray


def cuts_of(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """At most 31 cuts of each feature, quantiles of all rows: a value is left of the cuts that it does not exceed."""
    at = F.array(*[F.lit(k / (BINS - 1)) for k in range(BINS - 1)])
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f"c{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(c or [], np.float64)) for c in row]


def packed(df: DataFrame, features: Sequence[str], label: str, weight: str | None, cuts: list[np.ndarray]) -> DataFrame:
    """Chunks of rows: twice the bin of each feature plus the label, one byte each."""
    names = [f"c{i}" for i in range(len(features))]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"chunk": [base + made], "rows": [b"".join(r for r, _ in held)], "weights": [b"".join(w for _, w in held)]})

        for b in batches:
            y, rows = b["y"].to_numpy(np.uint8), np.empty((len(b), len(names)), np.uint8)
            for i, c in enumerate(names):
                rows[:, i] = 2 * np.searchsorted(cuts[i], b[c].to_numpy(np.float64)) + y
            held.append((rows.tobytes(), b["w"].to_numpy(np.float64).tobytes() if weight else b""))
            size += len(b)
            if size >= CHUNK:
                yield out()
                made, held, size = made + 1, [], 0
        if size:
            yield out()

    columns = [F.col(f).cast("double").alias(c) for f, c in zip(features, names)]
    extra = [F.col(weight).cast("double").alias("w")] if weight else []
    return df.select(*columns, F.col(label).cast("int").alias("y"), *extra).mapInPandas(pack, _PACKED)


def _node(tree: tuple[np.ndarray, np.ndarray], flat: np.ndarray, base: np.ndarray, level: int) -> np.ndarray:
    """Heap number of the node (or of a descendant of the leaf) of each row on a level."""
    feature, last = tree
    node = np.ones(len(base), np.intp)
    for _ in range(level):
        at = feature.take(node)
        at += base
        right = flat.take(at) > last.take(node)
        node += node
        node += right
    return node


def _bag(seed: int, tree: int, chunk: int, n: int) -> np.ndarray:
    return _BAG.take(np.frombuffer(np.random.default_rng([seed, tree, chunk]).bytes(2 * n), np.uint16))


def _paths(trees: Trees, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and greatest byte that goes left; rows of a leaf go left for ever."""
    split = trees.feature[t] >= 0
    return np.where(split, trees.feature[t], 0).astype(np.intp), np.where(split, 2 * trees.cut[t] + 1, 255).astype(np.uint8)


def _histograms(level: int, width: int, seed: int, plan: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, slots, subsets, weighted = plan.value
        sums = {}
        for b in batches:
            for chunk, rows, weights in zip(b["chunk"], b["rows"], b["weights"]):
                flat = np.frombuffer(rows, np.uint8)
                n = len(flat) // width
                of_row = np.frombuffer(weights, np.float64) if weighted else None
                for t, slot in slots.items():
                    bag, subset = _bag(seed, t, chunk, n), subsets[t]
                    drawn = np.flatnonzero(bag)
                    base = drawn * width
                    k = slot.take(_node(paths[t], flat, base, level) - (1 << level))
                    if k.size and k.min() < 0:
                        live = np.flatnonzero(k >= 0)
                        k, base, drawn = k[live], base[live], drawn[live]
                    times = bag[drawn].astype(np.float64)
                    per = 2 * BINS * subset.shape[1]
                    if t not in sums:
                        sums[t] = np.zeros((2 if weighted else 1, len(subset) * per))
                    first = k * per
                    for j in range(subset.shape[1]):
                        at = subset[:, j].take(k)
                        at += base
                        key = first + flat.take(at)
                        first += 2 * BINS
                        sums[t][0] += np.bincount(key, times, len(subset) * per)
                        if weighted:
                            sums[t][1] += np.bincount(key, times * of_row[drawn], len(subset) * per)
        if sums:
            yield pd.DataFrame({"tree": list(sums), "sums": [s.tobytes() for s in sums.values()]})

    return count


def _gini(w: np.ndarray) -> np.ndarray:
    total = w.sum(-1)
    return 1 - ((w / np.where(total > 0, total, 1)[..., None]) ** 2).sum(-1)


def best_splits(count: np.ndarray, weight: np.ndarray, leaf: int) -> np.ndarray:
    """Of histograms (node, feature of its subset, bin, class): place of the feature, last bin to the left, gain (0: no split),
    weights and rows of the node, weights and rows to the left."""
    left, drawn = weight.cumsum(2), count.sum(3).cumsum(2)
    total, rows = left[:, :, -1:], drawn[:, :, -1:]
    share = left.sum(-1) / np.maximum(total.sum(-1), 1e-300)
    gain = _gini(total) - share * _gini(left) - (1 - share) * _gini(total - left)
    gain = np.where((drawn >= leaf) & (rows - drawn >= leaf), gain, 0).reshape(len(count), -1)
    best, n = gain.argmax(1), np.arange(len(count))
    j, b = np.divmod(best, BINS)
    return np.column_stack([j, b, gain[n, best], total[:, 0, 0], rows[:, 0, 0], left[n, j, b], drawn[n, j, b]])


def grow(df: DataFrame, features: Sequence[str], label: str, weight: str | None, trees: int, depth: int, leaf: int, seed: int) -> tuple[Trees, list[np.ndarray]]:
    """All trees from the rows of ``df`` (features and the 0/1 label are not null), and the cuts of the bins."""
    spark, width = df.sparkSession, len(features)
    cuts = cuts_of(df, features)
    chunks = materialise(packed(df, features, label, weight, cuts), "binned")
    # a task sums the histograms of its chunks: no more tasks than cores
    chunks = chunks.coalesce(spark.sparkContext.defaultParallelism)
    some = min(width, math.ceil(math.sqrt(width))) if trees > 1 else width
    heap = 1 << (depth + 1)
    out = Trees(np.full((trees, heap), -1, np.int16), np.zeros((trees, heap), np.int16), np.zeros((trees, heap)), np.zeros((trees, heap, 2)), np.zeros((trees, heap)))
    opened = [np.array([1]) for _ in range(trees)]
    for level in range(depth):
        left = [t for t in range(trees) if len(opened[t])]
        largest = max((len(opened[t]) for t in left), default=1) * some * BINS * 16 * (2 if weight else 1)
        size = max(1, HELD // largest)
        for group in (left[i:i + size] for i in range(0, len(left), size)):
            slots, subsets = {}, {}
            for t in group:
                slots[t] = np.full(1 << level, -1, np.intp)
                slots[t][opened[t] - (1 << level)] = np.arange(len(opened[t]))
                drawn = np.random.default_rng([seed, t, level, 1]).random((len(opened[t]), width))
                subsets[t] = np.argsort(drawn, axis=1)[:, :some].astype(np.intp)
            plan = spark.sparkContext.broadcast(({t: _paths(out, t) for t in group}, slots, subsets, weight is not None))

            def best(rows: pd.DataFrame) -> pd.DataFrame:
                sums = sum(np.frombuffer(s, np.float64) for s in rows["sums"]).reshape(2 if weight else 1, -1, some, BINS, 2)
                return pd.DataFrame({"tree": rows["tree"].iloc[:1], "splits": [best_splits(sums[0], sums[-1], leaf).tobytes()]})

            sums = chunks.mapInPandas(_histograms(level, width, seed, plan), "tree int, sums binary")
            found = sums.groupBy("tree").applyInPandas(best, "tree int, splits binary").collect()  # at most 2^level splits a tree
            plan.unpersist()
            for t, splits in found:
                s, h = np.frombuffer(splits, np.float64).reshape(-1, 9), opened[t]
                out.weight[t, h], out.count[t, h] = s[:, 3:5], s[:, 5]
                ok = s[:, 2] > 0
                s, h, j = s[ok], h[ok], s[ok, 0].astype(int)
                out.feature[t, h], out.cut[t, h], out.gain[t, h] = subsets[t][ok, j], s[:, 1], s[:, 2]
                out.weight[t, 2 * h], out.weight[t, 2 * h + 1] = s[:, 6:8], s[:, 3:5] - s[:, 6:8]
                out.count[t, 2 * h], out.count[t, 2 * h + 1] = s[:, 8], s[:, 5] - s[:, 8]
                child = np.sort(np.concatenate([2 * h, 2 * h + 1]))
                opened[t] = child[(out.weight[t, child].min(1) > 0) & (out.count[t, child] >= 2 * leaf)]
    return merged(out), cuts


def merged(trees: Trees) -> Trees:
    """Two leaves that predict the same class become one, from the bottom up."""
    says = trees.weight[:, :, 1] > trees.weight[:, :, 0]
    heap = trees.feature.shape[1]
    top = heap // 2
    while top := top // 2:
        h = np.arange(top, 2 * top)
        both = (trees.feature[:, h] >= 0) & (says[:, 2 * h] == says[:, 2 * h + 1])
        if 2 * top < heap // 2:
            both &= (trees.feature[:, 2 * h] < 0) & (trees.feature[:, 2 * h + 1] < 0)
        trees.feature[:, h] = np.where(both, -1, trees.feature[:, h])
        says[:, h] = np.where(both, says[:, 2 * h], says[:, h])
    return trees


def _rows(trees: Trees, cuts: list[np.ndarray]) -> pd.DataFrame:
    """Nodes of all trees in the order in which Spark ML stores them: a node, all of its left side, all of its right side."""
    feature, rows = trees.feature.tolist(), []
    for t, of in enumerate(feature):
        todo, start = [(1, None)], len(rows)
        while todo:
            h, parent = todo.pop()
            at = len(rows) - start
            if parent is not None:
                rows[start + parent][3] = at  # the right child of its parent
            split = of[h] >= 0
            rows.append([t, at, at + 1 if split else -1, -1, h])
            if split:
                todo += [(2 * h + 1, at), (2 * h, None)]
    x = pd.DataFrame(rows, columns=["tree", "id", "left", "right", "h"])
    t, h = x["tree"].to_numpy(), x["h"].to_numpy()
    of, w = trees.feature[t, h].astype(int), trees.weight[t, h]
    cut = [float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(of.tolist(), trees.cut[t, h].tolist())]
    return x.drop(columns="h").assign(feature=of, cut=cut, w0=w[:, 0], w1=w[:, 1], gain=np.where(of >= 0, trees.gain[t, h], -1.0),
                                      impurity=_gini(w), rows=trees.count[t, h].astype(np.int64))


def as_model(spark: SparkSession, trees: Trees, cuts: list[np.ndarray], estimator: RandomForestClassifier, width: int) -> RandomForestClassificationModel:
    """A Spark ML model with these trees: a stored model of the estimator's settings whose nodes are replaced."""
    path = scratch_folder(spark, "forest")
    two = spark.createDataFrame([(Vectors.dense([float(y)] * width), y) for y in (0, 1)], ["features", estimator.getLabelCol()])
    plain = estimator.copy()
    if plain.isSet("weightCol"):
        plain.clear(plain.weightCol)
    plain.fit(two).write().overwrite().save(path)
    n, leaf = spark.createDataFrame(_rows(trees, cuts)), F.col("feature") < 0
    none = F.array().cast("array<double>")
    split = F.struct(F.col("feature").cast("int").alias("featureIndex"), F.when(leaf, none).otherwise(F.array("cut")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories"))
    node = F.struct(F.col("id").cast("int").alias("id"), (F.col("w1") > F.col("w0")).cast("double").alias("prediction"), "impurity",
                    F.array("w0", "w1").alias("impurityStats"), F.col("rows").cast("bigint").alias("rawCount"), "gain",
                    F.col("left").cast("int").alias("leftChild"), F.col("right").cast("int").alias("rightChild"), split.alias("split"))
    n.select(F.col("tree").cast("int").alias("treeID"), node.alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def fit(df: DataFrame, features: Sequence[str], estimator: RandomForestClassifier) -> RandomForestClassificationModel:
    """The forest of the estimator's settings; ``df`` has an assembled ``features`` column as well, for labels that are not 0 and 1."""
    label, weight = estimator.getLabelCol(), estimator.getOrDefault("weightCol") if estimator.isSet("weightCol") else None
    if {r[0] for r in df.select(F.col(label).cast("double")).distinct().limit(3).collect()} != {0.0, 1.0}:
        return estimator.fit(df)
    grown = grow(df, features, label, weight, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getSeed())
    return as_model(df.sparkSession, *grown, estimator, len(features))


class Scorer:
    """The probability of class 1 by a forest, for many rows at once: one bit a row.

    What a row answers to every condition of the forest is a bit, so a node is reached by the bits of its parent and its condition,
    64 rows an operation. The turns of a row, one bit a level, are the number of its leaf. Sums are taken in Spark ML's order, so
    the scores are the same doubles.
    """

    #: Deeper trees would need too long a table of leaves.
    DEEPEST = 16

    def __init__(self, model: RandomForestClassificationModel) -> None:
        spark, path = SparkSession.active(), scratch_folder(SparkSession.active(), "forest")
        model.write().save(path)
        n = F.col("nodeData")
        nodes = spark.read.parquet(f"{path}/data").select("treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias(
            "feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"), n["impurityStats"][0].alias("w0"), n["impurityStats"][1].alias("w1")).collect()
        self.conditions = sorted({(r.feature, r.cut) for r in nodes if r.left >= 0})
        number = {c: i for i, c in enumerate(self.conditions)}
        of_tree: dict[int, dict[int, tuple]] = {}
        for r in nodes:
            of_tree.setdefault(r.treeID, {})[r.id] = r
        self.trees = [self._levels(of_tree[t], number) for t in sorted(of_tree)]

    @staticmethod
    def _levels(nodes: dict, number: dict) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each level the conditions of its nodes and the places of the next level's among their left and right children; and
        the shares of both classes in each leaf."""
        levels, found, here = [], [], [(nodes[0], 0)]
        if nodes[0].left < 0:
            found, here = [(0, nodes[0])], []
        while here:
            after, places = [], []
            for side in (0, 1):
                for i, (r, code) in enumerate(here):
                    child = nodes[r.right if side else r.left]
                    reached = code | side << len(levels)
                    if child.left < 0:
                        found.append((reached, child))
                    else:
                        after.append((child, reached))
                        places.append(side * len(here) + i)
            levels.append((np.array([number[r.feature, r.cut] for r, _ in here], np.intp), np.array(places, np.intp)))
            here = after
        shares = np.zeros((2, 1 << len(levels)))
        for code, leaf in found:
            total = leaf.w0 + leaf.w1
            if total:
                shares[:, code] = leaf.w0 / total, leaf.w1 / total
        return levels, shares

    def answers(self, x: np.ndarray, only: int | None = None) -> np.ndarray:
        """Bits of the rows for each condition (those of one feature only, where given); a set bit goes right."""
        own = [(f, c) for f, c in self.conditions if only is None or f == only]
        size = -(-len(x) // 64) * 8
        out = np.zeros((len(own), size), np.uint8)
        for i, (f, c) in enumerate(own):
            b = np.packbits(x[:, f] > c, bitorder="little")
            out[i, :len(b)] = b
        return out.view(np.uint64)

    def score(self, bits: np.ndarray, n: int) -> np.ndarray:
        votes = np.zeros((2, bits.shape[1] * 64))
        for levels, shares in self.trees:
            reach, turns = np.full((1, bits.shape[1]), ~np.uint64(0)), []
            for conditions, places in levels:
                k = len(conditions)
                both = np.empty((2 * k, bits.shape[1]), np.uint64)
                np.bitwise_and(reach, bits.take(conditions, axis=0), out=both[k:])
                np.bitwise_xor(reach, both[k:], out=both[:k])
                turns.append(np.bitwise_or.reduce(both[k:], axis=0))
                reach = both.take(places, axis=0)
            code = np.zeros(votes.shape[1], np.intp)
            for at in range(0, len(turns), 8):
                byte = np.zeros(votes.shape[1], np.uint8)
                for i, turn in enumerate(turns[at:at + 8]):
                    byte |= np.unpackbits(turn.view(np.uint8), bitorder="little") << np.uint8(i)
                code += byte.astype(np.intp) << at
            votes[0] += shares[0].take(code)
            votes[1] += shares[1].take(code)
        total = votes.sum(0)
        return (votes[1] / np.where(total == 0, 1, total))[:n]
