"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic documents against unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daystrata.llm.mil import held_out
from daystrata.llm.words import ALPHANUMERIC, mixed, slices, words

#: Buckets of the hashed features (whole words and the leading bytes of longer ones).
BUCKETS = 1 << 22
#: Leading bytes of a word that are a feature of their own; inflected forms share them.
STEMS = (4, 5, 6)
#: Most confirmed toxic and most unlabelled documents that a classifier is trained on (chosen by a hash of doc_id).
TRAIN_POSITIVE, TRAIN_UNLABELLED = 5000, 20000
#: Features of the classifier, the most telling ones of all buckets.
FEATURES = 4096
THRESHOLD = 0.5
#: Class prior where no label tells it.
PRIOR = 0.1


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and stems of all texts, and the text that each belongs to (repeats included)."""
    found = words(texts, ALPHANUMERIC, lower=True)
    text = np.repeat(np.arange(len(texts)), np.diff(found.offsets))
    data = np.frombuffer(found.buffer, np.uint8)
    size = found.ends - found.starts
    parts, owners = [found.hashes], [text]
    code = np.zeros(len(size), np.uint64)
    for n in range(max(STEMS)):
        at = found.starts + n
        code = code * np.uint64(257) + np.where(n < size, data[np.minimum(at, len(data) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        if n + 1 in STEMS:
            longer = size > n + 1
            parts.append(mixed(code[longer] + np.uint64(n + 1 << 56)))
            owners.append(text[longer])
    return (np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """A linear score of how often the ``buckets`` occur in a text (the logarithm of one more, to base 2)."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[self.buckets] = np.arange(len(self.buckets))

    def __reduce__(self):  # the table is made again where the model is used
        return Model, (self.buckets, self.weights, self.bias)

    def present(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and number of occurrences, each pair once, by text."""
        bucket, text = features(texts)
        feature = self.place[bucket]
        at = np.flatnonzero(feature >= 0)
        n = max(1, len(self.buckets))
        pairs, times = np.unique(text[at] * n + feature[at], return_counts=True)
        return pairs // n, pairs % n, times

    def score(self, texts: list[str | None]) -> np.ndarray:
        text, feature, times = self.present(texts)
        return sigmoid(np.bincount(text, self.weights[feature] * np.log2(1 + times), len(texts)) + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the estimator on raw scores: prior x E_p[l(z)], and E_u[l(-z)] - prior x E_p[l(-z)].

    The loss l(z) = 1 / (1 + exp(z)) is bounded, so no single row outweighs the rest. The second part estimates the risk on
    clean text and is never negative in truth.
    """
    def loss(z: np.ndarray) -> float:
        return float(sigmoid(-z).mean()) if len(z) else 0.0

    return prior * loss(positive), loss(-unlabelled) - prior * loss(-positive)


class Rows:
    """Rows of (feature, occurrences), flat, with one more feature (the bias) that each row has once."""

    def __init__(self, rows: list[np.ndarray], bias: int):
        sizes = np.array([len(r) + 1 for r in rows], np.int64)
        flat = np.concatenate([np.vstack([r, [[bias, 1]]]) for r in rows]) if rows else np.empty((0, 2), np.int64)
        self.features, self.values = flat[:, 0], np.log2(1 + flat[:, 1])

        self.owners = np.repeat(np.arange(len(rows)), sizes)
        self.n, self.width = len(rows), bias + 1

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owners, weights[self.features] * self.values, self.n)

    def mean(self, slopes: np.ndarray) -> np.ndarray:
        """Mean gradient by the weights, from the derivative of the loss by each row's score."""
        return np.bincount(self.features, (slopes / self.n)[self.owners] * self.values, self.width)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, steps: int = 600,
          rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk; each row is an array of (feature, occurrences).

    Every step sees all rows: the fewer rows an estimate has, the more often it is negative by chance. Where the clean
    text's risk is below zero, the step leads away from that part alone (the overfitted one); else down the whole estimate.
    """
    weights = np.zeros(n + 1)
    weights[n] = np.log(prior / (1 - prior))  # the bias is the weight of a feature that every row has
    if not positive or not unlabelled:
        return weights[:n], float(weights[n])
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    toxic, rest = Rows(positive, n), Rows(unlabelled, n)
    for step in range(1, steps + 1):
        p, u = toxic.scores(weights), rest.scores(weights)
        bend_p, bend_u = sigmoid(p) * sigmoid(-p), sigmoid(u) * sigmoid(-u)  # derivative of the sigmoid
        clean = rest.mean(bend_u) - prior * toxic.mean(bend_p)
        grad = clean - prior * toxic.mean(bend_p) if risk(p, u, prior)[1] >= 0 else -clean
        grad[:n] += decay * weights[:n]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:n], float(weights[n])


def telling(positive: Column, unlabelled: Column, positives: int, others: int) -> Column:
    """Likelihood ratio of a bucket: how much the shares of documents that hold it differ between the two sets."""
    def part(seen: Column, total: int, share: Column) -> Column:
        missing = F.greatest(F.lit(total) - seen, F.lit(0))
        return (F.when(seen > 0, seen * F.log(seen / total / share)).otherwise(0.0)
                + F.when(missing > 0, missing * F.log(missing / total / (1 - share))).otherwise(0.0))

    # a share of one or none tells nothing; half a document on each side keeps the logarithms finite
    both = (positive + unlabelled + 0.5) / (positives + others + 1)
    return part(positive, positives, both) + part(unlabelled, others, both)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that hold each bucket, of the confirmed toxic ones and of all: one row for a bucket and task."""
    found = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        values, toxic = batch["text"].tolist(), batch["toxic"].to_numpy(bool)
        for part in slices(values):
            bucket, text = features(values[part])
            pairs = np.unique(text * BUCKETS + bucket)
            for row, chosen in ((0, toxic[part]), (1, ~toxic[part])):
                held, times = np.unique((pairs % BUCKETS)[chosen[pairs // BUCKETS]], return_counts=True)
                found[row, held] += times.astype(np.int32)
    at = np.flatnonzero(found.any(axis=0))
    for i in range(0, len(at), 1 << 16):
        some = at[i:i + (1 << 16)]
        yield pd.DataFrame({"bucket": some, "positive": found[0, some].astype(np.int64), "unlabelled": found[1, some].astype(np.int64)})


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", prior: float | None = None,
        most_positive: int = TRAIN_POSITIVE, most_unlabelled: int = TRAIN_UNLABELLED) -> Model:
    """Learn from confirmed documents (label 1) and unlabelled text; label 0 is not taken for clean.

    The held-out fold (``mil.held_out``) gives neither labels nor text. The document counts of all features cover the whole
    of the rest; the ``FEATURES`` most telling ones are kept, of those that differ more than the best of that many would by chance. The classifier is trained on at most ``most_positive`` confirmed and
    ``most_unlabelled`` unlabelled documents, chosen by a hash of their id. ``prior`` is the share of toxic documents; None takes
    the share among the labels outside the held-out fold. Rows without id or label are left out, repeated label rows count
    once, of different labels the larger one holds. Without confirmed documents every text gets the prior.
    """
    usable = (labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label")))
    if prior is None:
        seen, toxic = usable.agg(F.count("*"), F.sum("label")).first()
        prior = toxic / seen if toxic else PRIOR
    prior = float(min(max(prior, 1e-4), 0.9))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    confirmed = usable.filter("label = 1").orderBy(*by_hash).limit(most_positive).select("doc_id", F.lit(True).alias("toxic"))
    rest = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    marked = rest.join(F.broadcast(confirmed), "doc_id", "left").select("doc_id", "text", F.coalesce("toxic", F.lit(False)).alias("toxic"))
    counted = (marked.select("text", "toxic").mapInPandas(_counts, "bucket bigint, positive bigint, unlabelled bigint")
               .groupBy("bucket").agg(F.sum("positive").alias("positive"), F.sum("unlabelled").alias("unlabelled")))
    positives, others = marked.select("toxic").agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not positives or not others:
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))))
    ratio = telling(F.col("positive"), F.col("unlabelled"), positives, others)
    best = (counted.select("bucket", ratio.alias("ratio")).filter(F.col("ratio") > float(np.log(BUCKETS)))
            .orderBy(F.desc("ratio"), "bucket").limit(FEATURES).select("bucket").collect())
    model = Model(np.sort(np.array([r[0] for r in best], np.int64)), np.zeros(len(best)), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    def held(texts: pd.Series) -> pd.Series:
        rows, values = [], texts.tolist()
        for part in slices(values):
            text, feature, times = shared.value.present(values[part])
            pairs = np.column_stack([feature, times]).astype(np.int32).ravel()
            rows += np.split(pairs, 2 * np.searchsorted(text, np.arange(1, part.stop - part.start)))
        return pd.Series(rows, dtype=object)

    # the unlabelled rows are drawn from all text, confirmed or not: their share of toxic ones is the prior
    drawn = rest.filter("doc_id is not null").select("doc_id").distinct().orderBy(*by_hash).limit(most_unlabelled)
    chosen = drawn.withColumn("unlabelled", F.lit(True)).join(confirmed, "doc_id", "full")  # ids only, bounded by the parameters
    rows = (rest.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
            .select("doc_id", "toxic", "unlabelled", held(F.col("text")).alias("f")).collect())
    rows.sort(key=lambda r: r["doc_id"])

    def pairs(row) -> np.ndarray:
        return np.array(row["f"], np.int64).reshape(-1, 2)

    weights, bias = train([pairs(r) for r in rows if r["toxic"]], [pairs(r) for r in rows if r["unlabelled"]], len(model.buckets), prior)
    return Model(model.buckets, weights, bias)


def scored(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """Toxicity of every whole text, from 0 to 1; null and empty texts get what a text without any feature gets."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        rows = [shared.value.score(values[part]) for part in slices(values)]
        return pd.Series(np.concatenate(rows) if rows else [], dtype="float64")

    return score(F.col(text))
