import random
import zlib

import numpy as np
import pytest
from helpers import documents, solid
from pyspark.sql import functions as F

from daystrata.llm import mil


def text(rng, good):
    w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 300))]
    if not good:
        a = rng.randrange(len(w))
        w[a:] = [x.upper() + "!!" for x in w[a:]] if rng.random() < 0.5 else [w[a]] * (len(w) - a)
    return " ".join(w)


def test_bags_cover_whole_texts():
    rng = random.Random(1)
    texts = [None, "", " \n", "é", *[text(rng, True) for _ in range(20)], "w " * 5000]
    x, start = mil.bags(texts)
    assert [b - a for a, b in zip(start, start[1:])] == [max(1, -(-len(solid(t)) // mil.PASSAGE)) for t in texts]
    assert np.isfinite(x).all() and x.shape == (start[-1], mil.FEATURES)
    for i, t in enumerate(texts):  # neighbours make no difference
        assert np.allclose(mil.bags([t])[0], x[start[i]:start[i + 1]], atol=1e-6)


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    start, y = np.array([0, 3, 4, 9]), np.array([1.0, 0, 1])
    x = rng.normal(size=(9, mil.FEATURES))
    model = mil.train([x[:3], x[3:4], x[4:]], y, epochs=1)

    def loss():
        p = model.forward(x, start)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, grad in model.gradient(x, start, y).items():
        w = model.weights[name]
        at = tuple(0 for _ in w.shape)
        old, step = w[at], 1e-6
        w[at] = old + step
        up = loss()
        w[at] = old - step
        assert grad[at] == pytest.approx((up - loss()) / (2 * step), abs=1e-6)
        w[at] = old
    assert np.allclose(np.add.reduceat(model.forward(x, start)["attention"], start[:-1]), 1)


def test_learns_from_the_other_folds_and_scores_all(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, i % 3 > 0)) for i in range(900)] + [(None, "x"), (5000, None), (5001, ""), (5002, "w " * 30000)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(900)] + [(1, 1, 0), (2, None, 0), (None, 1, 0)]
    # what the held-out fold says must not matter
    spoilt = [(i, q if i is None or zlib.crc32(str(i).encode()) % 5 else 1, t) for i, q, t in labels]
    docs = documents(spark, rows, extra=("score", "quality"))
    schema = "doc_id long, quality int, toxic int"
    model = mil.fit(docs, spark.createDataFrame(spoilt, schema))
    got = {r.doc_id: r for r in docs.select("doc_id", mil.held_out(F.col("doc_id")).alias("h"), mil.scored(model, docs).alias("s")).collect()}
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got.values())
    assert all(got[i].h == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900)) and got[None].h is False
    held = [i for i in range(900) if got[i].h]
    right = np.mean([(got[i].s >= mil.THRESHOLD) == (i % 3 > 0) for i in held])
    assert right >= 0.95, right
    same = mil.fit(docs, spark.createDataFrame(labels, schema))
    assert all(np.array_equal(same.weights[k], model.weights[k]) for k in model.weights)


def test_without_labels(spark):
    docs = documents(spark, [(1, "x"), (2, None)])
    model = mil.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r[0] for r in docs.select(mil.scored(model, docs)).collect()] == [0.5, 0.5]
    assert docs.limit(0).select(mil.scored(model, docs)).count() == 0
