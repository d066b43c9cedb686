import random
import zlib

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from daystrata.llm import toxicity as tx

BAD = ["vilain", "grobian", "nastiness"]


def corpus(n, seed=0):
    """One in eight is toxic: it holds inflected forms of the bad stems among ordinary words."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(5, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "s", "ly", "ish"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_learns_from_confirmed_and_unlabelled_text_only(spark):
    rows, labels = corpus(3000)
    awkward = [(None, "vilain"), (9000, None), (9001, ""), (9002, "word " * 40000 + "grobians vilain"), (5, rows[5][1])]
    # only some toxic documents are confirmed; no label says that a document is clean, and the held-out fold says nonsense
    known = [(i, q, 1 - t if fold(i) else t) for i, q, t in labels if fold(i) or (t and i % 16 == 0)]
    known += [(None, 1, 1), (16, 1, None), (32, 1, 1)]
    docs = documents(spark, rows + awkward, extra=("toxic", "score"))
    model = tx.fit(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), prior=0.125)
    got = {r.doc_id: r.s for r in docs.select("doc_id", tx.scored(model, docs).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001] < 0.5 < got[9002] and got[None] > 2 * got[9001]
    held = [(got[i] >= tx.THRESHOLD, bool(t)) for i, _, t in labels if fold(i)]
    unconfirmed = [got[i] >= tx.THRESHOLD for i, _, t in labels if t and i % 16]
    assert np.mean([a == b for a, b in held]) >= 0.97 and np.mean(unconfirmed) >= 0.9


def test_risk_corrects_for_the_prior():
    """Unlabelled rows are a mixture: the corrected estimate equals the risk on clean rows alone."""
    rng = np.random.default_rng(0)
    toxic, clean = rng.normal(1, 1, 200_000), rng.normal(-1, 1, 200_000)
    mixture = np.concatenate([toxic[:60_000], clean[:140_000]])
    first, second = tx.risk(toxic, mixture, 0.3)
    assert first == pytest.approx(0.3 * tx.sigmoid(-toxic).mean()) and second == pytest.approx(0.7 * tx.sigmoid(clean).mean(), abs=2e-3)


def test_negative_estimate_turns_the_step():
    """Rows whose prior is overstated: without the correction the weights grow without bound, with it they settle."""
    one, none = np.array([[0, 1]]), np.empty((0, 2), np.int64)
    w, b = tx.train([one] * 50, [none] * 95 + [one] * 5, 1, prior=0.4, steps=400)
    p, u = tx.sigmoid(w[0] + b), tx.sigmoid(b)
    assert abs(0.95 * u + 0.05 * p - 0.4 * p) < 0.05


def test_without_labels_and_empty(spark):
    docs = documents(spark, [(1, "x"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tx.fit(docs, none)
    assert [r[0] for r in docs.select(tx.scored(model, docs)).collect()] == pytest.approx([tx.PRIOR] * 2)
    assert docs.limit(0).select(tx.scored(tx.fit(docs.limit(0), none), docs)).count() == 0
    assert [round(r[0], 6) for r in docs.select(tx.scored(tx.fit(docs, spark.createDataFrame([(1, 1, 1)], none.schema)), docs)).collect()] != []


def test_features_do_not_depend_on_neighbours():
    texts = ["Abcdefgh abc", "", None, "é 1a2b3 abcdefgh", "x" * 100]
    bucket, text = tx.features(texts)
    for i, t in enumerate(texts):
        assert sorted(bucket[text == i]) == sorted(tx.features([t])[0])
    assert len(tx.features(["abcdefgh"])[0]) == 4 and len(tx.features(["abc"])[0]) == 1
