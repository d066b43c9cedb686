import os
import sys
from collections import Counter

import pytest
from test_decontamination import brute as contaminated
from test_resemblance import first_ids
from test_secrets import base

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from daystrata.llm import mixing, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def states(spark, tmp_path_factory):
    """The rows after each stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        made = stage(spark, docs, SF)
        if name != "mix":
            assert made.columns == docs.columns
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality_rejects_what_the_labels_call_bad(spark, states):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(states[1]))
    right = [(r.doc_id in kept) == bool(label[r.doc_id]) for r in states[0] if r.doc_id in label]
    assert sum(right) >= 0.95 * len(right)
    assert Counter(map(tuple, states[1])) <= Counter(map(tuple, states[0]))


def test_one_of_each_group_stays(states):
    """By the rule of the stage: 0.8 of the five-word shingles, against all pairs."""
    assert ids(states[2]) == first_ids([(r.doc_id, r.text) for r in states[1]])


def test_benchmark_passages_go(spark, states):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for d, *_, bad in contaminated([(r.doc_id, r.text) for r in states[2]], items) if not bad]
    assert ids(states[3]) == sorted(clean)


def test_secrets_are_replaced(states):
    assert ids(states[4]) == ids(states[3])
    before = {r.doc_id: r.text for r in states[3]}
    for r in states[4]:
        assert r.text == secrets.redact(before[r.doc_id]) and r.n_chars == len(r.text)
        assert not base(r.text)


def test_mixture_is_the_listing_of_what_is_left(spark, states):
    left = spark.createDataFrame(states[4])
    want = Counter((r.doc_id, r.epoch, r.block, r.place) for r in mixing.listing(left).collect())
    assert Counter((r.doc_id, r.epoch, r.block, r.place) for r in states[5]) == want
    text = {r.doc_id: r.text for r in states[4]}
    assert all(r.text == text[r.doc_id] for r in states[5])


def test_run_gives_the_last_state(spark, states):
    key = lambda rows: Counter((r.doc_id, r.epoch, r.block, r.place) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(states[5])
