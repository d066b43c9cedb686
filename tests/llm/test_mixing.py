import math
import random
from collections import Counter, defaultdict

import pytest
from helpers import documents, solid

from daystrata.llm import mixing as m


def fixture():
    rng = random.Random(6)
    rows = []
    for i in range(600):
        source = rng.choices(["big", "mid", "small", None], [60, 25, 5, 10])[0]
        rows.append((i, " ".join("w" for _ in range(rng.randrange(0, 60))), source))
    rows += [(700, None, "mid"), (701, "", "empty"), (702, None, "empty"), (None, "a b c", "mid"), (5, rows[5][1], rows[5][2]), (703, "w " * 3000, "small")]
    return rows


def totals(rows):
    out = Counter()
    for _, t, s in set(rows):
        out[s] += len(solid(t))
    return {s: n for s, n in out.items() if n}


def weights(n, t):
    p = {s: x / sum(n.values()) for s, x in n.items()}
    z = sum(v**t for v in p.values())
    return {s: v**t / z for s, v in p.items()}


@pytest.mark.parametrize("entropy,repetition,budget", [(0.95, 4.0, None), (0.8, None, 5000), (None, 2.0, 40000), (1.0, 1.5, None), (None, None, None), (0.999, 1.01, None)])
def test_weights_epochs_and_quotas(spark, entropy, repetition, budget):
    rows = fixture()
    docs = documents(spark, rows, extra=("epoch", "bucket", "n"))
    n = totals(rows)
    budget_ = budget or sum(n.values())
    sources = spark.createDataFrame([(s, x) for s, x in n.items()], "source string, n long")
    t = m.exponent(sources, entropy, repetition, budget_)
    w = weights(n, t)
    spread = -sum(x * math.log(x) for x in w.values()) / math.log(len(w))
    most = max(w[s] * budget_ / n[s] for s in n)
    possible = budget_ / sum(n.values()) <= (repetition or math.inf)
    if repetition and possible:
        assert most <= repetition * (1 + 1e-4)
    if entropy and not (repetition and most > repetition * 0.999):
        assert spread >= entropy - 1e-4 and (t == 1 or spread <= entropy + 1e-4)
    got = m.listing(docs, budget, entropy, repetition, block_tokens=1500).collect()
    by, length = defaultdict(list), {(d, s, len(solid(x))) for d, x, s in rows}
    for r in got:
        assert (r.doc_id, r.source, r.n_tokens) in length
        by[r.source].append(r)
    assert set(by) <= set(n)
    for s, own in by.items():
        quota, used = math.floor(round(w[s], 9) * budget_), sum(r.n_tokens for r in own)
        assert used <= quota and quota - used <= max(k for d, x, k in length if x == s)
        epochs = Counter(r.epoch for r in own)
        docs_of = len({(d, x) for d, x, y in rows if y == s})
        assert all(epochs[e] == docs_of for e in range(max(epochs)))  # every epoch but the last is whole
        assert max(Counter((r.doc_id, r.n_tokens, r.epoch) for r in own).values()) == 1
        order = sorted(own, key=lambda r: (r.epoch, r.place))
        assert [r.block for r in order] == sorted(r.block for r in own)  # blocks follow the permutations
        blocks = -(-budget_ // 1500)
        share = Counter()
        for r in own:
            share[r.block] += r.n_tokens
        if s == "big":
            assert max(share) == blocks - 1 and all(abs(v - quota / blocks) <= 130 for v in share.values())
    again = m.listing(docs.repartition(7), budget, entropy, repetition, block_tokens=1500).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_buckets_do_not_matter(spark, monkeypatch):
    docs = documents(spark, fixture())
    want = Counter(map(tuple, m.listing(docs).collect()))
    monkeypatch.setattr(m, "BUCKET_ROWS", 1)
    assert Counter(map(tuple, m.listing(docs).collect())) == want


def test_documents_of_the_mixture(spark):
    docs = documents(spark, fixture(), extra=("Block", "place"))
    out = m.mixed(docs, entropy=1.0)
    assert out.columns == [*docs.columns, "epoch", "block_", "place_"]
    want = Counter((r.doc_id, r.source, r.epoch) for r in m.listing(docs, entropy=1.0).collect())
    assert set((r.doc_id, r.source, r.epoch) for r in out.collect()) == set(want)
    assert {r.text for r in out.collect()} <= {t for _, t, _ in fixture()}


def test_empty(spark):
    docs = documents(spark, [(1, None), (2, "  ")])
    assert m.listing(docs).count() == 0 and m.mixed(docs.limit(0)).count() == 0


def test_native(spark):
    plan = m.mixed(documents(spark, fixture()[:20]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
