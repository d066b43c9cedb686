import collections
import math
import random
import re

import numpy as np
import pytest
from helpers import documents

from daystrata.llm import lexical


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=10):
    """Every document against every item, by the formulas alone."""
    bags = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    total, size = len(bags), sum(n for *_, n in bags)
    df = collections.Counter(t for _, c, _ in bags for t in c)
    out = {}
    asked = collections.defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(terms(text))
    for item, words in asked.items():
        found = []
        for i, c, n in bags:
            m = 100 - 90 + (90 * n * total) // size
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out[item] = [(None if null else i, -s) for s, null, i in sorted(found)[:k]]
    return {i: rows for i, rows in out.items() if rows}


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["the", "a", "of", *(f"w{i}" for i in range(200))]
    weights = [300, 200, 150, *(1 + 100 / (i + 1) for i in range(200))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 80))) for _ in range(n)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    hot = [(n + i, texts[0]) for i in range(n // 3)]  # a third are one text: ties at every rank
    odd = [(5 * n, None), (5 * n + 1, ""), (5 * n + 2, "The THE É é w1"), (5 * n + 3, "w7 " * 50000), (None, texts[1]), (3, texts[2]), (3, texts[2])]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=12))) for i in range(30)]
    items += [(30, texts[0]), (31, None), (32, ""), (33, "unseen"), (None, "the"), (34, "É w7"), (34, "W8"), (30, texts[0])]
    return docs + hot + odd, items


@pytest.mark.parametrize("grid", [16, 4096])
def test_rank_against_brute_force(spark, monkeypatch, grid):
    monkeypatch.setattr(lexical, "GRID_DOCS", grid)
    monkeypatch.setattr(lexical, "FRONTIER", 8)
    docs, items = corpus(400)
    frame = documents(spark, docs, extra=("item_id", "score"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = lexical.rank(frame, asked).orderBy("item_id", "rank").collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r.item_id].append((r.doc_id, r.score))
        assert r.rank == len(got[r.item_id])
    assert dict(got) == brute(docs, items)
    few = lexical.rank(frame, asked, k=3, block_bytes=200).collect()
    assert len(few) == sum(len(v[:3]) for v in got.values()) and all(got[r.item_id][r.rank - 1] == (r.doc_id, r.score) for r in few)


def test_tree_finds_the_best_and_leaves_most_cells(monkeypatch):
    """Best-first: with one outstanding document, only a few ranges are split; without maxima every range would be."""
    monkeypatch.setattr(lexical, "FRONTIER", 4)
    rng = np.random.default_rng(2)
    rows, columns = np.divmod(np.flatnonzero(rng.random(64 * 1024) < 0.2), 1024)
    values = rng.integers(1, 100, len(rows))
    values[columns == 777] += 1000
    tree = lexical.Treap(rows, columns, values, 10)
    asked, seen, top = np.array([1, 5, 40]), [], lexical.Best(1)

    def take(at, score):
        seen.extend(at)
        return top.add(at, score)

    tree.search(asked, 1, take)
    score = np.bincount(columns[np.isin(rows, asked)], values[np.isin(rows, asked)], 1024)
    assert top.ids[0] == score.argmax() == 777 and top.scores[0] == score.max()
    assert len(seen) < 20


def test_long_texts_do_not_overflow():
    n = np.array([10**12])
    assert lexical.impacts(np.array([7]), np.array([3]), n, 10**10, 10**13).tolist() == [7 * (3 * 10**9 // (3000 + 8 * (10 + 90 * 10**12 * 10**10 // 10**13)))]


def test_empty_tables(spark):
    docs, items = documents(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).collect() == [] and lexical.rank(docs, items.limit(0)).collect() == []
    assert lexical.rank(documents(spark, [(1, None), (2, "--")]), items).collect() == []
    assert lexical.rank(docs, spark.createDataFrame([(1, "zz")], "item_id long, text string")).collect() == []
