import random
import re

import pytest
from helpers import documents, lowered

from daystrata.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, items):
    out = []
    for doc_id, text in rows:
        w = WORD.findall(lowered(text))
        hit, names = set(), set()
        for item, t in items:
            v = WORD.findall(lowered(t))
            if item is None or not v:
                continue
            n = min(13, len(v))
            grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}
            at = [i for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in grams]
            if at:
                names.add(str(item))
                hit.update(i + j for i in at for j in range(n))
        out.append((doc_id, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def got(frame, found):
    rows = frame.select("doc_id", found["n_words"].alias("n"), dc.n_hit(found).alias("h"), found["matches"].alias("m"),
                        dc.contaminated(found).alias("c")).collect()
    return [(r.doc_id, r.n, r.h, sorted({x.item_id for x in r.m}), r.c) for r in rows]


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "x1"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(n)) for i, n in enumerate([20, 30, 13, 12, 5, 40, 14])]
    items += [(7, items[1][1]), (8, None), (9, "--- !!"), (None, line(15)), (10, "W1"), (0, items[0][1])]
    rows = [(1, None), (2, ""), (3, "  \n"), (4, items[0][1].upper().replace("É", "É")), (5, line(300)),
            (6, line(50) + ", " + items[5][1] + ". " + line(40)), (7, line(30) + " " + items[4][1]), (7, items[2][1]),
            (None, items[6][1]), (8, " ".join(items[1][1].split()[:12]) + " zz"), (9, "w1"), (10, line(20000)),
            (11, (items[1][1] + " q ") * 50), (12, items[1][1]), (12, items[1][1])]
    return rows, items


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_matches_equal_brute_force(spark, fixture, block):
    rows, items = fixture
    docs = documents(spark, rows, extra=("_found", "matches", "N_WORDS"))
    frame, found = dc.matches(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    key = lambda r: (r[0] is None, str(r))
    assert sorted(got(frame, found), key=key) == sorted(brute(rows, items), key=key)


def test_matches_are_verbatim_and_longest(spark, fixture):
    rows, items = fixture
    frame, found = dc.matches(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    texts = dict((str(i), WORD.findall(lowered(t))) for i, t in items if i is not None)
    seen = 0
    for r in frame.select("text", found["matches"].alias("m")).collect():
        w = WORD.findall(lowered(r.text))
        for m in r.m:
            v, seen = texts[m.item_id], seen + 1
            assert w[m.doc_word:m.doc_word + m.n_words] == v[m.item_word:m.item_word + m.n_words]
            before, after = (m.doc_word - 1, m.item_word - 1), (m.doc_word + m.n_words, m.item_word + m.n_words)
            assert min(before) < 0 or w[before[0]] != v[before[1]]
            assert after[0] >= len(w) or after[1] >= len(v) or w[after[0]] != v[after[1]]
    assert seen > 20


def test_empty_tables_and_filter(spark, fixture):
    rows, items = fixture
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows, extra=("hits",))
    left = dc.decontaminate(docs, bench)
    assert left.columns == docs.columns
    clean = [r[0] for r in brute(rows, items) if not r[4]]
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, clean))
    assert dc.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert dc.decontaminate(docs.limit(0), bench).count() == 0
