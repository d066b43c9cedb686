import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from helpers import documents, solid

from daystrata.llm import phrases


def brute(rows):
    first = {}
    for doc, text in rows:
        w = solid(text)
        for i in range(len(w) - 12):
            if doc is not None:
                g = tuple(w[i:i + 13])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        w = solid(text)
        gone = {i + j for i in range(len(w) - 12) for j in range(13) if doc is not None and first[tuple(w[i:i + 13])] < doc}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [100_000, 2])
def test_equals_brute_force(spark, hot):
    rng = random.Random(9)
    line = lambda n, v=300: " ".join(f"v{rng.randrange(v)}" for _ in range(n))
    passage = [line(n) for n in (13, 14, 40, 12, 90)]
    rows = [(1, None), (2, ""), (3, "a " * 60), (4, "a " * 30 + line(20)), (None, passage[2]), (5, line(40) + " " + passage[2])]
    for i in range(30):
        rows.append((10 + rng.randrange(40), " ".join(rng.choice([line(15), rng.choice(passage), "É À"]) for _ in range(6))))
    rows += [(60, rows[8][1]), (60, rows[8][1]), (0, passage[4]), (70, line(9000, 5)), (71, " ".join(passage[4].split()[7:60]))]
    docs = documents(spark, rows, extra=("bucket", "n_words", "kept"))
    got = phrases.remove_repeats(docs, bucket_bytes=4000, shard_bytes=9000, hot_docs=hot).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert phrases.remove_repeats(documents(spark, [(1, "x")]).limit(0)).count() == 0


def test_more_words_than_characters():
    """One text of more distinct words than there are code points: it failed in decode."""
    passage = [f"p{i}" for i in range(40)]
    many = [f"{i:x}" for i in range(1_112_073)]
    text = " ".join(passage + many + passage[5:30])
    windows = phrases.Batch([" ".join(passage)]).hashes()
    told = pd.DataFrame({"pack": [phrases._pack(windows, np.ones(len(windows)))], "h": [None], "first": [None]})
    docs = pd.DataFrame({"doc_id": [2], "none": [False], "text": [text]})
    got = phrases._remove(["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])(docs, told).iloc[0]
    assert (got.n_words, got.n_removed) == (len(many) + 65, 65) and got.kept == " ".join(many)
    for top in (phrases.CHARACTERS, phrases.CHARACTERS + 1):
        number = np.array([1, 0xD7FF, 0xD800, top])
        made, width = phrases._characters(number)
        assert len(made) == 4 * width and len({made[i:i + width] for i in range(0, len(made), width)}) == 4
