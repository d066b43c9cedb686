import random

import xxhash
from helpers import documents, lowered, solid

from daystrata.llm import simhash as sh
from daystrata.llm.common import components


def brute_print(text):
    w = solid(lowered(text))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and part[i] != part[j]:
                old = part[i]
                part = [part[j] if p == old else p for p in part]
    ids = {}
    for (doc, _), p in zip(rows, part):
        if doc is not None:
            ids[p] = min(ids.get(p, doc), doc)
    return [(doc, prints[i], ids.get(part[i])) for i, (doc, _) in enumerate(rows)]


def rows_of_copies():
    rng = random.Random(3)
    line = lambda n: [f"v{rng.randrange(500)}" for _ in range(n)]
    base = line(400)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "two words"), (None, "one"), (None, " ".join(line(9)))]
    for i in range(60):  # a chain of near copies, and copies of copies
        rows.append((100 - i, " ".join(base)))
        base[rng.randrange(400)] = f"n{i}"
    rows += [(200 + i, " ".join(line(30))) for i in range(40)] + [(50, rows[20][1]), (50, rows[20][1])]
    rows.append((300, " ".join(line(20000))))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = rows_of_copies()
    found = sh.near_duplicates(documents(spark, rows, extra=("fingerprint", "component_id"))).collect()
    got = [(r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in found]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)


def test_small_trees_lose_no_link(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 300:
        x = centre
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            x ^= 1 << b
        values.add(x)
    values = [sh._signed(v) for v in values]
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    for limit in (4, 16, 1024):
        edges = {tuple(sorted(r)) for r in sh.links(frame, tree_nodes=limit).collect()}
        assert _parts(values, edges) == _parts(values, {(a, b) for a in values for b in values if a < b
                                                        and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2})


def _parts(values, edges):
    part = {v: v for v in values}

    def root(v):
        while part[v] != v:
            v = part[v]
        return v

    for a, b in edges:
        part[root(a)] = root(b)
    groups = {}
    for v in values:
        groups.setdefault(root(v), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 100)] + [(900, 900), (1000, 1001)] * 2
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{500 + i: 500 for i in range(100)}, 1000: 1000, 1001: 1000}


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = rows_of_copies()
    docs = documents(spark, rows, extra=("_text_hash", "component"))
    kept = sh.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    want = {c for _, _, c in brute_components(rows) if c is not None}
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1
    assert sh.deduplicate(docs.limit(0)).count() == 0
