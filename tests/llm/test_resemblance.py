import random

from helpers import documents, lowered, solid

from daystrata.llm import resemblance as rs
from daystrata.llm import simhash as sh


def brute_shingles(text):
    w = solid(lowered(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(rows):
    """Components of the pairs with 0.8 of their shingles in common, as sorted lists of row numbers."""
    sets, part = [brute_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    groups = {}
    for i, p in enumerate(part):
        groups.setdefault(p, []).append(i)
    return sorted(groups.values())


def first_ids(rows):
    return sorted(min(rows[i][0] for i in g) for g in brute_groups(rows))


def rows_of_edits():
    rng = random.Random(5)
    line = lambda n: [f"v{rng.randrange(500)}" for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "oNE"), (6, "one two"), (7, "a b c d"), (8, "A b\nc d")]
    for k in range(12):  # copies at about 0.95 down to about 0.6
        base = line(300)
        rows.append((1000 - 2 * k, " ".join(base)))
        for at in rng.sample(range(300), 1 + 2 * k // 2):
            base[at] = f"n{k}-{at}"
        rows.append((1001 - 2 * k, " ".join(base).upper()))
    base = line(120)
    for i in range(60):  # a chain: its ends resemble each other less than 0.8
        rows.append((500 - i, " ".join(base)))
        base[rng.randrange(120)] = f"n{i}"
    core = line(150)
    for i in range(50):  # each shares about 0.8 with the others
        rows.append((600 + i, " ".join(core + [f"x{i}-{j}" for j in range(rng.randrange(5, 30))])))
    return rows + [(700 + i, " ".join(line(30))) for i in range(40)] + [(800, " ".join(line(20000)))]


def test_groups_equal_brute_force(spark):
    rows = rows_of_edits()
    for size, nearest in ((3, 0), (20, 1), (rs.SLICE, rs.NEAREST)):  # small cells, and a first pass that finds little
        assert sorted(r.doc_id for r in rs.deduplicate(documents(spark, rows), size, nearest).collect()) == first_ids(rows)


def test_a_near_copy_beyond_two_bits_goes(spark):
    """The stage kept both: their SimHashes of three words differ in more than two bits."""
    rng = random.Random(9)
    base = [f"v{rng.randrange(900)}" for _ in range(300)]
    edited = list(base)
    for at in (30, 90, 150, 210, 270):
        edited[at] = f"n{at}"
    rows = [(2, " ".join(base)), (1, " ".join(edited)), (3, "another text")]
    assert ((sh.simhash(rows[0][1]) ^ sh.simhash(rows[1][1])) & (1 << 64) - 1).bit_count() > sh.RADIUS
    docs = documents(spark, rows, extra=("hash", "_text_hash", "node"))
    kept = rs.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_null_ids_and_repeated_rows(spark):
    big = (1 << 60) + 1
    rows = [(None, "a b c d e f"), (big, "A b c d e f"), (big, "A b c d e f"), (None, None), (None, "x y z"), (None, "x y z")]
    got = rs.deduplicate(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [(str(big), "A b c d e f"), ("None", "None"), ("None", "x y z")]
    assert rs.deduplicate(documents(spark, rows).limit(0)).count() == 0


def test_shingles_and_bands():
    a, b = rs.shingles(["One two THREE", "one\ntwo three"])
    assert len(a) == 1 and a.tolist() == b.tolist() and rs.shingles([None, ""])[0].size == 0
    rng = random.Random(2)
    for _ in range(200):  # resemblance 0.8: a band in common, bits within the radius
        both = [rng.getrandbits(64) for _ in range(80)]
        sets = [rs.np.unique(rs.np.array(both + [rng.getrandbits(64) for _ in range(10)], rs.np.uint64)) for _ in range(2)]
        assert rs.resembles(*sets)
        (_, x, k, p), (_, y, m, q) = map(rs.sketch, sets)
        assert bool(set(k) & set(m)) and (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count() <= rs.RADIUS
        assert sum(c == d for c, d in zip(p, q)) >= rs.AGREE


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in rs.deduplicate(docs).collect()) == first_ids(rows)


def test_trees_and_small_cells_find_the_same():
    """A cell searched by a BK-tree and one whose pairs are taken at once give the same pairs, of their own cell only."""
    rng, rows = random.Random(3), []
    for cell in range(9):
        base = [rng.getrandbits(64) for _ in range(60)]
        for k in range(rng.randrange(1, 30)):
            own = rs.np.unique(rs.np.array(base[rng.randrange(12):] + [rng.getrandbits(64) for _ in range(rng.randrange(12))], rs.np.uint64))
            name, bits, _, least = rs.sketch(own)
            rows.append((cell, name, bits, least, len(own), rng.random() < 0.7, rng.random() < 0.7))
    table = rs.pd.DataFrame(rows, columns=["key", "node", "bits", "least", "size", "asks", "inside"])
    brief, cell = rs.Brief(table), table["key"].to_numpy()

    def pairs(tree):
        got = [rs.np.stack(brief.alike(i, j)[:2], 1) for i, j in rs.close(brief, cell, table["asks"].to_numpy(), table["inside"].to_numpy(), tree)]
        return sorted(map(tuple, rs.np.concatenate(got).tolist()))

    assert pairs(0) == pairs(8) == pairs(rs.TREE) and len(pairs(0)) > 200
    assert all(cell[i] == cell[j] and table["asks"][i] and table["inside"][j] for i, j in pairs(0))


def test_small_cells_are_searched_by_trees(monkeypatch):
    """Every cell has a BK-tree, the one that insertion gives; pairs beyond the radius are not handed on."""
    from daystrata.llm.simhash import BKTree
    draw = rs.np.random.default_rng(3)
    base = draw.integers(0, 256, (9, 16), dtype=rs.np.uint8)
    bits = base[draw.integers(0, 9, 300)] ^ (rs.np.uint8(1) << draw.integers(0, 8, (300, 16), dtype=rs.np.uint8)) * (draw.random((300, 16)) < 0.5)
    cell = rs.np.sort(draw.integers(0, 40, 300))
    rows = rs.pd.DataFrame({"node": range(300), "size": 10, "bits": [b.tobytes() for b in bits.astype(rs.np.uint8)], "least": [bytes(rs.BANDS * rs.ROWS)] * 300})
    brief, every = rs.Brief(rows), rs.np.ones(300, bool)
    forest = rs.Forest(brief, cell, rs.np.arange(300))
    for c, own in enumerate(forest.cells.tolist()):
        tree = BKTree()
        for i in rs.np.flatnonzero(cell == own).tolist():
            value = int.from_bytes(rows["bits"][i], "big")
            if not tree.values or 0 not in [(v ^ value).bit_count() for v in tree.values]:
                tree.add(value)
        todo = [(0, c)]
        while todo:
            a, b = todo.pop()
            assert int.from_bytes(rows["bits"][forest.lead[b]], "big") == tree.values[a]
            edges = range(forest.edge[b], forest.edge[b + 1])
            assert sorted(tree.children[a]) == forest.apart[forest.edge[b]:forest.edge[b + 1]].tolist()
            todo += [(tree.children[a][int(forest.apart[e])], int(forest.child[e])) for e in edges]
    assert sorted(forest.held.tolist()) == list(range(300))
    got = [(int(x), int(y)) for i, j in rs.close(brief, cell, every, every, rs.TREE) for x, y in zip(i, j)]
    far = rs.np.bitwise_count(brief.bits[:, None] ^ brief.bits[None]).sum(-1)
    want = [(x, y) for x in range(300) for y in range(300) if cell[x] == cell[y] and far[x, y] <= rs.RADIUS]
    assert sorted(got) == want and len(want) > 400 and rs.np.bincount(cell).max() < rs.TREE


def test_keys_and_texts_of_all_documents_are_not_broadcast(spark, monkeypatch):
    plans, written = [], rs.written

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(rs, "written", noted)
    rs.deduplicate(documents(spark, [(i, f"one two three four five {i % 3}") for i in range(9)])).collect()
    for made in ("Generate posexplode", "MapInPandas"):  # the keys of the bands, and the texts that give the sets
        plan, = [p for p in plans if made in p and "hub" in p and "FlatMapGroupsInPandas" not in p]
        first, = [line for line in plan.splitlines() if "Join" in line][:1]
        assert "SortMergeJoin" in first
