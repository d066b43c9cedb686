import numpy as np
import pytest
from pyspark.sql import functions as F

from daystrata.operators import neighbours as nb
from daystrata.operators.splits import smote


def rows(n, dims, seed):
    """Clusters of very different density on a grid of 1/16, a third of all rows on one spot, and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, 1)) < 0.4, rng.normal(0, 0.3, (n, dims)), rng.normal(5, 20, (n, dims)))
    x = np.round(x * 16) / 16
    x[: n // 3] = x[0]
    keys = rng.permutation(n * 3)[:n]
    good = [(int(k), *map(float, v)) for k, v in zip(keys, x)]
    bad = [(None, *map(float, x[1])), (10**6, None, *[0.0] * (dims - 1)), (10**6 + 1, float("nan"), *[0.0] * (dims - 1)),
           (10**6 + 2, float("inf"), *[0.0] * (dims - 1)), (10**6 + 3, -0.0, *[0.0] * (dims - 1)), (10**6 + 4, *[0.0] * dims)]
    return good + bad


def brute(data, k):
    ok = [r for r in data if r[0] is not None and all(c is not None and np.isfinite(c) for c in r[1:])]
    keys, x = np.array([r[0] for r in ok]), np.array([r[1:] for r in ok])
    out = {}
    for i in range(len(ok)):
        d = ((x - x[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((keys, d)) if j != i][:k]
        out[int(keys[i])] = [(float(np.sqrt(d[j])), int(keys[j])) for j in order]
    return out


@pytest.mark.parametrize("dims,share,pivots", [(1, 4096, 1024), (3, 40, 8), (6, 4096, 1)])
def test_nearest_rows_against_all_pairs(spark, monkeypatch, dims, share, pivots):
    monkeypatch.setattr(nb, "SHARE_POINTS", share)
    monkeypatch.setattr(nb, "MAX_PIVOTS", pivots)
    data, names = rows(500, dims, dims), [f"f{i}" for i in range(dims)]
    frame = spark.createDataFrame(data, "key long, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    frame = frame.withColumns({"point": F.lit("x"), "cell": F.lit(1), "distance": F.lit(0)})  # clashing names
    got = {r.key: [(n.distance, n.key) for n in r.neighbours] for r in nb.nearest_rows(frame, "key", names, 5, cell_points=20).collect()}
    assert got == brute(data, 5)


def test_no_task_gets_more_than_a_share(spark, monkeypatch):
    """A dense cell is cut; a spot with a third of all rows is one point."""
    monkeypatch.setattr(nb, "SHARE_POINTS", 64)
    seen, inner = [], nb._best

    def watched(k):
        run = inner(k)

        def sized(asked, held):
            out = run(asked, held)
            return out.assign(distances=[[float(len(asked)), float(len(held))]] * len(out))
        return sized

    monkeypatch.setattr(nb, "_best", watched)
    points = spark.createDataFrame([(i, [float(i % 37), float(i)], [i]) for i in range(900)], "point long, x array<double>, ids array<long>")
    placed = points.withColumns({"cell": F.lit(0), "away": F.lit(0.0)})
    cells = nb.Cells(np.zeros((1, 2)), np.array([1000.0]), np.array([-(-900 // 64)]))
    seen = nb._searched(placed.select("point", "x", "cell"), placed, cells, 3).select("distances").distinct().collect()
    assert max(max(r.distances) for r in seen) <= 2 * 64 and len(seen) > 10


def test_cells_are_ruled_out(spark):
    """The triangle inequality keeps most cells away, and never one that holds a nearer point."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 10, (2000, 2))
    pivots = x[:50]
    cells = nb.Cells(pivots, np.zeros(50), np.ones(50, int))
    d = cells.distances(x)
    own = d.argmin(1)
    cells.radius = np.array([d[own == c, c].max() for c in range(50)])
    reach = np.full(len(x), 1.0)
    found = list(cells.visits(x, reach))
    for i in range(0, 2000, 17):
        near = np.flatnonzero(((x - x[i]) ** 2).sum(1) <= 1)
        assert set(own[near]) - {own[i]} <= set(found[i])
    assert np.mean([len(f) for f in found]) < 6


def test_empty_and_single(spark):
    one = spark.createDataFrame([(1, 2.0)], "key long, f double")
    assert nb.nearest_rows(one.limit(0), "key", ["f"], 5).collect() == []
    assert [r.neighbours for r in nb.nearest_rows(one, "key", ["f"], 5).collect()] == [[]]


def test_smote_balances_between_neighbours(spark):
    data = [(i, 1, float(i % 7), float(i)) for i in range(12)] + [(100 + i, 0, -5.0, 0.0) for i in range(50)]
    data += [(200, 1, None, 1.0), (201, None, 1.0, 1.0)]
    frame = spark.createDataFrame(data, "key long, label int, f double, g double")
    out = smote(frame, "label", F.col("key"), ["f", "g"], k=3).collect()
    made = [r for r in out if r.draw is not None]
    assert sum(r.label == 1 for r in out) == sum(r.label == 0 for r in out) == 50 and len(out) == 101
    assert sorted(r.draw for r in made) == list(range(37))
    near = brute([(k, f, g) for k, y, f, g in data if y == 1], 3)
    at = {k: (f, g) for k, _, f, g in data}
    for r in made:
        assert r.neighbour in [k for _, k in near[r.base]] and 0 <= r.gap < 1 and 200 not in (r.base, r.neighbour)
        for value, a, b in zip((r.f, r.g), at[r.base], at[r.neighbour]):
            assert value == pytest.approx(a + r.gap * (b - a))
    lone = frame.filter("label = 0 or key = 3")
    assert smote(lone, "label", F.col("key"), ["f", "g"]).count() == 51
    assert smote(frame.limit(0), "label", F.col("key"), ["f", "g"]).count() == 0


def test_work_of_a_visit_does_not_grow_with_the_cell(monkeypatch):
    """Inside a cell most boxes are left out, whatever the cell's size, and the entries are those of a full comparison."""
    import pandas as pd
    compared, inner = [], nb._squares
    monkeypatch.setattr(nb, "_squares", lambda q, x: compared.append(len(q) * len(x)) or inner(q, x))
    rng = np.random.default_rng(3)
    work = {}
    for n in (1000, 8000):
        x = np.unique(np.round(rng.uniform(0, 40, (n, 3)) * 4) / 4, axis=0)
        ids = [list(range(6 * i, 6 * i + 1 + i % 6)) for i in range(len(x))]
        held = pd.DataFrame({"x": list(x), "ids": ids})
        pick = rng.permutation(len(x))
        for reach in (np.inf, 4.0):
            compared.clear()
            got = nb._best(6)(pd.DataFrame({"visitor": pick, "vx": list(x[pick]), "reach": reach}), held).set_index("point")
            work[n, reach] = sum(compared) / len(x)
            for i in pick[::n // 100]:
                d = ((x - x[i]) ** 2).sum(1)
                want = sorted((d[j], key) for j in np.flatnonzero(d <= reach) for key in ids[j])[:6]
                assert list(zip(got.distances[i], got["keys"][i])) == want
                assert [list(v) for v in got.vectors[i]] == [list(x[key // 6]) for _, key in want]
    assert work[8000, np.inf] < 4 * work[1000, np.inf] and work[8000, np.inf] < 8000 / 2
