import numpy as np
import pytest

from daystrata.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def grid(v):
    return [int(np.floor(64 * np.float64(np.float32(c)))) + 1000000 for c in v]


def brute(rows):
    """Plain numpy over the same contract: rows that count, fit list, whitened values by definition."""
    ok = [(i, grid(v)) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in ok}), object)
    n, total = len(fit), fit.sum(axis=0)
    y = np.array((fit * n - total), np.float64) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)
    return ok, n, total, e[order], v[:, order]


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim)) * np.linspace(2, 0.3, dim)
    rows = [(i, (rng.normal(size=dim) @ mix + 3).astype(np.float32).tolist(), 0) for i in range(n)]
    for i in range(n // 3):  # a third of the rows are one vector
        rows[i] = (i, rows[0][1], 0)
    none = [None] + [1.0] * (dim - 1)
    return rows + [(n, None, 0), (n + 1, none, 0), (n + 2, [float("nan")] * dim, 0), (n + 3, [float("inf")] * dim, 0),
                   (None, rows[5][1], 0), (7, rows[9][1], 0), (n + 4, [], 0), (n + 5, [1.0], 0)]


@pytest.mark.parametrize("dim", [3, 20])
def test_against_numpy(spark, dim):
    rows = vectors(300, dim)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = wh.whiten(frame.withColumn("component", frame.label).withColumn("x", frame.label)).collect()
    ok, n, total, e, v = brute([r for r in rows if r[1] is None or len(r[1]) == dim])
    k = min(16, dim)
    assert len(got) == len(ok) * k and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    sign = {}
    for i, x in ok:
        d = [n * a - s for a, s in zip(x, total)]
        mine = by[i]
        assert sum(c * c for c in d) in {r.deviation for r in mine}
        if sum(j == i for j, _ in ok) > 1:
            continue
        for r in mine:
            want = float(np.array(d, float) / n @ v[:, r.component - 1] / np.sqrt(e[r.component - 1]))
            flip = sign.setdefault(r.component, np.sign(want * r.whitened))
            assert r.whitened * flip == pytest.approx(want, abs=1e-7)
            assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-9


def test_covariances_come_from_variances_of_sums(spark):
    """Exactly, with values whose squares overflow 64 bits; the covariances vanish without the pair sums."""
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 40), 1 << 40, size=(50, 4))
    frame = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(3)
    n, total = wh.sums(frame)
    assert n == 50 and total == [sum(map(int, c)) for c in x.T]
    centre = [s // n for s in total]
    square = wh.squares(frame, centre)
    y = [[int(a) - c for a, c in zip(r, centre)] for r in x]
    assert all(square[i, j] == sum((r[i] + (r[j] if j != i else 0)) ** 2 for r in y) for i in range(4) for j in range(i, 4))
    model = wh.Whitening.of(n, total, centre, square)
    assert np.allclose(model.vectors * model.values @ model.vectors.T, np.cov(x.T.astype(float), bias=True), rtol=1e-10)


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert wh.whiten(empty).collect() == [] and wh.whiten(spark.createDataFrame([(1, [], 0)], SCHEMA)).collect() == []
    one = wh.whiten(spark.createDataFrame([(1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0)], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)] * 4
    flat = wh.whiten(spark.createDataFrame([(i, [float(i), 2.0], 0) for i in range(4)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].explained == 1.0
    huge = wh.whiten(spark.createDataFrame([(i, [i * 1e9, 1.0 - i], 0) for i in range(3)], "vec_id long, embedding array<double>, label int"))
    assert all(r.deviation is None or r.deviation >= 0 for r in huge.collect())
