import numpy as np
import pytest
from conftest import days
from pyspark.sql import functions as F

from daystrata.operators import metrics as mt
from daystrata.operators import prefix
from daystrata.operators import resample as rs
from daystrata.spec import PanelSpec

SPEC = PanelSpec()


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(2000), 2)  # ties
    y = (rng.random(2000) < p * 0.4).astype(int)
    rows = [(i, "hot" if i % 3 else "cold", int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return y, p, spark.createDataFrame(rows, "id bigint, entity string, label int, p double").repartition(5).cache()


def brute_ap(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        tp, fp = (w * y)[hit].sum(), (w * (1 - y))[hit].sum()
        ap += (tp / (w * y).sum() - last) * tp / (tp + fp)
        last = tp / (w * y).sum()
    return ap


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_rank_metrics(scores):
    y, p, df = scores
    r = mt.rank_metrics(df).first()
    assert r.average_precision == pytest.approx(brute_ap(y, p)) and r.roc_auc == pytest.approx(brute_auc(y, p))


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.9)], "label int, p double")
    r = mt.rank_metrics(df).first()
    assert r.average_precision is None and r.roc_auc is None
    g = mt.grouped_report(df.withColumn("entity", F.lit("x")), 0.5, ["entity"]).first()
    assert g.f1 is None and g.fp == 1


def test_threshold_metrics_and_sweep_agree(scores):
    y, p, df = scores
    for r in mt.sweep(df, [0.3, 0.5, 0.7]).collect():
        hit = p >= r.threshold
        assert (r.tp, r.fp, r.fn, r.tn) == ((y & hit).sum(), ((1 - y) & hit).sum(), (y & ~hit).sum(), ((1 - y) & ~hit).sum())
        assert r.f1 == pytest.approx(mt.threshold_metrics(df, r.threshold).first().f1)


def test_calibration_bins(spark):
    df = spark.createDataFrame([(p, int(p > 0.5)) for p in (0.1, 0.2, 0.3, 0.6, 0.7, 1.0)], "p double, label int")
    # bin edges are i * 0.1 in doubles: 0.3, 0.6 and 0.7 fall below their edge
    edges = [i * 0.1 for i in range(10)]
    bins = {}
    for p in (0.1, 0.2, 0.3, 0.6, 0.7, 1.0):
        bins.setdefault(sum(p >= e for e in edges), []).append(p)
    expected = sum(abs(sum(q > 0.5 for q in b) - sum(b)) for b in bins.values()) / 6
    assert mt.calibration_error(df).first().ece == pytest.approx(expected)


def test_best_threshold_ties(spark):
    t = spark.createDataFrame([(0.2, 0.5, 0.5, 0.5, 0.5), (0.4, 0.6, 0.42, 0.5, 0.4), (0.6, 0.6, 0.42, 0.5, 0.4), (0.8, 0.2, 0.9, 0.3, 0.9)],
                              "threshold double, precision double, recall double, f1 double, fbeta double")
    assert mt.best_threshold(t, "f1_precision").first().threshold == 0.4
    assert mt.best_threshold(t, "f1_first").first().threshold == 0.2
    assert mt.best_threshold(t, "recall_floor").first().threshold == 0.2


def test_exact_quantiles_of_a_hot_group(scores):
    y, p, df = scores
    out = {r.entity: r for r in prefix.exact_quantiles(df, "p", {"a": 0.0, "m": 0.5, "x": 0.93}, ["entity"]).collect()}
    for e, mask in (("hot", np.arange(2000) % 3 > 0), ("cold", np.arange(2000) % 3 == 0)):
        np.testing.assert_allclose([out[e].a, out[e].m, out[e].x], np.quantile(p[mask], [0, 0.5, 0.93]))


def test_row_index_is_a_total_order(scores):
    _, p, df = scores
    out = prefix.row_index(df, ["p", "id"]).orderBy("row_index").collect()
    assert [r.row_index for r in out] == list(range(2000))
    assert [(r.p, r.id) for r in out] == sorted((float(x), i) for i, x in enumerate(p))


def test_rank_correlation(scores):
    y, p, df = scores
    import pandas as pd
    x = pd.DataFrame({"a": p, "b": (np.arange(2000) * 7 % 50)})
    r = mt.rank_correlation(df.withColumn("b", F.col("id") * 7 % 50), "p", "b").first()
    assert r.rho == pytest.approx(x["a"].rank().corr(x["b"].rank())) and r.n == 2000


def test_multinomial_blocks_add_up():
    for d in range(20):
        assert sum(rs.slots_in_range(1, d, 1003, 100, b) for b in range(11)) == 1003


def test_iid_bootstrap(scores):
    y, p, df = scores
    draws = rs.draw_sums(df, F.col("id"), 0.5, draws=60, seed=3, width=300).toPandas()
    assert len(draws) == 60 and (draws[["tp", "fp", "tn", "fn"]].sum(axis=1) == 2000).all()
    hit = p >= 0.5
    tp = (y & hit).sum()
    assert abs(draws["tp"].mean() - tp) < 4 * np.sqrt(tp) / np.sqrt(60) + 1
    assert draws["tp"].std() == pytest.approx(np.sqrt(tp * (1 - tp / 2000)), rel=0.4)
    ci = {r.metric: r for r in rs.iid_interval(df, F.col("id"), 0.5, draws=60).collect()}
    f1 = mt.threshold_metrics(df, 0.5).first().f1
    assert ci["f1"].lower <= f1 <= ci["f1"].upper


def test_block_bootstrap_of_identical_models_includes_zero(spark):
    rng = np.random.default_rng(2)
    from conftest import days
    rows = [(e, d, int(x > 0.7), float(x), float(min(1, x * 0.5 + 0.3 * z))) for e in "ab"
            for d, x, z in zip(days(100), rng.random(100), rng.random(100))]
    df = spark.createDataFrame(rows, "entity string, date date, label int, p_ref double, p_cmp double")
    same = rs.paired_block_interval(df.withColumn("p_cmp", F.col("p_ref")), SPEC, draws=20, threshold_cmp=0.7).collect()
    assert all(r.includes_zero and r.mean_diff == 0 for r in same) and len(same) == 2
    other = {r.metric: r for r in rs.paired_block_interval(df, SPEC, draws=20).collect()}
    assert other["pr_auc"].mean_diff < 0 and other["pr_auc"].lower <= other["pr_auc"].upper


def test_student_tail(spark):
    from daystrata.functions.student import two_sided_p
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (12.706204736, 1.0), (float("inf"), 3.0)], "t double, d double")
    got = [r[0] for r in df.select(two_sided_p("t", "d")).collect()]
    assert got == pytest.approx([0.07338803477074, 1.0, 0.05, 0.0], abs=1e-6)


def test_block_metrics_equal_resampled_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(e, d, int(rng.random() < 0.4), float(rng.integers(0, 30)) / 30, 0.5) for e, n in (("a", 60), ("b", 45), ("c", 5)) for d in days(n)]
    df = spark.createDataFrame(rows, "entity string, date date, label int, p_ref double, p_cmp double")
    monkeypatch.setattr(rs, "RANGE_ROWS", 20)
    monkeypatch.setattr(rs, "DRAWS_AT_ONCE", 3)
    got = {r.draw: (r.f1, r.average_precision) for r in rs.block_metrics(df, SPEC, "p_ref", 0.5, 7, 8, 3).collect()}
    seeds = {r.entity: abs(r.h) for r in df.select("entity", F.xxhash64("entity").alias("h")).distinct().collect()}
    for draw in range(8):
        y, p = [], []
        for e, seed in seeds.items():
            own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == e)
            for s in np.random.default_rng([3, draw, seed]).integers(0, len(own), max(1, len(own) // 7)):
                y += [r[1] for r in own[s:s + 7]]
                p += [r[2] for r in own[s:s + 7]]
        y, p = np.array(y), np.array(p)
        tp, fp, fn = ((p >= 0.5) & (y == 1)).sum(), ((p >= 0.5) & (y == 0)).sum(), ((p < 0.5) & (y == 1)).sum()
        ap = sum(((p == t) & (y == 1)).sum() * ((p >= t) & (y == 1)).sum() / (p >= t).sum() for t in np.unique(p)) / y.sum()
        assert got[draw] == pytest.approx((2 * tp / (2 * tp + fp + fn), ap))


def test_percent_sweep_counts_each_threshold_exactly(spark):
    """Scores on and beside the thresholds, outside of [0, 1] and missing; two groups."""
    import math
    ps = [k / 100 for k in range(101)] + [math.nextafter(k / 100, s) for k in range(101) for s in (-1, 2)] + [-0.5, 1.5]
    rows = [(g, p, (i + g) % 2) for g in (0, 1) for i, p in enumerate(ps)] + [(0, None, 1), (1, float("nan"), 1), (2, 0.3, 1)]
    df = spark.createDataFrame(rows, "g int, p double, label int")
    got = mt.percent_sweep(df, 5, 94, by=["g"]).collect()
    assert len(got) == 3 * 90
    for r in got:
        mine = [(p, y) for g, p, y in rows if g == r.g and p is not None and p == p]
        assert (r.tp, r.fp) == (sum(y for p, y in mine if p >= r.threshold), sum(1 - y for p, y in mine if p >= r.threshold))
        assert r.tp + r.fp + r.tn + r.fn == len(mine)
    wide = mt.sweep(df.filter("NOT isnan(p)"), [k / 100 for k in range(5, 95)]).select("threshold", "tp", "fp", "fn", "tn").collect()
    assert sorted(map(tuple, wide)) == sorted(map(tuple, mt.percent_sweep(df, 5, 94).select("threshold", "tp", "fp", "fn", "tn").collect()))


def test_no_threshold_helps(spark):
    none = spark.createDataFrame([(0.6, 0), (0.01, 1)], "p double, label int")
    assert mt.best_threshold(mt.percent_sweep(none, 5, 94), "f1_first").first().threshold == 0.5


def test_order_key_is_the_order_of_doubles(spark):
    import math
    import struct
    import sys
    rng = np.random.default_rng(0)
    v = [0.0, 5e-324, -5e-324, 2.2250738585072014e-308, sys.float_info.max, -sys.float_info.max, math.inf, -math.inf, 1.0, math.nextafter(1, 0),
         math.nextafter(1, 2), 2.0**52, 8.0, math.nextafter(8, 0), 0.1, -0.1]
    v += [x for x in (struct.unpack("<d", rng.bytes(8))[0] for _ in range(3000)) if x == x]
    got = dict(map(tuple, spark.createDataFrame([(x,) for x in v], "v double").select("v", prefix.order_key(F.col("v")).alias("k")).collect()))
    for x in v:
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert got[x] == (-bits if x < 0 else bits), x
    odd = spark.createDataFrame([(-0.0,), (float("nan"),), (None,)], "v double").select(prefix.order_key(F.col("v"))).collect()
    assert [r[0] for r in odd] == [0, 2**63 - 1, None]


@pytest.mark.parametrize("rows", [0, 1, 20, 250_000])
def test_quantiles_between_neighbouring_doubles(spark, monkeypatch, rows):
    """For any size of a cell that is sorted, down to none, which takes every pass. All rows of a group on two neighbouring doubles, a null group, negative values; against numpy."""
    import math
    monkeypatch.setattr(prefix, "BUCKET_ROWS", rows)
    rng, up = np.random.default_rng(1), math.nextafter(0.3, 1)
    data = {"a": [0.3] * 700 + [up] * 301, "b": list(rng.normal(0, 1e-3, 400)) + [-1e300, 1e300], None: [-2.5], "c": list(rng.integers(-5, 5, 333) / 4.0)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None), ("z", None)], "g string, x double").repartition(3)
    out = {r.g: r for r in prefix.exact_quantiles(df, "x", {"lo": 0.0, "q1": 0.25, "m": 0.5, "q": 0.933, "hi": 1.0}, ["g"]).collect()}
    assert set(out) == set(data)
    for g, xs in data.items():
        want = np.quantile(np.array(xs), [0.0, 0.25, 0.5, 0.933, 1.0])
        assert np.allclose([out[g][c] for c in ("lo", "q1", "m", "q", "hi")], want, rtol=1e-12, atol=0), g
    assert prefix.exact_quantiles(df.limit(0), "x", {"m": 0.5}).collect() in ([], [(None,)])


def test_buckets_are_cut_until_they_are_small(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BUCKET_ROWS", 40)
    rng = np.random.default_rng(2)
    xs = [1 + i * 2.0**-52 for i in range(300)] + list(rng.normal(0, 1, 500)) + [0.5] * 100
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    rows = [(r.x, r["_bucket"]) for r in prefix.with_bucket(df, "x").collect()]
    assert len(rows) == len(xs)
    rows.sort()
    assert [b for _, b in rows] == sorted(b for _, b in rows)
    sizes = {}
    for x, b in rows:
        sizes.setdefault(b, []).append(x)
    assert all(len(s) <= 40 or len(set(s)) == 1 or max(s) - min(s) < 2.0**-36 for s in sizes.values())
    plan = prefix.with_bucket(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "1.0" not in plan  # no cut is a literal


def test_ranking_reads_its_rows_once(spark, monkeypatch):
    """Few raw rows a bucket: every digit is looked into, but the scored rows are evaluated once only."""
    monkeypatch.setattr(prefix, "BUCKET_ROWS", 40)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def p(i):
        seen.add(1)
        return 1 / (1 + i // 2)

    rows = spark.range(600).select(p("id").alias("p"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    got = mt.rank_metrics(rows.withColumn("q", F.lit(0))).first()
    assert (got.positives, got.negatives) == (200, 400) and seen.value == 600


def test_ranks_read_their_rows_once(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BUCKET_ROWS", 40)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def x(i):
        seen.add(1)
        return 1 / (1 + i // 2)

    ranks = prefix.average_ranks(spark.range(600).select(x("id").alias("x")).repartition(3), "x").collect()
    assert len(ranks) == 300 and {r.n for r in ranks} == {2} and seen.value <= 1200  # the null filter and the value
