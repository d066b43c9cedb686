from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from conftest import days

from daystrata.operators import climatology as cl
from daystrata.operators import features as ft
from daystrata.operators import splits as sp
from daystrata.spec import HEAT, PanelSpec

SPEC = PanelSpec()


def frame(spark, values, entity="a"):
    rows = [(entity, d, None if v is None else float(v), None if v is None else v - 10.0, 0, int(i % 4 == 0), "coastal")
            for i, (d, v) in enumerate(zip(days(len(values)), values))]
    return spark.createDataFrame(
        rows, "entity string, date date, v double, departure double, qualifying int, label int, region_type string")


def brute_slope(past, width):
    out = []
    for i in range(len(past)):
        if i < width - 1:
            out.append(np.nan)
            continue
        y = past[i - width + 1:i + 1]
        ok = ~np.isnan(y)
        out.append(np.polyfit(np.arange(width)[ok], y[ok], 1)[0] if ok.sum() >= 2 else np.nan)
    return np.array(out)


@pytest.fixture(scope="module")
def built(spark):
    values = [None if i in (4, 16) else float(i + 1 + (i * 7) % 5) for i in range(40)]
    return values, ft.build(frame(spark, values), SPEC).orderBy("date").toPandas()


def test_lags_rolls_and_deltas(built):
    values, out = built
    s = pd.Series([np.nan if v is None else v for v in values])
    past = s.shift(1)
    for k in (1, 2, 3, 7):
        pd.testing.assert_series_equal(out[f"v_lag{k}"], s.shift(k), check_names=False)
    for w in (3, 7):
        r = past.rolling(w, min_periods=w)
        for name in ("mean", "max", "min"):
            pd.testing.assert_series_equal(out[f"v_roll{w}_{name}"], getattr(r, name)(), check_names=False)
    for k in (1, 3, 7):
        pd.testing.assert_series_equal(out[f"v_delta_{k}d"], s - s.shift(k), check_names=False)


def test_slopes_skip_nulls_but_keep_positions(built):
    values, out = built
    past = pd.Series([np.nan if v is None else v for v in values]).shift(1).to_numpy()
    for w in (3, 7):
        np.testing.assert_allclose(out[f"v_slope_{w}d"].to_numpy(float), brute_slope(past, w), atol=1e-9)


def test_zscore(built):
    values, out = built
    dep = pd.Series([np.nan if v is None else v - 10 for v in values])
    r = dep.shift(1).rolling(30, min_periods=10)
    expected = (dep - r.mean()) / r.std().replace(0, np.nan)
    np.testing.assert_allclose(out["departure_zscore"].to_numpy(float), expected.to_numpy(), atol=1e-9)


def test_constant_series_has_no_zscore(spark):
    out = ft.build(frame(spark, [5.0] * 35), SPEC).toPandas()
    assert out["departure_zscore"].isna().all()


def test_target_is_the_next_label_and_trim_drops_edges(spark):
    built = ft.build(frame(spark, list(range(30))), SPEC)
    x = built.orderBy("date").toPandas()
    assert x["target"].iloc[:-1].tolist() == x["label"].iloc[1:].tolist() and np.isnan(x["target"].iloc[-1])
    kept = ft.trim(built).orderBy("date").toPandas()
    assert len(kept) == 30 - 10 - 1 and kept["date"].iloc[0] == days(30)[10]


def test_entities_do_not_mix_and_row_order_is_irrelevant(spark):
    a, b = frame(spark, list(range(20))), frame(spark, list(range(100, 120)), "b")
    both = ft.build(a.union(b).orderBy("v", ascending=False).repartition(3), SPEC).filter("entity = 'b'").orderBy("date")
    alone = ft.build(b, SPEC).orderBy("date")
    pd.testing.assert_frame_equal(both.toPandas(), alone.toPandas())


def test_contract_has_110_columns_and_the_baseline_29():
    assert len(HEAT.contract()) == 110 and HEAT.contract() == sorted(HEAT.contract())
    assert len(HEAT.baseline_contract()) == 29


def test_sequences(spark):
    out = ft.sequences(frame(spark, list(range(10))), SPEC, ["v"], 4).orderBy("date").collect()
    assert len(out) == 7 and [x[0] for x in out[0].sequence] == [0.0, 1.0, 2.0, 3.0]


def test_normals_interpolate_and_wrap(spark):
    known = {10: 1.0, 20: 3.0, 300: 7.0}
    means = spark.createDataFrame([("a", d, v) for d, v in known.items()], "entity string, doy int, mean double")
    dense = cl.fill_days(means, SPEC).orderBy("doy").toPandas()
    expected = pd.Series(np.nan, index=range(1, 367))
    expected.update(pd.Series(known))
    expected = expected.interpolate(limit_direction="both")
    np.testing.assert_allclose(dense["mean"], expected.to_numpy())
    smooth = cl.circular_mean(cl.fill_days(means, SPEC), SPEC).orderBy("doy").toPandas()["normal"].to_numpy()
    ring = expected.to_numpy()
    brute = [np.mean([ring[(i + o) % 366] for o in range(-15, 16)]) for i in range(366)]
    np.testing.assert_allclose(smooth, brute)


def test_nearest_normal_prefers_the_later_day(spark):
    t = spark.createDataFrame([("a", 10, 1.0), ("a", 14, 2.0), ("a", 366, 9.0)], "entity string, doy int, normal double")
    out = {r.doy: r.normal for r in cl.nearest_normals(t, SPEC).collect()}
    assert len(out) == 366 and out[12] == 2.0 and out[11] == 1.0 and out[1] == 9.0 and out[100] == 35.0


def test_qualifying_thresholds(spark):
    rows = [("p", 40.0, 4.5, "plains", 1), ("p", 39.9, 9.0, "plains", 0), ("p", 45.0, 0.0, "plains", 1), ("c", 37.0, 4.5, "coastal", 1),
            ("c", 46.0, 4.4, "coastal", 0), ("p", None, None, "plains", 0)]
    df = spark.createDataFrame(rows, "entity string, v double, departure double, region_type string, want int")
    assert all(r.qualifying == r.want for r in cl.qualifying_absolute(df, SPEC).collect())


def test_scaler_uses_population_spread_of_train_only(spark):
    df = frame(spark, [1.0, 3.0, 5.0, 100.0]).withColumn("flat", df_lit(7.0))
    train = df.filter("v < 50")
    out = ft.apply_scaler(df, ft.fit_scaler(train, ["v", "flat"]), ["v", "flat"]).orderBy("date").toPandas()
    std = np.std([1, 3, 5])
    np.testing.assert_allclose(out["v"], [(x - 3) / std for x in (1, 3, 5, 100)])
    assert (out["flat"] == 0).all()


def df_lit(x):
    from pyspark.sql import functions as F
    return F.lit(x)


def test_resampling_counts(spark):
    from pyspark.sql import functions as F
    df = spark.range(1000).withColumn("label", (F.col("id") % 20 == 0).cast("int"))
    under = sp.undersample(df, "label", F.col("id"), ratio=3)
    assert under.filter("label = 1").count() == 50 and under.filter("label = 0").count() == 150
    over = sp.oversample(df, "label", F.col("id"))
    assert over.filter("label = 1").count() == 950 and over.filter("label = 0").count() == 950
    assert over.filter("label = 1").select("id").distinct().count() > 45


def test_splits_partition_the_panel(spark):
    df = frame(spark, list(range(20)))
    s = sp.by_year(df, SPEC, 1999, 2000)
    assert s.groupBy("split").count().collect()[0]["count"] == 20
    x, y, m = sp.roles(s.withColumn("target", s.label), SPEC, ["v"], "val")
    assert sp.reassemble(x, y, m, SPEC).count() == 20
    with pytest.raises(ValueError):
        sp.roles(s, SPEC, ["target"], "val")


def test_live_features_match_the_batch_rows(spark):
    from daystrata.streaming.live import newest_features
    values = [float((i * 13) % 29) for i in range(120)]
    p = frame(spark, values)
    live = newest_features(p, SPEC).orderBy("date").toPandas()
    batch = ft.build(p, SPEC, live=True).orderBy("date").toPandas().tail(7).reset_index(drop=True)
    for c in ("v_lag7", "v_roll7_mean", "v_slope_7d", "departure_zscore", "label_lag1"):
        np.testing.assert_allclose(live[c].to_numpy(float), batch[c].to_numpy(float), atol=1e-9)


def test_heat_configuration_builds_the_whole_contract(spark):
    from pyspark.sql import functions as F

    from daystrata.operators import runs
    from daystrata.operators.contract import check, project
    from daystrata.spec import WEATHER
    rng = np.random.default_rng(3)
    rows = [(c, d, "coastal" if c == "mumbai" else "plains", 20.0, 70.0, *map(float, rng.random(len(WEATHER)) * 45))
            for c in ("delhi", "mumbai") for d in days(400)]
    schema = "city_key string, date date, region_type string, latitude double, longitude double, " + ", ".join(f"{w} double" for w in WEATHER)
    p = spark.createDataFrame(rows, schema)
    n = cl.normals(p, HEAT, "2000-01-01", "2000-12-31")
    x = runs.label_runs(cl.qualifying_absolute(cl.attach(p, n, HEAT), HEAT), HEAT)
    f = ft.trim(ft.build(x, HEAT)).withColumn("entity_code", (F.col("city_key") == "mumbai").cast("int"))
    out = project(f, HEAT.contract(), ["city_key", "date"])
    assert len(out.columns) == 112 and out.count() == 2 * (400 - 11)
    assert check(out, HEAT.contract()).count() == 0


def test_curves_are_the_row_wise_normals(spark):
    rows = [(e, d, float((i * 37 + len(e)) % 101) / 3) for e, n in (("a", 700), ("bb", 40), ("ccc", 1)) for i, d in enumerate(days(n, "2000-03-05")) if i % 7 != 3]
    df = spark.createDataFrame(rows, "entity string, date date, v double").repartition(3)
    slow = cl.circular_mean(cl.fill_days(cl.doy_means(df, SPEC, "2000-01-01", "2001-12-31"), SPEC), SPEC)
    fast = cl.normals(df, SPEC, "2000-01-01", "2001-12-31")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.select("entity", "doy", "normal").collect()))
    curves = cl.curves(df, SPEC, "2000-01-01", "2001-12-31")
    key = ["entity", "date", "v", "normal", "departure"]
    assert sorted(map(tuple, cl.attach_curves(df, curves, SPEC).select(key).collect())) == sorted(map(tuple, cl.attach(df, slow, SPEC).select(key).collect()))


def test_the_panel_is_not_dealt_out_by_day_of_year(spark):
    from daystrata.plans import panels
    plan = panels.departed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # entity and date for the daily rows (twice), entity for all that follows
    assert "_doy" not in plan and plan.count("Generate") == 0
