import datetime as dt

from conftest import days
from pyspark.sql import functions as F

from daystrata.spec import PanelSpec
from daystrata.streaming import alerts as al
from daystrata.streaming import live as lv

SPEC = PanelSpec()
NOW = dt.datetime(2024, 5, 1, 5, 0)  # 10:30 local


def frames(spark, status=None, attempts=1, ago=10):
    cand = spark.createDataFrame([(1, "delhi", "a@b.c", "en", days(1)[0], "HIGH", 0.72)],
                                 "subscription_id int, entity string, email string, language string, date date, level string, probability double")
    sent = [] if status is None else [(1, days(1)[0], "HIGH", status, attempts, NOW - dt.timedelta(minutes=ago))]
    return cand, spark.createDataFrame(sent, "subscription_id int, date date, level string, status string, attempts int, created_at timestamp")


def test_due_once_and_not_at_night(spark):
    now = F.lit(NOW).cast("timestamp")
    assert al.due(*frames(spark), now).count() == 1
    assert al.due(*frames(spark, "sent"), now).count() == 0
    night = F.lit(dt.datetime(2024, 5, 1, 17, 30)).cast("timestamp")  # 23:00 local
    assert al.due(*frames(spark), night).count() == 0


def test_failed_delivery_backs_off(spark):
    now = F.lit(NOW).cast("timestamp")
    assert al.due(*frames(spark, "failed", 2, 3), now).count() == 0
    assert al.due(*frames(spark, "failed", 2, 4), now).count() == 1
    assert al.due(*frames(spark, "failed", 30, 59), now).count() == 0
    assert al.due(*frames(spark, "failed", 30, 60), now).count() == 1


def test_daily_cap(spark):
    cand, sent = frames(spark)
    many = cand.withColumn("date", F.explode(F.sequence(F.col("date"), F.date_add("date", 4))))
    assert al.due(many, sent, F.lit(NOW).cast("timestamp")).count() == 2


def test_minimum_level_is_a_rank(spark):
    f = spark.createDataFrame([("x", days(1)[0], lv_, 0.5) for lv_ in ("LOW", "MODERATE", "HIGH", "EXTREME")],
                              "entity string, date date, level string, probability double")
    s = spark.createDataFrame([(1, "x", "a@b.c", "HIGH", "en"), (2, "y", "a@b.c", "LOW", "en")],
                              "id int, entity string, email string, minimum_level string, language string")
    assert sorted(r.level for r in al.candidates(f, s).collect()) == ["EXTREME", "HIGH"]


def test_subscription_log(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("A@x.org", "d", "subscribe", t(1), "HIGH"), ("a@x.org", "d", "confirm", t(2), None), ("a@x.org", "d", "subscribe", t(3), "LOW"),
            ("b@x.org", "d", "subscribe", t(1), "HIGH"), ("c@x.org", "d", "subscribe", t(1), "HIGH"), ("c@x.org", "d", "confirm", t(2), None),
            ("c@x.org", "d", "unsubscribe", t(3), None), ("bad address", "d", "subscribe", t(1), "HIGH"), ("bad address", "d", "confirm", t(2), None)]
    log = spark.createDataFrame([(*r, "en") for r in rows], "email string, entity string, action string, ts timestamp, minimum_level string, language string")
    out = al.current_subscriptions(log).collect()
    assert [(r.email, r.minimum_level) for r in out] == [("a@x.org", "LOW")]


def test_text_falls_back_to_english(spark):
    cand, _ = frames(spark)
    texts = spark.createDataFrame([("en", "HIGH", "{city}: {probability}", ["one", "two"], "no promise", "leave {link}"),
                                   ("hi", "HIGH", "{level}", ["ek"], "x", "y {link}")], al.TEXT_COLUMNS)
    r = al.render(cand.withColumn("language", F.lit("xx")), texts).first()
    assert r.subject == "HIGH heat risk for Delhi" and r.summary == "Delhi: 72%" and list(r.tips) == ["one", "two"]
    assert r.body.split("\n") == ["Delhi: 72%", "- one", "- two", "no promise", f"leave /unsubscribe?id={r.subscription_id}"]
    own = al.render(cand.withColumn("language", F.lit("hi")), texts).first()
    assert own.summary == "HIGH" and list(own.tips) == ["ek"]


def test_forecast_horizon_counts_failed_days(spark):
    df = spark.createDataFrame([("a", d, None if i == 3 else 0.5) for i, d in enumerate(days(6))], "entity string, date date, probability double")
    out = lv.loggable(lv.forecast_rows(df, SPEC, str(days(6)[2]))).orderBy("date").collect()
    assert [(r.horizon, r.kind) for r in out] == [(0, "today"), (2, "forecast"), (3, "forecast")]


def test_late_correction_reads_history_before_it(spark):
    p = spark.createDataFrame([(e, d, 1.0) for e in "ab" for d in days(100)], "entity string, date date, v double")
    batch = spark.createDataFrame([("a", days(100)[60])], "entity string, date date")
    out = lv.touched_tail(p, batch, SPEC).groupBy("entity").agg(F.min("date"), F.count("*")).collect()
    back = SPEC.look_back()  # as far as the longest window of the features, the z-score's, and no further
    assert back == SPEC.z_window + 1
    assert [tuple(r) for r in out] == [("a", days(100)[60 - back], 40 + back)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "entity string, ts timestamp, v double"
    rows = [("a", dt.datetime(2024, 1, 1, 1), 1.0), ("a", dt.datetime(2024, 1, 1, 9), 2.0), ("b", dt.datetime(2024, 1, 2, 9), 5.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        s = lv.file_stream(spark, src, schema)
        lv.upsert_batches(lv.daily_totals(s, ["entity"], "ts", F.col("v")), str(tmp_path / "out"), str(tmp_path / "ck"))
        out = lv.latest(spark.read.parquet(str(tmp_path / "out")), ["entity", "date"]).collect()
        return {(r.entity, r.date.day): r.total for r in out}

    assert run() == {("a", 1): 3.0, ("b", 2): 5.0}
    # a later file updates an open day; nothing is counted twice
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 12), 4.0)], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == {("a", 1): 7.0, ("b", 2): 5.0}


def test_streamed_features_equal_the_batch_build_after_a_late_correction(spark, tmp_path):
    from daystrata.operators import features as ft
    src, schema = str(tmp_path / "days"), "entity string, date date, v double"
    base = [(e, d, float((i * 7 + len(e)) % 23)) for e in ("a", "bb") for i, d in enumerate(days(80))]

    def prepare(p):
        return p.withColumns({"departure": F.col("v") - 10, "qualifying": (F.col("v") > 15).cast("int")})

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        lv.run_refresh(lv.file_stream(spark, src, schema), SPEC, str(tmp_path / "p"), str(tmp_path / "f"), str(tmp_path / "c"), prepare)

    feed(base[:75] + base[80:155])
    feed([("a", days(80)[60], 99.0)] + base[75:80])  # a correction and five new days of one entity
    feed(base[155:])
    got = lv.latest(spark.read.parquet(str(tmp_path / "f")), ["entity", "date"]).orderBy("entity", "date").toPandas()
    final = [(e, d, 99.0 if (e, d) == ("a", days(80)[60]) else v) for e, d, v in base]
    want = ft.build(prepare(spark.createDataFrame(final, schema)), SPEC, live=True).orderBy("entity", "date").toPandas()
    assert len(got) == len(want) == 160
    for c in ("v", "v_lag7", "v_roll7_max", "v_slope_3d", "departure_zscore", "label_lag1"):
        assert got[c].round(9).equals(want[c].round(9)), c


def test_pending_forecasts(spark):
    log = spark.createDataFrame([(i, d) for i, d in enumerate(days(4))], "id int, date date")
    outcomes = spark.createDataFrame([(0, 41.0)], "id int, observed double")
    assert [r.id for r in lv.pending(log, outcomes, str(days(4)[3])).orderBy("id").collect()] == [1, 2]
    seen = spark.createDataFrame([("x", days(1)[0], 1)], "entity string, date date, prediction int")
    obs = spark.createDataFrame([("x", days(1)[0], 42.0)], "entity string, date date, observed double")
    lim = spark.createDataFrame([("x", 40.0)], "entity string, threshold double")
    from daystrata.operators.metrics import tracked_summary
    r = tracked_summary(lv.match_outcomes(seen, obs, str(days(2)[1]), lim)).first()
    assert (r.logged, r.matched, r.precision, r.recall, r.status) == (1, 1, 1.0, 1.0, "available")
    none = tracked_summary(lv.match_outcomes(seen, obs.limit(0), str(days(2)[1]), lim)).first()
    assert (none.matched, none.status, none.precision) == (0, "not_enough_data", None)


def test_forecasts_without_a_threshold_stay(spark):
    log = spark.createDataFrame([("a", days(1)[0], 0.5, 1), ("z", days(1)[0], 0.5, 1)], "entity string, date date, probability double, prediction int")
    seen = spark.createDataFrame([("a", days(1)[0], 38.0), ("z", days(1)[0], 38.0)], "entity string, date date, observed double")
    limits = spark.createDataFrame([("a", 37.0)], "entity string, threshold double")
    out = {r.entity: r.observed_signal for r in lv.match_outcomes(log, seen, "2030-01-01", limits).collect()}
    assert out == {"a": 1, "z": 0}


def test_only_folders_of_the_touched_entities_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(e, d, 1.0) for e in "abcdef" for d in days(3)], "entity string, date date, v double")
    rows.withColumn("_folder", lv._folder(SPEC)).write.partitionBy("_folder").parquet(str(tmp_path / "log" / "part=00000000"))
    log = lv.touched_log(spark, str(tmp_path / "log"), rows.filter("entity = 'a'"), SPEC)
    assert {r.entity for r in log.collect()} == {"a"} and log.count() == 3
    plan = log._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_folder" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_subscribers_of_an_entity_are_dealt_over_the_tasks(spark):
    f = spark.createDataFrame([("x", days(1)[0], "HIGH", 0.7)], "entity string, date date, level string, probability double")
    s = spark.range(4000).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") >= 0, "x").alias("entity"), F.lit("a@b.c").alias("email"),
                                 F.lit("LOW").alias("minimum_level"), F.lit("en").alias("language"))
    used = {r[0] for r in al.candidates(f, s).select(F.spark_partition_id()).distinct().collect()}
    assert len(used) == int(spark.conf.get("spark.sql.shuffle.partitions"))
