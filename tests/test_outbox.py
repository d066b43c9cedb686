import datetime as dt

import pytest
from conftest import days
from pyspark.sql import functions as F

from daystrata.streaming import alerts as al
from daystrata.streaming import live as lv
from daystrata.streaming import outbox as ob

SCHEMA = "subscription_id bigint, at timestamp, kind string, date date, level string, probability double, attempts int"
NOW = dt.datetime(2024, 5, 1, 5, 0)  # 10:30 local
DAY = [dt.date(2024, 5, 1) + dt.timedelta(days=i) for i in range(6)]


def minutes(m):
    return NOW + dt.timedelta(minutes=m)


def play(spark, folder, parts, delay="3 days"):
    """Each part is a file and a run of its own: the stream starts again from its checkpoint."""
    src, out, ck = (str(folder / n) for n in ("in", "out", "ck"))
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ob.run_outbox(lv.file_stream(spark, src, SCHEMA, files_per_trigger=1), out, ck, delay=delay)
    return sorted((r.subscription_id, r.due_at, r.date, r.level, r.slot) for r in spark.read.parquet(out).collect())


def beat(at):
    return (None, at, "beat", None, None, None, None)


def history():
    """Sends, failures and candidates of 30 subscriptions, all before NOW."""
    rows, c, d = [], [], []
    for s in range(30):
        for i, day in enumerate(DAY):
            level = ["MODERATE", "HIGH", "EXTREME"][(s + i) % 3]
            c.append((s, "x", "a@b.c", "en", day, level, 0.5 + i / 100))
            if (s * 7 + i) % 4 == 0:
                d.append((s, day, level, "sent" if s % 2 else "failed", (s + i) % 7, minutes(-((s * 37 + i * 11) % 200))))
            if s % 5 == 0:
                d.append((s, DAY[i], "LOW", "sent", 0, minutes(-1440 - i)))
    return c, d


def batches(rows, n):
    return [rows[i::n] for i in range(n)]


@pytest.mark.parametrize("n", [1, 4])
def test_any_cut_of_the_input_gives_the_batch_rows(spark, tmp_path, n):
    c, d = history()
    cand = spark.createDataFrame(c, "subscription_id bigint, entity string, email string, language string, date date, level string, probability double")
    dele = spark.createDataFrame(d, "subscription_id bigint, date date, level string, status string, attempts int, created_at timestamp")
    now = F.lit(NOW).cast("timestamp")
    want = sorted((r.subscription_id, r.date, r.level, r.slot) for r in al.due(cand, dele, now).collect())
    rows = sorted((tuple(r) for r in ob.events(cand, dele, now).collect()), key=lambda r: (hash(str(r)), r[0]))
    parts = batches(rows, n)
    parts.append([beat(NOW + dt.timedelta(days=3, seconds=1))])
    got = play(spark, tmp_path, parts)
    assert {r[1] for r in got} == {NOW} and sorted((s, *rest) for s, _, *rest in got) == want and len(want) > 20


def test_a_failure_comes_again_after_its_back_off(spark, tmp_path):
    first = [(1, NOW, "candidate", DAY[1], "HIGH", 0.7, None)]
    second = [(1, minutes(1), "failed", DAY[1], "HIGH", None, 3), (1, minutes(20), "failed", DAY[1], "HIGH", None, 4)]
    got = play(spark, tmp_path, [first, second, [beat(minutes(300))]], delay="1 hour")
    assert [(t, slot) for _, t, _, _, slot in got] == [(NOW, 1), (minutes(9), 1), (minutes(36), 1)]


def test_cap_quiet_hours_and_expiry(spark, tmp_path):
    evening = dt.datetime(2024, 5, 1, 17, 0)  # 22:30 local
    rows = [(1, evening, "candidate", d, "HIGH", 0.7, None) for d in DAY] + [(1, evening, "candidate", DAY[0], "EXTREME", 0.9, None)]
    sent = [(1, dt.datetime(2024, 5, 2, 1, 0), "sent", DAY[1], "HIGH", None, 1)]
    got = play(spark, tmp_path, [rows, sent, [beat(dt.datetime(2024, 5, 20))]], delay="1 hour")
    morning = [dt.datetime(2024, 5, 2 + i, 0, 30) for i in range(5)]  # six o'clock local
    # two on each morning, earliest days first; DAY[0] is over by then, and nothing comes twice
    assert [(t, d, slot) for _, t, d, _, slot in got] == [(morning[0], DAY[1], 1), (morning[0], DAY[2], 2), (morning[1], DAY[3], 1),
                                                          (morning[1], DAY[4], 2), (morning[2], DAY[5], 1)]


def test_odd_rows_only_move_the_watermark(spark, tmp_path):
    odd = [(None, NOW, "candidate", DAY[1], "HIGH", 0.7, None), (2, None, "candidate", DAY[1], "HIGH", 0.7, None), (2, NOW, "candidate", None, "HIGH", 0.7, None),
           (2, NOW, "candidate", DAY[1], "NONE", 0.7, None), (2, NOW, None, DAY[1], "HIGH", 0.7, None), (3, NOW, "candidate", DAY[1], "HIGH", None, None),
           (3, NOW, "candidate", DAY[1], "HIGH", None, None)]
    got = play(spark, tmp_path, [odd, [beat(minutes(120))]], delay="1 hour")
    assert got == [(3, NOW, DAY[1], "HIGH", 1)]


LOG, SEEN = "entity string, date date, prediction int", "entity string, date date, observed double"


def test_outcomes_of_two_streams(spark, tmp_path):
    """Late rows on both sides, a restart before each file, and what the watermark has passed: pending, once."""
    d = days(30, "2024-05-01")
    limits = spark.createDataFrame([("a", 37.0)], "entity string, threshold double")
    src = {n: str(tmp_path / n) for n in ("log", "seen")}

    def feed(log, seen):
        for name, rows, schema in (("log", log, LOG), ("seen", seen, SEEN)):
            if rows:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src[name])
        lv.run_outcomes(*(lv.file_stream(spark, src[n], s) for n, s in (("log", LOG), ("seen", SEEN))), limits,
                        str(tmp_path / "out"), str(tmp_path / "ck"), delay="2 days")
        out = spark.read.schema(LOG + ", observed double, threshold double, observed_signal int").parquet(str(tmp_path / "out"))
        return sorted((r.entity, r.date, r.prediction, r.observed, r.observed_signal) for r in out.collect() if r.observed is not None), sorted(
            (r.entity, r.date, r.prediction) for r in out.collect() if r.observed is None)

    feed([("a", d[5], 1), ("b", d[5], 0), ("a", d[6], 1)], [("x", d[6], 1.0)])
    met, pending = feed([("c", d[5], 1)], [("a", d[5], 38.0), ("c", d[5], 38.0)])  # both sides late, within the delay
    assert met == [("a", d[5], 1, 38.0, 1), ("c", d[5], 1, 38.0, 0)] and pending == []
    feed([("z", d[9], 0)], [("z", d[9], 50.0)])
    met, pending = feed([("q", d[2], 1)], [("a", d[6], 36.0), ("b", d[5], 99.0)])
    # the watermark stands at d[7]: b of d[5] and a of d[6] are over unless observed, and rows before it come too late
    assert pending == [("b", d[5], 0)] or pending == [("a", d[6], 1), ("b", d[5], 0)]
    assert ("z", d[9], 0, 50.0, 1) in met and all(m[:2] != ("q", d[2]) and m[3] != 99.0 for m in met)
    feed([("y", d[20], 0)], [("y", d[20], 50.0)])
    final = feed([("y", d[29], 0)], [("y", d[29], 50.0)])
    assert final[1] == [("a", d[6], 1), ("b", d[5], 0)] and len(final[0]) == 5


def test_state_of_outcomes_is_written_as_changes(spark, tmp_path, monkeypatch):
    """The store neither counts its keys by look-ups nor uploads its tables each batch; the session's settings come back."""
    seen, inner, d = [], lv.outcome_stream, days(3, "2024-05-01")
    names = [f"spark.sql.streaming.stateStore.rocksdb.{k}" for k in lv.SMALL_KEYS]
    monkeypatch.setattr(lv, "outcome_stream", lambda *a, **o: seen.append([spark.conf.get(n, None) for n in names]) or inner(*a, **o))
    src = {n: str(tmp_path / n) for n in ("log", "seen")}
    spark.createDataFrame([("a", d[0], 1), ("b", d[0], 0)], LOG).write.parquet(src["log"])
    spark.createDataFrame([("a", d[0], 41.0)], SEEN).write.parquet(src["seen"])
    lv.run_outcomes(*(lv.file_stream(spark, src[n], s) for n, s in (("log", LOG), ("seen", SEEN))),
                    spark.createDataFrame([], "entity string, threshold double"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert seen == [list(lv.SMALL_KEYS.values())] and [spark.conf.get(n, None) for n in names] == [None] * len(names)
    assert list((tmp_path / "ck" / "state").rglob("*.changelog"))
    assert [(r.entity, r.observed, r.observed_signal) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 41.0, 1)]


def test_a_block_keeps_its_subscriptions_apart(spark, tmp_path):
    """All in one group of the state: the same alerts as with a group each, and one timer for all."""
    rows = []
    for s in range(6):
        rows += [(s, minutes(s), "candidate", DAY[1], "HIGH", 0.7, None), (s, minutes(10 + s), "candidate", DAY[1 + s % 2], "EXTREME", 0.9, None)]
        rows += [(s, minutes(30), "failed", DAY[1], "HIGH", None, s)]
    outs = []
    for blocks in (1, 997):
        src, out, ck = (str(tmp_path / f"{n}{blocks}") for n in ("in", "out", "ck"))
        for part in (rows, [beat(NOW + dt.timedelta(days=3, minutes=12))], [beat(NOW + dt.timedelta(days=8))]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            ob.run_outbox(lv.file_stream(spark, src, SCHEMA, files_per_trigger=1), out, ck, blocks=blocks)
        outs.append(sorted(tuple(r) for r in spark.read.parquet(out).collect()))
    assert outs[0] == outs[1] and len(outs[0]) > 12


def test_state_of_outcomes_has_a_value_for_a_block(spark, tmp_path):
    """Not two entries of the store for each row; nulls, NaN and repeated rows come through as in a join of the tables."""
    d, nan = days(4, "2024-05-01"), float("nan")
    log, seen = LOG + ", share double, note string, sure boolean", SEEN
    asked = [(e, d[i % 3], None if i % 5 == 0 else i, (None, nan, 0.5 + i)[i % 3], None if i % 4 else f"n{i}", (None, True, False)[i % 3])
             for i in range(200) for e in ("a", "b", None)[:1 + i % 3]] + [("a", None, 1, 1.0, "never", None)]
    known = [("a", d[0], 41.0), ("a", d[0], 12.0), ("b", d[1], nan), ("b", d[2], None), (None, d[0], 50.0)]
    src, beat = {n: str(tmp_path / n) for n in ("log", "seen")}, d[3] + dt.timedelta(days=9)
    limits = spark.createDataFrame([("b", 1.0)], "entity string, threshold double")
    for rows, others in ((asked, known), ([("z", beat, 0, 0.0, "", True)], [("y", beat, 0.0)])):
        spark.createDataFrame(rows, log).write.mode("append").parquet(src["log"])
        spark.createDataFrame(others, seen).write.mode("append").parquet(src["seen"])
        lv.run_outcomes(*(lv.file_stream(spark, src[n], s) for n, s in (("log", log), ("seen", seen))), limits, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = lv.match_outcomes(spark.createDataFrame(asked, log), spark.createDataFrame(known, seen), str(d[3]), limits).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 400
    plan = lv.outcome_stream(*(lv.file_stream(spark, src[n], s) for n, s in (("log", log), ("seen", seen))), limits)._jdf.queryExecution().toString()
    assert "TransformWithState" in plan and plan.count("Join LeftOuter") == plan.count("Join LeftOuter, (entity")  # the thresholds only
