import random

import pytest
from pyspark.sql import functions as F

from daystrata.streaming.live import latest
from daystrata.streaming.log import CompactedLog, files_bound

SCHEMA = "entity string, day int, v long"


def make(spark, root, **kw):
    return CompactedLog(spark, str(root), ["entity", "day"], "entity", **{"fanout": 3, "folders": 2, **kw})


def batch(spark, i, rng):
    rows = [(f"e{rng.randrange(6)}", rng.randrange(8), 1000 * i + j) for j in range(5)]
    rows = list({(e, d): (e, d, v) for e, d, v in rows}.values())
    return rows, spark.createDataFrame(rows, SCHEMA).coalesce(1)


def state(log, version=None):
    rows = log.read(SCHEMA + ", _batch int", version)
    got = latest(rows, ["entity", "day"]).collect()
    return {(r.entity, r.day): r.v for r in got}


def test_files_stay_below_the_bound(spark, tmp_path):
    log, rng, want = make(spark, tmp_path / "log"), random.Random(1), {}
    for i in range(30):
        rows, df = batch(spark, i, rng)
        back = log.append(df, i)
        assert sorted((r.entity, r.day, r.v) for r in back.collect()) == sorted(rows)
        want.update({(e, d): v for e, d, v in rows})
        per_folder = {}
        for path in log.paths(i):
            per_folder[path.split("=")[-1]] = per_folder.get(path.split("=")[-1], 0) + 1
        assert max(per_folder.values()) <= files_bound(i + 1, 3)
    assert log.newest() == 29 and state(log) == want
    files = len(log.read(SCHEMA + ", _batch int").inputFiles())
    assert files <= 2 * files_bound(30, 3) < 30
    assert files_bound(200) == 21  # 64 folders of at most 21 runs, however many rows
    # what was merged is deleted, but for the last batch's
    parts = list((tmp_path / "log" / "data").glob("part=*/_folder=*"))
    assert len(parts) <= 2 * files_bound(30, 3) + 2 * 3 * 3 and len(list((tmp_path / "log" / "manifest").glob("v=*"))) == 2


@pytest.mark.parametrize("stage", ["written", "merged", "published"])
def test_a_crash_loses_and_doubles_nothing(spark, tmp_path, stage):
    """The batch that merges crashes at each step; readers see the old or the new version, and the repetition mends all."""
    log, rng, want = make(spark, tmp_path / "log", folders=1), random.Random(2), {}

    def crash(at):
        if at == stage:
            raise KeyboardInterrupt

    for i in range(7):
        rows, df = batch(spark, i, rng)
        if i in (2, 5):
            with pytest.raises(KeyboardInterrupt):
                log.append(df, i, crash)
            seen = {**want, **{(e, d): v for e, d, v in rows}} if stage == "published" else want
            assert log.newest() == (i if stage == "published" else i - 1) and state(log) == seen
        log.append(df, i)
        want.update({(e, d): v for e, d, v in rows})
        assert state(log) == want
        assert log.read(SCHEMA + ", _batch int").filter(F.col("_batch") == i).count() == len(rows)


def test_empty_batches_and_readers_before_the_first(spark, tmp_path):
    log = make(spark, tmp_path / "log")
    assert log.newest() == -1 and log.read(SCHEMA + ", _batch int").count() == 0
    log.append(spark.createDataFrame([], SCHEMA), 0)
    assert log.newest() == 0 and state(log) == {}
    log.append(spark.createDataFrame([("a", 1, 2), (None, 1, 3)], SCHEMA), 1)
    assert state(log) == {("a", 1): 2, (None, 1): 3}
