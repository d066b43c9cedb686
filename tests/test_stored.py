import datetime as dt

import pytest
from conftest import days

from daystrata.sources import stored as st
from daystrata.spec import PanelSpec

SPEC, SCHEMA = PanelSpec(), "entity string, date date, v long"


def write(spark, folder, files):
    """One file for each list of rows, in the order of their names."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    folder.mkdir()
    for i, rows in enumerate(files):
        e, d, v = (list(x) for x in zip(*rows)) if rows else ([], [], [])
        pq.write_table(pa.table({"entity": pa.array(e, pa.string()), "date": pa.array(d, pa.date32()), "v": pa.array(v, pa.int64())}),
                       folder / f"part-{i:05d}.parquet", row_group_size=7)
    return spark.read.schema(SCHEMA).parquet(str(folder))


def test_swaps_inside_and_across_files(spark, tmp_path):
    d = days(40)
    hot = [("h", x, i) for i, x in enumerate(d)]
    files = [hot[:20] + [("a", d[0], 0), ("a", d[1], 1)], [("b", d[9], 0), ("a", d[2], 2)] + hot[20:] + [("n", None, 0)], [("b", d[8], 1), ("a", d[2], 3)]]
    files[0][4], files[0][5] = files[0][5], files[0][4]  # inside a range
    files[1][21], files[0][19] = files[0][19], files[1][21]  # across two files
    for size in (3, 1000):
        got = {r.entity: (r.n, r.descents, r.repeats, r.ok) for r in st.stored_order(write(spark, tmp_path / f"t{size}", files), SPEC, range_rows=size).collect()}
        dates = [x[1] for f in files for x in f if x[0] == "h"]
        down = sum(b < a for a, b in zip(dates, dates[1:]))
        assert got == {"h": (40, down, 0, False), "a": (4, 0, 1, False), "b": (2, 1, 0, False)} and down >= 2
    assert st.stored_order(write(spark, tmp_path / "ok", [hot[:20], hot[20:]]), SPEC, range_rows=6).first().ok


def test_parts_side_by_side(spark, tmp_path):
    rows = [("e", d, i) for i, d in enumerate(days(50))]
    left = write(spark, tmp_path / "l", [rows[:10], [], rows[10:]]).select("v")
    right = write(spark, tmp_path / "r", [rows[:33], rows[33:]]).selectExpr("date", "v AS w")
    got = st.side_by_side([left, right]).collect()
    assert len(got) == 50 and all(r.v == r.w and r.date == rows[r.v][1] for r in got)
    short = write(spark, tmp_path / "s", [rows[:49]]).selectExpr("v AS w")
    with pytest.raises(ValueError, match="unequal"):
        st.side_by_side([left, short])
    with pytest.raises(ValueError, match="more than one"):
        st.side_by_side([left, write(spark, tmp_path / "t", [rows]).select("v")])
    assert isinstance(got[0].date, dt.date)


def test_parts_of_few_values_are_not_broadcast(spark, tmp_path):
    rows = [("e", days(1)[0], 7)] * 5000
    parts = [write(spark, tmp_path / c, [rows[:2000], rows[2000:]]).selectExpr(f"v AS {c}") for c in "ab"]
    both = st.side_by_side(parts)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin [_position" in plan
    assert both.count() == 5000


def test_tasks_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "TASK_ROWS", 10)
    rows = [(f"e{i % 20}", d, i) for i, d in enumerate(days(300))]
    out = st.stored_order(write(spark, tmp_path / "t", [rows[:100], rows[100:]]), SPEC, range_rows=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 30), REPARTITION_BY_NUM") == 2
    assert all(r.ok and r.n == 15 for r in out.collect())
