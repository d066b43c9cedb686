import pytest
from conftest import days

from daystrata.sources.commits import CommittedTable, promote_once
from daystrata.spec import PanelSpec

SCHEMA = "entity string, date date, v double"


def rows(spark, *values):
    return spark.createDataFrame([(e, days(1)[0], v) for e, v in values], SCHEMA)


def refuse(staged):
    raise ValueError(staged.count())


def content(table, schema):
    return sorted((r.entity, r.v, r.commit) for r in table.read(schema).collect())


def test_a_repeated_number_changes_nothing_and_a_broken_one_is_written_anew(spark, tmp_path):
    table, first, second = CommittedTable(spark, str(tmp_path / "t")), rows(spark, ("a", 1.0)), rows(spark, ("a", 1.0), ("b", 2.0))
    assert table.commits() == [] and content(table, first.schema) == []
    assert table.commit(first, 1) and not table.commit(second, 1)
    with pytest.raises(ValueError, match="2"):  # the check sees the rows as stored
        table.commit(second, 2, check=refuse)
    assert table.commits() == [1] and content(table, first.schema) == [("a", 1.0, 1)]
    assert table.commit(rows(spark, ("c", 3.0)), 2)
    assert content(table, first.schema) == [("a", 1.0, 1), ("c", 3.0, 2)]
    assert table.commit(first, 10) and table.commits() == [1, 2, 10]  # by number, and equal rows are two rows
    assert content(table, first.schema) == [("a", 1.0, 1), ("a", 1.0, 10), ("c", 3.0, 2)]


def test_a_commit_in_folders_and_an_empty_one(spark, tmp_path):
    table, both = CommittedTable(spark, str(tmp_path / "t")), rows(spark, ("a", 1.0), ("b", None))
    assert table.commit(both, 1, "entity") and table.commit(both.limit(0), 2, "entity")
    assert sorted((r.entity, r.v) for r in table.read(both.schema).collect()) == [("a", 1.0), ("b", None)]


def test_promotion_replaces_whole_entities_once(spark, tmp_path):
    table, spec = CommittedTable(spark, str(tmp_path / "t")), PanelSpec()
    old = spark.createDataFrame([(e, d, 1.0) for e in "abc" for d in days(3)], SCHEMA)
    table.commit(old, 1)
    staged = rows(spark, ("a", 2.0), ("b", None))
    for _ in range(2):
        refused = promote_once(staged, table, 2, spec, ["v"]).collect()
        assert [(r.entity, r.null_columns) for r in refused] == [("b", ["v"])]
        now = sorted((r.entity, r.v) for r in table.current(old.schema, "entity").collect())
        assert now == [("a", 2.0)] + [("b", 1.0)] * 3 + [("c", 1.0)] * 3
