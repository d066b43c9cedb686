"""A sample of registered queries against their SQL on the smallest tables."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
SAMPLE = ["d10_event_table", "e21_feature_table", "f1_column_profile", "i4_i5_rank_metrics", "k3_feature_drift", "g4_oversample"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert df.columns == [d[0] for d in cur.description]
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(cur.fetchall())


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_documents_are_read_back_once(spark):
    df = entry.queries()["r14_documents"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "get_json_object" not in plan
