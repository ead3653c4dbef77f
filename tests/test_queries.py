"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from lodestar.queries import DEFINED, ORACLE_SQL, QUERIES, TABLES, engine

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def tables(spark):
    return engine(spark, FOLDER)


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, tables, duck, name):
    df = QUERIES[name](spark, FOLDER) if name.startswith("strict_") else tables.sql(DEFINED[name][0])
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(df.columns, df.collect()) == bag(names, cursor.fetchall())


def test_filters_reach_the_scan(tables):
    """Predicates and columns that the query needs, and no others, go down to the files."""
    text = tables.explain("SELECT o_orderkey FROM orders WHERE o_custkey = 37").split("chosen plan:")[1]
    assert "EqualTo(o_custkey,37)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_semi_and_anti_joins(tables):
    plan = lambda name: tables.explain(DEFINED[name][0]).split("optimized plan:")[1].split("chosen plan:")[0]
    assert "LeftSemi" in plan("sub_in") and "LeftSemi" in plan("corr_exists")
    assert "LeftAnti" in plan("corr_not_exists") and "LeftAnti" in plan("sub_not_in")
    assert "OR" not in plan("sub_not_in").split("LeftAnti")[1].split("\n")[0]  # a plain hash join, no broadcast of the set


@pytest.mark.parametrize("name", ["win_number_without_order", "win_rows_without_order", "win_three_orders", "limit_beyond_int"])
def test_no_task_holds_all_rows(tables, name):
    """Windows over all rows are dealt by buckets; what is in one task has a row for each bucket."""
    plan = tables.explain(DEFINED[name][0]).split("chosen plan:")[1]
    assert "hashpartitioning(__" in plan or "Window" in plan
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in part.split("\n")[1] or "ObjectHashAggregate" in part.split("\n")[1] or "Aggregate" in part.split("\n")[1], part[:300]


def test_windows_of_further_orders_are_added_once(tables):
    """What an order's buckets hold is counted from the rows that came in: the work is not doubled by each further order."""
    plan = tables.explain(DEFINED["win_three_orders"][0]).split("chosen plan:")[1]
    assert plan.count("BroadcastHashJoin") == 3 and plan.count("BroadcastNestedLoopJoin") == 6
