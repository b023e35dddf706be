"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest
from check_queries import compare, open_tables

import __spark_entry__ as spark_entry
from corpusflow import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.load().queries, catalog.load().sql


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return open_tables(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(spark_entry.queries())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    result = QUERIES[name](spark, FOLDER)
    plan = plan_of(result)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("EvalPython" in plan) == (name == "exploded_records") and ("MapInPandas" in plan) == (name == "quarantined_map")
    assert compare(result, tables, SQL[name]) is None


def test_scans_are_pruned(spark, tables):
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan_of(QUERIES["batch_counts"](spark, FOLDER))
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan_of(QUERIES["shard"](spark, FOLDER))
    assert "ReadSchema: struct<value:double>" in plan_of(QUERIES["feature_min_max"](spark, FOLDER))


@pytest.mark.parametrize("name", ["nbest_rank", "best_k_vector_average"])
def test_rank_limits_act_before_the_shuffle(spark, tables, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "WindowGroupLimit" in plan[plan.index("Exchange") :]


def test_words_are_shuffled_as_whole_rows(spark, tables):
    plan = plan_of(QUERIES["duration_offsets"](spark, FOLDER))
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_entry(spark, tables):
    assert spark_entry.entry(spark).count() > 0
