"""Every llm query: against its SQL twin where it has one, else that it answers for the whole table."""

import os

import pytest
from check_queries import compare, open_tables

import __spark_entry__ as spark_entry
from corpusflow.llm.catalog import catalog

FOLDER = "/root/testdata/sf0.001"
NATIVE = ("op2_license_scan", "op5_decontaminate")


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries if n.startswith("op")))
def test_query(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    result = spark_entry.queries()[name](spark, FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert name not in NATIVE or not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    if name in catalog.sql:
        assert compare(result, open_tables(FOLDER), catalog.sql[name]) is None
    elif "doc_id" in result.columns:
        assert result.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    else:
        assert result.count() > 0


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in spark_entry.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in spark_entry.queries()
