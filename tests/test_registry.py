"""Every registered query against its SQL, and what its plan must not contain."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as registry
from oracle import compare, compare_rows, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
CHECKED = [n for n in QUERIES if n in SQL]
LEARNERS = [n for n in QUERIES if n not in SQL]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def check_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert forbidden not in plan
    lines = [line.strip(" :+-*()0123456789") for line in plan.splitlines()]
    for i, line in enumerate(lines):
        # All rows may meet in one task only after they were aggregated (importance has
        # a row per feature) or cut to a top-k.
        if line.startswith("Exchange SinglePartition"):
            assert lines[i + 1].startswith(
                ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "Project [feature_pos")
            ), lines[i + 1]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql_by_a_distributed_plan(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    check_plan(df)
    assert compare_rows(df, duck, SQL[name]) == ""


def test_comparison_notices_differences(spark, duck):
    query = lambda s, d: s.sql("SELECT 1 AS a, 2.0D AS b")
    assert compare(spark, duck, query, "SELECT cast(1 AS int) AS a, cast(2 AS double) AS b", SF_DIR) == ""
    for wrong in ("SELECT 1 AS a, cast(2.5 AS double) AS b", "SELECT 1 AS a, cast(2 AS double) AS c", "SELECT 1 AS a, cast(2 AS double) AS b FROM range(2)"):
        assert compare(spark, duck, query, wrong, SF_DIR) != ""


@pytest.mark.parametrize("name", ["fit_gbt_regression", "fit_gbt_multiclass", "permutation_importance_gbt", "pdp_gbt"])
def test_learner_queries_run(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    rows = registry.entry(spark).orderBy("rank").collect()
    assert rows[0]["feature"] == "quantity" and rows[0]["code"] == "topFactor"


def test_scans_read_only_what_is_used(spark):
    plan = QUERIES["target_cardinality"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "l_linestatus" in plan and "l_extendedprice" not in plan
