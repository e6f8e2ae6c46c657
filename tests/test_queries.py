"""Every named query runs, and equals its SQL twin in DuckDB where it has one."""

import re

import pytest

import __spark_entry__ as entry_points
import check

SF_DIR = "/root/testdata/sf0.001"

EXPECTED_ROWS = {"group_rmse_long": 20, "fold_cluster_tags": 20, "als_cv": 10, "model_report": 3}


#: Users of a few items: Spark ML multiplies all user blocks with the block of those items.
FACTOR_PRODUCTS = {"recommend_item_subset_check"}
#: Products of many vectors are made by numpy; the text operators run in Python workers, too.
PYTHON = re.compile("recommend_users_check|op[0-9]+_.*")


@pytest.fixture(scope="module")
def connection():
    return check.connect(SF_DIR)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["endpoint", "count"] and df.count() == 12


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, connection, name):
    result, _ = check.compare(spark, connection, name, SF_DIR)
    assert result.startswith(("ok", "rows only")), result
    if name in EXPECTED_ROWS:
        assert result.endswith(f" {EXPECTED_ROWS[name]}"), result


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_plan(spark, name):
    """No Python worker, and no cartesian product."""
    plan = entry_points.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    if not PYTHON.fullmatch(name):
        assert not re.search("Python|InPandas|InArrow", plan)
    if name not in FACTOR_PRODUCTS:
        assert "Cartesian" not in plan and "NestedLoop" not in plan
