"""Driver contract and plan-shape checks on the star-schema queries."""

import os

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_entry_smoke(spark):
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test data not available")
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["ord", "metric", "value", "subtext"]
    assert len(rows) == 3


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_every_query_runs_small(spark, name):
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test data not available")
    df = E.queries()[name](spark, SF_SMALL)
    df.limit(1).collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # No Python evaluation anywhere in the plans.
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_prunes_columns(spark):
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test data not available")
    df = E.queries()["district_heatmap"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan


def test_entry_module_imports_without_spark():
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as E; assert len(E.queries()) >= len(E.oracle_sql()) > 0"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
