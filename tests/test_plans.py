"""Physical plans stay free of the shapes that do not scale."""

import re

import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "key", ["clean_transactions", "customer_summary", "feature_table_imputed", "clv_segments", "pareto_curve", "qq_points"]
)
def test_no_cross_join_no_python(spark, key):
    text = plan(entry_points.queries()[key](spark, SF_DIR))
    for shape in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF"):
        assert shape not in text


def test_cleaning_needs_one_shuffle_and_prunes_the_scan(spark):
    text = plan(entry_points.queries()["clean_transactions"](spark, SF_DIR))
    assert text.count("Exchange hashpartitioning") == 1
    assert "l_discount" not in text and "o_totalprice" not in text


def test_unpartitioned_windows_see_slice_tables_only(spark):
    text = plan(entry_points.queries()["pareto_curve"](spark, SF_DIR))
    rows = text.split("\n")
    for i, row in enumerate(rows):
        if "Exchange SinglePartition" in row:  # what it gathers is aggregated per slice
            assert re.search(r"HashAggregate\(keys=\[_slice|Project|Window|Sort", " ".join(rows[i + 1 : i + 3]))
            assert "_slice" in " ".join(rows[i + 1 : i + 4])
