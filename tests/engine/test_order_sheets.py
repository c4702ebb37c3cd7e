"""Sheets out of orders: who names columns gets these alone, as the whole table has them."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.functions.numeric import parse_numeric
from plumbline.plans.sheet_queries import order_sheets

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_wanted_columns_are_those_of_the_whole(spark):
    names = ["sheet", "components", "schedules"]
    part, whole = order_sheets(spark, SF, *names), order_sheets(spark, SF)
    assert part.columns == names
    key = lambda r: r["sheet"]
    assert sorted(part.collect(), key=key) == sorted(whole.select(*names).collect(), key=key)


def test_a_quantity_is_trimmed_once(spark):
    rows = spark.createDataFrame([(" 12 ",), ("1,250",), ("007",), ("3' - 6\"",), ("50%",), (None,)], "t string").select(parse_numeric(F.col("t")).alias("v"))
    assert [r["v"] for r in rows.collect()] == [12.0, 1250.0, 7.0, 42.0, None, None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lines_are_sorted_without_a_comparator(spark):
    plan = order_sheets(spark, SF, "sheet", "components")._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
    assert "cast(transform(" not in plan
