"""Scales in texts and characters: callouts keep to their lines, and each is worked out once."""

from pyspark.sql import functions as F

from plumbline.functions.geometry import snapped
from plumbline.operators import scales


def test_a_number_ends_with_its_line(spark):
    texts = ["page 2019\n1/2\" = 1'-0\"", "1 = 20'\n1/2\" = 1'-0\"", "1 1/2\" = 1'-0\"", "3/4\" =\n1'-0\""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", scales.text_scales(F.col("t")).alias("found"))
    found = {r["k"]: [round(v, 6) for v in r["found"]] for r in rows.collect()}
    assert found == {0: [2.0], 1: [20.0, 2.0], 2: [0.666667], 3: [1.333333]}


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_scale_is_worked_out_once_for_all_steps_of_the_ladder(spark):
    rows = spark.range(3).select(snapped(F.regexp_extract(F.col("id").cast("string"), r"(\d+)", 1).cast("double")).alias("s"))
    assert plan(rows).count("regexp_extract(") == 1


def test_characters_are_read_a_bounded_number_of_times(spark):
    chars = spark.createDataFrame([(1, 0, i, float(i), 10.0, c) for i, c in enumerate("SCALE 1/4\" = 1'-0\"")], "page int, line int, ord int, x double, y double, c string")
    found = scales.callouts(chars)
    assert [r["feet_per_inch"] for r in found.collect()] == [4.0]
    assert plan(found).count("RLIKE") + plan(found).count("rlike") <= 2
