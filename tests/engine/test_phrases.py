"""The phrase index against the rules as they stand, one by one."""

import random

from pyspark.sql import functions as F

from plumbline.operators import estimate, phrases
from plumbline.plans import rules, sheet_queries

PIECES = ["floor", "subfloor", "tile", "ceiling", "cmu", "wall", "walls", "sch 40", "sch-40", "pipe", "storm", "sewer", "storm  sewer", "panel", "precast", "É", "éclair", "doors", "outdoor", "x", "12'", "fire extinguisher", "bb ci", "BB CI", "mh", "mhs", "L-4", "", "ladder", "-", "/"]


def test_index_against_single_rules(spark):
    rng = random.Random(2)
    texts = [rng.choice([" ", "", "-", ", "]).join(rng.choice(PIECES) for _ in range(rng.randint(0, 5))) for _ in range(1500)]
    # A phrase that first stands within a longer word doesn't count, even if it stands alone further on.
    texts += ["xstorm sewer and storm sewer", "storm sewers", "storm sewer", "(storm sewer)", "Storm Sewer 1storm sewer", None, "a" * 50_000 + " trench drain", "trench drain " * 3000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, said string").withColumns({"text": F.lit("clash"), "kind": F.lit("clash"), "mode": F.lit("clash")})
    got = phrases.classified(rows, {"by": F.col("said"), "other": F.reverse("said")})
    want = rows.withColumns({"by": estimate.classify(F.col("said")), "other": estimate.classify(F.reverse("said"))})
    assert sorted(map(tuple, got.select("k", "by", "other").collect())) == sorted(map(tuple, want.select("k", "by", "other").collect()))
    assert got.columns == [*rows.columns, "by", "other"]
    assert phrases.classified(rows.limit(0), {"by": F.col("said")}).count() == 0


def test_names_of_distinct_pairs(spark):
    rows = spark.createDataFrame([("PVC pipe 8\"", "storm_pipe"), (None, None), ("nothing", None), ("nothing", "x_y"), ("nothing", "x_y")], "description string, item_type string")
    got = phrases.named(rows).select("description", "item_type", "ruled")
    want = rows.withColumn("ruled", estimate.item_name(F.col("description"), F.col("item_type")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_every_table_and_rule_is_met(spark):
    got = sheet_queries.every_rule(spark, "/root/testdata/sf0.001")
    assert {r[0] for r in got.select("item_type").distinct().collect()} >= {t[0] for t in rules.ESTIMATION}
    met = {r[0] for r in got.select(F.regexp_replace("name", '-.*$', "")).distinct().collect()}
    assert met >= {n.split("-")[0] for _, n, _ in rules.ITEM_NAMES}
