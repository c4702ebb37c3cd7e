"""Records that break off: cut and closed as a walk over every character does it, and without one step a token."""

import json
import random

from pyspark.sql import functions as F

from plumbline.sources.extraction import parsed, repaired


def walked(text):
    """Character by character: brackets, commas and quotes."""
    open_, quoted, cut, ends, i = "", False, 0, "", 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        i += 1
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            open_ = ("}" if c == "{" else "]") + open_
        elif not quoted and c in "}]":
            open_ = open_[1:]
            cut, ends = i, open_
        elif not quoted and c == ",":
            cut, ends = i - 1, open_
    return text[:cut] + ends


def test_cut_anywhere(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return rng.choice(['a "[{,', "back\\slash\\", "ü\n𝄞", "", 17, None, True])
        inner = [value(depth - 1) for _ in range(rng.randrange(4))]
        return inner if kind == 3 else {f"k{rng.choice(',}]')}{n}": v for n, v in enumerate(inner)}

    texts = [json.dumps({"a": [value(7), value(2)], "b": value(8)}, ensure_ascii=False) for _ in range(60)]
    texts = [t[:k] for t in texts for k in {len(t), *(rng.randrange(len(t)) for _ in range(25))}]
    texts += ["", "}", "]}{", '{"a": [1}, 2', "{\\{,", '{"a', "[[[[[[[[[1,", "[" * 40 + "]" * 7, '{"a":1},', "{\\", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", repaired(F.col("t")).alias("r")).collect()
    for r in rows:
        assert r["r"] == (None if r["t"] is None else walked(r["t"])), r["t"]


def test_a_long_record(spark):
    """A hundred thousand elements and escapes: neither a stack overflow nor a quadratic walk."""
    text = '{"a": ["' + '\\"[' * 50_000 + '", ' + '{"b": [1, {"c": "x"}]}, ' * 50_000 + '{"b": "un'
    got = spark.createDataFrame([(text,)], "t string").select(repaired(F.col("t")).alias("r")).first()["r"]
    assert got == text[: text.rindex(",")] + "]}"


def test_steps_follow_open_brackets_only(spark):
    """No step of a walk for what is closed: the walk's array comes after all patterns."""
    plan = spark.createDataFrame([("",)], "t string").select(repaired(F.col("t")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_repaired_once(spark):
    """A filter on what was read repairs no text again."""
    rows = parsed(spark.createDataFrame([('{"sheet": "A", "components": [{"name": "x"}, {"na',)], "value string")).where("NOT has_error").select("sheet", "components")
    assert [r["components"][0]["name"] for r in rows.collect()] == ["x"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1, plan
