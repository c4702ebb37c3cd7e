"""Sources, sinks, feeds and merges by hand-made rows."""

import difflib
import json
import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions.numeric import parse_numeric
from plumbline.operators import merge, reports, scales, scoring
from plumbline.sources import extraction, manifest, runs, sinks
from plumbline.streaming import feed, pages


@pytest.mark.parametrize("form", ["list", "objects", "csv"])
def test_manifests_of_every_form(spark, tmp_path, form):
    entries = [{"Name": "CMU Wall", "unit": "sf", "aliases": ["block wall", "masonry"], "measure": "Wall_Area", "height_ft": 12, "assumptions": {"coats": 2}}, {"item": "cmu walls"}, {"item_name": "Bollards", "unit": "EA", "aliases": "bollard;post", "measure": "count"}, {"unit": "EA"}]
    path = tmp_path / ("m.csv" if form == "csv" else "m.json")
    if form == "csv":
        path.write_text("NAME,unit,aliases,measure,height_ft\nCMU Wall,sf,block wall|masonry,Wall_Area,12\ncmu walls,,,,\nBollards,EA,bollard;post,count,\n")
    else:
        path.write_text(json.dumps(entries if form == "list" else {"objects": entries}))
    found = {r["entry"]: r for r in (manifest.read_csv if form == "csv" else manifest.read_json)(spark, str(path)).collect()}
    assert set(found) == {"CMU Wall", "Bollards"}
    assert (found["CMU Wall"]["entry_unit"], found["CMU Wall"]["aliases"], found["CMU Wall"]["measure"]) == ("SF", ["block wall", "masonry"], "wall_area")
    assert found["CMU Wall"]["assumptions"] == ({"height_ft": 12.0} if form == "csv" else {"height_ft": 12.0, "coats": 2.0})
    assert found["Bollards"]["aliases"] == ["bollard", "post"]


def test_manifests_are_never_needed(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    assert manifest.tolerant(manifest.read_json, spark, None) is None
    assert manifest.tolerant(manifest.read_json, spark, str(tmp_path / "none.json")) is None
    assert manifest.tolerant(manifest.read_json, spark, str(tmp_path / "bad.json")) is None


def test_run_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "P", 7, k, 10 + k, f"A{k}", None, "ok" if k else None, None, None) for k in range(3)], "project_id long, project_name string, folder_id long, ord int, page_id long, sheet_name string, screenshot_rel string, capture_status string, analysis_status string, source string")
    runs.save(rows, str(tmp_path / "run"))
    back = runs.read(spark, str(tmp_path / "run")).orderBy("ord").collect()
    assert [(r["page_id"], r["capture_status"], r["analysis_status"]) for r in back] == [(10, "pending", "pending"), (11, "ok", "pending"), (12, "ok", "pending")]
    assert {r[0] for r in feed.still_to_do(rows.select("page_id"), rows.select("page_id", F.col("capture_status").alias("status")), ["page_id"]).collect()} == {10}


def test_cached_records(spark):
    pages_ = spark.createDataFrame([("1",), ("2",), ("3",)], "page_id string")
    records = spark.createDataFrame([("1", '{"sheet": "A1", "components": [{"name": "Bollard"}, 5]}'), ("2", '{"sheet": "A2", '), ("3", '{"error": "no"}')], "page_id string, value string")
    good, todo = extraction.cached(pages_, records)
    assert [(r["page_id"], r["sheet"], len(r["components"])) for r in good.collect()] == [("1", "A1", 1)]
    assert {r[0] for r in todo.collect()} == {"2", "3"}


def test_feed_keeps_the_last_event(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = lambda *r: spark.createDataFrame(r, "page long, at long, status string")
    for batch in (rows((1, 1, "pending"), (2, 1, "pending")), rows((1, 2, "ok"), (3, 1, "pending"), (2, 0, "old"))):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        feed.upsert_into(stream, target, mark, ["page"], ["at"]).awaitTermination()
        time.sleep(0.1)
    assert {tuple(r) for r in feed.kept(spark, target, batch.schema).collect()} == {(1, 2, "ok"), (2, 1, "pending"), (3, 1, "pending")}


def test_status_windows(spark):
    events = spark.createDataFrame([("2026-01-01 00:01:00", "ok"), ("2026-01-01 00:04:00", "ok"), ("2026-01-01 00:06:00", "failed")], "t string, status string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r["status"], r["count"]) for r in pages.status_counts(events, "t").collect()) == [("failed", 1), ("ok", 2)]


def test_text_report(spark, tmp_path):
    total = spark.createDataFrame([("Bollards", "28", "EA"), ("A name that is longer than its forty characters", "1,234", "SF")], "item string, quantity_fmt string, unit string")
    log = spark.createDataFrame([("A1", "floor_plan", 1, 2, 3, 4, 0), (None, None, None, 0, 0, 0, 1)], "sheet string, type string, measurements int, components int, rooms int, materials int, sheet_ord int")
    groups = spark.createDataFrame([("room", 3)], "group string, n long")
    lines = reports.text_summary({"Project": "P", "Sheets analyzed": 2}, total, log, groups)
    sinks.write_lines(lines, str(tmp_path / "text"))
    text = [r["line"] for r in lines.orderBy("part", "ord").collect()]
    assert text[3] == "Project:          P"
    assert f"  {'Bollards':<40} {'28':>12}  {'EA':<8}" in text
    assert f"  {'A name that is longer than its forty characters':<40} {'1,234':>12}  {'SF':<8}" in text
    assert f"  [{'A1':<35}] type={'floor_plan':<14} meas={1:>3} comp={2:>3} rooms={3:>3} mat={4:>3}" in text
    assert f"  {'ROOM':15s}  {3:>4} items" in text
    assert sinks.write_json({"total": total}, str(tmp_path / "json")) == {} and spark.read.json(str(tmp_path / "json/total")).count() == 2
    assert reports.manifest_template(spark).count() == 4


def test_parse_numeric_edges(spark):
    cases = {"1′ 6″": 18.0, "3/0": None, "1-1/0": None, "12,5": 125.0, ".5": None, "7 to": 7.0, "n.t.s": None, "EL. 5": None, "  8 ": 8.0, "100%": None, "5' x": 5.0, "2,000.5 sf": 2000.5, "9=9": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_numeric(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == cases


def test_upgrade_takes_the_first_sure_count(spark):
    one = "array<struct<name:string,quantity:string,confidence:string>>"
    rows = spark.createDataFrame([([("Bollard", None, None), (" bollard", None, None)], [("BOLLARD", "3", "low"), ("bollard ", "5", "high"), ("bollard", "9", "high"), ("Lift", None, None), ("lift", "2", "high"), (None, "1", None)])], f"m {one}, c {one}")
    (merged,) = rows.select(merge.merged_components(F.col("m"), F.col("c")).alias("x")).collect()
    assert [(c["name"], c["quantity"]) for c in merged["x"]] == [("Bollard", None), (" bollard", "5"), ("Lift", "2")]


def test_scales_in_text(spark):
    (row,) = spark.createDataFrame([("1/8\" = 1'-0\" and 1\" = 20' and 1 1/2\" = 1'-0\" and 37\" = 1'", None)], "t string, n string").select(scales.text_scales(F.col("t")).alias("a"), scales.text_scales(F.col("n")).alias("b")).collect()
    assert [round(v, 4) for v in row["a"]] == [8.0, 20.0, 0.6667] and row["b"] == []


def test_fuzzy_matching_against_difflib(spark):
    """Equal, equal without signs, most similar, none: against the standard library, name by name."""
    golden = ["CMU Wall", "Gas Piping", "bollards", "Sealed Concrete", "Unheard of", "Ladder-H-20'"]
    summary = ["cmu wall", "GAS-PIPING", "Bollard", "Seal Concrete", "Seale Concrete", "Ladder", "x"]
    plain = lambda t: "".join(c for c in t.lower() if c.isalnum())
    want = {}
    for g in golden:
        ranked = sorted(summary, key=lambda t: (t.lower() != g.lower(), plain(t) != plain(g), -difflib.SequenceMatcher(None, g.lower(), t.lower()).ratio(), t))
        near = plain(ranked[0]) == plain(g) or difflib.SequenceMatcher(None, g.lower(), ranked[0].lower()).ratio() >= 0.7
        want[g] = ranked[0] if near else None
    left = spark.createDataFrame([("p", g, 1.0) for g in golden], "project string, item_name string, quantity double")
    right = spark.createDataFrame([("p", t, 1.0, "EA") for t in summary], "project string, item string, quantity double, unit string")
    assert {r["item_name"]: r["found"] for r in scoring.matched(left, right, ["project"]).collect()} == want
