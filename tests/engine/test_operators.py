"""The engine's operators over small take-off fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry, numeric, text
from plumbline.operators import aggregate, estimate, history, lookup, match, pages, scoring
from plumbline.plans import pipeline
from plumbline.sources import extraction, manifest, sinks


def column(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(expression(F.col("v"))).collect()]


def test_scales(spark):
    got = column(spark, geometry.parse_scale, ['1/4" = 1\'-0"', '3/16" = 1\'-0"', '1" = 20\'', "1:100", "NTS", "none", None, '1-1/2" = 1\'-0"'])
    assert got[0] == 4 and got[1] == pytest.approx(16 / 3) and got[2] == 20 and got[3] == pytest.approx(100 / 12)
    assert got[4:7] == [None] * 3 and got[7] == pytest.approx(2 / 3)
    assert column(spark, geometry.snapped, [4.1, 19.5, 7.0, None], "double") == [4.0, 20.0, None, None]


def test_geometry_scales_with_its_drawing(spark):
    points = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 5.0}, {"x": 0.0, "y": 5.0}]
    rows = spark.createDataFrame([(points,), (points[:1],), ([],)], "p array<struct<x:double,y:double>>")
    got = [tuple(r) for r in rows.select(geometry.shoelace_area(F.col("p")), geometry.polyline_length(F.col("p")), geometry.polyline_length(F.col("p"), True)).collect()]
    assert got == [(50.0, 25.0, 30.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    one, two = (spark.range(1).select(geometry.rescaled(F.lit(720.0), F.lit(s), 1), geometry.rescaled(F.lit(720.0), F.lit(s), 2)).first() for s in (36.0, 72.0))
    assert two[0] == 2 * one[0] and two[1] == 4 * one[1]


def test_names_and_quantities(spark):
    assert column(spark, text.name_key, ["Bollards, Pipe", "pipe bollard", "WC-1", "WC-2", "the"]) == ["bollard pipe"] * 2 + ["1 wc", "2 wc", ""]
    assert column(spark, numeric.quantity_text, [1234.0, 1234.5, None], "double") == ["1,234", "1,234.5", "—"]
    dims = ["12'-0\" x 15'-6\"", "10 x 20", "10", None]
    assert column(spark, numeric.area_from_dimensions, dims) == [144 * 186, 200, None, None]
    assert column(spark, lambda c: numeric.area_from_dimensions(c, False), dims[:2]) == [186, 200]
    described = ["Bollard", "Outdoor mat", "sealed concrete floor", "Swinging doors", None, "Columns-H-35'"]
    assert column(spark, estimate.classify, described) == ["bollard", "general", "sealed_concrete", "doors", "general", "columns"]
    named = column(spark, lambda c: estimate.item_name(c, F.lit("x_y"))["name"], ["Duct liner", "ductwork", 'PVC pipe 8"', "nothing known"])
    assert named == ["X Y", "Duct LF", 'Storm Pipe-8"', "X Y"]


SHEETS = [
    {"sheet": "C-1", "sheet_ord": 0, "sheet_type": "civil_site", "measurements": None, "components": [{"name": "Catch basin", "quantity": "12", "unit": "ea"}, 7, {"name": "Ladder", "quantity": None}, {"name": "Gizmo", "quantity": "3"}],
     "pipe_runs": [{"length_lf": 342.5, "material": "RCP", "raw_text": "RCP"}, {"length_lf": 156, "material": "PVC"}], "civil_structures": [{"type": "manhole", "quantity": 8, "id": "M"}]},
    {"sheet": "A-1", "sheet_ord": 1, "sheet_type": "floor_plan", "rooms": [{"name": "Sales", "area": "12000 SF", "material_notes": "VCT"}], "components": [{"name": "Bollard", "quantity": "6"}],
     "schedules": [{"name": "Doors", "rows": [{"MARK": "D-1", "DESCRIPTION": "Hollow metal door", "QTY": "5"}, {"MARK": "D-2", "QTY": "varies"}]}, {"name": "Spec", "table_purpose": "specification_reference", "rows": [{"QTY": "9", "DESCRIPTION": "x"}]}],
     "lintel_runs": [{"mark": "L1", "size": "L4", "individual_length_ft": 4.0, "count": 3}]},
    {"sheet": "X", "sheet_ord": 2, "error": None},
]


@pytest.fixture(scope="module")
def sheets(spark):
    rows = spark.createDataFrame([(json.dumps(s),) for s in SHEETS] + [("```json\n{broken",)], "value string")
    return extraction.parsed(rows)


def test_extraction_keeps_good_elements(sheets):
    got = {r["sheet"]: r for r in sheets.collect()}
    assert [e["name"] for e in got["C-1"]["components"]] == ["Catch basin", "Ladder", "Gizmo"]
    assert got["X"]["has_error"] and not got["A-1"]["has_error"] and got[None]["has_error"]


def test_estimates(sheets):
    rows = {(r["item_type"], r["description"]): r for r in estimate.estimate(sheets, "retail").collect()}
    kinds = {k for k, _ in rows}
    assert kinds == {"catch_basin", "component", "storm_pipe", "manhole", "flooring", "ceiling_grid", "paint", "drywall", "bollard", "doors", "lintel"}
    assert rows["flooring", "Sales"]["quantity"] == 13200.0
    assert rows["doors", "D-1 - Hollow metal door"]["quantity"] == 5.0
    assert rows["component", "Gizmo"]["needs_review"]
    assert rows["storm_pipe", "RCP"]["quantity"] == pytest.approx(359.62, abs=0.01)
    assert rows["lintel", "Lintel L1 L4"]["quantity"] == pytest.approx(12.6)


def test_takeoff(spark, sheets):
    entries = manifest.entries(spark.createDataFrame([("Steel Bollard", "EA", "bollards", 0), ("Unicorn", "EA", "", 1), ("steel bollards", "EA", None, 2)], "name string, unit string, aliases string, ord int"))
    assert entries.count() == 2
    total = {r["item"]: r for r in aggregate.takeoff(estimate.estimate(sheets, "retail"), entries).collect()}
    assert total["Steel Bollard"]["quantity"] == 6 and total["Steel Bollard"]["source"] == "manifest"
    assert total["Unicorn"]["needs_review"] and total["Unicorn"]["quantity_fmt"] == "—"
    assert total["Mobilization"]["quantity"] == 1
    assert aggregate.takeoff(estimate.estimate(sheets, "retail").limit(0)).count() == 0


def items(spark, rows):
    names = "sheet string, sheet_ord int, src_ord int, elem_ord int, item_type string, description string, quantity double, unit string, qty_source string, confidence string, needs_review boolean, auto_verified boolean, review_reason string"
    return spark.createDataFrame([(f"S{k}", k, 0, 0, *r[:5], *r[5:], *[None] * (8 - len(r) + 1)) for k, r in enumerate(rows)], names)


def test_legend_suppresses_its_items(spark):
    rows = [("columns", "Columns-H-35'", 132.0, "EA", "companion_takeoff_legend"), ("columns", "Columns", 140.0, "ea", None), ("bollard", "Bollards", 28.4, "ea", None), ("bollard", "Pipe bollard", 2.0, "ea", None)]
    got = {r["item"]: r["quantity"] for r in aggregate.takeoff(items(spark, rows)).collect()}
    assert got == {"Columns-H-35'": 132.0, "Bollards": 30.0, "Mobilization": 1.0}


def test_worst_confidence_and_flags(spark):
    rows = [("a", "Bollard", 1.0, "EA", None, "high", None, True, None), ("a", "Bollard", 2.0, "EA", None, None, True, True, "look"), ("a", "Bollard", 3.0, "EA", None, "weird", None, True, "")]
    got = next(r for r in aggregate.takeoff(items(spark, rows)).collect() if r["item"] == "Bollards")
    assert (got["confidence"], got["needs_review"], got["auto_verified"], got["review_reasons"], got["line_count"]) == ("medium", True, False, ["look"], 3)


def test_verified_summary_is_idempotent(spark):
    kind = "item string, unit string, measure_type string, sheet string, points_pt array<struct<x:double,y:double>>, feet_per_inch double, height_ft double, closed boolean, count int, verified boolean, source string, ord int"
    run = lambda n: [{"x": 0.0, "y": 0.0}, {"x": float(n), "y": 0.0}]
    rows = [("CMU Wall", "SF", "wall_area", "A", run(100), 48.0, 20.0, None, None, True, "auto", 0), ("cmu wall ", "SF", "wall_area", "B", run(50), 48.0, 20.0, None, None, None, "auto", 1), ("Gas Piping", "LF", "length", "A", run(100), 48.0, None, None, None, True, "user", 2), ("Bollards", "EA", "count", "A", run(1), None, None, None, None, True, "user", 3), ("Off", "LF", "length", "A", run(9), None, None, None, None, True, "user", 4), ("No", "EA", "count", "A", run(1), None, None, None, None, False, "user", 5)]
    measured = aggregate.measurements(spark.createDataFrame(rows, kind))
    got = {r["item_key"]: r for r in measured.collect()}
    assert {k: r["quantity"] for k, r in got.items()} == {"cmu wall": 2000.0, "gas piping": 66.67, "bollards": 2.0}
    assert got["cmu wall"]["auto"] and got["cmu wall"]["item"] == "CMU Wall" and got["cmu wall"]["source_sheets"] == ["A", "B"]
    base = spark.createDataFrame([("Gas Piping", 5000.0, "LF", "vision"), ("Doors", 4.0, "EA", "vision")], "item string, quantity double, unit string, source string")
    hand = spark.createDataFrame([("doors", 7.0, None)], "item string, quantity double, unit string")
    out = lambda b: {r["item_key"]: (r["quantity"], r["unit"], r["source"]) for r in aggregate.verified_summary(b, measured, hand).collect()}
    first = out(base)
    assert first["gas piping"] == (66.67, "LF", "measured_verified") and first["doors"] == (7.0, "EA", "human_verified")
    assert out(base) == first


def test_references(spark):
    refs = spark.createDataFrame([(1, 1, "3", "A5"), (1, 2, "9", "A-5"), (1, 3, "1", "Z9"), (1, 4, "1", "")], "project int, ref_id int, ref_number string, ref_sheet string")
    where = spark.createDataFrame([(1, "p1", "A-5 DETAILS", 0), (1, "p2", "A5.1", 1)], "project int, sheet string, label string, sheet_ord int")
    details = spark.createDataFrame([(1, "p1", 1, 0, "component 3"), (1, "p1", 0, 1, "row 3")], "project int, sheet string, prio int, ord int, text string")
    got = {r["ref_id"]: (r["sheet"], r["detail"], r["status"]) for r in lookup.cross_references(refs, where, details).collect()}
    assert got == {1: ("p1", "row 3", "resolved"), 2: ("p1", None, "target_found_detail_missing"), 3: (None, None, "target_sheet_not_found"), 4: (None, None, "target_sheet_not_found")}


def test_pages(spark):
    assert column(spark, lambda c: pages.sheet_type(c, F.lit("")), ["SHEET INDEX", "DOOR SCHEDULE", "M-101 HVAC PLAN", "GRADING", "OVERALL"]) == ["title_sheet", "schedule", "mep_plan", "civil_site", "floor_plan"]
    legend = spark.createDataFrame([(1, "Bollards\n\n28 EA\nGas Piping 886.77 LF\nnote\n12 EA extra\n5 SF\n")], "p int, text string")
    got = [(r["item"], r["quantity"], r["unit"]) for r in pages.legend_lines(legend, ["p"]).orderBy("line_no").collect()]
    assert got == [("Bollards", 28.0, "EA"), ("Gas Piping", 886.77, "LF"), ("12 EA extra", 5.0, "SF")]
    plans = spark.createDataFrame([(1, "Warehouse tilt up, sealed concrete"), (1, "retail"), (2, "nothing"), (3, "office"), (3, "school")], "p int, text string")
    assert {r["p"]: r["project_type"] for r in pages.project_type(plans, ["p"]).collect()} == {1: "industrial", 2: "auto", 3: "mixed_use"}


def test_scores(spark):
    golden = spark.createDataFrame([(1, "Bollards", 28.0, "EA", 0.0, "exact_or_within_1"), (1, "CMU Wall", 2204.33, "SF", 3.0, "pct"), (1, "Ladder", 1.0, "EA", 0.0, "exact_or_within_1")], "p int, item_name string, quantity double, unit string, tolerance_pct double, match_mode string")
    summary = spark.createDataFrame([(1, "bollard", 29.0, "EA", 0), (1, "CMU-Wall", 2000.0, "SF", 1), (1, "Ladder-H-20'", 1.0, "EA", 2), (1, "Zebra", 1.0, "EA", 3)], "p int, item string, quantity double, unit string, ord int")
    strict = scoring.judged(scoring.matched(golden, summary, ["p"]))
    assert {r["item_name"]: (r["found"], r["quantity_ok"]) for r in strict.collect()} == {"Bollards": ("bollard", True), "CMU Wall": ("CMU-Wall", False), "Ladder": (None, False)}
    loose = scoring.judged(scoring.token_matched(golden, summary, ["p"]))
    assert {r["item_name"]: r["found"] for r in loose.collect()} == {"Bollards": "bollard", "CMU Wall": "CMU-Wall", "Ladder": "Ladder-H-20'"}
    assert scoring.rates(loose, ["p"]).first()["quantity_ok_rate"] == pytest.approx(0.6667)
    assert {r["item"] for r in scoring.extra_rows(summary, loose, ["p"]).collect()} == {"Zebra"}


def test_history(spark):
    status = column(spark, lambda c: history.outcome(c, F.lit(None), F.when(c == "warned", "w"), F.lit(0)), ["cancelled", "failed", "warned", "done"])
    assert status == ["cancelled", "failed", "partial", "success"]
    assert column(spark, lambda c: history.log_tail(c, 2), [[1, 2, 3], [1]], "array<int>") == [[2, 3], [1]]


def test_plan_and_sinks(spark, sheets, tmp_path):
    out = pipeline.run_project(sheets)
    assert out["project_type"].count() == 1
    assert {r["item"] for r in out["summary"].collect()} >= {"Bollards", "Mobilization"}
    sinks.write_report(out, str(tmp_path / "report"))
    back = spark.read.option("header", True).csv(str(tmp_path / "report" / "summary"))
    assert back.count() == out["summary"].count() and "quantity_fmt" in back.columns


def test_matches_stay_within_their_group(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a")], "g int, l string")
    right = spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "g int, r string, o int")
    got = match.ranked_match(left, right, ["g"], F.lit(True), ["o"], ["g", "l"], "left").orderBy("g").collect()
    assert [r["r"] for r in got] == ["y", None]
