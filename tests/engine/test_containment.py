"""Containment, references and suggestions against plain loops."""

import difflib
import random

from pyspark.sql import functions as F

from plumbline.operators import containment, lookup
from plumbline.plans import queries

SF = "/root/testdata/sf0.001"


def test_first_holding_against_all_pairs(spark):
    rng = random.Random(6)
    letters = "ab1-"
    made = lambda n, low, high: ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]
    needles = [(p, x) for p in (1, 2, 3) for x in made(120, 0, 8)] + [(1, None), (None, "a"), (1, "aaaaaaaaaaaaaaaaaaaaa")]
    texts = [(p, x, k % 17, k) for p in (1, 2) for k, x in enumerate(made(90, 0, 14))] + [(1, None, 0, 900), (None, "a", 0, 901), (1, "x" * 40_000 + "ab1-ab1-ab1-ab1", 99, 902)]
    rows = spark.createDataFrame(texts, "p int, text string, o int, id int").withColumn("_gram", F.lit("clash"))
    got = containment.first_holding(spark.createDataFrame(needles, "p int, needle string").repartition(3), rows.repartition(3), ["p"], ["o", "id"])
    want = {}
    for p, needle in set(needles):
        held = [(o, k) for q, text, o, k in texts if p is not None and p == q and needle and text and needle in text]
        if held:
            want[p, needle] = min(held)
    assert {(r["p"], r["needle"]): (r["o"], r["id"]) for r in got.collect()} == want
    assert containment.first_holding(spark.createDataFrame(needles, "p int, needle string"), rows.drop("_gram").limit(0), ["p"], ["o"]).count() == 0


def test_a_reference_within_a_longer_one(spark):
    sheets = spark.createDataFrame([("p", "S1", "C-41 Site", 0), ("p", "S2", "C-4 Grading", 1), ("p", "S3", "3/A5", 2), ("q", "S4", "C-4", 0)], "project string, sheet string, label string, sheet_ord int")
    refs = spark.createDataFrame([("p", 1, "7", "C-4"), ("p", 2, "", "3A5"), ("p", 3, "9", "c 41"), ("p", 4, "1", "Z"), ("p", 5, "1", None), ("q", 6, "1", "C-4")], "project string, ref_id int, ref_number string, ref_sheet string")
    details = spark.createDataFrame([("p", "S1", 1, 0, "detail 17"), ("p", "S1", 0, 5, "see 7b"), ("q", "S4", 0, 0, None)], "project string, sheet string, prio int, ord int, text string")
    got = {r["ref_id"]: (r["sheet"], r["detail"], r["status"]) for r in lookup.cross_references(refs, sheets, details).collect()}
    assert got == {1: ("S1", "see 7b", "resolved"), 2: ("S3", None, "target_found_detail_missing"), 3: ("S1", None, "target_found_detail_missing"), 4: (None, None, "target_sheet_not_found"), 5: (None, None, "target_sheet_not_found"), 6: ("S4", None, "target_found_detail_missing")}


def test_suggestions_against_difflib(spark):
    refs, catalog = queries._linked(spark, SF)
    names = {}
    for r in catalog.collect():
        names.setdefault(r["g"], set()).add(r["sheet_name"].upper().replace("/", "-").replace(".", "-"))
    got = {}
    for r in queries.near_references(spark, SF).collect():
        got.setdefault((r["g"], r["ref"]), {})[r["place"]] = r["near"]
    for g, ref in {(r["g"], "Q" + r["ref"]) for r in refs.collect()}:
        plain = ref.upper().replace("/", "-").replace(".", "-")
        near = difflib.get_close_matches(plain, sorted(names.get(g, ())), n=3, cutoff=0.4)
        assert [got.get((g, ref), {})[k] for k in sorted(got.get((g, ref), {}))] == near
    assert got


def test_a_report_lists_the_first_pages(spark):
    refs = spark.createDataFrame([("p", f"A{k}", f"S{k}", 0, k) for k in range(30)] + [("p", "a3", "S99", 1, 0), ("p", "nowhere", "S", 0, 99)], "p string, ref string, from_sheet string, source_ord int, ord int")
    catalog = spark.createDataFrame([("p", k, f"A{k} - plan") for k in range(30)], "p string, page_id int, sheet_name string")
    in_run = spark.createDataFrame([("p", 0), ("p", 2), (None, 3)], "p string, page_id int")
    got = lookup.linked_sheets(refs, catalog, in_run, ["p"], 5).orderBy("place").collect()
    assert [(r["page_id"], r["ref_from"], r["suggested_only"]) for r in got] == [(k, f"S{k}", False) for k in (1, 3, 4, 5, 6)]
    assert lookup.linked_sheets(refs, catalog, in_run, ["p"], 5, include=False).where("suggested_only").count() == 5


def test_sheet_images_against_all_pairs(spark):
    """Names within each other both ways, short ones, equal times, repeated and empty names, by brute force."""
    from plumbline.operators import catalog

    rng = random.Random(3)
    name = lambda: "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 7))).strip()
    sheets = [(k % 3, k, name() if k % 9 else None) for k in range(150)]
    files = [(k % 3, f"001_{name()}.png", rng.randrange(4)) for k in range(60)]
    got = catalog.sheet_images(spark.createDataFrame(sheets, "project int, page_id long, sheet_name string"), spark.createDataFrame(files, "project int, file string, modified int")).collect()
    plain = lambda t: " ".join((t or "").lower().split())
    want = {}
    for project, page, own in sheets:
        hits = []
        for p, file, modified in files:
            held = plain(file[4:-4])
            if p == project and held and plain(own) and (held in plain(own) or plain(own) in held):
                hits.append((-modified, plain(own) != held, file))
        if hits:
            want[page] = min(hits)[2]
    assert {r["page_id"]: r["file"] for r in got} == want and len(got) == len(want) > 50
