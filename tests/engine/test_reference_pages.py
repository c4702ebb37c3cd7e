"""A reference takes the sheet whose code it equals, not a shorter name that begins with it."""

from plumbline.operators import lookup


def test_equal_code_goes_before_a_longer_code(spark):
    names = ["C-41", "C-4 - GRADING PLAN", "A10", "a1 - Floor plan", "3-A5 DETAILS"]
    catalog = spark.createDataFrame([(1, k, n) for k, n in enumerate(names)], "g int, page_id int, sheet_name string")
    refs = spark.createDataFrame([(1, r) for r in ("C-4", "A1", "3/A5", "C4")], "g int, ref string")
    got = {r["ref"]: (r["page_id"], r["score"]) for r in lookup.reference_pages(refs, catalog, ["g"]).collect()}
    assert got == {"C-4": (1, 3), "A1": (3, 3), "3/A5": (4, 2)}
