"""Benchmark items shorter than every seed mask must be found whole, and only whole."""

from plumbline.llm import decontaminate

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota".split()


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(n, " ".join(f"{w}{n}" for w in ITEM[:n])) for n in range(1, 10)], "item_id long, text string")
    rows = []
    for n in range(1, 10):
        words = [f"{w}{n}" for w in ITEM[:n]]
        rows.append((n, "before this, " + " ".join(words).title() + "; and after"))
        rows.append((10 + n, " ".join(words)))
        # One word replaced or left out.
        rows.append((20 + n, "so " + " ".join(["other", *words[1:]]) + " it goes on"))
        rows.append((30 + n, "so " + " ".join(words[:-1]) + " it goes on"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in decontaminate.overlaps(docs, items).select("doc_id", "item_id", "n_equal").collect()}
    assert found == {(d, n, n) for n in range(1, 10) for d in (n, 10 + n)}
    assert {r[0] for r in decontaminate.clean(docs, items).select("doc_id").collect()} == {d for d, _ in rows if d > 20}
