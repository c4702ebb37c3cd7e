import json

from plumbline.streaming import pages


def test_resumes_without_repeating(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text(json.dumps({"sheet": f"S{k}", "components": [{"name": "x", "quantity": "1"}]}) + "\n")
        pages.append_to(pages.arriving(spark, str(source)), str(out), str(state)).awaitTermination()
    assert sorted(r["sheet"] for r in spark.read.parquet(str(out)).collect()) == ["S0", "S1"]
