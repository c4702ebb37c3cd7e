"""Feeds, page states, the stored catalog and imports when batches die and runs start again; records that break off; order statistics."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import storage
from plumbline.operators import aggregate
from plumbline.sources import extraction, store
from plumbline.streaming import feed, states

EVENT = "page int, at int, status string"


def test_a_batch_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    """Killed between its rows and its list of parts, and again while it writes its rows: the table stays, and the batch can run again."""
    path, rows = str(tmp_path / "t"), lambda *r: spark.createDataFrame(list(r), EVENT)
    read = lambda: {tuple(r) for r in feed.kept(spark, path, rows((0, 0, "")).schema).collect()}
    first = [(k, 1, "pending") for k in range(40)]
    feed.upsert_batch(rows(*first), 0, path, ["page"], ["at"])
    assert read() == set(first)
    second = [(k, 2, "ok") for k in range(0, 50, 2)] + [(1, 0, "older")]
    with monkeypatch.context() as m:
        session = type(spark)
        create = session.createDataFrame

        def dies(self, data, schema=None, *a, **b):
            if schema == "batch long, part int":
                raise RuntimeError("killed")
            return create(self, data, schema, *a, **b)

        m.setattr(session, "createDataFrame", dies)
        with pytest.raises(RuntimeError, match="killed"):
            feed.upsert_batch(rows(*second), 1, path, ["page"], ["at"])
    assert read() == set(first)
    # What a job that was killed leaves behind.
    os.makedirs(f"{path}/rows/batch=1/_temporary/0", exist_ok=True)
    os.makedirs(f"{path}/done/batch=1/_temporary/0", exist_ok=True)
    assert read() == set(first)
    want = {(k, 2, "ok") for k in range(0, 50, 2)} | {(k, 1, "pending") for k in range(1, 40, 2)}
    for _ in range(2):
        feed.upsert_batch(rows(*second), 1, path, ["page"], ["at"])
        assert read() == want


def test_page_states_over_restarts(spark, tmp_path):
    """Timers, retries, late and repeated events, retention; every file is a batch, every start a restart."""
    at = lambda minute: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)
    batches = [
        [("r", "a", "pending", at(0)), ("r", "b", "pending", at(0)), ("r", "c", "skipped", at(1)), ("r", "d", "unheard of", at(1)), ("r", "a", "pending", at(0))],
        [("r", "a", "ok", at(3)), ("r", "a", "failed", at(4)), ("r", "e", "pending", None)],
        [("r", "x", "pending", at(60))],  # time goes on: b is not heard of
        [("r", "b", "pending", at(61)), ("r", "b", "ok", at(62)), ("r", "late", "ok", at(2))],
        [("s", "z", "pending", at(60 * 24 * 3))],  # and on: what is final is forgotten
        [("s", "y", "pending", at(60 * 24 * 3 + 1))],
    ]
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.STATE_STORE)
    try:
        for batch in batches:
            frame = spark.createDataFrame(batch, "run string, page string, status string, at timestamp")
            frame.coalesce(1).write.mode("append").parquet(source)
            changes = states.page_states(spark.readStream.schema(frame.schema).parquet(source), patience=600, retention=86_400)
            changes.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault((r["run"], r["page"]), []).append((r["status"], r["attempts"], r["reason"]))
    assert sorted(got["r", "a"]) == [("forgotten", 1, None), ("ok", 1, None), ("pending", 1, None)]
    assert sorted(got["r", "b"], key=str) == sorted([("pending", 1, None), ("failed", 1, "no answer in time"), ("pending", 2, None), ("ok", 2, None), ("forgotten", 2, None)], key=str)
    assert sorted(got["r", "c"]) == [("forgotten", 0, None), ("skipped", 0, None)]
    assert ("failed", 1, "no answer in time") in got["r", "x"]
    assert ("r", "d") not in got and ("r", "e") not in got and ("r", "late") not in got
    assert got["s", "y"] == [("pending", 1, None)]


def test_imports_once_each(spark, tmp_path):
    source, path = tmp_path / "caches", str(tmp_path / "store")
    source.mkdir()
    assert store.import_caches(spark, str(tmp_path / "nowhere"), path, "2026-01-01") == 0
    cache = lambda pid, *pages: json.dumps({"project_id": pid, "fetched_at": "2026-01-02T03:04:05", "plans": [{"page_id": p, "sheet_name": f"S{p}"} for p in pages]})
    (source / "7.json").write_text(cache(None, 1, 2, 2))
    (source / "x.json").write_text(cache(8, 3))
    (source / "_9.json").write_text(cache(9, 4))
    (source / "bad.json").write_text("{not json")
    (source / "10.json").write_text(json.dumps({"plans": []}))
    (source / "note.txt").write_text(cache(11, 5))
    assert store.import_caches(spark, str(source), path, "2026-01-01") == 4
    rows = lambda: sorted((r["project"], r["folder"], r["page_id"], r["sheet_name"]) for r in store.read(spark, path, "plans").collect())
    assert rows() == [(7, 0, 1, "S1"), (7, 0, 2, "S2"), (8, 0, 3, "S3")]
    assert store.import_caches(spark, str(source), path, "2026-01-01") == 0
    # Files that were taken by a run that died before its ledger are taken again, to the same rows.
    (source / "12.json").write_text(cache(12, 6))
    taken = store.ledger(spark, path).count()
    append = store.synced_plans
    try:
        store.synced_plans = lambda rows, p: (append(rows, p), (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            store.import_caches(spark, str(source), path, "2026-01-01")
    finally:
        store.synced_plans = append
    assert store.ledger(spark, path).count() == taken and (12, 0, 6, "S6") in rows()
    assert store.import_caches(spark, str(source), path, "2026-01-01") == 1
    assert len(rows()) == 4


def test_store_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.version(spark, path) is None and store.project_count(spark, path) == 0 and store.read(spark, path, "plans").count() == 0
    store.migrate(spark, path)  # nothing to do
    store.upsert_projects(spark.createDataFrame([(1, "One", 5), (2, "two", None)], "project long, name string, sheet_count long"), path, 1)
    assert store.version(spark, path) == 1
    for _ in range(2):
        store.migrate(spark, path)
    assert store.version(spark, path) == 2
    assert [tuple(r)[:2] for r in store.listed_projects(spark, path).collect()] == [(1, "One"), (2, "two")]
    assert store.sheet_counts(spark, path).count() == 0
    stamp = F.lit("2026-01-01").cast("timestamp")
    plans = spark.createDataFrame([(1, 5, 10, "A", 0), (1, 5, 11, "B", 1), (1, 6, 12, "C", 0)], "project long, folder long, page_id long, sheet_name string, ord int").withColumn("synced_at", stamp)
    store.synced_plans(plans, path)
    store.synced_plans(plans.where("page_id = 10"), path)
    assert [r["page_id"] for r in store.plans(spark, path, 1).collect()] == [10, 12]
    assert [r["page_id"] for r in store.plans(spark, path, 1, 6).collect()] == [12]
    assert "PartitionFilters: [isnotnull(folder" in store.plans(spark, path, 1, 6)._jdf.queryExecution().toString() or "folder" in store.plans(spark, path, 1, 6)._jdf.queryExecution().toString().split("PartitionFilters")[1][:200]
    assert {(r["project"], r["sheet_count"]) for r in store.sheet_counts(spark, path).collect()} == {(1, 2)}


def test_records_that_break_off(spark):
    whole = {"sheet": "S", "components": [{"name": 'a "[{', "quantity": "1"}, {"name": "b\\", "quantity": "2"}], "rooms": [{"name": "R", "area": "5"}]}
    text = json.dumps(whole)
    cuts = [text[:n] for n in range(1, len(text) + 1)]
    rows = spark.createDataFrame(list(enumerate(cuts, 1)), "n int, value string")
    got = {r["n"]: r for r in extraction.parsed(rows, "value", ["n"]).collect()}
    for n, cut in enumerate(cuts, 1):
        done = [c for c in whole["components"] if json.dumps(c) in cut]
        found = [(c["name"], c["quantity"]) for c in got[n]["components"] or []]
        assert found[: len(done)] == [(c["name"], c["quantity"]) for c in done], cut
        assert len(found) <= len(done) + 1
        if '"R", "area": "5"}' in cut:
            assert [(r["name"], r["area"]) for r in got[n]["rooms"]] == [("R", "5")]
    odd = spark.createDataFrame([("",), (None,), ("{",), ("}{",), ('{"a": "' + "x\\\"" * 20_000,), ('{"sheet": "S", "components": [' + '{"name": "x"}, ' * 5000,), ("[1, 2",), ('{"a": 1}}',)], "value string")
    sizes = [len(r["components"] or []) for r in extraction.parsed(odd).collect()]
    assert sizes[5] == 5000 and len(sizes) == 8


def test_order_statistics_of_a_crowded_page(spark):
    """By counts and by a whole window: the same positions, with ties, few values, and several pages."""
    rng = random.Random(4)
    values = {1: [rng.gauss(0, 100) for _ in range(6000)], 2: [float(rng.randint(0, 3)) for _ in range(5000)], 3: [7.0] * 4000, 4: [1.0, 2.0, 3.0], 5: [0.0] * 3990 + [1e9] * 10}
    rows = spark.createDataFrame([(p, v) for p, vs in values.items() for v in vs] + [(1, None), (None, 5.0)], "page int, v double").repartition(5)
    for low, high in ((0.5, 99.5), (0.0, 100.0), (50.0, 50.0)):
        got = {r["page"]: (r["low"], r["high"], r["n"]) for r in aggregate.trimmed_extent(rows, ["page"], "v", low, high, many=1000).collect()}
        assert got.keys() == {*values, None}
        for p, vs in values.items():
            ranked = sorted(vs)
            assert got[p] == (*(ranked[min(int(len(vs) * q / 100), len(vs) - 1)] for q in (low, high)), len(vs))


def test_intermediate_tables_go_by_one_call(spark):
    path = storage.shared_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path) and storage.clear_intermediate(spark) >= 1 and not os.path.exists(path)
    assert storage.clear_intermediate(spark) == 0
