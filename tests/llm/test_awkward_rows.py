"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import ann, chat, decontaminate, langid, license_scan, packing, pii, simhash, token_store, url_filter
from plumbline.llm.common import fresh_path
from plumbline.llm.encoding import encoder

LONG = " ".join(f"word{k % 997}x the of" for k in range(30_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
DOCS = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, "   \n\t ", "en", None),
    (4, "12345 67890 !!", "en", "a"),
    (5, "The cat sat on the mat and the dog ran off.\nAll rights reserved.", "en", "a"),
    (5, "The cat sat on the mat and the dog ran off.\nAll rights reserved.", "en", "a"),
    (6, "The cat sat on the mat and the dog ran off.\nAll rights reserved.", "en", "b"),
    (None, "Le chat est sur la table et le chien dort. mail a@b.co now", "fr", "b"),
    (None, None, None, None),
    (7, LONG, "en", "a"),
    (8, f"before {PASSAGE} after", "en", "a"),
    (-9, "É", "fr", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns bear the names that operators use inside."""
    rows = spark.createDataFrame(DOCS, SCHEMA)
    clash = ("fp", "node", "row", "key", "mask", "task", "length", "h", "ids", "found", "base", "held_out", "cluster", "_id", "_hash", "component_id", "text_hash", "_nth")
    return rows.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_near_duplicates(docs, empty):
    got = [tuple(r) for r in simhash.near_duplicates(docs, 4, 4).select("doc_id", "fp", "component_id").collect()]
    assert len(got) == len(DOCS)
    zero = {r[0] for r in got if r[1] == 0}
    assert {1, 2, 3, None} <= zero
    assert {r[2] for r in got if r[1] == 0} == {1}
    assert {r[2] for r in got if r[0] in (5, 6)} == {5}
    assert simhash.near_duplicates(empty).count() == 0


def test_without_near_copies(docs, empty):
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted((r[0] is None, r[0]) for r in kept.select("doc_id").collect())
    assert ids.count((False, 5)) == 1 and (False, 6) not in ids
    assert simhash.without_near_copies(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (None, "one two"), (1, PASSAGE)], "item_id long, text string")
    found = {(r[0], r[1]) for r in decontaminate.overlaps(docs, items).select("doc_id", "item_id").collect()}
    assert found == {(8, 1)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - 1
    assert decontaminate.overlaps(empty, items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(DOCS)


def test_language(docs, empty):
    net = langid.learn(docs)
    got = {(r[0], r[2]): r[3] for r in langid.predict(docs, net).collect()}
    assert langid.predict(docs, net).count() == len(DOCS)
    assert got[(1, "und")] == 0 and got[(4, "und")] == 0 and got[(None, "und")] == 0
    assert langid.spoken(docs, net, 0.0).columns == docs.columns
    assert langid.learn(empty) is None
    assert langid.predict(empty, None).count() == 0
    assert {r[2] for r in langid.predict(docs, None).collect()} == {"und"}


def test_license_scan(docs, empty):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert license_scan.scan(docs).count() == len(DOCS)
    assert (got[1]["n_words"], got[1]["labels"], got[1]["score"], got[1]["first_word"]) == (0, "", 0.0, None)
    assert (got[5]["n_base"], got[5]["first_word"], got[5]["labels"]) == (1, 11, "reserved")
    assert got[7]["n_words"] == 90_000
    assert license_scan.scan(empty).count() == 0


def test_pii(docs, empty):
    got = [(r[0], r[1]) for r in pii.find(docs).select("doc_id", pii.listed(F.col("found"))).collect()]
    assert len(got) == len(DOCS)
    assert {s for d, s in got if s} == {"email:48:54"}
    stage = corpus_pipeline.personal_data(None, docs, "")
    assert stage.columns == docs.columns
    texts = [r[0] for r in stage.select("text").collect()]
    assert texts.count(None) == 2 and any("mail [EMAIL] now" in t for t in texts if t)
    assert pii.find(empty).count() == 0


def test_packing(docs, empty):
    placed = packing.pack(packing.token_pieces(docs, "word_bpe_49k.json", 64).drop("ids"), 64).collect()
    encode = encoder("word_bpe_49k.json").encode
    assert sum(r["length"] for r in placed) == sum(len(encode(d[1] or "")) // 4 + 1 for d in DOCS)
    for sequence in {r["sequence_id"] for r in placed}:
        at = 0
        for r in sorted((r for r in placed if r["sequence_id"] == sequence), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack(packing.token_pieces(empty, "word_bpe_49k.json", 64).drop("ids"), 64).count() == 0


def test_token_shards(spark, docs, empty):
    path = fresh_path(spark, "test-shards")
    token_store.write_shards(docs, path, "byte_bpe_50k.json", shard_ids=50)
    rows = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r["start"])
    order = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    encode, at = encoder("byte_bpe_50k.json").encode, 0
    for r, d in zip(rows, order, strict=True):
        ids = encode(d[1] or "") + bytes(4)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d[0], at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    path = fresh_path(spark, "test-shards")
    token_store.write_shards(empty, path, "byte_bpe_50k.json")
    assert token_store.read_documents(spark, path).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a</s>b"), (1, 1, "assistant", "a</s>b"), (None, 0, None, ""), (2, None, "system", LONG), (2, None, "x[/ROLE]y", "\\[\\INST]")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.text_messages(turns))).collect()}
    assert set(got) == {1, 2, None}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\na</s>b\nassistant\na</s>b\n").hexdigest()
    assert got[1]["loss_chars"] == 12
    assert got[2]["turns_sha256"] == hashlib.sha256(f"system\n{LONG}\nx[/ROLE]y\n\\[\\INST]\n".encode()).hexdigest()
    assert chat.read_back(chat.format_turns(chat.text_messages(turns.limit(0)))).count() == 0


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (None, "http://A.com/x?y"), (4, "http://b.co.uk"), (4, "http://b.co.uk"), (5, "x://é.net/fr/?://z")], "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(4, False), (4, False), (None, True), (1, None)], "page_id long, good boolean")
    rules = (url_filter.Rule("com/", "allow"), url_filter.Rule("net/fr/", "block"))
    got = [(r[0], r[1], r[2], r[3], r[4]) for r in url_filter.judge(pages, labels, rules).collect()]
    assert (None, "a.com", "/x", "com/", "allow") in got and (5, "é.net", "/fr/", "net/fr/", "block") in got
    assert [r[1:4] for r in got if r[0] in (1, 2)] == [("", "", None)] * 2
    assert url_filter.judge(pages.limit(0), labels, rules).count() == 0
    assert url_filter.judge(pages, labels.limit(0), rules).count() == len([*pages.collect()])


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(40)] + [(k, [1.0, 0.0, 0.0, 0.0]) for k in range(100, 160)]
    bad = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [float("inf")] * 4), (205, [1.0] * 3), (None, [1.0] * 4), (100, [1.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("h", F.lit("clash"))
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    queries = [r for r in rows if r[0] % 20 == 0]
    assert {r["query_id"] for r in got} == {q[0] for q in queries}
    for q, v in queries:
        scores = sorted((-float(np.dot(v, w)), k) for k, w in rows if k != q)[:20]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [k for _, k in scores]
    assert ann.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vectors.where("vec_id < 5")
    assert ann.nearest(few, F.col("vec_id") == 0).count() == 4
