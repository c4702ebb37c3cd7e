"""Each method against brute force, an exact round trip, its SQL or held-out accuracy."""

import itertools
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat, decontaminate, encoding, langid, packing, pii, queries, simhash, url_filter
from plumbline.llm.elias_fano import EliasFano

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = connection.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


ODD = st.lists(st.sampled_from(["<", "s", ">", "/", "[", "]", "I", "N", "S", "T", "\\", " ", "A", ":", "é", "ROLE", "INST]", "</s>", "[INST] ", "[ATT:"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x[/ROLE]<s>", ""]), ODD), max_size=5))
def test_chat_round_trip(turns):
    text = [{"kind": "text", "text": None}]
    formatted = "".join(chat.render_turn(r, [text[0] | {"text": t}], chat.TokenCosts())[0] for r, t in turns)
    assert [(r, t) for r, t, _ in chat.parse(formatted)] == turns


def test_chat_parts():
    nothing = dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages"))
    parts = [nothing | {"kind": "text", "text": "see [ATT:image:0]"}, nothing | {"kind": "image", "ref": "a.png", "width": 56, "height": 29}, nothing | {"kind": "audio", "ref": "b", "seconds": 2.0}, nothing | {"kind": "document", "ref": "c", "pages": 3}, None]
    segment, loss, kept = chat.render_turn("assistant", parts, chat.TokenCosts())
    assert segment == r"see [\ATT:image:0][ATT:image:0][ATT:audio:1][ATT:document:2]</s>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in kept] == [("image", "a.png", 4), ("audio", "b", 25), ("document", "c", 1536)]
    assert [segment[s["start"] : s["end"]] for s in loss] == [r"see [\ATT:image:0]"]
    assert list(chat.parse(segment)) == [("assistant", "see [ATT:image:0]", [("image", 0), ("audio", 1), ("document", 2)])]


def test_deletion_variants_reach_all_within_the_bound():
    masks = simhash.deletion_masks(3)
    assert len(masks) == 64
    rng = np.random.default_rng(1)
    for _ in range(2000):
        flips = rng.choice(64, 4, replace=False)
        difference = sum(1 << int(b) for b in flips)
        assert any(difference & m == 0 for m in masks)


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(spark, documents):
    def brute(text):
        words = text.encode().lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d: brute(t) for d, t in documents.items()}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components(prints, pairs)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op2_simhash_dedup(spark, SF).collect()}
    assert got == {d: (prints[d], want[d]) for d in prints}


def test_large_group_of_near_fingerprints(spark):
    """A hub and all fingerprints a few bits from it: one component, found without all pairs."""
    near = [0] + [1 << a | 1 << b for a, b in itertools.combinations(range(30), 2)]
    far = [(1 << 62) | (1 << 61) | (1 << 60) | (1 << 59) | (1 << 58)]
    fps = spark.createDataFrame([(x,) for x in near + far], "fp long")
    index = fps.select(F.col("fp").alias("node"), simhash.variants("fp", simhash.deletion_masks(3)))
    edges = [tuple(r) for r in simhash.links(index, ("node",), (4,)).collect()]
    found = components(near + far, edges)
    assert len({found[x] for x in near}) == 1 and found[far[0]] == far[0]


def test_encoding_equals_the_tokenizer(documents):
    odd = ["", " ", "  a  b\n\n c", "a \n b", "\na", "a\n", " a", "a ", "don't  stop  x", "<|endoftext|> x", "É é é", "x" * 200, "a\tb\t c", "12 a1b2", "ﬁ İ K", "a,b. c,. d", "a\n\nb"]
    for vocabulary in encoding.VOCABULARIES:
        encoder = encoding.encoder(vocabulary)
        texts = [*documents.values(), *odd]
        want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [encoder.encode(t) for t in texts] == [np.array(w.ids, "<u4").tobytes() for w in want]


def test_packing_against_the_bound(spark, documents):
    tokenizer = encoding.encoder("word_bpe_49k.json").tokenizer
    want = {}
    for d, t in documents.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[d, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = queries.op4_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(v[1] for v in want.values()) // 2048) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=12), st.integers(40, 60))
def test_plan_takes_everything_once(counts, capacity):
    taken = Counter()
    for times, used in packing.plan(dict(counts), capacity):
        assert sum(k * n for k, n in used.items()) <= capacity
        for k, n in used.items():
            taken[k] += n * times
    assert taken == counts


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=6), st.integers(0, 60))
def test_fullest_is_the_best_subset(counts, room):
    items = [k for k, n in counts.items() for _ in range(n)]
    best = max(sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= room) if len(items) <= 12 else None
    used = packing.fullest(sorted(counts.items(), reverse=True), room)
    assert all(used[k] <= counts[k] for k in used)
    total = sum(k * n for k, n in used.items())
    assert total <= room and (best is None or total == best)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano(values):
    values = sorted(values)
    code = EliasFano.from_bytes(EliasFano.encode(np.array(values, dtype=np.uint64)).to_bytes())
    assert code.values().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    starts = np.cumsum(np.random.default_rng(0).integers(1, 600, 10_000))
    assert len(EliasFano.encode(starts).to_bytes()) * 8 / 10_000 < 2 + np.log2(300) + 2.5


def test_token_shards(spark, documents):
    tokenizer, at = encoding.encoder("byte_bpe_50k.json").tokenizer, 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op5_token_shards(spark, SF).collect()}
    for d in sorted(documents):
        ids = [*tokenizer.encode(documents[d], add_special_tokens=False).ids, 0]
        assert got.pop(d) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def brute_overlaps(texts, items):
    out = {}
    words = {k: decontaminate.word_hashes(t) for k, t in items.items()}
    for d, text in texts.items():
        w, places = decontaminate.word_hashes(text), defaultdict(list)
        for k, x in enumerate(w.tolist()):
            places[x].append(k)
        for item, it in words.items():
            for shift in {p - q for q, x in enumerate(it.tolist()) for p in places.get(x, ())}:
                a, b = max(0, -shift), min(len(it), len(w) - shift)
                n = decontaminate.best_stretch(it[a:b] == w[a + shift : b + shift])
                if n >= min(decontaminate.LEAST, len(it)):
                    out[d, item] = max(n, out.get((d, item), 0))
    return out


def test_decontamination_against_brute_force(spark, documents):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["n_equal"] for r in queries.op6_decontaminate(spark, SF).collect()}
    assert got and got == brute_overlaps(documents, items)


def test_seeds_tolerate_substitutions():
    """Any stretch of 13 words with one replaced keeps a seed; nearly all of 20 with two."""
    def kept(n, replaced):
        return any(all(not (mask[r - at] == "1") for r in replaced if 0 <= r - at < len(mask)) for mask in decontaminate.MASKS for at in range(n - len(mask) + 1))

    assert all(kept(13, (r,)) for r in range(13))
    pairs = list(itertools.combinations(range(20), 2))
    assert sum(kept(20, p) for p in pairs) >= 0.95 * len(pairs)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.learn(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.97


def test_gradient_of_the_network():
    net = langid.ByteConvNet(["a", "b"])
    windows = np.random.default_rng(0).integers(1, 256, (3, langid.WINDOW)).astype(np.uint8)
    targets = np.array([0, 1, 0])
    loss = lambda: float(-np.log(net.probabilities(windows)[np.arange(3), targets]).mean())
    slope = net._slopes(windows, targets)["dense"][0, 0]
    net.dense = net.dense.astype(np.float64)
    net.dense[0, 0] += 1e-4
    up = loss()
    net.dense[0, 0] -= 2e-4
    assert abs((up - loss()) / 2e-4 - slope) < 1e-2 * max(1, abs(slope))


def test_ann_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = defaultdict(dict)
    for r in queries.op10_ann(spark, sf).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        top = ids[np.lexsort((ids, -scores))[:20]]
        hits += len(got[ids[i]].keys() & set(top.tolist()))
        total += 20
        assert len(got[ids[i]]) == 20
        assert all(abs(dict(zip(ids.tolist(), scores, strict=True))[v] - s) < 1e-12 for v, s in got[ids[i]].items())
    assert hits / total >= 0.9


def test_pii_checksums(spark):
    texts = ["pay 4111 1111 1111 1111 now", "pay 4111 1111 1111 1112 now", "iban DE89 3704 0044 0532 0130 00.", "iban DE88 3704 0044 0532 0130 00.", "1.2.3.4.5 and 1.2.3.256", "a@b.c_d@e.f", "a@" + "b." * 5000 + "c", "+1 (555) 010-9999.", "x" * 100_000 + "@", "1-" * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.find(rows).select("doc_id", pii.listed(F.col("found"))).collect()}
    assert got == {0: "card:4:23", 1: "", 2: "iban:5:32", 3: "", 4: "ip:0:7", 5: "email:0:5,email:5:11", 6: "email:0:10003", 7: "phone:0:17", 8: "", 9: ""}


def test_reputation_blocks_bad_hosts(spark):
    pages = spark.createDataFrame([(k, f"http://{'bad' if k < 20 else 'good'}.example.org/{k}") for k in range(60)] + [(100, "http://new.example.org/")], "page_id long, url string")
    labels = spark.createDataFrame([(k, k >= 20) for k in range(60)], "page_id long, good boolean")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels, ()).collect()}
    assert {got[k] for k in range(20)} == {"block"} and {got[k] for k in range(20, 60)} == {"allow"}


def near_copies(documents):
    """Components of exact five-word similarity 0.8, by brute force over shared shingles."""
    def grams(text):
        w = text.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: grams(t) for d, t in documents.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return components(documents, pairs)


def test_pipeline_against_brute_force(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoken = corpus_pipeline.language_id(spark, docs, SF)
    assert {r[0] for r in spoken.select("doc_id").collect()} == {d for d, t in documents.items() if any(map(str.isalpha, t))}
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    want = near_copies(documents)
    assert {r[0] for r in kept.select("doc_id").collect()} == {d for d, root in want.items() if d == root}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    assert {r[0] for r in clean.select("doc_id").collect()} == set(documents) - {d for d, _ in brute_overlaps(documents, items)}
    redacted = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, docs, SF).collect()}
    spans = {r[0]: r[1] for r in pii.find(docs).collect()}
    assert all((redacted[d] == documents[d]) == (not spans[d]) for d in documents)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == {d for d, root in want.items() if d == root} - {d for d, _ in brute_overlaps(documents, items)}
    by = defaultdict(int)
    for r in packed:
        by[r["sequence_id"]] += r["length"]
    assert len(by) <= -(-sum(by.values()) // corpus_pipeline.CAPACITY) + 1 and max(by.values()) <= corpus_pipeline.CAPACITY
