"""Rules added after the first round: odd part sizes, control strings, hosts, contexts, wrapped notices, rejection, overlaps, recall at several sizes."""

import json
import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import ann, chat, common, decontaminate, encoding, langid, license_scan, pii, url_filter


def test_part_sizes_that_are_no_sizes(spark):
    """Typed parts through DataFrames: nulls, odd numbers, unknown kinds, clashing columns, empty tables."""
    part = lambda kind, **more: dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages")) | {"kind": kind} | more
    odd = [part("audio", seconds=x) for x in (float("nan"), float("inf"), -3.0, None, 2.0)]
    odd += [part("image", width=-5, height=10), part("image", width=28, height=28), part("document", pages=-1), part("video", text="only text"), part(None, text="t"), None]
    rows = spark.createDataFrame([(1, 0, "assistant", odd), (1, 1, "user", None), (2, 0, None, [])], f"conv_id long, turn long, role string, parts {chat.PARTS}").withColumn("loss", F.lit("clash"))
    segments = {(r["conv_id"], r["turn"]): r for r in chat.format_turns(rows).collect()}
    assert [a["tokens"] for a in segments[1, 0]["attachments"]] == [0, 0, 0, 0, 25, 0, 1, 0]
    assert segments[1, 0]["segment"].endswith("only textt</s>") and segments[2, 0]["attachments"] == []
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(rows)).collect()}
    assert (back[1]["n_turns"], back[1]["n_attachments"], back[1]["attachment_tokens"], back[1]["loss_chars"]) == (2, 8, 26, 10)
    assert chat.format_turns(rows.limit(0)).count() == 0


@pytest.mark.parametrize("vocabulary", sorted(encoding.VOCABULARIES))
def test_control_strings_become_their_ids(vocabulary):
    """Against a tokenizer that nobody has changed."""
    fresh = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    rng = random.Random(vocabulary)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", " ", "  ", "\n", "word", "don't", "é", ".", ",", "12", "<|ENDOFTEXT|>", "\t"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(9))) for _ in range(3000)]
    got = [encoding.encoder(vocabulary).encode(t) for t in texts]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in fresh.encode_batch(texts, add_special_tokens=False)]


def brute_stretch(a, b):
    """The best number of equal words over all diagonals: a point for an equal word, two less for another."""
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        top, run, equal = 0, 0, 0
        for k in range(max(0, -shift), min(len(b), len(a) - shift)):
            same = b[k] == a[k + shift]
            if run < 0:
                run, equal = 0, 0
            run, equal = run + (1 if same else -2), equal + same
            if run > top:
                top, found = run, equal
        best = max(best, found if top else 0)
    return best


def test_overlaps_against_independent_brute_force(spark):
    """Items of 1 to 40 words, some of repeated words, in texts that replace some of them."""
    rng = random.Random(4)
    items = {n: [f"w{n}x{k}" for k in range(n)] for n in range(1, 41)}
    items |= {50: ["same"] * 30, 51: ["to", "be"] * 12, 52: [f"long{k}" for k in range(400)]}
    docs = {}
    for n, words in items.items():
        for share in (0.0, 0.05, 0.1):
            copied = [w if rng.random() >= share else f"other{rng.randrange(10**9)}" for w in words]
            docs[len(docs)] = [f"a{rng.randrange(99)}" for _ in range(5)] + copied + [f"b{rng.randrange(99)}" for _ in range(5)]
    docs |= {1000: ["same"] * 3000, 1001: ["be"], 1002: []}
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_equal"] for r in decontaminate.overlaps(rows, bench).collect()}
    for d, words in docs.items():
        if d == 1000:
            continue
        for i, item in items.items():
            best = brute_stretch(words, item)
            if (d, i) in got:
                assert got[d, i] == best >= min(decontaminate.LEAST, len(item)), (d, i)
            elif len(item) < 8 or best >= 13:
                # Shorter stretches with replaced words may keep no seed; whole items and long stretches keep one.
                assert best < min(decontaminate.LEAST, len(item)), (d, i, best)
    assert got[1000, 50] == 30 and (1000, 51) not in got


def test_diagonals_of_repeated_words():
    a, b = (np.array([1] * n, np.uint64) for n in (4000, 3000))
    many = decontaminate.diagonals(a, b)
    assert many.min() >= -2999 and many.max() <= 3999 and {-2990, 0, 3990} <= set(many.tolist())


def test_hosts_without_ports_dots_and_users(spark):
    hosts = {"10.1.2.3": ("10.1.2.3", "10.1.2.3"), "a.example.com:8080": ("example.com", "com"), "example.com.": ("example.com", "com"), "u:p@b.example.co.uk": ("example.co.uk", "co.uk"), "x.gov.pl": ("x.gov.pl", "gov.pl"), "localhost": ("localhost", "localhost"), "[::1]:80": ("[::1]", "[::1]"), "": ("", "")}
    bare = url_filter.bare_host(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_filter.registered_domain(bare), url_filter.public_suffix(bare)).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == hosts


HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
PII_CASES = [
    (f"token: {HEX} and {HEX}", "secret:7:47,secret:52:92", "80,80"),
    (f"api_key {HEX}\n{HEX.upper()}", "secret:8:48,secret:49:89", "80,80"),
    (f"{HEX} is the password", "secret:0:40", "80"),
    (f"{HEX} stands here alone, and so far from any of those words that tell what it is for that nobody would think of it as a password", "", ""),
    ("ssn 123-45-6789 and 123-45-67890", "ssn:4:15", "80"),
    ("card 4111 1111 1111 1111", "card:5:24", "100"),
    ("x" * 20_000 + " host 1.2.3.4", "ip:20006:20013", "90"),
    (f"AKIA{'A1' * 8}", "key:0:20", "90"),
]


def test_contexts_scores_and_redaction(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(PII_CASES)] + [(99, None)], "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in pii.find(rows).select("doc_id", pii.listed(F.col("found")), pii.scores(F.col("found"))).collect()}
    assert got == {k: (s, p) for k, (_, s, p) in enumerate(PII_CASES)} | {99: ("", "")}
    redacted = {r[0]: r[1] for r in rows.select("doc_id", pii.redact(F.col("text"))).collect()}
    assert redacted[0] == "token: [SECRET] and [SECRET]" and redacted[1] == "api_key [SECRET]\n[SECRET]" and redacted[3] == PII_CASES[3][0]
    assert redacted[6] == "x" * 20_000 + " host [IP]" and redacted[99] is None


WRAPPED = [
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided"),
    ("gpl", " * you can redistribute it and/or modify\n * it under the terms of the GNU General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"),
    ("", "all\nof these\nrights are\nnot reserved"),
]


def test_wrapped_notices(spark):
    rows = spark.createDataFrame([(k, f"first line\n\n{t}\nlast line") for k, (_, t) in enumerate(WRAPPED)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(rows).collect()}
    assert all(label in got[k] for k, (label, _) in enumerate(WRAPPED))


def test_words_strewn_over_a_line_are_no_notice(spark):
    """Enough words of a notice on one long line, but never near each other; and the same notices whole, within long lines."""
    filler = " ".join(f"w{k}" for k in range(220))
    strewn = [f"all {filler} rights {filler} reserved", f" {filler} ".join(["licensed", "under", "cc", "nc", "4", "0"]), "all w rights reserved", "all\nrights\nreserved"]
    whole = [f"{filler} All rights reserved {filler}", f"{filler} licensed, under CC nc x 4 0 {filler}", f"{filler} permission is hereby granted free of charge to any person obtaining a copy of that software {filler}"]
    rows = spark.createDataFrame(list(enumerate(strewn + whole)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(rows).collect()}
    assert [got[k] for k in range(3)] == [("", 0.0)] * 3
    assert got[3] == ("reserved", 1.0)  # a phrase of the base stands over any lines
    assert got[4] == ("reserved", 1.0) and got[5][0] == "cc-by-nc-4.0" and got[6][0] == "mit" and 0.8 <= got[6][1] < 1


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "kjq wzx pvb qqk zxw jkv bqx wqz pzx vkj qxb zwq kxj vqz bpx wkq jzx qvw kzb xpq zwk jqv pxk wvz qqj zbk xwp vjq kkz bqp xzv wjk",
]


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.learn(docs, others=True)
    bar = langid.rejection_bar(docs, net)
    assert langid.spoken(docs, net, bar).count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    foreign = spark.createDataFrame([(k, t) for k, t in enumerate([*FOREIGN, "Kj", None, "123"])], "doc_id long, text string")
    assert [r["doc_id"] for r in langid.spoken(foreign, net, bar).collect()] == [len(FOREIGN)]


def test_network_against_plain_loops():
    """Convolution, pooling, softmax and the mean over windows, written out."""
    net = langid.ByteConvNet(["a", "b", "c"])
    text = "Un texte de plus de deux cent cinquante-six octets. " * 7
    data, sums = text.encode(), np.zeros(3)
    for at in range(0, len(data), langid.WINDOW):
        window = data[at : at + langid.WINDOW]
        padded = list(window) + [0] * (langid.WINDOW - len(window) + max(langid.WIDTHS) - 1)
        pooled = []
        for f in range(len(langid.WIDTHS) * langid.FILTERS):
            width = langid.WIDTHS[f // langid.FILTERS]
            weights = net.filters[:, f].reshape(max(langid.WIDTHS), -1)
            pooled.append(max(sum(float(net.embedding[padded[i + j]] @ weights[j]) for j in range(width)) for i in range(langid.WINDOW)))
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.dense + net.out_bias
        sums += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(window)
    (mean,) = langid.means(net, [text])
    assert np.allclose(mean, sums / len(data), atol=1e-4)


def brute_recall(spark, x, got, top=20):
    hits = total = 0
    for i in range(0, len(x), 20):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-scores)[:top].tolist()))
        total += top
    return hits / total


@pytest.mark.parametrize(("n", "clusters"), [(500, 0), (4000, 0), (12000, 40)])
def test_recall_at_three_sizes(spark, n, clusters):
    """Vectors without structure, and in clusters, where few partitions are probed."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    if clusters:
        x = rng.normal(size=(clusters, 32))[rng.integers(clusters, size=n)] * 3 + x * 0.6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([json.dumps({"vec_id": k, "embedding": v}) for k, v in enumerate(x.tolist())], "string")
    vectors = rows.select(F.from_json("value", "vec_id long, embedding array<double>").alias("v")).select("v.*")
    got = {i: set() for i in range(0, n, 20)}
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert all(len(found) == 20 for found in got.values())
    assert brute_recall(spark, x, got) >= 0.9


def test_a_passage_in_every_item(spark):
    """400 texts that all begin as 200 items do go by their first reading; the others are read to the end."""
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(10**6)}"
    opening = " ".join(word() for _ in range(16))
    items = [(k, f"{opening} " + " ".join(word() for _ in range(20))) for k in range(200)]
    # A text that shares most with one item, by seeds alone, and overlaps with another.
    strewn = " ".join(" ".join(items[0][1].split()[16 + k : 22 + k]) + " x y z" for k in range(0, 12, 4))
    texts = [(k, f"{opening} " + " ".join(word() for _ in range(60))) for k in range(400)] + [(k, " ".join(word() for _ in range(60))) for k in range(400, 420)]
    texts += [(420, f"{strewn} " + " ".join(items[7][1].split()[17:31])), (421, None)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = {r["doc_id"] for r in decontaminate.clean(rows, bench).collect()}
    found = {r["doc_id"] for r in decontaminate.overlaps(rows.where("doc_id >= 390"), bench).select("doc_id").distinct().collect()}
    assert kept == {*range(400, 420), 421} and found == {*range(390, 400), 420}


@pytest.mark.parametrize(("parts", "clusters", "most_probes"), [(256, 0, 200), (1024, 2048, 40)])
def test_learning_of_many_partitions(parts, clusters, most_probes):
    """Recall over all vectors with as many partitions as a large table has, and the memory that learning them takes."""
    script = f"""
import resource, sys
import numpy as np
from plumbline.llm import ann
rng, n, parts, clusters = np.random.default_rng(1), {32 * parts}, {parts}, {clusters}
x = rng.normal(size=(n, 64))
if clusters:
    x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, n)] + 0.35 * x
x /= np.linalg.norm(x, axis=1, keepdims=True)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
router = ann.Router.learn(x[::2], parts)
probes = ann.probes_needed(router, parts, x[1::2], 20, n)
own, hits = router.order(x, 1)[:, 0], 0
for i in range(0, n, n // 200):
    near = x @ x[i]
    near[i] = -np.inf
    best = np.argpartition(-near, 20)[:20]
    hits += np.isin(own[best], router.order(x[i : i + 1], probes)[0]).mean()
sizes = np.bincount(own, minlength=parts)
print(hits / len(range(0, n, n // 200)), probes, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, env=os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}).stdout.split()
    recall, probes, megabytes = map(float, out)
    assert recall >= 0.9 and probes <= most_probes and megabytes < 700


def test_intermediate_tables_and_settings(spark):
    """A run puts the session's batch size back, and what it wrote goes by one call."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with common.arrow_rows(spark, 17):
        assert spark.conf.get(name) == "17"
    assert spark.conf.get(name) == before
    path = common.fresh_path(spark, "some")
    spark.range(2).write.parquet(path)
    assert os.path.isdir(path)
    common.clear_intermediate(spark)
    assert not os.path.exists(path) and common.clear_intermediate(spark) == 0
