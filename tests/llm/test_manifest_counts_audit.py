"""The Merkle manifest, token counts and divergence audit against brute force, and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import divergence, merkle, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 997}x the of" for k in range(30_000))
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, "   \n\t ", "en", None, 6),
    (4, "12345 67890 !!", "", "a", 14),
    (5, "The cat\nsat. It's <|endoftext|>there", "en", "a", 35),
    (5, "The cat\nsat. It's <|endoftext|>there", "en", "a", 35),
    (5, "another", "en", "b", 7),
    (None, "Le chat é", "fr", "b", 9),
    (None, None, None, None, None),
    (7, LONG, "en", "a", len(LONG)),
    (-9, "É", "zh", "a", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    clash = ("tree", "at", "size", "digest", "shown", "hash", "term", "n", "doc", "spaced", "shard", "rank", "_read", "_part", "leaf", "root", "siblings", "first")
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit("clash") for c in clash})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def brute_manifest(rows):
    """Whole levels as lists, each proof read off them."""
    by = defaultdict(list)
    for row in rows:
        by[row[2]].append(row)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
    trees = {lang: levels([leaf_of(*r) for r in by[lang]]) for lang in langs}
    forest = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for place, row in enumerate(by[lang]):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            folded, proof = leaf_of(*row[:4], row[4] + 1) if changed else leaf_of(*row), []
            for tree, at in ((trees[lang], place), (forest, k)):
                for level in tree[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += run[: at % 2] + run[at % 2 + 1 :]
                    run[at % 2] = folded
                    folded, at = h(*run), at // 2
            root = forest[-1][0]
            out.append((row[0], leaf_of(*row), trees[lang][-1][0], root, h(*proof), folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(docs, levels=merkle.LEVELS):
    made = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, levels, n_chars=F.col("n_chars") + 1)
    return sorted((tuple(r) for r in made.collect()), key=str)


def test_manifest_awkward(awkward):
    assert manifest_rows(awkward) == brute_manifest(AWKWARD)
    assert manifest_rows(awkward.limit(0)) == []
    assert manifest_rows(awkward.where("doc_id = 4")) == brute_manifest([AWKWARD[3]])


@pytest.mark.parametrize("levels", [2, 3, 10])
def test_manifest_over_rounds(spark, levels):
    """Blocks of 4, 8 and 1024 leaves: the same rows, however many rounds, also with more trees than a block has leaves."""
    rows = [(k, f"text {k}", f"l{k % 11}" if k % 5 else "en", "s", k) for k in range(190)]
    assert manifest_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), levels) == brute_manifest(rows)


def test_manifest_copies(spark):
    """Rows that are equal in all columns are leaves each, over several partitions."""
    rows = [(3, "same", "en", "s", 4)] * 2500
    assert manifest_rows(spark.createDataFrame(rows, SCHEMA)) == brute_manifest(rows)


ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "中", "<|endoftext|>", "1", "23", ".", ",", "ing", "\r", "\x1c", "ǅ", "😀", "́", "_", "aaaa", "Hello", "ª", "\x85", "\xa0", "᠎", "١", "\0"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_odd_strings(library):
    rng = random.Random(7)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    texts += ["a" * n for n in range(1, 200)] + ["ab" * 50, "x" * 50_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "é中😀" * 3000]
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert counter.count(texts) == library(texts)


def test_counts_with_a_small_memo(monkeypatch, library):
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 3)
    monkeypatch.setattr(token_counts, "MEMO_CHARS", 4)
    monkeypatch.setattr(token_counts, "BATCH_SYMBOLS", 5)
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["the quick brown fox", "the the unbelievably\nquick", "", "fox."]
    for _ in range(3):
        assert counter.count(texts) == library(texts)


def test_merging_one_pair_at_a_time():
    """Survivors of ragged sequences against merging the first of the lowest pairs again and again."""
    rng = random.Random(5)
    pairs, names = [], ["a", "b", "c"]
    while len(pairs) < 12:
        a, b = rng.choice(names), rng.choice(names)
        if a + b not in names:
            pairs.append((a, b))
            names.append(a + b)
    merges = token_counts.Merges({n: k for k, n in enumerate(names)}, pairs)
    rank = {p: k for k, p in enumerate(pairs)}

    def slow(symbols):
        while True:
            best = min((rank.get(p, 99) for p in zip(symbols, symbols[1:], strict=False)), default=99)
            if best == 99:
                return len(symbols)
            at = next(k for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if rank.get(p) == best)
            symbols[at : at + 2] = ["".join(symbols[at : at + 2])]

    sequences = [[rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(3000)]
    got = merges.survivors(np.array([names.index(x) for s in sequences for x in s]), np.array([len(s) for s in sequences]))
    assert got.tolist() == [slow(list(s)) for s in sequences]


def test_counts_of_tables(spark, awkward, library):
    got = sorted((tuple(r) for r in token_counts.count_tokens(awkward).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(AWKWARD, library([r[1] or "" for r in AWKWARD]), strict=True)]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(awkward.limit(0)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    counted = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs).collect()}
    assert counted == {d: (len(t.encode()), n, n > 512) for (d, t), n in zip(texts.items(), library(list(texts.values())), strict=True)}


def brute_audit(rows, least, ranks):
    """Python numbers throughout."""
    split = lambda t: "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in t or "").split(" ")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = [w for w in split(text) if w]
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for g, s in counts if g == lang)
        p = lambda n, total: 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(kept))
        n_of = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        of = {s: {t: p(counts[lang, s][t], n_of[s]) for t in kept} for s in sources}
        q = {t: p(sum(counts[lang, s][t] for s in sources), sum(n_of.values())) for t in kept}
        for s in sources:
            pair = [(sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(of[s][t] - q[t], t) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def audit_rows(docs, least, ranks, sizes=divergence.Sizes()):
    return sorted(tuple(r) for r in divergence.audit(docs, least, ranks, sizes).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_awkward(awkward):
    assert audit_rows(awkward, 2, 50) == brute_audit(AWKWARD, 2, 50)
    assert audit_rows(awkward, 1, 3) == brute_audit(AWKWARD, 1, 3)
    assert audit_rows(awkward, 99, 3) == brute_audit(AWKWARD, 99, 3)  # no term is kept: pairs of 0
    assert audit_rows(awkward.limit(0), 1, 3) == []


def test_terms_that_span_batches():
    """A term's rows are added up however batches cut them, and whatever the order of columns."""
    rows = [(h, "en", f"s{k}", f"t{h}", 1, 1 + h % 2) for h in range(40) for k in range(1 + h % 7)]
    names = ["lang", "source", "term", "n", "docs", "hash"]
    table = pa.table({c: [dict(zip(["hash", *names[:-1]], r, strict=True))[c] for r in rows] for c in names})
    for size in (1, 5, 1000):
        kept = divergence._keep(4, divergence.Sizes(shard_rows=6))(table.to_batches(max_chunksize=size))
        got = sorted((r["hash"], r["source"], r["n"], r["first"]) for b in kept for r in b.to_pylist())
        assert got == sorted((h, s, n, int(s == "s0")) for h, _, s, _, n, _ in rows if (1 + h % 7) * (1 + h % 2) >= 4)


def test_audit_in_small_shards(spark):
    """Shards, portions and blocks of sources of the least size give the same rows; ties go by the item's bytes."""
    sizes = divergence.Sizes(text_bytes=200, shard_rows=7, pair_rows=9, sources_at_once=2)
    rng = random.Random(3)
    words = ["the", "of", "Zeta", "zeta", "é", "É", "naïve", "中文", "x1y", "don't"] + [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"]
    rows = [(k, " ".join(rng.choice(words[: 6 + k % 40]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), f"s{rng.randint(0, 6)}", 0) for k in range(400)]
    for partitions in (1, 6):
        assert audit_rows(spark.createDataFrame(rows, SCHEMA).repartition(partitions), 12, 5, sizes) == brute_audit(rows, 12, 5)
