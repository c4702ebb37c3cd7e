"""Near copies against brute force: large groups that one source connects, and every kind of edit just at the bound."""

import random

import pytest

from plumbline.llm import simhash

SCHEMA = "doc_id long, text string"


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return sorted(r[0] for r in simhash.without_near_copies(docs).select("doc_id").collect())


def words(rng, n, tag=""):
    return [f"{tag}w{rng.randrange(10**9)}" for _ in range(n)]


def grams(ws):
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_copies_that_only_their_source_connects(spark):
    """2000 copies with five words replaced: each is near the source, hardly any near another."""
    rng = random.Random(5)
    source = words(rng, 250)
    copies = []
    for k in range(2000):
        copy = list(source)
        for place in range(5):
            copy[place * 50 + rng.randrange(5, 45)] = f"new{k}x{place}"
        copies.append(copy)
    assert min(jaccard(source, c) for c in copies) >= 0.8
    assert sum(jaccard(a, b) >= 0.8 for a, b in zip(copies, copies[1:], strict=False)) == 0
    # The source comes last, and a text that shares only its first half stays.
    half = source[:125] + words(rng, 125)
    assert kept(spark, [" ".join(t) for t in (*copies, half, source)]) == [0, 2000]


@pytest.mark.parametrize("kind", ["cut", "extended", "block", "scattered"])
def test_pairs_just_at_the_bound(spark, kind):
    """Isolated pairs of 60 words at 0.8 to 0.85, and others just below."""
    rng = random.Random(kind)
    texts, want = [], []
    for k in range(300):
        a = words(rng, 60, f"{kind}{k}")
        edits = {"cut": 11, "extended": 13}.get(kind, 2) + k % 3
        b = list(a)
        if kind == "cut":
            b = b[: 60 - edits]
        elif kind == "extended":
            b += words(rng, edits)
        elif kind == "block":
            at = rng.randrange(10, 40)
            b[at : at + edits] = words(rng, edits)
        else:
            for at in rng.sample(range(60), edits - 1):
                b[at] = words(rng, 1)[0]
        want += [2 * k] if jaccard(a, b) >= 0.8 else [2 * k, 2 * k + 1]
        texts += [" ".join(a), " ".join(b)]
    assert 300 < len(want) < 600
    assert kept(spark, texts) == want


def test_a_family_of_common_passages(spark, monkeypatch):
    """Many texts that share a passage and little else, over many blocks: the same as all pairs."""
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 1 << 12)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 1 << 12)
    rng = random.Random(11)
    passage, texts = words(rng, 30, "p"), []
    for k in range(400):
        texts.append(passage + words(rng, rng.randrange(5, 60), f"t{k}"))
    for k in range(0, 400, 7):
        copy = list(texts[k])
        copy[-1] = f"other{k}"
        texts.append(copy)
    rng.shuffle(order := list(range(len(texts))))
    groups, sets = {}, [grams(texts[k]) for k in order]
    for at, a in enumerate(sets):
        for j, b in enumerate(sets[:at]):
            if len(a & b) >= 0.8 * len(a | b):
                groups.setdefault(at, set()).add(j)
    least = list(range(len(order)))
    moved = True
    while moved:
        moved = False
        for a, others in groups.items():
            for b in others:
                low = min(least[a], least[b])
                moved |= least[a] != low or least[b] != low
                least[a] = least[b] = low
    assert kept(spark, [" ".join(texts[k]) for k in order]) == sorted(set(least))


def test_fingerprints_give_candidates(spark):
    """Texts whose fingerprints op2 links are candidates of the stage; which of them are copies the sets decide."""
    rng = random.Random(3)
    texts = []
    for k in range(40):
        a = words(rng, 400, f"f{k}")
        texts += [" ".join(a), " ".join(a[:-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    nodes = docs.select("doc_id", simhash._text_hash().alias("node"), "text")
    of = {r["node"]: r["doc_id"] for r in nodes.collect()}
    pairs = {tuple(sorted((of[r["u"]], of[r["v"]]))) for r in simhash.fingerprint_pairs(nodes.select("node", "text"), 5).collect()}
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4}
    assert pairs == want and len(want) >= 30
    assert kept(spark, texts) == list(range(0, 80, 2))


def test_the_stage_reads_fingerprints(spark, monkeypatch):
    seen = []
    real = simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda *a: seen.append(a) or real(*a))
    assert kept(spark, ["a b c d e f", "a b c d e f", "x y"]) == [0, 2] and seen
