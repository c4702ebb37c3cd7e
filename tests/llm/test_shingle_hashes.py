"""Shingles hashed together have the xxhash library's hashes; the network's tables give what its filters give."""

import random

import numpy as np
import xxhash

from plumbline.llm import common, decontaminate, langid, shingle_hashes, simhash


def test_slices_against_the_library():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(2000))
    slices = [(rng.randrange(1600), n) for n in [*range(shingle_hashes.LONG + 3), 400, 0, 7, 32] for _ in range(3)]
    slices += [(2000 - n, n) for n in range(70)]  # up to the end
    starts, lengths = np.array(slices).T
    for seed in (0, 42, (1 << 64) - 1):
        want = [xxhash.xxh64_intdigest(data[at : at + n], seed) for at, n in slices]
        assert shingle_hashes.slice_hashes(data, starts, lengths, seed).tolist() == want


def test_fingerprints_and_sets_of_many_texts_against_plain_loops():
    rng = random.Random(2)
    texts = [None, b"", b" \n\t", b"One", b"a  B\x0bc", " ".join("äöü" for _ in range(9)).encode(), b"x" * 999 + b" y", b"w " * 700]
    texts += [" ".join(rng.choice(["Alpha", "beta", "g", "d" * 80]) for _ in range(rng.randrange(1400))).encode() for _ in range(40)]
    for size in (4, 5):
        sets, prints = simhash.hash_runs(texts, size)
        for text, grams, fp in zip(texts, sets, prints.tolist(), strict=True):
            words = (text or b"").lower().split()
            runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
            hashes = [xxhash.xxh64_intdigest(r, simhash.SEED) for r in runs]
            assert grams.tolist() == sorted(set(hashes))
            assert fp == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) == simhash.fingerprint(text, size)
    assert simhash.hash_runs([], 5)[0] == []


def test_the_stage_hashes_a_text_once_for_fingerprint_and_set(spark):
    """Profiles bear the fingerprints that candidates come from."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c d e f g", "", None, "x y"])], "node long, text string")
    got = {r["node"]: r["fp"] for r in simhash.profiles(rows, 5, 0.8).collect()}
    assert {k: v & (1 << 64) - 1 for k, v in got.items()} == {r["node"]: simhash.fingerprint(r["text"].encode() if r["text"] else None, 5) for r in rows.collect()}


def test_tables_give_the_filters_responses():
    rng = np.random.default_rng(4)
    net = langid.ByteConvNet(["a", "b", "c"])
    windows = rng.integers(0, 256, (150, langid.WINDOW)).astype(np.uint8)
    windows[3, 9:] = 0
    for _ in range(2):
        peak = net._pooled(net._patches(windows)).max(1)
        want = langid._softmax(np.maximum(peak + net.bias, 0) @ net.dense + net.out_bias)
        assert np.allclose(net.probabilities(windows), want, atol=1e-5)
        assert net.tables is not None and net.__getstate__()["tables"] is None
        net.train(windows, rng.integers(0, 3, 150), least_steps=3)  # the tables are made anew
        assert net.tables is None


def test_seeds_of_many_texts_at_once_are_those_of_each(monkeypatch):
    """Masks that reach into the next text, texts shorter than a mask, and rows longer than are hashed at once."""
    rng = random.Random(5)
    texts = [None, "", "one", "a b c", *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) for _ in range(60)), ""]
    used = list(range(len(decontaminate.PATTERNS)))
    each = [{(k, h) for k in used for h in decontaminate.seed_hashes(decontaminate.word_hashes(t), decontaminate.PATTERNS[k]).view(np.int64).tolist()} for t in texts]
    everything, some = np.full(1 << 17, 255, np.uint8), np.random.default_rng(6).integers(0, 256, 1 << 17).astype(np.uint8)
    for size in (7, 1 << 14):
        monkeypatch.setattr(decontaminate, "WORDS", size)
        for bits in (everything, some):
            want = [sorted(x for x in pairs if common.passes(bits, np.array([x[1]], np.int64))[0]) for pairs in each]
            got = decontaminate.found_seeds(texts, bits, used)
            assert [[(x["pattern"], x["hash"]) for x in got.get(k, [])] for k in range(len(texts))] == want
    assert decontaminate.found_seeds([None], everything, used) == {}
