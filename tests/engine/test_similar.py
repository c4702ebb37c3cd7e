"""Most similar names against difflib over all pairs."""

import difflib
import random
import re

import numpy as np
from plumbline.operators import scoring, similar
from plumbline.plans import queries

WORDS = ["steel", "column", "wall", "CMU", "brick", "pipe", "door", "8in", "hm-frame", "duct", "slab", "joist", "é", "bollard", "gas", "12'", "roof", "curb"]


def names(n, seed):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for k in range(0, n, 3):  # a misspelt one
        at = rng.randrange(len(made[k]) + 1)
        made[k] = made[k][:at] + rng.choice("abcxyz ") + made[k][at + 1 :]
    return made + ["", "x" * 90, "x" * 80 + "y" * 9, "中文", "a", "steel"]


def brute(left, right, cutoff, query_second):
    out = set()
    for a in set(left):
        scored = [(difflib.SequenceMatcher(None, b, a).ratio() if query_second else difflib.SequenceMatcher(None, a, b).ratio(), b) for b in set(right)]
        best = max(s for s, _ in scored)
        out |= {(a, b, s) for s, b in scored if s == best and s >= cutoff}
    return out


def test_bounds():
    """Neither bound is below M; the subsequence is the true one."""
    left, right = names(60, 1), names(60, 2)
    (a, la), (b, lb) = similar._coded(left), similar._coded(right)
    shared = similar.shared_characters(a, b)
    for i, x in enumerate(left):
        i_rows = np.full(len(right), i)
        found = similar.common_subsequences(a[i_rows], la[i_rows], b) if len(x) <= similar.WORD else shared[i]
        for j, y in enumerate(right):
            m = sum(block.size for block in difflib.SequenceMatcher(None, x, y).get_matching_blocks())
            assert m <= found[j] <= shared[i, j]


def test_blocks_against_difflib():
    for cutoff in (0.4, 0.6, 0.7, 0.9):
        for second in (False, True):
            left, right = sorted(set(names(150, 3))), sorted(set(names(150, 4)))
            got = {(left[i], right[j], r) for i, j, r in similar.best_of_block(left, right, cutoff, second)}
            assert got == brute(left, right, cutoff, second)


def test_small_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 50)
    monkeypatch.setattr(similar, "MANY", 60)
    left = {p: names(n, p) for p, n in ((1, 10), (2, 120), (3, 12), (4, 8))}
    right = {p: names(n, 90 + p) for p, n in ((1, 10), (2, 130), (3, 160), (5, 9))}
    rows = lambda sides: [(p, x) for p, xs in sides.items() for x in xs] + [(None, "steel"), (1, None)]
    got = similar.most_similar(spark.createDataFrame(rows(left), "p int, a string"), spark.createDataFrame(rows(right), "p int, b string"), ["p"], 0.7)
    want = {(p, *r) for p in (1, 2, 3) for r in brute(left[p], right[p], 0.7, False)}
    assert {(r["p"], r["a"], r["b"], r["ratio"]) for r in got.collect()} == want
    assert got.count() == len(want)


def test_ten_thousand_names_of_one_project(spark):
    """Every best match of 10,000 x 10,000 names; a sample of them against difflib over all names."""
    rng = random.Random(8)
    letters = "etaoinshrdlu"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    right = list({f"{word()} {word()} {word()}" for _ in range(10_000)})
    left = [r[:-1] + "s" if k % 2 else f"{word()} {word()}" for k, r in enumerate(right)]
    got = similar.most_similar(spark.createDataFrame([(1, x) for x in left], "p int, a string").repartition(4), spark.createDataFrame([(1, x) for x in right], "p int, b string"), ["p"], 0.7)
    found = {}
    for r in got.collect():
        found.setdefault(r["a"], set()).add((r["b"], r["ratio"]))
    for a in left[::1000] + left[1::1000]:
        scored = []
        for b in right:
            matcher = difflib.SequenceMatcher(None, a, b)
            if matcher.real_quick_ratio() >= 0.7 and matcher.quick_ratio() >= 0.7:
                scored.append((matcher.ratio(), b))
        best = max((s for s, _ in scored), default=0)
        assert found.get(a, set()) == ({(b, s) for s, b in scored if s == best} if best >= 0.7 else set())


STOP = {"the", "a", "an", "of", "and", "to", "for", "in", "on", "alt", "h"}


def tokens(name):
    return {t for t in re.split(r"[-_/\s'\"]+", name.lower()) if t and t not in STOP and not t.isdigit()}


def test_token_matches_against_a_loop(spark):
    """The first row that contains or is contained, else the first of the best score."""
    golden, summary = names(80, 11), names(90, 12) + ["the Steel of column", "8 9", "columns steel"]
    got = scoring.token_matched(
        spark.createDataFrame([("p", x) for x in set(golden)], "p string, item_name string"),
        spark.createDataFrame([("p", x, float(k), k) for k, x in enumerate(summary)], "p string, item string, quantity double, ord int"), ["p"],
    )
    found = {r["item_name"]: (r["found"], r["found_quantity"]) for r in got.collect()}
    for g in set(golden):
        mine, best, score = tokens(g), None, 0.0
        for k, s in enumerate(summary):
            theirs = tokens(s)
            if not mine or not theirs:
                continue
            if mine <= theirs or theirs <= mine:
                best, score = (s, float(k)), 1.0
                break
            now = max(len(mine & theirs) / len(mine | theirs), difflib.SequenceMatcher(None, " ".join(sorted(mine)), " ".join(sorted(theirs))).ratio())
            if now > score:
                best, score = (s, float(k)), now
        assert found[g] == (best if score >= 0.6 else (None, None)), g


def test_golden_matches_against_close_matches(spark):
    golden, summary = sorted({x for x in names(60, 21) if x}), sorted({x for x in names(70, 22) if x})
    got = scoring.matched(spark.createDataFrame([("p", x) for x in golden], "p string, item_name string"), spark.createDataFrame([("p", x, 1.0, "EA") for x in summary], "p string, item string, quantity double, unit string"), ["p"])
    plain = lambda x: re.sub(r"[-_/]+", " ", x.lower()).strip()
    known = {plain(x) for x in summary}
    for r in got.collect():
        near = {r["item_name"].lower()} & {x.lower() for x in summary} or difflib.get_close_matches(plain(r["item_name"]), known, n=1, cutoff=0.7)
        assert (plain(r["found"]) if r["found"] else None) == (plain(next(iter(near))) if near else None)


def test_extra_rows(spark):
    golden = spark.createDataFrame([("p", "Steel Column")], "p string, item_name string")
    summary = spark.createDataFrame([("p", "steel column", 1.0, "EA"), ("p", "door", 2.0, "EA")], "p string, item string, quantity double, unit string")
    assert [r["item"] for r in scoring.extra_rows(summary, scoring.matched(golden, summary, ["p"]), ["p"]).collect()] == ["door"]


def test_both_sides_of_one_table(spark):
    """The registered query matches a table with a version of itself."""
    rows = queries.benchmark_matches(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["found"] for r in rows if len(r["item_name"]) % 4 in (0, 3))
