"""Nearest sites against all pairs: even, crowded, equal and constrained."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import pages, scales, spatial


def layout(kind, n, seed):
    rng = np.random.default_rng(seed)
    if kind == "even":
        return rng.uniform(0, 1000, (n, 2))
    if kind == "crowd":  # nearly all in one corner, one far away
        return np.vstack([rng.normal(5, 0.01, (n - 1, 2)), [[1e6, 1e6]]])
    if kind == "lattice":  # many equal distances
        return rng.integers(0, 12, (n, 2)).astype(float)
    return np.tile(rng.uniform(0, 10, (1, 2)), (n, 1))  # all at one place


@pytest.mark.parametrize("kind", ["even", "crowd", "lattice", "one place"])
def test_against_all_pairs(spark, kind):
    sites, points = layout(kind, 300, 1), np.vstack([layout(kind, 80, 2), layout("even", 40, 3)])
    site_rows = [(p, f"s{k}", float(x), float(y), k) for p, few in ((1, 300), (2, 5)) for k, (x, y) in enumerate(sites[:few])]
    point_rows = [(p, k, float(x), float(y)) for p in (1, 2, 3) for k, (x, y) in enumerate(points)]
    got = spatial.nearest(spark.createDataFrame(point_rows, "page int, point int, px double, py double"), spark.createDataFrame(site_rows, "page int, site string, x double, y double, ord int"), ["page"], few=8)
    found = {(r["page"], r["point"]): (r["site"], r["d2"]) for r in got.collect()}
    assert len(found) == 2 * len(points)  # page 3 has no site
    for p, few in ((1, 300), (2, 5)):
        for k, (x, y) in enumerate(points):
            d2 = (sites[:few, 0] - x) * (sites[:few, 0] - x) + (sites[:few, 1] - y) * (sites[:few, 1] - y)
            assert found[p, k] == (f"s{int(d2.argmin())}", d2.min())


def test_with_a_measure(spark):
    """Only sites of a fitting length count, also where none of the near ones has it."""
    rng = np.random.default_rng(4)
    sites = rng.uniform(0, 100, (400, 2))
    lengths = np.where(np.arange(400) % 50 == 0, 500.0, rng.uniform(21, 40, 400))
    asked = [(1, k, float(x), float(y), float(f)) for k, (x, y) in enumerate(rng.uniform(0, 100, (60, 2))) for f in [(9, 60, 300, 5000)[k % 4]]]
    points = spark.createDataFrame(asked, "page int, point int, px double, py double, feet double").withColumns({"low": F.col("feet") / 2, "high": F.col("feet") * 20})
    placed = spark.createDataFrame([(1, k, float(x), float(y), k, float(w)) for k, ((x, y), w) in enumerate(zip(sites, lengths, strict=True))], "page int, site int, x double, y double, ord int, w double")
    ratio = F.col("feet") / F.col("w")
    found = {r["point"]: r["site"] for r in spatial.nearest(points, placed, ["page"], (ratio > 0.05) & (ratio < 2.0), few=16).collect()}
    for _, k, x, y, feet in asked:
        fit = np.flatnonzero((feet / lengths > 0.05) & (feet / lengths < 2.0))
        d2 = ((sites[fit] - (x, y)) ** 2).sum(axis=1)
        assert found.get(k) == (int(fit[d2.argmin()]) if len(fit) else None)


def test_nulls_and_empty(spark):
    points = spark.createDataFrame([(1, 1, None, 2.0), (None, 2, 1.0, 1.0), (1, 3, float("nan"), 0.0), (1, 4, 0.0, 0.0)], "page int, point int, px double, py double")
    sites = spark.createDataFrame([(1, "a", None, 0.0, 0), (1, "b", 3.0, 4.0, 2), (1, "c", 3.0, 4.0, 1), (None, "d", 0.0, 0.0, 0)], "page int, site string, x double, y double, ord int")
    assert [tuple(r) for r in spatial.nearest(points, sites, ["page"]).collect()] == [(1, 4, "c", 25.0)]
    assert spatial.nearest(points, sites.limit(0), ["page"]).count() == 0
    assert spatial.nearest(points.limit(0), sites, ["page"], few=1).count() == 0


def test_a_page_without_all_pairs(spark):
    """100,000 segments and 10,000 callouts on one page: joins make a small multiple of the segments' number."""
    segments = spark.range(100_000).select(F.lit(1).alias("page"), F.col("id").alias("seg"), *((F.pmod(F.xxhash64(F.col("id") * 4 + k), F.lit(10_000)) / 10.0).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))
    anchors = spark.range(10_000).select(F.lit(1).alias("page"), F.col("id").alias("anchor"), *((F.pmod(F.xxhash64(F.col("id") * 4 + k, F.lit("a")), F.lit(10_000)) / 10.0).alias(c) for k, c in enumerate(("ax", "ay"))), F.col("id").alias("ord"))
    found = pages.nearest_anchor(segments, anchors, ["page"])
    assert found.count() == 100_000
    some = found.where("seg % 997 = 0").collect()
    at = {r["seg"]: r for r in segments.where("seg % 997 = 0").collect()}
    sites = np.array([(r["ax"], r["ay"]) for r in anchors.orderBy("ord").collect()])
    for r in some:
        s = at[r["seg"]]
        d2 = (sites[:, 0] - (s["x0"] + s["x1"]) / 2) ** 2 + (sites[:, 1] - (s["y0"] + s["y1"]) / 2) ** 2
        assert r["anchor"] == int(d2.argmin())


def test_dimensions_of_a_crowded_page(spark):
    """The scale from dimensions is the same by the grid as by all pairs."""
    rng = np.random.default_rng(9)
    lines = [(1, k, float(x), float(y), float(x + length), float(y)) for k, (x, y, length) in enumerate(zip(*rng.uniform(0, 2000, (2, 500)), rng.uniform(15, 400, 500), strict=True))]
    words = [(1, k, float(x), float(y), float(x), float(y), f"{8 + k % 70}'") for k, (x, y) in enumerate(rng.uniform(0, 2000, (90, 2)))]
    got = scales.dimension_scale(spark.createDataFrame(words, "page int, ord int, x0 double, y0 double, x1 double, y1 double, text string"), spark.createDataFrame(lines, "page int, seg int, x0 double, y0 double, x1 double, y1 double")).collect()
    length, mx, my = (np.array(v) for v in zip(*((x1 - x0, (x0 + x1) / 2, (y0 + y1) / 2) for _, _, x0, y0, x1, y1 in lines), strict=True))
    ratios = []
    for _, k, x, y, *_ in words:
        r = (8 + k % 70) / length
        fit = np.flatnonzero((r > 0.05) & (r < 2.0) & (length > 20))
        if len(fit):
            ratios.append(r[fit[((mx[fit] - x) ** 2 + (my[fit] - y) ** 2).argmin()]])
    assert got[0]["feet_per_inch"] == pytest.approx(np.median(ratios) * 72)
