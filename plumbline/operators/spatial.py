"""Nearest sites by a grid that is refined where sites crowd.

A page with few sites is compared directly.  On any other, cells are cut four by four (and in four
by a further measure, such as a length) until they hold few sites, and each keeps the bounds of what
it holds.  Points go down level by level: a cell stays only while it may hold something nearer than
the farthest corner of a cell that surely holds something fit, so a point meets the few cells around
it however crowded or empty a page is, and the result is exact without a fallback over all pairs.
Every step is a join on (page, cell) or a ranking of one point's cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialised

#: Sites that a point is compared with directly: of a page, or of a cell that is cut no further.
FEW = 64
#: Levels at most; each has four times the cells of the one above on each axis.
DEPTH = 6
#: Room for the digits of a cell's place on one axis.
_BITS = 2 * DEPTH


def _sides(axis: str) -> tuple[Column, Column]:
    return F.col(f"_min_{axis}"), F.col(f"_max_{axis}")


def _bounds(prefix: str = "") -> list[Column]:
    return [f(f"{prefix}{axis}").alias(f"_{name}_{axis}") for axis in "xyw" for name, f in (("min", F.min), ("max", F.max))]


def _cell(level: Column) -> Column:
    """The cell of a site at a level: its place on each axis, cut to two binary digits a level."""
    code = F.lit(0).cast("long")
    for axis in "xyw":
        cut = F.call_function("shiftright", F.col(f"_i{axis}"), (2 * (DEPTH - level)).cast("int"))
        code = F.shiftleft(code, _BITS).bitwiseOR(cut)
    return code


def _parent(level: Column, cell: Column) -> Column:
    """The cell above: two binary digits less on each axis."""
    part = lambda n: F.shiftright(F.shiftright(cell, n * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)), 2)
    return F.when(level > 0, F.shiftleft(part(2), 2 * _BITS).bitwiseOR(F.shiftleft(part(1), _BITS)).bitwiseOR(part(0)))


def grid(sites: DataFrame, keys: Sequence[str], few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Cells (keys, _level, _cell, _parent, _leaf, bounds) and sites with the leaf that holds each; both stored.

    sites: keys, x, y, w and anything else.
    """
    on = list(keys)
    whole = sites.groupBy(*keys).agg(*_bounds())
    for axis in "xyw":
        low, high = _sides(axis)
        width = F.nullif(high - low, F.lit(0.0)) / (1 << _BITS)
        place = F.floor((F.col(axis) - low) / width).cast("long")
        sites = sites if axis != "x" else sites.join(whole, on)
        sites = sites.withColumn(f"_i{axis}", F.coalesce(F.greatest(F.least(place, F.lit((1 << _BITS) - 1)), F.lit(0)), F.lit(0).cast("long")))
    sites = sites.drop(*(f"_{name}_{axis}" for axis in "xyw" for name in ("min", "max")))
    placed = sites.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))).withColumn("_cell", _cell(F.col("_level")))
    cells = placed.groupBy(*keys, "_level", "_cell").agg(F.count("*").alias("_n"), *_bounds())
    cells = cells.withColumn("_parent", _parent(F.col("_level"), F.col("_cell")))
    of_parent = F.sum("_n").over(Window.partitionBy(*keys, "_level", "_parent"))  # at most 64 cells
    cells = cells.withColumn("_above", of_parent).where((F.col("_level") == 0) | (F.col("_above") > few))
    cells = materialised(cells.withColumn("_leaf", (F.col("_n") <= few) | (F.col("_level") == DEPTH)).drop("_n", "_above"), "grid-cells")
    leaves = cells.where("_leaf").select(*keys, "_level", "_cell")
    held = placed.drop("_ix", "_iy", "_iw").join(leaves, [*keys, "_level", "_cell"])
    return cells, materialised(held, "grid-sites")


def _off(axis: str, at: Column, far: bool) -> Column:
    """Squared distance on one axis to the nearest or the farthest place of a cell."""
    low, high = _sides(axis)
    d = F.greatest(at - low, high - at) if far else F.greatest(low - at, at - high, F.lit(0.0))
    return d * d


def nearest(points: DataFrame, sites: DataFrame, keys: Sequence[str], fits: Column | None = None, few: int = FEW) -> DataFrame:
    """keys, point, site and d2 of each point's nearest site on its page; of equally near ones the least `ord`.

    points: keys, point, px, py, and with fits also low and high; sites: keys, site, x, y, ord, and
    with fits also w.  fits is the exact condition on a pair of columns of both, which must imply
    low < w < high and hold wherever w is between them by more than rounding.  A point without any
    fitting site on its page has no row; null coordinates are nowhere.
    """
    on = list(keys)
    if fits is None:
        points, sites, fits = points.withColumns({"low": F.lit(-1.0), "high": F.lit(1.0)}), sites.withColumn("w", F.lit(0.0)), F.lit(True)
    points = points.where("px IS NOT NULL AND py IS NOT NULL AND NOT isnan(px) AND NOT isnan(py)")
    sites = sites.where("x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    best = lambda pairs: pairs.where(fits).withColumn("d2", d2).groupBy(*keys, "point").agg(F.min_by(F.struct("site", "d2"), F.struct("d2", "ord")).alias("_best")).select(*keys, "point", "_best.*")

    crowds = sites.groupBy(*keys).agg(F.count("*").alias("_n"))
    crowded = crowds.where(F.col("_n") > few).drop("_n")
    if crowded.isEmpty():
        return best(points.join(sites, on))
    crowded = materialised(crowded, "crowded-pages")
    calm = points.join(crowded, on, "left_anti").join(sites.join(crowded, on, "left_anti"), on)

    # Of sites at one place the first in order is the only one that can be nearest.
    alone = sites.join(crowded, on, "left_semi").groupBy(*keys, "x", "y", "w").agg(F.min_by(F.struct(*(c for c in sites.columns if c not in (*on, "x", "y", "w"))), "ord").alias("_first")).select(*keys, "x", "y", "w", "_first.*")
    cells, held = grid(alone, keys, few)
    deepest = cells.agg(F.max("_level")).first()[0] or 0
    bounds = [f"_{name}_{axis}" for axis in "xyw" for name in ("min", "max")]
    cells = cells.select(*keys, "_level", "_cell", "_parent", *bounds)
    asked = points.join(crowded, on, "left_semi")
    front = asked.join(cells.where("_level = 0").drop("_parent"), on)
    of_point = Window.partitionBy(*keys, "point")
    for level in range(1, deepest + 1):
        below = cells.where(F.col("_level") == level).select(*keys, F.col("_parent").alias("_cell"), F.lit(level - 1).alias("_level"), F.struct("_level", "_cell", *bounds).alias("_below"))
        # A leaf of an upper level has nothing below it, and stays.
        front = front.join(below, [*keys, "_level", "_cell"], "left")
        front = front.select(*(c for c in asked.columns), *(F.coalesce(F.col(f"_below.{c}"), F.col(c)).alias(c) for c in ("_level", "_cell", *bounds)))
        slack = F.lit(1e-9) * (F.abs("low") + F.abs("high"))
        sure = (F.col("_min_w") > F.col("low") + slack) & (F.col("_max_w") < F.col("high") - slack)
        may = (F.col("_max_w") >= F.col("low") - slack) & (F.col("_min_w") <= F.col("high") + slack)
        reach = F.min(F.when(sure, _off("x", F.col("px"), True) + _off("y", F.col("py"), True))).over(of_point)
        least = _off("x", F.col("px"), False) + _off("y", F.col("py"), False)
        # Rounding must never cut a cell off that holds the nearest site.
        front = front.where(may).withColumns({"_reach": reach, "_least": least}).where(F.col("_reach").isNull() | (F.col("_least") <= F.col("_reach") * (1 + 1e-9))).drop("_reach", "_least")
    near = front.drop(*bounds).join(held, [*keys, "_level", "_cell"])
    return best(calm.unionByName(near.select(*calm.columns)))
