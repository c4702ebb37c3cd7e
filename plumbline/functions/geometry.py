"""Plane geometry over arrays of points, and drawing scales, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules
from .numeric import bound

POINTS_PER_INCH = 72


def _pairs(points: Column, closed: bool) -> tuple[Column, Column]:
    """Each point and the one after it; closed: the first follows the last."""
    n = F.size(points)
    following = F.slice(points, 2, F.greatest(n - 1, F.lit(0)))
    if closed:
        return points, F.concat(following, F.slice(points, 1, 1))
    return F.slice(points, 1, F.greatest(n - 1, F.lit(0))), following


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def polyline_length(points: Column, closed: bool = False) -> Column:
    """Length along points (array of x, y structs); 0 for fewer than two."""
    a, b = _pairs(points, closed)
    return F.when(F.size(points) < 2, 0.0).otherwise(_sum(F.zip_with(a, b, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))))


def shoelace_area(points: Column) -> Column:
    """The area inside a ring, closed if it isn't; 0 for fewer than three points."""
    a, b = _pairs(points, True)
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(_sum(F.zip_with(a, b, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))) / 2)


def measured_quantity(kind: Column, points: Column, feet_per_inch: Column, height: Column | None = None, count: Column | None = None, closed: Column | None = None) -> Column:
    """A measurement's quantity: count, length, area or wall_area; without a scale only counts have one."""
    feet = feet_per_inch / POINTS_PER_INCH
    run = polyline_length(points)
    if closed is not None:
        run = F.when(F.coalesce(closed, F.lit(False)), polyline_length(points, True)).otherwise(run)
    counted = F.coalesce(count, F.size(points)) if count is not None else F.size(points)
    tall = height if height is not None else F.lit(None).cast("double")
    scaled = F.when(kind == "length", run * feet).when(kind == "area", shoelace_area(points) * feet * feet).when(kind == "wall_area", run * feet * tall)
    return F.when(kind == "count", counted.cast("double")).when(feet_per_inch > 0, F.bround(scaled, 2))


def calibrated(distance_points: Column, real_feet: Column) -> Column:
    """Feet an inch of paper stands for, from two points of known distance."""
    return F.when((distance_points > 0) & (real_feet > 0), F.bround(real_feet / distance_points * POINTS_PER_INCH, 4))


def rescaled(raw: Column, feet_per_inch: Column, power: int) -> Column:
    """A raw length (power 1) or area (power 2) in points at a scale; null without one."""
    return F.when(feet_per_inch > 0, F.bround(raw * F.pow(feet_per_inch / POINTS_PER_INCH, F.lit(power)), 1))


def snapped(feet_per_inch: Column, ladder: Sequence[float] = rules.SCALE_LADDER, tolerance: float = rules.SCALE_TOLERANCE) -> Column:
    """The nearest usual scale within a relative tolerance, else null."""
    steps = F.array(*map(F.lit, ladder))
    nearest = lambda feet: F.array_min(F.transform(steps, lambda c: F.struct((F.abs(feet - c) / c).alias("off"), c.alias("scale"))))
    return bound(feet_per_inch, lambda feet: bound(nearest(feet), lambda n: F.when(n["off"] <= tolerance, n["scale"])))


def _length(text: Column, mark: str) -> Column:
    """Feet or inches: a whole, a fraction or both, before a mark."""
    whole = F.regexp_extract(text, rf"^\s*(\d+(?:\.\d+)?)(?:\s*[-\s]\s*\d+/\d+)?\s*{mark}", 1).try_cast("double")
    up = F.regexp_extract(text, r"(\d+)/(\d+)", 1).try_cast("double")
    down = F.regexp_extract(text, r"(\d+)/(\d+)", 2).try_cast("double")
    only_fraction = text.rlike(rf"^\s*\d+/\d+\s*{mark}")
    return F.when(only_fraction, up / down).otherwise(whole + F.coalesce(up / down, F.lit(0.0)))


def parse_scale(text: Column) -> Column:
    """Feet per paper inch of ``1/4" = 1'-0"``, ``1" = 20'`` or ``1:100``; null for none or not to scale."""
    t = F.upper(F.trim(text))
    sides = F.split(t, r"\s*=\s*")
    paper, real = _length(sides[0], '["″]'), sides[1]
    feet = F.regexp_extract(real, r"(\d+(?:\.\d+)?)\s*['′]", 1).try_cast("double")
    inches = F.coalesce(F.regexp_extract(real, r"['′]\s*-?\s*(\d+(?:\.\d+)?)\s*[\"″]", 1).try_cast("double"), F.lit(0.0))
    ratio = F.regexp_extract(t, r"^1\s*:\s*(\d+(?:\.\d+)?)$", 1).try_cast("double")
    return F.when(t.rlike(r"N\.?T\.?S|NOT TO SCALE"), F.lit(None).cast("double")).when((F.size(sides) == 2) & (paper > 0), (feet + inches / 12) / paper).when(ratio.isNotNull(), ratio / 12)
