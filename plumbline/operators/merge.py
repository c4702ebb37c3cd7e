"""One record a sheet out of its passes: components, schedules, rooms; recounts, failure reasons, images at hand.

A sheet's arrays are bounded by the sheet, so passes are joined by sheet and merged inside arrays,
without exploding and gathering them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import rules
from .match import first_rows, resolve_names


def _list(column: Column, like: str) -> Column:
    return F.coalesce(column, F.array().cast(like))


def _states_quantities(schedule: Column) -> Column:
    return F.coalesce(schedule["table_purpose"].isin(*rules.TAKEOFF_PURPOSES), F.lit(False))


def merged_schedules(combined: Column) -> Column:
    """A sheet's schedules of all passes: those with rows.

    If one of them is for take-off, the one of most rows (the first of equals) goes first and
    tables that only explain are dropped.
    """
    filled = F.filter(combined, lambda s: s.isNotNull() & (F.size(s["rows"]) > 0))
    placed = F.transform(filled, lambda s, i: F.struct((-F.size(s["rows"])).alias("fewer"), i.alias("i"), (_states_quantities(s) & F.coalesce(s["use_for_takeoff"], F.lit(True))).alias("legend")))
    first = F.array_min(F.filter(placed, lambda p: p["legend"]))["i"]
    explains = lambda s: F.coalesce(s["table_purpose"].isin(*rules.SECONDARY_PURPOSES), F.lit(False))
    rest = F.filter(filled, lambda s, i: (i != first) & ~explains(s))
    return F.when(first.isNull(), filled).otherwise(F.concat(F.slice(filled, first + 1, F.lit(1)), rest))


def merged_components(measured: Column, counted: Column) -> Column:
    """Measured components, the last of a name with the count's quantity where it has none and a count is sure; then counted names that were not measured, once each."""
    key = lambda c: F.lower(F.trim(c["name"]))
    named = F.filter(counted, lambda c: c.isNotNull() & (F.coalesce(c["name"], F.lit("")) != ""))
    sure = lambda k: F.get(F.filter(named, lambda c: (key(c) == k) & (c["confidence"] == "high") & c["quantity"].isNotNull()), F.lit(0))["quantity"]
    known, keys = F.transform(measured, key), F.transform(named, key)
    last = lambda i, k: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda other: other == k)
    upgraded = F.transform(measured, lambda c, i: F.when(c["quantity"].isNull() & last(i, key(c)), c.withField("quantity", sure(key(c)))).otherwise(c))
    fresh = F.filter(named, lambda c, i: ~F.array_contains(known, key(c)) & (F.array_position(keys, key(c)) == i + 1))
    return F.concat(upgraded, F.transform(fresh, lambda c: F.when(c["quantity"].isNull(), c.withField("quantity", sure(key(c)))).otherwise(c)))


def accurate_rooms(rooms: Column, schedules: Column) -> Column:
    """A sheet's rooms; where a take-off legend names slabs or walls, rooms that are only assumed to have some go."""
    filled = lambda s: s.isNotNull() & _states_quantities(s) & (F.size(s["rows"]) > 0)
    cells = F.flatten(F.flatten(F.transform(schedules, lambda s: F.transform(F.coalesce(s["rows"], F.array().cast("array<map<string,string>>")), F.map_values))))
    said = F.lower(F.array_join(F.array(F.array_join(cells, " ")), " "))
    slabs = F.exists(F.array(*map(F.lit, rules.SLAB_WORDS)), lambda w: F.contains(said, w))
    notes = lambda r: F.lower(F.concat_ws(" ", r["notes"], r["name"]))
    kept = F.filter(rooms, lambda r: notes(r).rlike(rules.KEPT_ROOMS) | ~notes(r).rlike(rules.OVERRULED_ROOMS))
    return F.when(F.exists(schedules, filled) & slabs, kept).otherwise(rooms)


def all_passes(measured: DataFrame, counted: DataFrame, scheduled: DataFrame, legends: DataFrame, key: str = "sheet") -> DataFrame:
    """The measure pass's sheets with what the other passes add to components, schedules and rooms.

    Each side has one row a sheet; a sheet that only another pass has is kept, too.
    """
    types = dict(measured.dtypes)
    out = measured
    for df, column, name in ((counted, "components", "_counted"), (scheduled, "schedules", "_scheduled"), (legends, "schedules", "_legends")):
        out = out.join(df.select(key, F.col(column).alias(name)), key, "full_outer")
    own = lambda c, like: _list(F.col(c), types[like])
    two = merged_schedules(F.concat(own("schedules", "schedules"), own("_scheduled", "schedules")))
    more = own("_legends", "schedules")
    merged = F.when(F.size(more) > 0, merged_schedules(F.concat(two, more))).otherwise(two)
    out = out.withColumns({"components": merged_components(own("components", "components"), own("_counted", "components")), "schedules": merged})
    return out.withColumn("rooms", accurate_rooms(own("rooms", "rooms"), F.col("schedules"))).select(*measured.columns)


def tiled_recount(components: DataFrame, tiles: DataFrame, entries: DataFrame, grid: str = "2x2") -> DataFrame:
    """Counted entries that a sheet's components don't supply, as the sum over its tiles: low confidence, whole numbers.

    components and tiles: sheet, name, unit, quantity; entries: entry, entry_unit, aliases, ord, measure.
    """
    wanted = entries.where(F.col("measure").isin("count", "each"))
    of_entry = lambda rows: rows.join(resolve_names(rows.select("name", "unit"), entries).select("name", "unit", "entry"), ["name", "unit"]).groupBy("sheet", "entry").agg(F.sum(F.coalesce(F.col("quantity").try_cast("double"), F.lit(0.0))).alias("n"))  # noqa: E731, E501
    have = of_entry(components).where("n > 0")
    found = of_entry(tiles).where("n > 0").join(have, ["sheet", "entry"], "left_anti").join(wanted.select("entry", "entry_unit"), "entry")
    return found.select(
        "sheet", F.col("entry").alias("name"), F.bround("n", 0).cast("string").alias("quantity"), F.coalesce(F.nullif("entry_unit", F.lit("")), F.lit("ea")).alias("unit"),
        F.lit("low").alias("confidence"), F.lit(f"tiled recount {grid}").alias("location"),
    )


def failure_reasons(pages: DataFrame, failures: DataFrame, keys: Sequence[str], default: str = "") -> DataFrame:
    """Each page with the first reason that was given for its failure; failures: keys, ord, reason."""
    first = first_rows(failures.where(F.col("reason").isNotNull()), keys, ["ord"]).select(*keys, "reason")
    return pages.join(first, list(keys), "left").withColumn("reason", F.coalesce("reason", F.lit(default)))


def images_at_hand(pages: DataFrame, files: DataFrame, keys: Sequence[str], least_bytes: int = 1000) -> DataFrame:
    """Pages with the newest image that is large enough to be one, null where it must be taken again; files: keys, file, bytes, modified."""
    newest = first_rows(files.where(F.col("bytes") > least_bytes), keys, [F.desc("modified"), "file"]).select(*keys, "file")
    return pages.join(newest, list(keys), "left")
