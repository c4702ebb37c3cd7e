"""Printed tables and title blocks: take-off rows, door schedules and their columns, sheet names.

Cells come as rows (keys, row_ord, cells array<string>); columns are compared by counting over all rows of a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import parse_numeric
from ..functions.text import first_match
from ..plans import rules
from .match import first_rows


def _header(cell: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(cell, F.lit(""))), "[^a-z0-9]+", "")


def column_roles(cells: Column) -> Column:
    """Which columns of a header row hold quantity, item and unit: the first of each, by their names; -1 for none."""
    names = F.transform(cells, _header)
    at = lambda listed: F.coalesce(F.array_min(F.transform(names, lambda c, i: F.when(c.isin(*listed), i))), F.lit(-1))
    return F.struct(*(at(words).alias(role) for role, words in rules.TABLE_HEADERS.items()))


def table_items(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Take-off rows of tables with a quantity column: its header is the first of their first three rows that names one.

    An item needs a name with a letter and a plain positive number; its unit is EA where none is printed.
    """
    rows = cells.withColumn("_role", column_roles(F.col("cells")))
    header = first_rows(rows.where((F.col("row_ord") < 3) & (F.col("_role.qty") >= 0)), keys, ["row_ord"]).select(*keys, "_role", (F.col("row_ord") == 0).cast("int").alias("_from"))
    rows = cells.join(header, list(keys)).where("row_ord >= _from")
    cell = lambda i: F.trim(F.coalesce(F.get("cells", i), F.lit("")))
    item, printed = cell(F.greatest(F.col("_role.item"), F.lit(0))), cell(F.col("_role.qty"))
    unit = F.coalesce(F.nullif(F.upper(F.when(F.col("_role.unit") >= 0, cell(F.col("_role.unit"))).otherwise("")), F.lit("")), F.lit("EA"))
    out = rows.select(*keys, "row_ord", item.alias("item"), printed.alias("printed"), unit.alias("unit")).withColumn("quantity", parse_numeric(F.col("printed")))
    return out.where((F.col("quantity") > 0) & F.col("item").rlike("[A-Za-z]") & F.col("printed").rlike(r"^[\d,]+(\.\d+)?$")).select(*keys, "row_ord", "item", "quantity", "unit")


def tags(cell: Column) -> Column:
    """The door tags of a cell, which may hold several."""
    return F.filter(F.split(F.trim(F.coalesce(cell, F.lit(""))), r"\s+"), lambda t: t.rlike(rules.DOOR_TAG))


def door_columns(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each door table's tag, panel and frame columns, for tables that are door schedules.

    The tag column is among the first four the one with most tag rows, three at least.  Panels and frames are
    where words stand that only they have, else the first and the last column with materials.  Three rows and 40
    percent of all must show a material: door marks on a plan show none.
    """
    own = Window.partitionBy(*keys)
    flat = cells.select(*keys, "row_ord", F.posexplode("cells").alias("col", "cell"))
    counts = flat.where("col < 4").groupBy(*keys, "col").agg(F.count_if(F.size(tags(F.col("cell"))) > 0).alias("hits"))
    tag = first_rows(counts.where("hits >= 3"), keys, [F.desc("hits"), "col"]).select(*keys, F.col("col").alias("tag_col"))
    rows = cells.join(tag, list(keys)).where(F.size(tags(F.get("cells", F.col("tag_col")))) > 0)
    words = rows.select(*keys, "tag_col", "row_ord", F.posexplode("cells").alias("col", "cell")).where("col != tag_col")
    words = words.select(*keys, "row_ord", "col", F.explode(F.split(F.upper(F.coalesce("cell", F.lit(""))), r"\s+")).alias("w"))
    listed = {"panel": rules.PANEL_MATERIALS, "frame": rules.FRAME_MATERIALS, "panel_only": rules.PANEL_ONLY, "frame_only": rules.FRAME_ONLY}
    score = words.groupBy(*keys, "col").agg(*(F.count_if(F.col("w").isin(*w)).alias(name) for name, w in listed.items()), F.min("row_ord").alias("seen"))
    # The commonest of a kind; of equals the first met, by row and column.
    met = {name: words.where(F.col("w").isin(*listed[name])).groupBy(*keys, "col").agg(F.count("*").alias("n"), F.min(F.struct("row_ord", "col")).alias("at")) for name in ("panel_only", "frame_only")}
    surely = {name: first_rows(df, keys, [F.desc("n"), "at"]).select(*keys, F.col("col").alias(f"_{name}")) for name, df in met.items()}
    bounds = score.withColumns({"_first": F.min(F.when(F.col("panel") > 0, F.col("col"))).over(own)}).join(surely["panel_only"], list(keys), "left")
    panel = F.coalesce("_panel_only", "_first")
    out = bounds.withColumn("panel_col", panel).groupBy(*keys).agg(
        F.max("panel_col").alias("panel_col"), F.max(F.when((F.col("frame") > 0) & ~F.col("col").eqNullSafe(F.col("panel_col")), F.col("col"))).alias("_last")
    )
    out = out.join(surely["frame_only"], list(keys), "left").select(*keys, "panel_col", F.coalesce("_frame_only", "_last").alias("frame_col"))
    held = lambda column, words: F.arrays_overlap(F.split(F.upper(F.coalesce(F.get("cells", F.col(column)), F.lit(""))), r"\s+"), F.array(*map(F.lit, words)))
    shown = rows.join(out, list(keys)).withColumn("shows", F.coalesce(held("panel_col", rules.PANEL_MATERIALS), F.lit(False)) | F.coalesce(held("frame_col", rules.FRAME_MATERIALS), F.lit(False)))
    covered = shown.groupBy(*keys, "tag_col", "panel_col", "frame_col").agg(F.count("*").alias("door_rows"), F.count_if("shows").alias("covered"))
    return covered.where("door_rows >= 3 AND covered >= 3 AND covered >= 0.4 * door_rows")


def deterministic_legends(doors: DataFrame, footprints: DataFrame, companions: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Legend rows that need no model: doors always, the footprint's only where no companion take-off states the areas.

    doors and footprints: keys, item, quantity, unit; companions: keys of projects that have one.
    """
    areas = footprints.join(companions.select(*keys).distinct(), list(keys), "left_anti")
    listed = lambda df, name: df.select(*keys, F.lit(name).alias("legend"), "item", "quantity", "unit")
    return listed(doors, "doors").unionByName(listed(areas, "footprint"))


def title_block(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The words in a page's lower right part, joined in their order; words: keys, ord, x0, y0, width, height, text.

    A page's title block is a few dozen words, so it is gathered.
    """
    inside = words.where((F.col("y0") > F.col("height") * 0.80) & (F.col("x0") > F.col("width") * 0.55))
    gathered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return inside.groupBy(*keys).agg(F.array_join(F.transform(gathered, lambda w: w["text"]), " ").alias("title"))


def sheet_id(title: Column, text: Column, page: Column) -> Column:
    """A sheet's number out of its title block, else out of its whole text, else ``Page_n``.

    Forms are tried in order (A4.0, A-101, A101); what stands inside a standard's name or a fraction is none.
    """

    def of(source):
        said = F.coalesce(source, F.lit(""))
        noise = F.flatten(F.array(*(F.regexp_extract_all(said, F.lit(f"(?i){p}"), F.lit(0)) for p in rules.SHEET_ID_NOISE)))
        real = lambda form: F.get(F.filter(F.regexp_extract_all(said, F.lit(rf"\b({form})\b"), F.lit(1)), lambda c: ~F.exists(noise, lambda n: F.contains(n, c))), F.lit(0))
        return F.coalesce(*map(real, rules.SHEET_ID_FORMS))

    return F.coalesce(of(title), of(text), F.concat(F.lit("Page_"), page))


def material_name(code: Column, of: str) -> Column:
    """A door material's name: of ``panel`` or ``frame``; an unknown code stays."""
    return first_match(code, [(f"^{k}$", v) for k, v in rules.MATERIAL_LABELS[of].items()], code)
