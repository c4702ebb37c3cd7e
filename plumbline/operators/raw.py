"""What sheets say, as flat rows: raw items, specification tables, the sheet log, calculated rows, sheet images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import parse_scale
from ..plans import rules
from .match import first_rows


def first_filled(row: Column, keys: Sequence[str]) -> Column:
    """The first non-empty value among a row's columns (a map), else null."""
    return F.coalesce(*(F.nullif(row[k], F.lit("")) for k in keys))


def first_filled_key(row: Column, keys: Sequence[str]) -> Column:
    out = F
    for k in keys:
        out = out.when(F.coalesce(row[k], F.lit("")) != "", k)
    return out.otherwise(None)


def row_text(row: Column, between: str = " | ", pair: str = "{}={}", all_values: bool = False) -> Column:
    """A row's columns and values in their order; empty values only if all_values."""
    before, middle, after = pair.split("{}")
    entries = F.map_entries(row)
    held = entries if all_values else F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(held, lambda e: F.concat(F.lit(before), e["key"], F.lit(middle), F.coalesce(e["value"], F.lit("None")), F.lit(after))), between)


def _text(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


_SHEET = ("sheet", "sheet_ord", "sheet_type", "page_id")


def _branch(sheets: DataFrame, array: str, src: int, category: str, **columns: Column) -> DataFrame:
    rows = sheets.select(*_SHEET, F.posexplode(array).alias("elem_ord", "e")).where("e IS NOT NULL")
    return rows.select(F.lit(category).alias("category"), *_SHEET, F.lit(src).alias("src_ord"), "elem_ord", F.lit(0).alias("row_ord"), *(c.alias(k) for k, c in columns.items()))


def _schedule_rows(sheets: DataFrame, src: int) -> DataFrame:
    """One header row for each schedule, then one for each of its rows."""
    tables = sheets.select(*_SHEET, F.posexplode("schedules").alias("elem_ord", "s")).where("s IS NOT NULL")
    name = F.coalesce(F.nullif(F.col("s.name"), F.lit("")), F.nullif(F.col("s.type"), F.lit("")), F.lit("Unnamed Schedule"))
    kind = F.coalesce(F.nullif(F.col("s.schedule_type"), F.lit("")), F.nullif(F.col("s.type"), F.lit("")), F.lit("schedule"))

    def of_row(row):
        described = F.coalesce(first_filled(row, rules.RAW_ROW_KEYS["description"]), F.left(F.concat(F.lit("{"), row_text(row, ", ", "'{}': '{}'", True), F.lit("}")), F.lit(80)))
        key, tag = first_filled_key(row, rules.RAW_ROW_KEYS["value"]), first_filled(row, rules.RAW_ROW_KEYS["mark"])
        return F.struct(
            F.lit("schedule_row").alias("category"), F.concat(F.lit("["), name, F.lit("] "), described).alias("description"), _text(first_filled(row, rules.RAW_ROW_KEYS["value"])).alias("value"),
            _text(F.lower(key)).alias("unit"), _text(F.concat(F.lit("row "), tag)).alias("location_on_sheet"), row_text(row).alias("source_text"),
        )

    header = F.struct(
        F.lit("schedule_header").alias("category"), name.alias("description"), _text("s.header_info").alias("value"), kind.alias("unit"), F.lit("").alias("location_on_sheet"), _text("s.totals").alias("source_text"),
    )
    listed = F.filter(F.coalesce("s.rows", F.array().cast("array<map<string,string>>")), lambda r: r.isNotNull())
    rows = tables.select(*_SHEET, "elem_ord", F.posexplode(F.concat(F.array(header), F.transform(listed, of_row))).alias("row_ord", "r"))
    return rows.select("r.category", *_SHEET, F.lit(src).alias("src_ord"), "elem_ord", "row_ord", *(f"r.{c}" for c in ("description", "value", "unit", "location_on_sheet", "source_text")))


def raw_rows(sheets: DataFrame) -> DataFrame:
    """Everything that was read from the sheets, in rows of rules.RAW_COLUMNS with their order (sheet, source, element, row).

    A schedule gives a header row and one for each of its rows.  No array is gathered: each is
    exploded where its sheet lies.
    """
    branches = [
        _branch(sheets, "measurements", 0, "measurement", description=_text("e.description"), value=_text("e.value"), unit=_text("e.unit"), location_on_sheet=_text("e.location"), source_text=_text("e.raw_text")),
        _branch(sheets, "components", 1, "component", description=_text("e.name"), value=F.col("e.quantity"), unit=_text("e.unit"), location_on_sheet=_text("e.location"), source_text=_text("e.specification")),
        _branch(sheets, "rooms", 2, "room", description=_text("e.name"), value=_text("e.area"), unit=F.lit("sq_ft"), location_on_sheet=_text("e.dimensions"), source_text=_text("e.notes")),
        _branch(sheets, "materials", 3, "material", description=_text("e.type"), value=_text("e.quantity"), unit=_text("e.unit"), location_on_sheet=F.lit(""), source_text=_text("e.specification")),
        _schedule_rows(sheets, 4),
    ]
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out.select(*rules.RAW_COLUMNS, "sheet_ord", "src_ord", "elem_ord", "row_ord")


#: Columns of a calculated row and what stands there for null.
CALCULATED = {
    "item_type": "", "description": "", "raw_value": "", "raw_unit": "", "calculated_quantity": None, "calculated_unit": "", "waste_factor": 1.0, "formula_applied": "", "approximate": False,
    "estimation_table": "none", "confidence": None, "needs_review": False, "review_reason": "", "source_sheet": "", "source_location": "", "source_text": "", "specification": "", "qty_source": "",
}
_CALCULATED_FROM = {"calculated_quantity": "quantity", "calculated_unit": "unit", "waste_factor": "waste_factor_applied", "formula_applied": "formula", "estimation_table": "table_used", "source_sheet": "sheet", "source_text": "source_raw"}
_CALCULATED_TYPES = {"calculated_quantity": "double", "waste_factor": "double", "approximate": "boolean", "needs_review": "boolean"}


def calculated_rows(estimates: DataFrame) -> DataFrame:
    """Estimates under the report's column names, with its defaults; auto_verified is no column of a report."""
    out = []
    for name, default in CALCULATED.items():
        source = _CALCULATED_FROM.get(name, name)
        value = F.col(source) if source in estimates.columns else F.lit(None)
        value = value.cast(_CALCULATED_TYPES.get(name, "string"))
        out.append((F.coalesce(value, F.lit(default)) if default is not None else value).alias(name))
    return estimates.select(*out)


def specification_tables(sheets: DataFrame) -> DataFrame:
    """The schedules that are references for looking up, not for take-off."""
    tables = sheets.select(F.coalesce("sheet", F.lit("unknown")).alias("source_sheet"), "sheet_ord", F.posexplode("schedules").alias("table_ord", "s"))
    return tables.where("s.table_purpose = 'specification_reference'").select("source_sheet", "sheet_ord", "table_ord", "s.name", "s.lookup_key", "s.rows")


def sheet_log(sheets: DataFrame) -> DataFrame:
    """One line a sheet: how much was read from it, and its scale in feet an inch."""
    counts = [F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0)).alias(a) for a in ("measurements", "components", "rooms", "materials", "schedules")]
    return sheets.select("sheet", "page_id", F.col("sheet_type").alias("type"), "scale", parse_scale(F.col("scale")).alias("scale_feet_per_inch"), *counts, "sheet_ord")


def is_scale_bearing(name: Column, sheet_type: Column) -> Column:
    """Whether a sheet has a drawing scale to be verified: by its type, or by its name."""
    named = F.upper(F.coalesce(name, F.lit("")))
    by_name = F.exists(F.array(*map(F.lit, rules.SCALE_NAME_MARKERS)), lambda m: F.contains(named, m))
    return F.lower(F.trim(F.coalesce(sheet_type, F.lit("")))).isin(*rules.SCALE_SHEET_TYPES) | by_name


def sheet_assets(sheets: DataFrame) -> DataFrame:
    """Each usable sheet's image; of one name the last."""
    usable = ~F.coalesce("skipped", F.lit(False)) & ~F.coalesce("has_error", F.lit(False)) & (F.coalesce("sheet", F.lit("")) != "") & (F.coalesce("image", F.lit("")) != "")
    return first_rows(sheets.where(usable), ["sheet"], [F.desc("sheet_ord")]).select("sheet", "image", "page_id", F.coalesce("sheet_type", F.lit("")).alias("type"))
