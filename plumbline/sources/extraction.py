"""Recorded sheet extractions: JSON text to typed rows.

An array whose elements aren't all objects keeps those that are.  A text that is no JSON object gives a
row with has_error.  Row maps keep their column names as data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import bound

#: The typed part of each array's elements.
ARRAYS = {
    "measurements": "description string, value string, unit string, approximate boolean, location string, raw_text string",
    "components": "name string, quantity string, unit string, specification string, location string, confidence string",
    "rooms": "name string, area string, dimensions string, notes string, material_notes string, ceiling string",
    "materials": "type string, quantity string, unit string, specification string",
    "schedules": "name string, table_purpose string, use_for_takeoff boolean, lookup_key string, rows array<map<string,string>>, type string, schedule_type string, header_info string, totals string",
    "pipe_runs": "length_lf double, diameter_in double, material string, raw_text string, slope_pct double",
    "civil_structures": "type string, quantity double, id string, specification string",
    "lintel_runs": "mark string, size string, individual_length_ft double, count double, total_lf double, location string, raw_text string",
    "cross_references": "ref_number string, ref_sheet string, item_described string, context string",
}
SCALARS = {"sheet": "string", "sheet_ord": "int", "sheet_type": "string", "project": "string", "scale": "string", "skipped": "boolean", "page_id": "string", "image": "string"}


def _objects(raw: Column, schema: str) -> Column:
    """Typed elements of an array of JSON texts; whatever is no object goes."""
    objects = F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda e: F.startswith(F.ltrim(e), F.lit("{")))
    return F.transform(objects, lambda e: F.from_json(e, schema))


#: What stands between brackets and commas: a whole string, an escaped character, or any other.
_BETWEEN = r'(?:[^{}\[\],"\\]++|\\.|"(?:[^"\\]++|\\.)*+")*+'
#: A text up to its last closing bracket or comma.  Every loop is possessive, so none recurses, however long the text is.
_WHOLE = rf"(?s)\A(?:(?:{_BETWEEN}[{{\[])*+{_BETWEEN}[}}\],])*+"
#: All but brackets.
_NO_BRACKETS = r'(?s)(?:[^{}\[\]"\\]++|\\.|"(?:[^"\\]++|\\.)*+")++'
#: How deep the pairs of brackets are that patterns take out; what is nested deeper is walked through.
_NESTED = 4


def repaired(text: Column) -> Column:
    """A JSON text that breaks off, cut after its last whole value and closed: whole elements and fields stay.

    One pattern finds the cut; brackets that are closed before it go, and those left are closed from the last to the first.
    """
    cut = F.regexp_replace(F.regexp_extract(text, _WHOLE, 0), r",\z", "")

    def closing(whole):
        open_ = F.regexp_replace(whole, _NO_BRACKETS, "")
        for _ in range(_NESTED):
            open_ = F.regexp_replace(open_, r"[{\[][}\]]", "")
        closer = lambda c: F.translate(c, "{[", "}]")
        return F.aggregate(F.filter(F.split(open_, ""), lambda c: c != ""), F.lit(""), lambda ends, c: F.when(c.isin("{", "["), F.concat(closer(c), ends)).otherwise(F.substring(ends, 2, 1 << 20)))

    return bound(cut, lambda whole: F.concat(whole, closing(whole)))


def parsed(rows: DataFrame, column: str = "value", keep: Sequence[str] = (), repair: bool = True) -> DataFrame:
    """One row a text: scalars, typed arrays and has_error (an ``error`` key, whatever its value, or no JSON).

    A record that breaks off is repaired first, if asked; its whole elements count.
    """
    bare = F.regexp_replace(F.trim(column), r"^```(?:json)?\s*|\s*```$", "")
    loose = ", ".join([f"{k} {v}" for k, v in SCALARS.items()] + [f"{k} array<string>" for k in ARRAYS])
    out = rows.select(*keep, bare.alias("text"))
    if repair:
        broken = F.json_object_keys("text").isNull() & F.startswith("text", F.lit("{"))
        # Generated and not projected, so that no filter on what follows repairs the text a second time.
        out = out.select(*keep, F.explode(F.array(F.when(broken, repaired(F.col("text"))).otherwise(F.col("text")))).alias("text"))
    out = out.withColumn("j", F.from_json("text", loose)).withColumn("keys", F.json_object_keys("text"))
    error = F.col("keys").isNull() | F.array_contains("keys", "error")
    return out.select(*keep, *(F.col(f"j.{k}").alias(k) for k in SCALARS), *(_objects(F.col(f"j.{k}"), t).alias(k) for k, t in ARRAYS.items()), F.coalesce(error, F.lit(True)).alias("has_error"))


def cached(pages: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id) and what was recorded of them (page_id, value text): usable records, and the pages still to be analysed.

    A record that is no whole JSON object, or reports an error, is as good as none.
    """
    good = parsed_with(records, ["page_id"], repair=False).where("NOT has_error")
    known = pages.select(F.col("page_id").cast("string"))
    return good, known.join(good.select("page_id").distinct(), "page_id", "left_anti")


def parsed_with(rows: DataFrame, keep: list[str], column: str = "value", repair: bool = True) -> DataFrame:
    """`parsed`, with columns of the rows beside it, which overrule those of the text."""
    whole = parsed(rows.select(F.to_json(F.struct(*keep)).alias("_keep"), column), column, ["_keep"], repair)
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return whole.withColumn("_keep", F.from_json("_keep", types)).withColumns({k: F.col(f"_keep.{k}").cast("string") for k in keep}).drop("_keep")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every JSON file under a path, one sheet each."""
    return parsed(spark.read.text(path, wholetext=True))
