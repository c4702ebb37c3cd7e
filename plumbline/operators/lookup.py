"""Specification tables, cross references, sheet catalogues and plan sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sheet_key
from .containment import first_holding
from .match import first_rows
from .similar import most_similar


def inch_key(text: Column) -> Column:
    """``8 in`` of the first whole number of inches in a text."""
    n = F.regexp_extract(F.lower(text), r"(\d+)\s*(?:inch|in|\")", 1)
    return F.when(n != "", F.concat(n, F.lit(" in")))


def spec_lookup(items: DataFrame, specs: DataFrame, key: str = "lookup_key") -> DataFrame:
    """Each item's specification by key: the first table that has it; within a table the last row of a key."""
    last = first_rows(specs.where(F.col(key).isNotNull()), ["table_name", key], [F.desc("row_ord")])
    first = first_rows(last, [key], ["table_ord"]).select(key, "table_name", "spec")
    return items.join(first, key, "left")


def cross_references(refs: DataFrame, sheets: DataFrame, details: DataFrame) -> DataFrame:
    """Each reference's target sheet within its project, and the detail found on it.

    refs: project, ref_id, ref_number, ref_sheet; sheets: project, sheet, label, sheet_ord;
    details: project, sheet, prio, ord, text (schedule values before component names before
    civil detail numbers).  The first sheet whose label holds the reference, in sheet order.
    """
    wanted = sheet_key(F.col("ref_sheet"))
    slashless = lambda c: F.replace(c, F.lit("/"), F.lit(""))
    forms = lambda text: F.array(F.struct(F.lit(0).alias("form"), text.alias("v")), F.struct(F.lit(1).alias("form"), slashless(text).alias("v")))
    needles = refs.where(wanted != "").select("project", "ref_id", "ref_number", F.inline(forms(wanted))).withColumnRenamed("v", "needle")
    labels = sheets.select("project", "sheet", "sheet_ord", F.inline(forms(sheet_key(F.col("label"))))).withColumnRenamed("v", "text")
    hits = first_holding(needles, labels, ["project", "form"], ["sheet_ord"]).select("project", "form", "needle", "sheet", "sheet_ord")
    target = first_rows(needles.join(hits, ["project", "form", "needle"]), ["project", "ref_id"], ["sheet_ord"]).select("project", "ref_id", "ref_number", "sheet")
    asked = target.withColumn("needle", F.lower("ref_number"))
    said = details.select("project", "sheet", "prio", "ord", F.col("text").alias("detail"), F.lower("text").alias("text"))
    detail = asked.join(first_holding(asked, said, ["project", "sheet"], ["prio", "ord"]), ["project", "sheet", "needle"]).select("project", "ref_id", "detail")
    out = refs.join(target.select("project", "ref_id", "sheet"), ["project", "ref_id"], "left").join(detail, ["project", "ref_id"], "left")
    status = F.when(F.col("sheet").isNull(), "target_sheet_not_found").when(F.col("detail").isNull(), "target_found_detail_missing").otherwise("resolved")
    return out.withColumn("status", status)


def unresolved_references(refs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct references by upper-cased label, the first seen kept; refs: ref, source_ord, ord."""
    rows = refs.withColumn("ref", F.upper(F.trim("ref"))).where("ref != ''")
    return first_rows(rows, [*keys, "ref"], ["source_ord", "ord"])


def reference_pages(refs: DataFrame, catalog: DataFrame, on: Sequence[str], limit: int | None = None) -> DataFrame:
    """Each reference's catalogue page: a name that equals it before `` - `` scores 3, containment 2; then the shorter and earlier name.

    on: columns that refs and catalog share.
    """
    plain = lambda c: F.translate(F.regexp_replace(F.upper(c), r"^\s+|\s+$", ""), "/.", "--")
    asked, known = refs.withColumn("_ref", plain("ref")).where("_ref != ''"), catalog.withColumn("_name", plain("sheet_name"))
    # Equal names are joined by value; only references that they leave are looked for within names.
    equal = asked.join(known.withColumn("_ref", F.substring_index("_name", " - ", 1)), [*on, "_ref"]).withColumn("score", F.lit(3))
    rest = asked.join(equal.select(*on, "_ref").distinct(), [*on, "_ref"], "left_anti")
    order = [F.length("sheet_name"), "page_id"]
    held = first_holding(rest.withColumn("needle", F.col("_ref")), known.withColumn("text", F.col("_name")), on, order).withColumnRenamed("needle", "_ref").drop("text")
    held = rest.join(held, [*on, "_ref"]).withColumn("score", F.lit(2))
    scored = equal.unionByName(held.select(*equal.columns)).drop("_ref", "_name")
    best = first_rows(scored, [*on, "ref"], [F.desc("score"), F.length("sheet_name"), "page_id"])
    return best if limit is None else first_rows(best, list(on), ["ref"], limit)


def near_references(refs: DataFrame, catalog: DataFrame, on: Sequence[str], n: int = 3, cutoff: float = 0.4) -> DataFrame:
    """on, ref, near, ratio, place: for references that no name holds the n most similar names, as suggestions."""
    plain = lambda c: F.translate(F.regexp_replace(F.upper(c), r"^\s+|\s+$", ""), "/.", "--")
    found = reference_pages(refs, catalog, on).select(*on, "ref").distinct()
    lost = refs.join(found, [*on, "ref"], "left_anti").withColumn("a", plain("ref")).where("a != ''")
    near = most_similar(lost, catalog.withColumn("b", plain("sheet_name")), on, cutoff, query_second=True, n=n)
    place = F.row_number().over(Window.partitionBy(*on, "a").orderBy(F.desc("ratio"), F.desc("b")))  # n rows
    return lost.select(*on, "ref", "a").distinct().join(near.withColumn("place", place), [*on, "a"]).select(*on, "ref", F.col("b").alias("near"), "ratio", "place")


def linked_sheets(refs: DataFrame, catalog: DataFrame, in_run: DataFrame, on: Sequence[str], most: int = 10, include: bool = True) -> DataFrame:
    """on, page_id, sheet_name, ref_from, place, suggested_only: pages that a run's references lead to and that aren't part of it.

    refs: on, ref, from_sheet, source_ord, ord; in_run: on, page_id.  A page counts by the first
    reference that leads to it, in the order of references; at most so many pages, as a report lists
    them.  Without include they are only suggested.
    """
    distinct = unresolved_references(refs, on)
    pages = reference_pages(distinct, catalog, on).select(*on, "page_id", "sheet_name", F.col("from_sheet").alias("ref_from"), "source_ord", "ord")
    fresh = pages.join(in_run.select(*on, "page_id").distinct(), [*on, "page_id"], "left_anti")
    once = first_rows(fresh, [*on, "page_id"], ["source_ord", "ord"])
    place = F.row_number().over(Window.partitionBy(*on).orderBy("source_ord", "ord", "page_id"))
    ranked = once.withColumn("place", place).where(F.col("place") <= most)
    return ranked.select(*on, "page_id", "sheet_name", "ref_from", "place", F.lit(not include).alias("suggested_only"))


def normalised_plan_sets(sets: DataFrame, system: Sequence[str], key: str = "project") -> DataFrame:
    """Plan sets without system folders, without names of two versions, and without ``Plans X`` beside an equal X.

    sets: key, folder_id, name, sheet_count.
    """
    low = F.lower(F.trim("name"))
    rows = sets.where(~low.isin(*system) & ~low.rlike(r"^plans\s*>") & ~(low.rlike(r"\bv1\b") & low.rlike(r"\bv2\b")))
    child = F.regexp_extract(low, r"^plans\s+(.+)$", 1)
    others = rows.select(F.col(key).alias("_k"), F.lower(F.trim("name")).alias("_child"), F.col("sheet_count").alias("_n"), F.col("folder_id").alias("_id"))
    same = (F.col(key) == F.col("_k")) & (child == F.col("_child")) & F.col("sheet_count").eqNullSafe(F.col("_n")) & (F.col("folder_id") != F.col("_id"))
    return rows.join(others, same, "left_anti")


def replaced_partitions(base: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with every key group that fresh holds replaced by fresh's rows: a catalogue upsert."""
    return base.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)
