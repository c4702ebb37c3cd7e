"""Scales, geometry and printed tables over the test tables: vectors give coordinates, parts give texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scales, tables
from .registry import query, table

_AT = "embedding[{0}]::DOUBLE"
_LINES_SQL = f"""d AS (SELECT vec_id, label AS page, CASE WHEN embedding[9] > 0.1 THEN 're' ELSE 'l' END AS kind, round({_AT.format(1)} * 1000, 3) AS x0, round({_AT.format(2)} * 1000, 3) AS y0, round({_AT.format(3)} * 1000, 3) AS x1, round({_AT.format(4)} * 1000, 3) AS y1 FROM embeddings),
s AS (SELECT page, vec_id * 4 AS seg, x0, y0, x1, y1 FROM d WHERE kind = 'l' UNION ALL SELECT page, vec_id * 4, x0, y0, x1, y0 FROM d WHERE kind = 're' UNION ALL SELECT page, vec_id * 4 + 1, x1, y0, x1, y1 FROM d WHERE kind = 're'
  UNION ALL SELECT page, vec_id * 4 + 2, x1, y1, x0, y1 FROM d WHERE kind = 're' UNION ALL SELECT page, vec_id * 4 + 3, x0, y1, x0, y0 FROM d WHERE kind = 're')"""


def _at(i: int):
    return F.round(F.get("embedding", F.lit(i - 1)).cast("double") * 1000, 3)


def _segments(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    kind = F.when(F.get("embedding", F.lit(8)) > F.lit(0.1).cast("float"), "re").otherwise("l")
    return scales.segments(vectors.select(F.col("label").alias("page"), F.col("vec_id").alias("ord"), kind.alias("kind"), _at(1).alias("x0"), _at(2).alias("y0"), _at(3).alias("x1"), _at(4).alias("y1")))


@query(f"WITH {_LINES_SQL.replace('> 0.1 ', '> 0.1::FLOAT ')} SELECT * FROM s")
def page_segments(spark, sf_dir):
    """S8"""
    return _segments(spark, sf_dir)


_EXTENT = "max(v) FILTER (i = least(floor(n * 99.5 / 100), n - 1)) - max(v) FILTER (i = least(floor(n * 0.5 / 100), n - 1))"


def _raw_sql(source: str, keys: str, least: str) -> str:
    axis = lambda a, name: f"{name} AS (SELECT {keys}, {_EXTENT} AS e FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM (SELECT {keys}, unnest([{a}0, {a}1]) AS v FROM {source})) GROUP BY {keys})"  # noqa: E731, E501
    return f"""{axis('x', 'w')}, {axis('y', 'h')}, sums AS (SELECT {keys}, count(*) AS n_segments, sum(len) AS total, coalesce(sum(len) FILTER (len >= {least}), 0) AS long FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM {source}) GROUP BY {keys})"""


@query(f"""
WITH {_LINES_SQL.replace('> 0.1 ', '> 0.1::FLOAT ')}, {_raw_sql('s', 'page', '36')}
SELECT page, n_segments, round(w.e * h.e, 3) AS footprint_pt2, round(total, 3) AS total_linework_pt, round(long, 3) AS long_run_pt, round(w.e, 3) AS width_pt, round(h.e, 3) AS height_pt FROM sums JOIN w USING (page) JOIN h USING (page)
""")
def raw_geometry(spark, sf_dir):
    """A12, F9"""
    return scales.raw_geometry(_segments(spark, sf_dir), ["page"])


_CALLOUTS = ((10, 10.0, -150.0, 20.0), (20, 40.0, 150.0, -30.0), (30, 10.0, 0.0, 200.0))


@query(f"""
WITH {_LINES_SQL.replace('> 0.1 ', '> 0.1::FLOAT ')}, c AS (SELECT * FROM (VALUES {", ".join(map(str, _CALLOUTS))}) AS v(anchor, fpi, x, y)),
p AS (SELECT s.*, anchor, fpi FROM s, c QUALIFY row_number() OVER (PARTITION BY page, seg ORDER BY (x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2), anchor) = 1),
{_raw_sql('p', 'page, anchor, fpi', '360 / fpi')},
m AS (SELECT page, anchor, CAST(fpi AS DOUBLE) AS feet_per_inch, n_segments, round_even(round(w.e * h.e, 3) * pow(fpi / 72, 2), 1) AS footprint_sf, round_even(round(total, 3) * (fpi / 72), 1) AS total_linework_lf, round_even(round(long, 3) * (fpi / 72), 1) AS long_run_lf
  FROM sums JOIN w USING (page, anchor, fpi) JOIN h USING (page, anchor, fpi))
SELECT *, row_number() OVER (PARTITION BY page ORDER BY footprint_sf DESC, total_linework_lf DESC, anchor) = 1 AS dominant, CAST(sum(n_segments) OVER (PARTITION BY page, feet_per_inch) / sum(n_segments) OVER (PARTITION BY page) AS DOUBLE) AS share FROM m
""")
def viewports(spark, sf_dir):
    """J19, A14, D19"""
    segs = _segments(spark, sf_dir)
    found = segs.select("page").distinct().join(F.broadcast(spark.createDataFrame(list(_CALLOUTS), "line int, feet_per_inch double, x double, y double")))
    return scales.viewports(segs, found).select("page", "anchor", "feet_per_inch", "n_segments", "footprint_sf", "total_linework_lf", "long_run_lf", "dominant", "share")


@query(f"""
WITH {_LINES_SQL.replace('> 0.1 ', '> 0.1::FLOAT ')}, dims AS (SELECT vec_id AS dim, label AS page, round({_AT.format(5)} * 1000, 3) AS cx, round({_AT.format(6)} * 1000, 3) AS cy, 8.0 + vec_id % 60 AS feet FROM embeddings WHERE embedding[10] > 0.1::FLOAT),
l AS (SELECT page, seg, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM s WHERE abs(x0 - x1) < 2 OR abs(y0 - y1) < 2),
r AS (SELECT page, dim, feet / len AS ratio FROM dims JOIN l USING (page) WHERE len > 20 AND feet / len > 0.05 AND feet / len < 2 QUALIFY row_number() OVER (PARTITION BY page, dim ORDER BY (mx - cx) * (mx - cx) + (my - cy) * (my - cy), seg) = 1)
SELECT page, round(median(ratio) * 72, 6) AS feet_per_inch FROM r GROUP BY page HAVING count(*) >= 3
""")
def dimension_scale(spark, sf_dir):
    """J20, A13"""
    vectors = table(spark, sf_dir, "embeddings").where(F.get("embedding", F.lit(9)) > F.lit(0.1).cast("float"))
    words = vectors.select(F.col("label").alias("page"), F.col("vec_id").alias("ord"), _at(5).alias("x0"), _at(6).alias("y0"), _at(5).alias("x1"), _at(6).alias("y1"), F.concat((8 + F.col("vec_id") % 60).cast("string"), F.lit("'")).alias("text"))
    return scales.dimension_scale(words, _segments(spark, sf_dir)).select("page", F.round("feet_per_inch", 6).alias("feet_per_inch"))


_SCALES = ("1/4\" = 1'-0\"", "1\" = 20'", "18\" = 1'-0\"", "316 = 1'-0\"", "1\" = 37'", "3 / 4 = 2'", "7 = 1'")


@query(r"""
WITH t AS (SELECT doc_id, CAST(doc_id % 7 AS INT) AS k, len(regexp_extract_all(coalesce(text, ''), '[0-9][^\n=]{0,12}=\s*[0-9]+\s*(''|ft|feet)')) AS others FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 20.0 WHEN 2 THEN 8.0 WHEN 3 THEN 5.333333 END AS first, 2.0::DOUBLE AS last, CASE WHEN others = 0 THEN CASE WHEN k < 4 THEN 2 ELSE 1 END END AS n FROM t
""")
def text_scales(spark, sf_dir):
    """a note of each kind before every whole text, and a second scale after it"""
    note = F.get(F.array(*map(F.lit, _SCALES)), (F.col("doc_id") % 7).cast("int"))
    text = F.coalesce("text", F.lit(""))
    found = scales.text_scales(F.concat(F.lit("SCALE "), note, F.lit("\nDETAIL "), text, F.lit("\n1/2\" = 1'-0\"")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", found.alias("found"))
    at = lambda i: F.round(F.element_at("found", i), 6)
    has_others = text.rlike(r"[0-9][^\n=]{0,12}=\s*[0-9]+\s*('|ft|feet)")
    return rows.select("doc_id", F.when(F.col("doc_id") % 7 < 4, at(1)).alias("first"), at(-1).alias("last"), F.when(~has_others, F.size("found")).alias("n"))


_DRAWN_SQL = f"""WITH {_LINES_SQL.replace('> 0.1 ', '> 0.1::FLOAT ')},
c AS (SELECT * FROM (VALUES {", ".join(map(str, _CALLOUTS))}) AS v(anchor, fpi, x, y)),
dims AS (SELECT vec_id AS dim, label AS page, round({_AT.format(5)} * 1000, 3) AS cx, round({_AT.format(6)} * 1000, 3) AS cy, 8.0 + vec_id % 60 AS feet FROM embeddings WHERE embedding[10] > 0.1::FLOAT),
l AS (SELECT page, seg, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM s WHERE abs(x0 - x1) < 2 OR abs(y0 - y1) < 2),
r AS (SELECT page, dim, feet / len AS ratio FROM dims JOIN l USING (page) WHERE len > 20 AND feet / len > 0.05 AND feet / len < 2 QUALIFY row_number() OVER (PARTITION BY page, dim ORDER BY (mx - cx) * (mx - cx) + (my - cy) * (my - cy), seg) = 1),
drawn AS (SELECT page, median(ratio) * 72 AS fpi FROM r GROUP BY page HAVING count(*) >= 3),
p AS (SELECT s.*, anchor, fpi FROM s, c WHERE page % 4 = 2 QUALIFY row_number() OVER (PARTITION BY page, seg ORDER BY (x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2), anchor) = 1),
pages AS (SELECT DISTINCT page FROM s), w1 AS (SELECT page, CASE page % 4 WHEN 0 THEN 30.0 WHEN 1 THEN 20.0 ELSE fpi END AS fpi, CASE page % 4 WHEN 0 THEN 'override' WHEN 1 THEN 'printed_scale' ELSE CASE WHEN fpi IS NULL THEN 'none' ELSE 'dimension_calibration' END END AS method FROM pages LEFT JOIN drawn USING (page) WHERE page % 4 <> 2),
whole AS (SELECT s.*, method, w1.fpi FROM s JOIN w1 USING (page))"""
_SIZES = "round_even(round(w.e * h.e, 3) * pow(fpi / 72, 2), 1) AS footprint_sf, round_even(round(total, 3) * (fpi / 72), 1) AS total_linework_lf, round_even(round(long, 3) * (fpi / 72), 1) AS long_run_lf"


def _sized(name: str, source: str, keys: str, least: str) -> str:
    """The sizes of groups of segments, under names of their own."""
    raw = _raw_sql(source, keys, least)
    for part in ("w", "h", "sums"):
        raw = raw.replace(f"{part} AS (SELECT {keys},", f"{name}_{part} AS (SELECT {keys},", 1)
    return f"{raw}, {name} AS (SELECT {keys}, n_segments, {_SIZES} FROM {name}_sums JOIN {name}_w AS w USING ({keys}) JOIN {name}_h AS h USING ({keys}))"


@query(f"""
{_DRAWN_SQL}, {_sized("parts", "p", "page, anchor, fpi", "360 / fpi")}, {_sized("wholes", "whole", "page, method, fpi", "coalesce(360 / fpi, 36)")},
best AS (SELECT page, 'printed_scale_viewport' AS method, fpi, footprint_sf, total_linework_lf, long_run_lf, sum(n_segments) OVER (PARTITION BY page, fpi) / sum(n_segments) OVER (PARTITION BY page) AS share FROM parts
  QUALIFY row_number() OVER (PARTITION BY page ORDER BY footprint_sf DESC, total_linework_lf DESC, anchor) = 1)
SELECT page, round(CAST(fpi AS DOUBLE), 6) AS feet_per_inch, method, CASE WHEN share >= 0.6 THEN 'high' ELSE 'medium' END AS confidence, footprint_sf, total_linework_lf, long_run_lf, share < 0.6 AS needs_review FROM best
UNION ALL SELECT page, round(CAST(fpi AS DOUBLE), 6), method, CASE method WHEN 'dimension_calibration' THEN 'low' WHEN 'none' THEN 'none' ELSE 'high' END, footprint_sf, total_linework_lf, long_run_lf, method NOT IN ('override', 'printed_scale') FROM wholes
""")
def measured_pages(spark, sf_dir):
    """Pages by a given scale, a printed note, several callouts, or the dimensions drawn on them"""
    segs = _segments(spark, sf_dir)
    page = F.col("page")
    of_pages = segs.select("page").distinct()
    found = of_pages.where("page % 4 = 2").join(F.broadcast(spark.createDataFrame(list(_CALLOUTS), "line int, feet_per_inch double, x double, y double")))
    sheets = of_pages.select("page", F.when(page % 4 == 0, 30.0).alias("override"), F.when(page % 4 == 1, "SCALE: 1\" = 20'").alias("scale_text"), F.lit("").alias("text"))
    vectors = table(spark, sf_dir, "embeddings").where(F.get("embedding", F.lit(9)) > F.lit(0.1).cast("float"))
    words = vectors.select(F.col("label").alias("page"), F.col("vec_id").alias("ord"), _at(5).alias("x0"), _at(6).alias("y0"), _at(5).alias("x1"), _at(6).alias("y1"), F.concat((8 + F.col("vec_id") % 60).cast("string"), F.lit("'")).alias("text"))
    return scales.measured_pages(sheets, segs, words, found).withColumn("feet_per_inch", F.round("feet_per_inch", 6))


@query("""
WITH t AS (SELECT p_partkey, p_size, p_brand FROM part)
SELECT p_partkey AS page, CASE p_size % 3 WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 20.0 ELSE 8.0 END AS feet_per_inch FROM t
""")
def char_callouts(spark, sf_dir):
    """Fractions with a slash, whole inches, and stacked fractions, character by character"""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), (F.col("p_size") % 3).alias("k"))
    line = F.when(F.col("k") == 0, "SCALE 1/4\" = 1'-0\"").when(F.col("k") == 1, "SCALE: 1\" = 20'").otherwise("SCALE 18\" = 1'-0\"")
    chars = rows.select("page", "k", F.lit(0).alias("line"), F.posexplode(F.split(line, "")).alias("ord", "c")).where("c != ''")
    # In a stacked fraction the 8 stands below the 1.
    y = F.when((F.col("k") == 2) & (F.col("c") == "8"), 14.0).otherwise(10.0)
    return scales.callouts(chars.select("page", "line", "ord", F.col("ord").cast("double").alias("x"), y.alias("y"), "c")).select("page", "feet_per_inch")


@query("""
SELECT 'S' || o_orderkey AS sheet, CASE WHEN o_orderkey % 2 = 0 THEN nullif(round_even(CAST(o_custkey AS DOUBLE) / 7, 4), 0) WHEN o_orderstatus = 'P' THEN 20.0 ELSE 4.0 END AS feet_per_inch,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'high' ELSE 'none' END ELSE 'medium' END AS scale_confidence, o_orderkey % 2 = 0 AND o_orderstatus = 'F' AND o_custkey > 0 AS auto_verified
FROM orders WHERE o_orderkey % 2 = 0 OR (o_orderkey % 3 <> 0 AND o_orderstatus <> 'O')
""")
def scale_calibration(spark, sf_dir):
    """P16"""
    return scales.calibration(_calibrated_sheets(spark, sf_dir)).select("sheet", "feet_per_inch", "scale_confidence", "auto_verified")


def _calibrated_sheets(spark, sf_dir):
    name, even = F.concat(F.lit("S"), "o_orderkey"), F.col("o_orderkey") % 2 == 0
    raw = F.struct(*(F.col("o_totalprice").alias(c) for c in ("footprint_pt2", "total_linework_pt", "long_run_pt", "width_pt", "height_pt")))
    geometry = F.struct((F.col("o_custkey") / 7).alias("feet_per_inch"), F.when(F.col("o_orderstatus") == "F", "high").alias("confidence"), F.lit("printed_scale").alias("method"), F.lit(False).alias("needs_review"), raw.alias("raw"))
    kind = F.when(F.col("o_orderstatus") == "F", "floor_plan").when(F.col("o_orderstatus") == "P", "civil_site").otherwise("detail")
    note = F.when(F.col("o_orderstatus") == "P", "1\" = 20'").otherwise("1/4\" = 1'-0\"")
    return table(spark, sf_dir, "orders").select(name.alias("sheet"), F.col("o_orderkey").alias("sheet_ord"), kind.alias("sheet_type"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(name, F.lit(".png"))).alias("image"), note.alias("scale"), F.when(even, geometry).alias("geometry"))


@query("""
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN nullif(round_even(CAST(o_custkey AS DOUBLE) / 7, 4), 0) WHEN o_orderstatus = 'P' THEN 20.0 ELSE 4.0 END AS fpi, o_totalprice, o_orderkey % 2 = 0 AS drawn
  FROM orders WHERE o_orderkey % 2 = 0 OR (o_orderkey % 3 <> 0 AND o_orderstatus <> 'O')),
g AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 50.0 ELSE fpi END AS f FROM c)
SELECT 'S' || o_orderkey AS sheet, f AS feet_per_inch, CASE WHEN drawn THEN round_even(o_totalprice * (f / 72), 1) END AS total_linework_lf, o_orderkey % 5 = 0 AS given FROM g
""")
def scale_overrides(spark, sf_dir):
    """Numbers count, other texts and negative ones don't"""
    keys = table(spark, sf_dir, "orders").select(F.concat(F.lit("S"), "o_orderkey").alias("sheet"), F.when(F.col("o_orderkey") % 5 == 0, "50").when(F.col("o_orderkey") % 5 == 1, "-3").when(F.col("o_orderkey") % 5 == 2, "n/a").alias("value"))
    out = scales.overridden(scales.calibration(_calibrated_sheets(spark, sf_dir)), keys)
    return out.select("sheet", "feet_per_inch", "total_linework_lf", (F.col("scale_source") == "user_verified").alias("given"))


@query("""
SELECT 'S' || o_orderkey AS sheet FROM orders WHERE (o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0) AND NOT (o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0) AND (o_orderkey % 2 = 0 OR o_orderstatus <> 'O')
""")
def scale_backfill(spark, sf_dir):
    """A table of the drawn sheets alone, completed from the sheets' images"""
    sheets = _calibrated_sheets(spark, sf_dir)
    drawn = scales.calibration(sheets.where("geometry IS NOT NULL"))
    return scales.enriched(drawn, sheets.drop("geometry")).select("sheet")


@query("""
WITH s AS (SELECT n_regionkey AS project, c_nationkey AS page, c_custkey, 50 + c_custkey % 200 AS feet, c_custkey % 3 = 0 AS across FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT project, page, max(feet) FILTER (across) AS w, max(feet) FILTER (NOT across) AS d FROM s GROUP BY ALL HAVING w IS NOT NULL AND d IS NOT NULL)
SELECT project, page, CAST(w AS DOUBLE) AS width_ft, CAST(d AS DOUBLE) AS depth_ft, CAST(w * d AS DOUBLE) AS area_sf, CAST(2 * (w + d) AS DOUBLE) AS perimeter_lf FROM p
QUALIFY row_number() OVER (PARTITION BY project ORDER BY page % 2 = 0 DESC, w * d DESC, page) = 1
""")
def best_footprint(spark, sf_dir):
    """F8, A15"""
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    across = F.col("c_custkey") % 3 == 0
    spans = customer.select(F.col("n_regionkey").alias("project"), F.col("c_nationkey").alias("page"), F.when(across, 1.0).otherwise(0.0).alias("dir_x"), F.when(across, 0.0).otherwise(1.0).alias("dir_y"), F.concat(50 + F.col("c_custkey") % 200, F.lit("' - 0\"")).alias("text"))
    titles = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("page"), F.when(F.col("n_nationkey") % 2 == 0, "Level 1 Floor Plan").otherwise("details").alias("text"))
    return scales.best_footprint(spans, titles).drop("confidence")


@query("""
SELECT p_brand AS tab, p_partkey, p_name AS item, CAST(p_size AS DOUBLE) AS quantity, CASE WHEN p_size % 2 = 0 THEN 'LF' ELSE 'EA' END AS unit FROM part WHERE p_size % 5 <> 0
""")
def table_items(spark, sf_dir):
    """Headers in any case and order, dashes and marks for quantities"""
    part = table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") % 5 == 0, F.concat("p_size", F.lit("A"))).otherwise(F.col("p_size").cast("string"))
    rows = part.select(F.col("p_brand").alias("tab"), "p_partkey", F.array(F.lit("x"), "p_name", F.when(F.col("p_size") % 2 == 0, "lf").otherwise(""), size).alias("cells"))
    heads = part.select(F.col("p_brand").alias("tab")).distinct().select("tab", F.lit(-1).alias("p_partkey"), F.array(*map(F.lit, ("No. of sheet", "Description", "U.O.M.", "QTY."))).alias("cells"))
    cells = heads.unionByName(rows).withColumn("row_ord", F.when(F.col("p_partkey") < 0, 0).otherwise(F.col("p_partkey") + 1))
    return tables.table_items(cells.drop("p_partkey"), ["tab"]).select("tab", (F.col("row_ord") - 1).alias("p_partkey"), "item", "quantity", "unit")


@query("""
SELECT p_brand AS tab, 0 AS tag_col, 2 AS panel_col, 3 AS frame_col, count(*) AS door_rows, count(*) AS covered FROM part GROUP BY p_brand HAVING count(*) >= 3
""")
def door_columns(spark, sf_dir):
    """A10, D22"""
    code = F.concat(F.lit("D-"), F.col("p_partkey") % 900)
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words)).cast("int"))
    cells = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tab"), F.col("p_partkey").alias("row_ord"), F.array(code, "p_name", pick(("SCW", "HM")), pick(("GALV", "HM"))).alias("cells"))
    return tables.door_columns(cells, ["tab"])


@query("""
WITH t AS (SELECT p_partkey, p_size % 4 AS k FROM part)
SELECT p_partkey AS page, CASE k WHEN 0 THEN 'A4.0' WHEN 1 THEN 'C-4' WHEN 2 THEN 'S120' ELSE 'Page_' || p_partkey END AS sheet FROM t
""")
def sheet_ids(spark, sf_dir):
    """In the title block, in the text, beside a standard's number, nowhere"""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), (F.col("p_size") % 4).alias("k"))
    said = F.when(F.col("k") == 0, "SHEET A4.0 ASTM E283").when(F.col("k") == 1, "NFPA 13").when(F.col("k") == 2, "ASTM C90 S120").otherwise("ASTM E283")
    words = part.select("page", F.posexplode(F.split(said, " ")).alias("ord", "text")).select("page", "ord", F.lit(90.0).alias("x0"), F.lit(95.0).alias("y0"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), "text")
    left = part.select("page", F.lit(-1).alias("ord"), F.lit(10.0).alias("x0"), F.lit(95.0).alias("y0"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), F.lit("Z-9").alias("text"))
    titles = tables.title_block(words.unionByName(left), ["page"])
    text = F.when(F.col("k") == 1, "see sheet C-4").otherwise("nothing here")
    return part.join(titles, "page").select("page", tables.sheet_id(F.col("title"), text, F.col("page").cast("string")).alias("sheet"))
