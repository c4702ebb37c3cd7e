"""Sheets, their passes and reports over the test tables: an order is a sheet, its lines are what was read from it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import quantity_text
from ..functions.storage import materialised
from ..operators import aggregate, estimate, merge, pages, phrases, raw, reports
from ..sources import extraction, manifest
from . import pipeline, rules
from .registry import query, table

#: Item names with the type, name and unit that the engine's own rules must give them.
ITEMS = (
    ("Bollard at dock", "bollard", "Bollards", "EA"), ("24 in RCP storm pipe", "storm_pipe", 'Storm Pipe-24"', "LF"), ("catch basin type 1", "catch_basin", "Catch Basins", "EA"),
    ("sanitary manhole", "manhole", "Manholes", "EA"), ("VCT flooring", "flooring", "Flooring", "SF"), ("sealed concrete slab", "sealed_concrete", "Sealed Concrete", "SF"),
    ("8 in CMU wall", "cmu_wall", "CMU Wall", "SF"), ("plain widget", "general", "General", None),
)


def picked(key: Column | str = "l_partkey"):
    return F.get(F.array(*(F.lit(i[0]) for i in ITEMS)), ((F.col(key) if isinstance(key, str) else key) % len(ITEMS)).cast("int"))


_NAMES_SQL = "[" + ", ".join("'" + i[0] + "'" for i in ITEMS) + "]"
_LINES_SQL = f"""lines AS (
  SELECT lineitem.*, part.*, o_orderpriority, o_orderstatus, o_totalprice, 'S' || o_orderkey AS sheet, {_NAMES_SQL}[1 + CAST(l_partkey % {len(ITEMS)} AS INT)] AS item, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q,
    CASE o_orderstatus WHEN 'F' THEN 'floor_plan' WHEN 'O' THEN 'detail' ELSE 'civil_site' END AS sheet_type,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def order_sheets(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """Every order with lines as a recorded sheet, its arrays in order of lines; at most a few lines an order.

    Lines are gathered as plain columns and their structs made within the sheet.  Who names the wanted columns gets
    only these, worked out where they are read; all columns are recorded once, for many readers.
    """
    q = lambda x: x["l_quantity"].cast("bigint").cast("string")
    s = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    item = lambda x: picked(x["l_partkey"])
    parts = {
        "measurements": lambda x: s(description=F.concat(item(x), F.lit(" total")), value=q(x), unit=F.when(x["l_linestatus"] == "O", "LF").otherwise("SF"), approximate=x["l_tax"] > 0.06, location=x["l_linestatus"], raw_text=x["p_name"]),
        "components": lambda x: s(name=item(x), quantity=F.when(x["l_returnflag"] != "R", q(x)), unit=F.lit("EA"), specification=x["p_type"], location=x["l_returnflag"], confidence=F.when(x["l_discount"] > 0.05, "high")),
        "materials": lambda x: s(type=x["p_type"], quantity=q(x), unit=F.lit("EA"), specification=x["p_brand"]),
    }
    order = ("l_linenumber", "l_partkey", "l_quantity")
    needed = {"measurements": ("l_linestatus", "l_tax", "p_name"), "components": ("l_returnflag", "l_discount", "p_type"), "materials": ("p_type", "p_brand"), "schedules": ("l_returnflag",)}
    gathered = tuple(dict.fromkeys(c for name, columns in needed.items() if not wanted or name in wanted for c in columns))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*order, *gathered))).alias("lines"))
    sheets = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    of = lambda name: F.transform("lines", parts[name])
    printed = lambda x: F.create_map(F.lit("ITEM"), item(x), F.lit("QTY"), q(x), F.lit("TAG"), x["l_linenumber"].cast("string"))
    purpose = F.when(F.col("o_orderpriority") == "1-URGENT", "specification_reference").when(F.col("o_orderpriority") == "2-HIGH", "takeoff_legend")
    schedule = lambda: s(name=F.col("o_orderpriority"), table_purpose=purpose, use_for_takeoff=F.lit(None).cast("boolean"), lookup_key=F.lit(None).cast("string"), rows=F.transform(F.filter("lines", lambda x: x["l_returnflag"] == "A"), printed), type=F.lit(None).cast("string"), schedule_type=F.lit("lines"), header_info=F.lit(""), totals=F.lit(None).cast("string"))
    room = s(name=F.concat(F.lit("Room "), "o_orderkey"), area=F.col("o_totalprice").cast("bigint").cast("string"), dimensions=F.lit(None).cast("string"), notes=F.when(F.col("o_orderkey") % 2 == 0, "Warehouse area").otherwise("office"), material_notes=F.lit(None).cast("string"), ceiling=F.lit(None).cast("string"))
    kind = F.when(F.col("o_orderstatus") == "F", "floor_plan").when(F.col("o_orderstatus") == "O", "detail").otherwise("civil_site")
    name = F.concat(F.lit("S"), "o_orderkey")
    columns = {
        "sheet": lambda: name, "sheet_ord": lambda: F.col("o_orderkey"), "sheet_type": lambda: kind, "page_id": lambda: F.col("o_orderkey").cast("string"), "scale": lambda: F.lit("1\" = 20'"),
        "skipped": lambda: F.lit(False), "has_error": lambda: F.lit(False), "image": lambda: F.when(F.col("o_orderkey") % 3 != 0, F.concat(name, F.lit(".png"))),
        "measurements": lambda: of("measurements"), "components": lambda: of("components"), "materials": lambda: of("materials"), "rooms": lambda: F.array(room), "schedules": lambda: F.array(schedule()),
        "pipe_runs": lambda: F.array().cast("array<struct<length_lf:double,diameter_in:double,material:string,raw_text:string,slope_pct:double>>"),
        "civil_structures": lambda: F.array().cast("array<struct<type:string,quantity:double,id:string,specification:string>>"),
        "lintel_runs": lambda: F.array().cast("array<struct<mark:string,size:string,individual_length_ft:double,count:double,total_lf:double,location:string,raw_text:string>>"),
    }
    recorded = sheets.select(*(columns[c]().alias(c) for c in wanted or columns))
    return recorded if wanted else materialised(recorded, "order-sheets")


_RAW_SQL = f"""
WITH {_LINES_SQL}, o AS (SELECT DISTINCT sheet, sheet_type, l_orderkey, o_orderpriority, o_totalprice FROM lines), a AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n FROM lines WHERE l_returnflag = 'A')
SELECT 'measurement' AS category, sheet, sheet_type, CAST(l_orderkey AS VARCHAR) AS page_id, item || ' total' AS description, q AS value, CASE l_linestatus WHEN 'O' THEN 'LF' ELSE 'SF' END AS unit, l_linestatus AS location_on_sheet, p_name AS source_text, 0 AS src_ord, i AS elem_ord, 0 AS row_ord FROM lines
UNION ALL SELECT 'component', sheet, sheet_type, CAST(l_orderkey AS VARCHAR), item, CASE WHEN l_returnflag <> 'R' THEN q END, 'EA', l_returnflag, p_type, 1, i, 0 FROM lines
UNION ALL SELECT 'room', sheet, sheet_type, CAST(l_orderkey AS VARCHAR), 'Room ' || l_orderkey, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR), 'sq_ft', '', CASE WHEN l_orderkey % 2 = 0 THEN 'Warehouse area' ELSE 'office' END, 2, 0, 0 FROM o
UNION ALL SELECT 'material', sheet, sheet_type, CAST(l_orderkey AS VARCHAR), p_type, q, 'EA', '', p_brand, 3, i, 0 FROM lines
UNION ALL SELECT 'schedule_header', sheet, sheet_type, CAST(l_orderkey AS VARCHAR), o_orderpriority, '', 'lines', '', '', 4, 0, 0 FROM o
UNION ALL SELECT 'schedule_row', sheet, sheet_type, CAST(l_orderkey AS VARCHAR), '[' || o_orderpriority || '] ' || item, q, 'qty', 'row ' || l_linenumber, 'ITEM=' || item || ' | QTY=' || q || ' | TAG=' || l_linenumber, 4, 0, n FROM a
"""


@query(_RAW_SQL)
def raw_rows(spark, sf_dir):
    """P1, K2"""
    rows = raw.raw_rows(order_sheets(spark, sf_dir))
    return rows.select(*reports.raw_table(rows).columns, "src_ord", "elem_ord", "row_ord")


@query(f"""
WITH {_LINES_SQL} SELECT DISTINCT sheet AS source_sheet, o_orderpriority AS name, (SELECT count(*) FROM lines AS x WHERE x.sheet = lines.sheet AND x.l_returnflag = 'A') AS n_rows FROM lines WHERE o_orderpriority = '1-URGENT'
""")
def specification_tables(spark, sf_dir):
    """P3"""
    return raw.specification_tables(order_sheets(spark, sf_dir)).select("source_sheet", "name", F.size("rows").cast("long").alias("n_rows"))


@query(f"""
WITH {_LINES_SQL} SELECT sheet, sheet_type AS type, 20.0::DOUBLE AS scale_feet_per_inch, CAST(count(*) AS INT) AS measurements, CAST(count(*) AS INT) AS components, 1 AS rooms, CAST(count(*) AS INT) AS materials, 1 AS schedules FROM lines GROUP BY ALL
""")
def sheet_log(spark, sf_dir):
    """P4"""
    return raw.sheet_log(order_sheets(spark, sf_dir)).drop("page_id", "scale", "sheet_ord")


@query(f"""
WITH {_LINES_SQL} SELECT l_orderkey, l_linenumber, item AS description, {"CASE item " + " ".join(f"WHEN '{i[0]}' THEN '{i[1]}'" for i in ITEMS) + " END"} AS item_type, {"CASE item " + " ".join(f"WHEN '{i[0]}' THEN '{i[2]}'" for i in ITEMS) + " END"} AS name FROM lines
""")
def own_rules(spark, sf_dir):
    """D10, D11 with the engine's own tables"""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", picked().alias("description"))
    found = phrases.named(phrases.classified(lines, {"item_type": F.col("description")}))
    return found.select("l_orderkey", "l_linenumber", "description", "item_type", F.col("ruled.name").alias("name"))


def rule_texts() -> list[str]:
    """A text for each keyword of the tables and for each alternative of the name rules."""
    plain = ((r"\(\?!.*?\)(?=$|\|)", ""), (r"\\b|\?$", ""), (r"\.\*|\\s\*|\.\?|\?", " "), (r"\\d\+?", "12"), (r"(?<=\w)\.(?=\w)", " "))
    texts = [k for _, _, _, words in rules.ESTIMATION for k in words]
    for pattern, *_ in rules.ITEM_NAMES:
        for text in pattern.split("|"):
            for old, new in plain:
                text = re.sub(old, new, text)
            texts.append(text)
    return list(dict.fromkeys(texts))


def _name_rule_sql(pattern: str) -> str:
    """A name rule for a matcher without lookahead: what follows the last forbidden text is searched."""
    tests = []
    for part in pattern.split("|"):
        wanted, _, forbidden = part.partition("(?!.*")
        text = f"regexp_replace(low, '^.*({forbidden[:-1]})', '\\1')" if forbidden else "low"
        tests.append(f"regexp_matches({text}, '{wanted}')")
    return " OR ".join(tests)


_TEXTS_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in rule_texts()) + "]"
_RULED_SQL = rf"""
WITH rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE l_linenumber % 3 WHEN 0 THEN upper(t) WHEN 1 THEN p_name || ' ' || t ELSE t || ', ' || p_name || ' - H 12' END AS description
  FROM (SELECT *, {_TEXTS_SQL}[1 + CAST((l_orderkey * 7 + l_partkey) % {len(rule_texts())} AS INT)] AS t FROM lineitem JOIN part ON l_partkey = p_partkey)),
d AS (SELECT DISTINCT description, lower(description) AS low FROM rows),
k AS (SELECT * FROM (VALUES {", ".join(f"({place}, '{mode}', '{keyword}', '{kind}')" for mode, place, keyword, kind in phrases.keyword_rules(rules.ESTIMATION))}) AS v(place, mode, keyword, kind)),
met AS (SELECT description, arg_min(kind, place) AS kind FROM d, k WHERE CASE mode
  WHEN 'phrase' THEN strpos(low, keyword) > 0 AND NOT regexp_matches(substr(low, strpos(low, keyword) - 1, CASE WHEN strpos(low, keyword) > 1 THEN 1 ELSE 0 END), '[a-z0-9]') AND NOT regexp_matches(substr(low, strpos(low, keyword) + length(keyword), 1), '[a-z0-9]')
  ELSE list_contains(regexp_extract_all(regexp_replace(low, '[-_/'']+', ' ', 'g'), '[a-z][a-z0-9]+'), keyword) END GROUP BY description),
typed AS (SELECT d.*, coalesce(kind, 'general') AS item_type, regexp_extract(low, 'h[-\s]*(\d+(?:[''′]?(?:-?\d+)?["″]?))', 1) AS height, regexp_extract(low, '(\d+(?:\.\d+)?)\s*(?:in\b|inch|"|″)', 1) AS inches,
  CASE {" ".join(f"WHEN {_name_rule_sql(p)} THEN '{n}'" for p, n, _ in rules.ITEM_NAMES)} END AS rule,
  CASE {" ".join(f"WHEN {_name_rule_sql(p)} THEN '{u}'" for p, _, u in rules.ITEM_NAMES)} END AS unit FROM d LEFT JOIN met USING (description))
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, item_type, unit,
  CASE WHEN rule IS NULL THEN array_to_string(list_transform(string_split(item_type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') WHEN rule IN ('Columns', 'Ladder') AND height <> '' THEN rule || '-H-' || height WHEN rule LIKE '%Pipe%' AND inches <> '' THEN rule || '-' || inches || '"' ELSE rule END AS name
FROM rows JOIN typed USING (description)
"""


@query(_RULED_SQL)
def every_rule(spark, sf_dir):
    """Every keyword of all tables and every alternative of all name rules, within other words"""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    texts = rule_texts()
    said = F.get(F.array(*map(F.lit, texts)), ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % len(texts)).cast("int"))
    third = F.col("l_linenumber") % 3
    description = F.when(third == 0, F.upper(said)).when(third == 1, F.concat_ws(" ", "p_name", said)).otherwise(F.concat(said, F.lit(", "), "p_name", F.lit(" - H 12")))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", description.alias("description"))
    found = phrases.named(phrases.classified(rows, {"item_type": F.col("description")}))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "item_type", F.col("ruled.unit").alias("unit"), F.col("ruled.name").alias("name"))


_KIND = "CASE item " + " ".join(f"WHEN '{i[0]}' THEN '{i[1]}'" for i in ITEMS) + " END"


@query(f"""
WITH {_LINES_SQL} SELECT sheet, CAST(i AS INT) AS elem_ord, CASE WHEN kind = 'general' THEN 'component' ELSE kind END AS item_type, round_even(CAST(q AS DOUBLE) * CASE kind WHEN 'flooring' THEN 1.10 WHEN 'storm_pipe' THEN 1.05 ELSE 1.0 END, 2) AS quantity,
  CASE WHEN l_discount > 0.05 THEN 'high' WHEN kind = 'general' THEN 'low' ELSE 'medium' END AS confidence, kind = 'general' AS needs_review
FROM (SELECT *, {_KIND} AS kind FROM lines WHERE l_returnflag <> 'R' AND CAST(q AS INT) <> 0)
""")
def component_items(spark, sf_dir):
    """D3, P11"""
    return estimate.from_components(order_sheets(spark, sf_dir, "sheet", "sheet_ord", "sheet_type", "components")).select("sheet", "elem_ord", "item_type", "quantity", "confidence", "needs_review")


@query(f"""
WITH {_LINES_SQL}, k AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'lf' ELSE 'sq_ft' END AS u, {_KIND} AS kind, CAST(q AS DOUBLE) AS v FROM lines)
SELECT sheet, CAST(i AS INT) AS elem_ord, kind AS item_type, round_even(CASE kind WHEN 'flooring' THEN v * 1.10 WHEN 'storm_pipe' THEN v * 1.05 ELSE v END, 2) AS quantity,
  CASE kind WHEN 'storm_pipe' THEN 'lf' WHEN 'flooring' THEN 'sq_ft' WHEN 'sealed_concrete' THEN 'sq_ft' WHEN 'cmu_wall' THEN 'sq_ft' ELSE 'ea' END AS unit, l_tax > 0.06 AS needs_review,
  CASE WHEN l_tax > 0.06 THEN 'low' WHEN sheet_type = 'floor_plan' THEN 'high' ELSE 'medium' END AS confidence, l_tax <= 0.06 AND sheet_type = 'floor_plan' AS auto_verified
FROM k WHERE kind <> 'general' AND NOT (sheet_type = 'detail' AND kind = 'bollard') AND (kind NOT IN ('bollard', 'catch_basin', 'manhole') OR v >= 1)
""")
def measurement_items(spark, sf_dir):
    """Sheets that are floor plans have a scale that is surely known"""
    sheets = order_sheets(spark, sf_dir, "sheet", "sheet_ord", "sheet_type", "measurements").withColumn("scale_confidence", F.when(F.col("sheet_type") == "floor_plan", "high"))
    return estimate.from_measurements(sheets).select("sheet", "elem_ord", "item_type", "quantity", "unit", "needs_review", "confidence", "auto_verified")


@query(f"""
WITH {_LINES_SQL}, e AS (SELECT *, {_KIND} AS kind FROM lines WHERE l_returnflag <> 'R' AND CAST(q AS INT) <> 0)
SELECT CASE WHEN kind = 'general' THEN 'component' ELSE kind END AS item_type, item AS description, q AS raw_value, 'EA' AS raw_unit, 1.0::DOUBLE AS waste_factor, 'none' AS estimation_table, '' AS qty_source, sheet AS source_sheet, p_type AS specification FROM e
""")
def calculated_rows(spark, sf_dir):
    """P2, K4"""
    rows = raw.calculated_rows(estimate.from_components(order_sheets(spark, sf_dir, "sheet", "sheet_ord", "sheet_type", "components")))
    return rows.select("item_type", "description", "raw_value", "raw_unit", "waste_factor", "estimation_table", "qty_source", "source_sheet", "specification")


@query(f"""
WITH {_LINES_SQL}, e AS (SELECT *, {_KIND} AS kind FROM lines WHERE l_returnflag <> 'R' AND CAST(q AS INT) <> 0)
SELECT CASE WHEN kind = 'general' THEN 'component' ELSE kind END AS item_type, item AS description, q AS raw_value, 'EA' AS raw_unit, 1.0::DOUBLE AS waste_factor, sheet AS source_sheet FROM e
""")
def calculated_listing(spark, sf_dir):
    """K4: the columns of the calculations file"""
    rows = reports.calculated_table(raw.calculated_rows(estimate.from_components(order_sheets(spark, sf_dir, "sheet", "sheet_ord", "sheet_type", "components"))))
    return rows.select("item_type", "description", "raw_value", "raw_unit", "waste_factor", "source_sheet")


_PART_TOTAL = """t AS (SELECT p_type AS item, CAST(sum(p_size) AS DOUBLE) AS quantity, bool_or(p_size > 45) AS needs_review, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS sheets, count(*) AS line_count FROM part GROUP BY 1)"""


def _part_total(spark, sf_dir):
    total = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("item")).agg(
        F.sum("p_size").cast("double").alias("quantity"), F.bool_or(F.col("p_size") > 45).alias("needs_review"), F.sort_array(F.collect_set("p_brand")).alias("source_sheets"), F.count("*").alias("line_count")
    )
    reasons = F.when(F.col("needs_review"), F.array(F.lit("large"), F.lit("verify"))).otherwise(F.array().cast("array<string>"))
    return total.withColumns({"quantity_fmt": quantity_text(F.col("quantity")), "unit": F.lit("EA"), "confidence": F.lit(None).cast("string"), "source": F.lit(""), "review_reasons": reasons})


@query(f"""
WITH {_PART_TOTAL} SELECT item, format('{{:,}}', CAST(quantity AS BIGINT)) AS quantity, 'EA' AS unit, '' AS confidence, CASE WHEN needs_review THEN 'yes' ELSE '' END AS needs_review, 'vision' AS source,
  CASE WHEN needs_review THEN 'large; verify' ELSE '' END AS review_notes, sheets AS source_sheets, line_count FROM t
""")
def summary_table(spark, sf_dir):
    """K3"""
    return reports.summary_table(_part_total(spark, sf_dir))


@query(f"""
WITH {_PART_TOTAL} SELECT item, '  ' || rpad(item, 40, ' ') || ' ' || lpad(format('{{:,}}', CAST(quantity AS BIGINT)), 12, ' ') || '  ' || rpad('EA', 8, ' ') AS line FROM t
""")
def summary_lines(spark, sf_dir):
    """K6"""
    return reports.summary_lines(_part_total(spark, sf_dir))


@query("""SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","tags":["' || p_brand || '","' || p_type || '"]}' AS json FROM part""")
def report_json(spark, sf_dir):
    """K5, F24"""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("tags"))
    return reports.as_json(rows, ["p_partkey"])


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 500 AS capped FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def preview(spark, sf_dir):
    """K9, O10"""
    rows, total, capped = reports.capped(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])
    return rows.withColumns({"total": F.lit(total).cast("long"), "capped": F.lit(capped)})


_PASSES_SQL = f"""
{_LINES_SQL}, tables AS (
  SELECT sheet, o_orderpriority AS name, CASE o_orderpriority WHEN '1-URGENT' THEN 'specification_reference' WHEN '2-HIGH' THEN 'takeoff_legend' END AS purpose, count(*) FILTER (l_returnflag = 'A') AS n, 0 AS src FROM lines GROUP BY ALL
  UNION ALL SELECT sheet, 'second', CASE WHEN l_orderkey % 2 = 0 THEN 'takeoff_schedule' ELSE 'general_notes' END, count(*) FILTER (l_returnflag = 'N'), 1 FROM lines GROUP BY sheet, l_orderkey)"""


@query(f"""
WITH {_PASSES_SQL}, filled AS (SELECT * FROM tables WHERE n > 0), best AS (SELECT sheet, arg_max(src, n * 10 - src) AS first FROM filled WHERE purpose IN ('takeoff_legend', 'takeoff_schedule') GROUP BY sheet)
SELECT filled.sheet, name, CAST(n AS BIGINT) AS n_rows, CAST(row_number() OVER (PARTITION BY filled.sheet ORDER BY coalesce(src <> first, false), src) - 1 AS INT) AS place FROM filled LEFT JOIN best USING (sheet)
WHERE first IS NULL OR src = first OR coalesce(purpose, '') NOT IN ('specification_reference', 'general_notes')
""")
def merged_schedules(spark, sf_dir):
    """J2, J3"""
    # Four sides read them, so they are recorded, but only what passes are merged from.
    sheets = materialised(order_sheets(spark, sf_dir, "sheet", "sheet_ord", "components", "schedules", "rooms"), "passes")
    rows = F.transform(F.filter("components", lambda c: c["location"] == "N"), lambda c: F.create_map(F.lit("ITEM"), c["name"]))
    purpose = F.when(F.col("sheet_ord") % 2 == 0, "takeoff_schedule").otherwise("general_notes")
    second = F.transform("schedules", lambda s: s.withField("name", F.lit("second")).withField("table_purpose", purpose).withField("rows", rows))
    empty = sheets.select("sheet", F.slice("schedules", 1, 0).alias("schedules"), F.slice("components", 1, 0).alias("components"))
    merged = merge.all_passes(sheets, empty.select("sheet", "components"), sheets.select("sheet", second.alias("schedules")), empty.select("sheet", "schedules"))
    out = merged.select("sheet", F.posexplode("schedules").alias("place", "s"))
    return out.select("sheet", "s.name", F.size("s.rows").cast("long").alias("n_rows"), "place")


@query(f"""
WITH {_LINES_SQL}, m AS (SELECT * FROM lines), c AS (SELECT sheet, 'counted ' || item AS name, min(i) AS i FROM lines WHERE l_discount > 0.05 GROUP BY ALL)
SELECT sheet, item AS name, CASE WHEN l_returnflag <> 'R' THEN q WHEN i = max(i) OVER (PARTITION BY sheet, item) THEN '77' END AS quantity FROM m
UNION ALL SELECT sheet, name, '5' FROM c
""")
def merged_components(spark, sf_dir):
    """J1, J3 inside arrays: counts of 77 for what was measured without a number, and counted names of 5"""
    sheets = order_sheets(spark, sf_dir, "sheet", "components")
    sure = F.transform("components", lambda c: c.withField("name", F.upper(c["name"])).withField("quantity", F.lit("77")).withField("confidence", F.lit("high")))
    new = F.transform(F.filter("components", lambda c: c["confidence"] == "high"), lambda c: c.withField("name", F.concat(F.lit("counted "), c["name"])).withField("quantity", F.lit("5")).withField("confidence", F.lit(None).cast("string")))
    counted = F.concat(F.filter(sure, lambda c: c["name"] != ""), new)
    return sheets.select("sheet", F.explode(merge.merged_components(F.col("components"), counted)).alias("c")).select("sheet", "c.name", "c.quantity")


@query(f"""
WITH {_LINES_SQL} SELECT DISTINCT sheet, CASE WHEN o_orderpriority = '2-HIGH' AND l_orderkey % 2 = 0 AND (SELECT bool_or(x.item IN ('sealed concrete slab', '8 in CMU wall')) FROM lines AS x WHERE x.sheet = lines.sheet AND x.l_returnflag = 'A') THEN 0 ELSE 1 END AS n_rooms FROM lines
""")
def accurate_rooms(spark, sf_dir):
    """P12"""
    return order_sheets(spark, sf_dir).select("sheet", F.size(merge.accurate_rooms(F.col("rooms"), F.col("schedules"))).alias("n_rooms"))


@query("""
WITH e AS (SELECT * FROM (VALUES ('Bolt Large', 'EA'), ('Cold Widget', 'EA')) AS v(entry, unit)), r AS (SELECT p_brand AS sheet, p_name, p_size, CASE p_name WHEN 'large bolt' THEN 'Bolt Large' WHEN 'cold widget' THEN 'Cold Widget' END AS entry FROM part),
have AS (SELECT sheet, entry, sum(CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END) AS n FROM r WHERE p_size < 12 GROUP BY ALL), tiles AS (SELECT sheet, entry, sum(p_size) AS n FROM r WHERE p_size >= 12 GROUP BY ALL)
SELECT sheet, entry AS name, CAST(CAST(n AS DOUBLE) AS VARCHAR) AS quantity, e.unit FROM tiles JOIN e USING (entry) WHERE n > 0 AND NOT EXISTS (SELECT 1 FROM have WHERE have.sheet = tiles.sheet AND have.entry = tiles.entry AND have.n > 0)
""")
def tiled_recount(spark, sf_dir):
    """J21"""
    entries = spark.createDataFrame([("Bolt Large", "EA", [], 0, "count"), ("Cold Widget", "EA", [], 1, "each"), ("Plate", "SF", [], 2, "area")], "entry string, entry_unit string, aliases array<string>, ord int, measure string")
    part = table(spark, sf_dir, "part").where("p_name IN ('large bolt', 'cold widget')").select(F.col("p_brand").alias("sheet"), F.col("p_name").alias("name"), F.lit("EA").alias("unit"), "p_size")
    found = part.where("p_size < 12").withColumn("quantity", F.when(F.col("p_size") % 2 == 0, "n/a").otherwise(F.col("p_size").cast("string")))
    return merge.tiled_recount(found, part.where("p_size >= 12").withColumn("quantity", F.col("p_size").cast("string")), entries).select("sheet", "name", "quantity", "unit")


@query("""
WITH f AS (SELECT user_id, event_type AS reason FROM events WHERE event_type <> 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT DISTINCT events.user_id, coalesce(reason, 'none') AS reason FROM events LEFT JOIN f USING (user_id)
""")
def failure_reasons(spark, sf_dir):
    """J25"""
    events = table(spark, sf_dir, "events")
    failures = events.where("event_type != 'click'").select("user_id", F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("reason"))
    return merge.failure_reasons(events.select("user_id").distinct(), failures, ["user_id"], "none")


@query("""
WITH f AS (SELECT o_custkey, o_orderkey AS file, o_orderdate FROM orders WHERE o_totalprice > 100000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1)
SELECT c_custkey, file FROM customer LEFT JOIN f ON c_custkey = o_custkey
""")
def images_at_hand(spark, sf_dir):
    """J26"""
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("file"), F.col("o_totalprice").alias("bytes"), F.col("o_orderdate").alias("modified"))
    return merge.images_at_hand(table(spark, sf_dir, "customer").select("c_custkey"), files, ["c_custkey"], 100_000)


@query("""SELECT 'S' || o_orderkey AS sheet, 'S' || o_orderkey || '.png' AS image, CASE o_orderstatus WHEN 'F' THEN 'floor_plan' WHEN 'O' THEN 'detail' ELSE 'civil_site' END AS type, o_orderstatus <> 'O' AS scaled
FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def sheet_assets(spark, sf_dir):
    """P14, P15"""
    assets = raw.sheet_assets(order_sheets(spark, sf_dir))
    return assets.select("sheet", "image", "type", raw.is_scale_bearing(F.col("sheet"), F.col("type")).alias("scaled"))


_ROOM = "(SELECT DISTINCT l_orderkey, CAST(trunc(o_totalprice) AS DOUBLE) AS area FROM lines WHERE trunc(o_totalprice) > 0)"


@query(f"""
WITH {_LINES_SQL}, r AS {_ROOM}, w AS (SELECT *, 4 * sqrt(area) * 10 AS wall FROM r)
SELECT 'S' || l_orderkey AS sheet, 'flooring' AS item_type, round_even(area * 1.1, 2) AS quantity, 'medium' AS confidence FROM w UNION ALL SELECT 'S' || l_orderkey, 'ceiling_grid', round_even(area * 1.08, 2), 'medium' FROM w
UNION ALL SELECT 'S' || l_orderkey, 'paint', ceil(wall * 2 / 350), 'low' FROM w UNION ALL SELECT 'S' || l_orderkey, 'drywall', ceil(wall * 1.12 / 32), 'low' FROM w
""")
def room_items(spark, sf_dir):
    """Rooms whose notes name no material, with walls of ten feet"""
    return estimate.from_rooms(order_sheets(spark, sf_dir, "sheet", "sheet_ord", "sheet_type", "rooms"), "retail", 10.0).select("sheet", "item_type", "quantity", "confidence")


@query(f"""
WITH {_LINES_SQL}, k AS (SELECT *, {_KIND} AS kind, CAST(q AS DOUBLE) AS v FROM lines WHERE l_returnflag = 'A' AND o_orderpriority <> '1-URGENT' AND CAST(q AS INT) > 0)
SELECT sheet, CASE WHEN kind = 'general' THEN 'schedule_item' ELSE kind END AS item_type, l_linenumber || ' - ' || item AS description,
  CASE WHEN o_orderpriority = '2-HIGH' OR kind = 'general' THEN v ELSE round_even(CASE kind WHEN 'flooring' THEN v * 1.10 WHEN 'storm_pipe' THEN v * 1.05 ELSE v END, 2) END AS quantity,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'companion_takeoff_legend' ELSE 'schedule' END AS qty_source FROM k WHERE NOT contains(item, CAST(l_linenumber AS VARCHAR))
""")
def schedule_items(spark, sf_dir):
    """Rows of take-off schedules, printed legends as they are"""
    sheets = order_sheets(spark, sf_dir, "sheet", "sheet_ord", "sheet_type", "schedules")
    marked = F.transform("schedules", lambda s: s.withField("rows", F.transform(s["rows"], lambda r: F.create_map(F.lit("DESCRIPTION"), r["ITEM"], F.lit("QTY"), r["QTY"], F.lit("MARK"), r["TAG"]))))
    found = estimate.from_schedules(sheets.withColumn("schedules", marked))
    return found.where(F.contains("description", F.lit(" - "))).select("sheet", "item_type", "description", "quantity", "qty_source")


_RUNS = (("black steel", "gas_pipe", 1.05), ("spiral duct", "duct_lf", 1.1), ("EMT", "conduit_lf", 1.1), ("RCP", "storm_pipe", 1.05))
_STRUCTURES = (("Catch Basin", "catch_basin"), ("BB inlet", "catch_basin"), ("manhole", "manhole"), ("fence", None))


def _pick(values, column="l_linenumber"):
    return F.get(F.array(*map(F.lit, values)), (F.col(column) % len(values)).cast("int"))


@query(f"""
WITH r AS (SELECT l_orderkey, l_quantity, CAST(l_linenumber % 4 AS INT) AS k FROM lineitem)
SELECT 'S' || l_orderkey AS sheet, {[r[1] for r in _RUNS]}[1 + k] AS item_type, round_even(l_quantity * CAST({[r[2] for r in _RUNS]}[1 + k] AS DOUBLE), 2) AS quantity FROM r
UNION ALL SELECT 'S' || l_orderkey, {[r[1] or "" for r in _STRUCTURES]}[1 + k], CASE WHEN k = 2 THEN 1.0 ELSE l_quantity END FROM r WHERE k <> 3
UNION ALL SELECT 'S' || l_orderkey, 'lintel', round_even(CASE WHEN k < 2 THEN l_quantity ELSE 4.0 * 3 END * 1.05, 2) FROM r
""")
def run_items(spark, sf_dir):
    """Pipe runs, civil structures and lintels, a sheet for each order"""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_orderkey").alias("sheet"), F.lit(0).alias("sheet_ord"), F.lit("civil_site").alias("sheet_type"), "l_linenumber", "l_quantity")
    k, none = F.col("l_linenumber") % 4, F.lit(None)
    runs = F.array(F.struct(F.col("l_quantity").alias("length_lf"), _pick([r[0] for r in _RUNS]).alias("material"), none.cast("string").alias("raw_text")))
    structures = F.array(F.struct(_pick([r[0] for r in _STRUCTURES]).alias("type"), F.when(k != 2, F.col("l_quantity")).alias("quantity"), none.cast("string").alias("id"), none.cast("string").alias("specification")))
    lintels = F.array(F.struct(F.lit("L").alias("mark"), F.lit("4x4").alias("size"), F.lit(4.0).alias("individual_length_ft"), F.lit(3.0).alias("count"), F.when(k < 2, F.col("l_quantity")).otherwise(0.0).alias("total_lf")))
    sheets = lines.select("sheet", "sheet_ord", "sheet_type", runs.alias("pipe_runs"), structures.alias("civil_structures"), lintels.alias("lintel_runs"))
    found = estimate.from_pipe_runs(sheets).unionByName(estimate.from_civil_structures(sheets)).unionByName(estimate.from_lintel_runs(sheets))
    return found.select("sheet", "item_type", "quantity")


@query()
def project_summary(spark, sf_dir):
    """All sheets of a project to its summary, through estimates of every kind and a manifest; no SQL, its parts have theirs"""
    named = spark.createDataFrame([("Bollards", "EA", "bollard", 0), ("Catch Basins", "EA", "catch basin", 1), ("Unheard Of", "EA", "", 2)], "name string, unit string, aliases string, ord int")
    sheets = materialised(order_sheets(spark, sf_dir, *pipeline.COLUMNS), "order-sheets")
    out = pipeline.run_project(sheets, manifest.entries(named))
    return reports.summary_table(out["summary"])


@query(f"""
WITH {_LINES_SQL}, e AS (SELECT item, CAST(q AS DOUBLE) AS q, {_KIND} AS kind, sheet FROM lines WHERE l_returnflag <> 'R' AND CAST(q AS INT) <> 0),
w AS (SELECT {"CASE item " + " ".join(f"WHEN '{i[0]}' THEN '{i[2]}'" for i in ITEMS[:-1]) + " ELSE 'Component' END"} AS item, round_even(q * CASE kind WHEN 'flooring' THEN 1.10 WHEN 'storm_pipe' THEN 1.05 ELSE 1.0 END, 2) AS q FROM e)
SELECT item, round(sum(q), 4) AS quantity, count(*) AS line_count FROM w GROUP BY item UNION ALL SELECT 'Mobilization', 1.0, 1 WHERE EXISTS (FROM w)
""")
def component_totals(spark, sf_dir):
    """A1, A3: counted things of all sheets under their canonical names"""
    total = aggregate.takeoff(estimate.from_components(order_sheets(spark, sf_dir, "sheet", "sheet_ord", "sheet_type", "components")))
    return total.select("item", F.round("quantity", 4).alias("quantity"), F.coalesce("line_count", F.lit(0)).alias("line_count"))


@query(f"""
SELECT o_orderkey, kind, unnest(passes) AS pass FROM (SELECT o_orderkey, kind, CASE kind {" ".join(f"WHEN '{k}' THEN {list(v)}" + "::VARCHAR[]" for k, v in rules.PASS_MATRIX.items())} ELSE ['measure'] END AS passes
  FROM (SELECT o_orderkey, {[*rules.PASS_MATRIX, "unknown"]}[1 + CAST(o_orderkey % {len(rules.PASS_MATRIX) + 1} AS INT)] AS kind FROM orders))
UNION ALL SELECT o_orderkey, 'floor_plan', 'legend' FROM orders WHERE o_orderkey % {len(rules.PASS_MATRIX) + 1} = 0
""")
def planned_passes(spark, sf_dir):
    """Every type of sheet, thoroughly"""
    kinds = [*rules.PASS_MATRIX, "unknown"]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % len(kinds)).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))
    return rows.select("o_orderkey", "kind", F.explode(pages.planned_passes(F.col("kind"), True)).alias("pass"))


@query(r"""
WITH t AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'SHEET INDEX' WHEN 1 THEN 'Door Schedule' WHEN 2 THEN 'ROOF PLAN' WHEN 3 THEN 'M-2 floor plan' WHEN 4 THEN 'level 1 floor plan' WHEN 5 THEN 'building sections' END AS title, coalesce(text, '') AS text FROM documents),
w AS (SELECT * FROM (VALUES """ + ", ".join(rf"({k}, '{kind}', '\b(?:{'|'.join(words)})\b')" for k, (kind, words) in enumerate(rules.SHEET_WORDS)) + r""", (90, 'mep_plan', '^\s*[MEP]-?\d(?s:.)*PLAN'), (91, 'floor_plan', 'FLOOR PLANS?|PLAN|LEVEL')) AS v(k, kind, pattern)),
a AS (SELECT doc_id, arg_min(kind, k) AS kind FROM t, w WHERE regexp_matches(upper(title), pattern) GROUP BY 1), b AS (SELECT doc_id, arg_min(kind, k) AS kind FROM t, w WHERE title IS NULL AND regexp_matches(upper(text), pattern) GROUP BY 1)
SELECT doc_id, coalesce(a.kind, b.kind, 'floor_plan') AS kind FROM t LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
""")
def sheet_types(spark, sf_dir):
    """By title blocks, and by whole texts where there is none"""
    titles = ("SHEET INDEX", "Door Schedule", "ROOF PLAN", "M-2 floor plan", "level 1 floor plan", "building sections", None)
    title = F.get(F.array(*map(F.lit, titles)), (F.col("doc_id") % 7).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", pages.sheet_type(title, F.coalesce("text", F.lit(""))).alias("kind"))
