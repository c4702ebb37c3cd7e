"""The engine's operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, numeric, text
from ..operators import aggregate, estimate, history, lookup, match, pages, scoring, similar
from . import catalog_queries, scale_queries, sheet_queries, store_queries  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
from .registry import query as _query
from .registry import table as _t

#: Item types of the test parts, in the form of the engine's estimation table.
PART_TABLES = (
    ("small_plate", "sq_ft", 1.1, ("small plate", "tiny plate")),
    ("cold_item", "ea", None, ("cold widget", "cold gear", "cold bolt")),
    ("bolt", "ea", None, ("bolt", "screw")),
    ("plate", "sq_ft", 1.05, ("plate", "panel")),
    ("gear", "lf", 1.03, ("gear", "wheel")),
)
#: Name rules of the test parts.
PART_NAMES = ((r"widget", "Widgets", "EA"), (r"bolt|screw", "Fasteners", "EA"), (r"plate|panel", "Sheets", "SF"), (r"old|new", "Dated Goods", "EA"))
PART_FORMULAS = {"ECONOMY": "flooring", "SMALL": "drywall", "MEDIUM": "paint", "PROMO": "concrete_slab", "STANDARD": "storm_pipe", "LARGE": "wall_framing"}
DOC_KEYWORDS = {"industrial": (r"\bthe\b", r"\bof\b"), "retail": (r"\bder\b", r"\bund\b"), "civil": (r"\bque\b", r"\bles?\b")}


@_query("""
SELECT p_partkey, p_name, CASE
  WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])small plate([^a-z0-9]|$)') OR regexp_matches(lower(p_name), '(^|[^a-z0-9])tiny plate([^a-z0-9]|$)') THEN 'small_plate'
  WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])cold (widget|gear|bolt)([^a-z0-9]|$)') THEN 'cold_item'
  WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])(bolt|screw)s?([^a-z0-9]|$)') THEN 'bolt'
  WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])(plate|panel)s?([^a-z0-9]|$)') THEN 'plate'
  WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])(gear|wheel)s?([^a-z0-9]|$)') THEN 'gear'
  ELSE 'general' END AS item_type FROM part
""")
def classify_keywords(spark, sf_dir):
    """D10"""
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name", estimate.classify(F.col("p_name"), PART_TABLES).alias("item_type"))


@_query("""
SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 'Widgets' WHEN p_name LIKE '%bolt%' OR p_name LIKE '%screw%' THEN 'Fasteners'
  WHEN p_name LIKE '%plate%' OR p_name LIKE '%panel%' THEN 'Sheets' WHEN p_name LIKE '%old%' OR p_name LIKE '%new%' THEN 'Dated Goods'
  ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS name FROM part
""")
def first_match_rules(spark, sf_dir):
    """D6, D11"""
    return _t(spark, sf_dir, "part").select("p_partkey", estimate.item_name(F.col("p_name"), F.col("p_type"), PART_NAMES)["name"].alias("name"))


@_query("""
SELECT l_orderkey, l_linenumber, CAST(CASE p_type WHEN 'ECONOMY' THEN l_quantity * 1.1 WHEN 'SMALL' THEN ceil(l_quantity * 1.12 / 32) WHEN 'MEDIUM' THEN ceil(l_quantity * 2 / 350)
  WHEN 'PROMO' THEN round(l_quantity * 4 / 324, 2) WHEN 'STANDARD' THEN l_quantity * 1.05 WHEN 'LARGE' THEN ceil((ceil(l_quantity * 12 / 16) + 1) * 1.10) ELSE l_quantity END AS DOUBLE) AS quantity,
  CASE p_type WHEN 'ECONOMY' THEN 'sq_ft' WHEN 'SMALL' THEN 'sheets' WHEN 'MEDIUM' THEN 'gallons' WHEN 'PROMO' THEN 'cy' WHEN 'STANDARD' THEN 'lf' WHEN 'LARGE' THEN 'studs' ELSE 'ea' END AS unit
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def apply_formula(spark, sf_dir):
    """D9"""
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.coalesce(numeric.literal_map(PART_FORMULAS)[F.col("p_type")], F.lit("general"))
    f = estimate.apply_formula(kind, F.col("l_quantity"), F.lit("ea"))
    return rows.select("l_orderkey", "l_linenumber", f["quantity"].alias("quantity"), f["unit"].alias("unit"))


NUMERIC_CASES = (
    ("12'-6\"", 150.0), ("12'6\"", 150.0), ("12'", 144.0), ("1-1/2", 1.5), ("3/4\"", 0.75), ("1,234", 1234.0), ("245 SF", 245.0), ("3.5", 3.5), ("12 SF", 12.0),
    ("1, 2, 3", None), ("2 to 4", None), ("1 and 2", None), ("W-L-2546", None), ("FCU-1", None), ("NTS", None), ("1/4\" = 1'-0\"", None), ("5 EACH", None),
    ("EL: 100", None), ("2.5%", None), ("Scale 10", None), ("-4", None), ("", None), ("Multiple", None), ("12-6", 12.0), ("A1-2", None), ("1,250.75 LF", 1250.75),
)


@_query(
    "WITH c AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, '" + t.replace("'", "''") + "', " + ("CAST(NULL AS DOUBLE)" if v is None else f"CAST({v} AS DOUBLE)") + ")" for k, (t, v) in enumerate(NUMERIC_CASES))
    + f") AS v(k, value_text, value)) SELECT p_partkey, value_text, value FROM part JOIN c ON k = (p_partkey + p_size) % {len(NUMERIC_CASES)}"
)
def parse_numeric(spark, sf_dir):
    """every part has one of the odd cells; the expected values stand in the SQL"""
    texts = F.array(*(F.lit(t) for t, _ in NUMERIC_CASES))
    cell = F.get(texts, ((F.col("p_partkey") + F.col("p_size")) % len(NUMERIC_CASES)).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", cell.alias("value_text"), numeric.parse_numeric(cell).alias("value"))


@_query("""
SELECT p_partkey, CAST(CASE p_partkey % 7 WHEN 0 THEN p_size WHEN 1 THEN 12 * p_size + p_size % 12 WHEN 2 THEN p_size * 1000 WHEN 5 THEN p_size + (p_size % 5 + 1) / 8 WHEN 6 THEN round(p_retailprice, 2) END AS DOUBLE) AS value FROM part
""")
def numeric_cells(spark, sf_dir):
    """F1 over a whole table: with units, feet and inches, thousands, names, percentages, mixed fractions, plain"""
    size, k = F.col("p_size"), F.col("p_partkey") % 7
    cells = (
        F.when(k == 0, F.concat(size, F.lit(" SF"))).when(k == 1, F.concat(size, F.lit("'-"), size % 12, F.lit('"'))).when(k == 2, F.format_number(size * 1000, 0)).when(k == 3, F.col("p_name"))
        .when(k == 4, F.concat(size, F.lit(" %"))).when(k == 5, F.concat(size, F.lit("-"), size % 5 + 1, F.lit("/8"))).otherwise(F.round("p_retailprice", 2).cast("decimal(20,2)").cast("string"))
    )
    return _t(spark, sf_dir, "part").select("p_partkey", numeric.parse_numeric(cells).alias("value"))


@_query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ft' WHEN 'O' THEN 'ea' WHEN 'P' THEN 'gallons' ELSE lower(o_orderstatus) END AS unit FROM orders")
def convert_units(spark, sf_dir):
    """F3"""
    code = numeric.literal_map({"F": "Feet", "O": " EACH ", "P": "gal"})[F.col("o_orderstatus")]
    return _t(spark, sf_dir, "orders").select("o_orderkey", numeric.unit_name(F.coalesce(code, F.col("o_orderstatus"))).alias("unit"))


@_query("""
WITH x AS (
  SELECT p_type AS name, l_quantity AS q, l_returnflag AS unit, l_linestatus AS kind, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate) AS ord,
    CASE WHEN l_discount > 0.05 THEN 'legend' ELSE '' END AS source, 'S' || CAST(l_suppkey % 5 AS VARCHAR) AS sheet, l_tax > 0.07 AS review,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE NULL END AS conf, l_tax < 0.08 AS auto
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT name, round(sum(q), 6) AS quantity, arg_max(unit, ord) AS unit, arg_max(kind, ord) AS item_type, arg_min(source, ord) FILTER (source <> '') AS source,
  string_agg(DISTINCT sheet, ',' ORDER BY sheet) AS source_sheets, count(q) AS line_count, bool_or(review) AS needs_review, bool_and(auto) AND NOT bool_or(review) AS auto_verified,
  CASE min(conf) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS confidence
FROM x GROUP BY name
""")
def canonical_aggregate(spark, sf_dir):
    """A1, A2"""
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(
        F.col("p_type").alias("name"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("unit"), F.col("l_linestatus").alias("item_type"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate",
        F.when(F.col("l_discount") > 0.05, "legend").otherwise("").alias("source"), F.concat(F.lit("S"), F.col("l_suppkey") % 5).alias("sheet"), (F.col("l_tax") > 0.07).alias("needs_review"),
        F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "high").alias("confidence"), (F.col("l_tax") < 0.08).alias("auto_verified"), F.lit(None).cast("string").alias("review_reason"),
    )
    out = aggregate.roll_up(rows, ["name"], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"])
    return out.withColumn("source_sheets", F.array_join("source_sheets", ",")).drop("review_reasons")


@_query("""
WITH n AS (SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN p_size % 3 = 0 THEN '-H' ELSE '' END AS name FROM part),
c AS (SELECT DISTINCT split_part(replace(p_name, ' ', '-'), '-', 1) AS c FROM part WHERE p_name LIKE 'cold%' UNION SELECT DISTINCT replace(p_name, ' ', '-') || '-H' FROM part WHERE p_name LIKE 'large%')
SELECT p_partkey, name FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c = name OR starts_with(name, c || '-') OR starts_with(c, name || '-'))
""")
def suppress_legend(spark, sf_dir):
    """J6"""
    part = _t(spark, sf_dir, "part").withColumn("dashed", F.replace("p_name", F.lit(" "), F.lit("-")))
    rows = part.select("p_partkey", F.concat("dashed", F.when(F.col("p_size") % 3 == 0, "-H").otherwise("")).alias("name"))
    heads = part.where("p_name LIKE 'cold%'").select(F.split("dashed", "-")[0].alias("name"))
    return match.suppressed(rows, heads.union(part.where("p_name LIKE 'large%'").select(F.concat("dashed", F.lit("-H")))))


@_query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_shipdate::DATE - DATE '1990-01-01' WHEN -1 THEN '' ELSE ['flooring','cmu_wall','sealed_concrete','doors'][1 + (l_partkey % 4)] END AS kind, l_returnflag = 'A' AS sched FROM lineitem),
s AS (SELECT l_orderkey, list(DISTINCT kind) AS kinds FROM x WHERE sched GROUP BY l_orderkey)
SELECT x.l_orderkey, l_linenumber, kind FROM x LEFT JOIN s USING (l_orderkey)
WHERE sched OR NOT coalesce((kind = 'flooring' AND (list_contains(kinds, 'flooring') OR list_contains(kinds, 'cmu_wall') OR list_contains(kinds, 'sealed_concrete'))) OR (kind <> 'doors' AND list_contains(kinds, kind)), false)
""")
def suppress_profile(spark, sf_dir):
    """J7"""
    kinds = F.array(*map(F.lit, ("flooring", "cmu_wall", "sealed_concrete", "doors")))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.get(kinds, (F.col("l_partkey") % 4).cast("int")).alias("item_type"), F.when(F.col("l_returnflag") == "A", "schedule").alias("qty_source"))
    return estimate.without_profile_duplicates(rows, "l_orderkey").select("l_orderkey", "l_linenumber", F.col("item_type").alias("kind"))


MANIFEST = (("Bolt Large", "EA", ["large bolts"], 0), ("Cold Widget", "EA", ["chilled widget", "widget cold"], 1), ("Plate", "SF", [], 2), ("Gear Assembly", "LF", ["gears"], 3), ("Unicorn Saddle", "EA", [], 4))


def _manifest(spark):
    return spark.createDataFrame(list(MANIFEST), "entry string, entry_unit string, aliases array<string>, ord int")


_TOKENS_SQL = "list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(lower({0}), '[-_/ ''\".,()]+'), lambda w: w <> '' AND w NOT IN ('a','alt','an','and','assembly','at','ea','for','in','of','on','system','the','to','total','typ')), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[1:-2] ELSE w END)))"
_RESOLVE_SQL = f"""
WITH n AS (SELECT DISTINCT p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'EA' ELSE 'SF' END AS unit FROM part), e AS (
  SELECT entry, entry_unit, ord, unnest(phrases) AS phrase FROM (VALUES
    ('Bolt Large', 'EA', ['large bolts', 'Bolt Large'], 0), ('Cold Widget', 'EA', ['chilled widget', 'widget cold', 'Cold Widget'], 1),
    ('Plate', 'SF', ['Plate'], 2), ('Gear Assembly', 'LF', ['gears', 'Gear Assembly'], 3), ('Unicorn Saddle', 'EA', ['Unicorn Saddle'], 4)) AS v(entry, entry_unit, phrases, ord)
), s AS (
  SELECT name, unit, entry, entry_unit, ord, CASE WHEN a = b THEN 1.0 WHEN len(list_filter(a, lambda w: NOT list_contains(b, w))) = 0 OR len(list_filter(b, lambda w: NOT list_contains(a, w))) = 0 THEN 0.9
    ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS score
  FROM (SELECT *, {_TOKENS_SQL.format("name")} AS a, {_TOKENS_SQL.format("phrase")} AS b FROM n, e) WHERE len(a) > 0 AND len(b) > 0
)"""


@_query(
    _RESOLVE_SQL
    + """ SELECT name, unit, entry, entry_unit, CAST(score AS DOUBLE) AS score FROM s WHERE score >= 0.62
QUALIFY row_number() OVER (PARTITION BY name, unit ORDER BY round(score, 3) DESC, CASE WHEN unit = entry_unit THEN 1 ELSE 0 END DESC, length(entry) DESC, ord, score DESC) = 1"""
)
def resolve_similarity(spark, sf_dir):
    """J4"""
    names = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "EA").otherwise("SF").alias("unit"))
    return match.resolve_names(names, _manifest(spark))


@_query(_RESOLVE_SQL + " SELECT DISTINCT entry FROM e WHERE entry NOT IN (SELECT entry FROM s WHERE score >= 0.62)")
def completeness_missing(spark, sf_dir):
    """J5, A4"""
    return match.missing_entries(_manifest(spark), _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"))).select("entry")


@_query("""
WITH i AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' in' AS k FROM lineitem),
t AS (SELECT p_brand AS tab, CAST(p_size AS VARCHAR) || ' in' AS k, p_type || ' ' || CAST(p_partkey AS VARCHAR) AS spec, p_partkey FROM part),
l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY tab, k ORDER BY p_partkey DESC) = 1),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY k ORDER BY tab) = 1)
SELECT l_orderkey, l_linenumber, tab AS table_name, spec FROM i LEFT JOIN f USING (k)
""")
def spec_lookup(spark, sf_dir):
    """J8"""
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lookup.inch_key(F.concat(F.lit("pipe "), F.col("l_quantity").cast("bigint"), F.lit('" dia'))).alias("lookup_key"))
    specs = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("table_name"), F.col("p_brand").alias("table_ord"), lookup.inch_key(F.concat("p_size", F.lit(" inch"))).alias("lookup_key"), F.concat_ws(" ", "p_type", "p_partkey").alias("spec"), F.col("p_partkey").alias("row_ord"))
    return lookup.spec_lookup(items, specs).select("l_orderkey", "l_linenumber", "table_name", "spec")


@_query("""
WITH s AS (SELECT n_regionkey AS project, n_nationkey AS sheet, upper(replace(replace(n_name, ' ', ''), '_', '')) AS label FROM nation),
r AS (SELECT c_custkey AS ref_id, n_regionkey AS project, CAST(c_custkey % 7 AS VARCHAR) AS num, CASE WHEN c_custkey % 4 = 0 THEN 'QQ' ELSE upper(substr(n_name, 1 + CAST(c_custkey % 3 AS INT), 3)) END AS want FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT ref_id, project, num, sheet FROM (SELECT *, replace(replace(want, ' ', ''), '_', '') AS w FROM r) JOIN s USING (project) WHERE w <> '' AND contains(label, w) QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY sheet) = 1),
d AS (SELECT s_nationkey AS sheet, min(s_suppkey) AS m, 'Detail ' || CAST(s_suppkey % 10 AS VARCHAR) AS txt FROM supplier GROUP BY s_nationkey, s_suppkey % 10),
f AS (SELECT ref_id, txt AS detail FROM t JOIN d USING (sheet) WHERE contains(txt, num) QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY m) = 1)
SELECT r.ref_id, t.sheet, f.detail, CASE WHEN t.sheet IS NULL THEN 'target_sheet_not_found' WHEN f.detail IS NULL THEN 'target_found_detail_missing' ELSE 'resolved' END AS status
FROM r LEFT JOIN t USING (ref_id) LEFT JOIN f USING (ref_id)
""")
def crossref_resolve(spark, sf_dir):
    """J9, J10"""
    nation = _t(spark, sf_dir, "nation")
    sheets = nation.select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("sheet"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("sheet_ord"))
    want = F.when(F.col("c_custkey") % 4 == 0, "QQ").otherwise(F.substr("n_name", (1 + F.col("c_custkey") % 3).cast("int"), F.lit(3)))
    refs = _t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("project"), F.col("c_custkey").alias("ref_id"), (F.col("c_custkey") % 7).cast("string").alias("ref_number"), want.alias("ref_sheet"))
    supplier = _t(spark, sf_dir, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 10).alias("n")).agg(F.min("s_suppkey").alias("ord"))
    details = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("project"), F.col("s_nationkey").alias("sheet"), F.lit(0).alias("prio"), "ord", F.concat(F.lit("Detail "), "n").alias("text"))
    return lookup.cross_references(refs, sheets, details).select("ref_id", "sheet", "detail", "status")


@_query("""
WITH c AS (SELECT s_nationkey AS g, s_suppkey AS page_id, regexp_replace(upper(s_name), '[\\s._-]+', '', 'g') AS name FROM supplier),
r AS (SELECT DISTINCT c_nationkey AS g, upper(trim('Supplier ' || CAST(c_custkey % 40 AS VARCHAR))) AS ref FROM customer UNION SELECT DISTINCT c_nationkey, CAST(c_custkey % 40 AS VARCHAR) FROM customer),
x AS (SELECT r.g, ref, page_id, length(name) AS n, CASE WHEN starts_with(name, k) THEN 3 WHEN contains(name, k) THEN 2 ELSE 0 END AS score FROM (SELECT *, regexp_replace(ref, '[\\s._-]+', '', 'g') AS k FROM r) AS r JOIN c ON r.g = c.g)
SELECT g, ref, page_id, score FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY g, ref ORDER BY score DESC, n, page_id) = 1
""")
def ref_to_page(spark, sf_dir):
    """J11, A21"""
    customer = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), "c_custkey")
    number = F.col("c_custkey") % 40
    refs = customer.select("g", F.concat(F.lit("Supplier "), number).alias("ref"), F.lit(0).alias("source_ord"), F.col("c_custkey").alias("ord")).union(customer.select("g", number.cast("string"), F.lit(1), "c_custkey"))
    distinct = lookup.unresolved_references(refs, ["g"]).select("g", "ref")
    catalog = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("page_id"), F.col("s_name").alias("sheet_name"))
    return lookup.reference_pages(distinct, catalog, ["g"]).select("g", "ref", "page_id", "score")


@_query("""
WITH m AS (SELECT o_orderkey AS id, o_orderpriority || CAST(o_custkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS q FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT o_orderkey AS id, ' ' || upper(o_orderpriority) || CAST(o_custkey AS VARCHAR) AS name, o_totalprice AS q, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'low' END AS conf FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
f AS (SELECT *, lower(trim(name)) AS k FROM c QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY id) = 1),
b AS (SELECT *, lower(trim(name)) AS k, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY id DESC) = 1 AS last FROM m)
SELECT coalesce(b.id, f.id) AS id, coalesce(b.name, f.name) AS name, CASE WHEN b.id IS NULL OR (last AND b.q IS NULL AND conf = 'high') THEN f.q ELSE b.q END AS quantity,
  CASE WHEN b.id IS NULL THEN 'counted' WHEN last AND b.q IS NULL AND conf = 'high' THEN 'upgraded' ELSE 'measured' END AS merged_from
FROM b FULL JOIN f ON b.k = f.k
""")
def pass_merge(spark, sf_dir):
    """J1"""
    orders = _t(spark, sf_dir, "orders")
    name = F.concat("o_orderpriority", "o_custkey")
    measured = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), name.alias("name"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("quantity"))
    counted = orders.where("o_orderpriority IN ('1-URGENT', '5-LOW')").select(F.col("o_orderkey").alias("id"), F.concat(F.lit(" "), F.upper("o_orderpriority"), "o_custkey").alias("name"), F.col("o_totalprice").alias("quantity"), F.when(F.col("o_orderkey") % 2 == 0, "high").otherwise("low").alias("confidence"))
    return match.pass_merge(measured, counted, "name", "quantity", "id")


@_query("""
WITH b AS (SELECT c_mktsegment AS k, round(sum(c_acctbal), 2) AS q FROM customer GROUP BY 1),
m AS (SELECT c_mktsegment AS k, round(max(c_acctbal), 2) AS q FROM customer WHERE c_nationkey < 10 GROUP BY 1 HAVING c_mktsegment < 'F' UNION ALL SELECT 'new item', 5.0),
o AS (SELECT 'new item' AS k, 7.5 AS q UNION ALL SELECT 'MACHINERY', 1.0)
SELECT k AS item_key, CAST(coalesce(o.q, m.q, b.q) AS DOUBLE) AS quantity, CASE WHEN o.q IS NOT NULL THEN 'human' WHEN m.q IS NOT NULL THEN 'measured' ELSE 'base' END AS source
FROM b FULL JOIN m USING (k) FULL JOIN o USING (k)
""")
def overlay_layers(spark, sf_dir):
    """J14, J15"""
    customer = _t(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "item_key")
    of = lambda df, how, source: df.groupBy("item_key").agg(F.round(how("c_acctbal"), 2).alias("quantity")).withColumn("source", F.lit(source))
    schema = "item_key string, quantity double, source string"
    measured = of(customer.where("c_nationkey < 10 AND item_key < 'F'"), F.max, "measured").union(spark.createDataFrame([("new item", 5.0, "measured")], schema))
    human = spark.createDataFrame([("new item", 7.5, "human"), ("MACHINERY", 1.0, "human")], schema)
    return match.overlay(of(customer, F.sum, "base"), [measured, human], "item_key", ["quantity"])


@_query("""
WITH s AS (SELECT source, unnest([{'t': 'industrial', 's': regexp_matches(lower(text), '\\bthe\\b')::INT + regexp_matches(lower(text), '\\bof\\b')::INT},
  {'t': 'retail', 's': regexp_matches(lower(text), '\\bder\\b')::INT + regexp_matches(lower(text), '\\bund\\b')::INT},
  {'t': 'civil', 's': regexp_matches(lower(text), '\\bque\\b')::INT + regexp_matches(lower(text), '\\bles?\\b')::INT}]) AS x FROM documents),
g AS (SELECT source, x.t AS t, sum(x.s) AS score FROM s GROUP BY ALL),
w AS (SELECT source, max(score) AS score, list(t ORDER BY t) AS ts FROM (SELECT *, max(score) OVER (PARTITION BY source) AS m FROM g) WHERE score = m GROUP BY source)
SELECT source, CASE WHEN score = 0 THEN 'auto' WHEN len(ts) = 1 THEN ts[1] WHEN list_contains(ts, 'industrial') AND score >= 3 THEN 'industrial' ELSE 'mixed_use' END AS project_type, CAST(score AS BIGINT) AS score FROM w
""")
def project_type_argmax(spark, sf_dir):
    """A8"""
    return pages.project_type(_t(spark, sf_dir, "documents").select("source", "text"), ["source"], DOC_KEYWORDS)


@_query("""
SELECT 'order' AS category, CAST(o_orderkey AS VARCHAR) AS sheet, o_orderpriority AS description, CAST(CAST(o_custkey AS BIGINT) AS VARCHAR) AS value FROM orders
UNION ALL SELECT 'line', CAST(l_orderkey AS VARCHAR), l_returnflag, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'event', CAST(user_id AS VARCHAR), event_type, json_extract_string(props, '$.k') FROM events
""")
def flatten_line_items(spark, sf_dir):
    """Uniform rows of three sources, one of them JSON"""
    s = lambda c: F.col(c).cast("string")
    orders = _t(spark, sf_dir, "orders").select(F.lit("order").alias("category"), s("o_orderkey").alias("sheet"), F.col("o_orderpriority").alias("description"), s("o_custkey").alias("value"))
    lines = _t(spark, sf_dir, "lineitem").select(F.lit("line").alias("category"), s("l_orderkey").alias("sheet"), F.col("l_returnflag").alias("description"), F.col("l_quantity").cast("bigint").cast("string").alias("value"))
    events = _t(spark, sf_dir, "events").select(F.lit("event").alias("category"), s("user_id").alias("sheet"), F.col("event_type").alias("description"), F.get_json_object("props", "$.k").alias("value"))
    return orders.unionByName(lines).unionByName(events)


@_query("SELECT l_orderkey, l_linenumber, l_quantity AS quantity FROM lineitem WHERE (l_returnflag = 'A' AND (l_quantity < 5 OR l_quantity > 45)) OR (l_returnflag = 'R' AND (l_quantity < 2 OR l_quantity > 30))")
def sanity_flags(spark, sf_dir):
    """P13"""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("unit"))
    return estimate.sanity_flags(rows, {"a": (5, 45), "r": (2, 30)}).select("l_orderkey", "l_linenumber", "quantity")


def _points(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 64).cast("array<double>").alias("e"))
    pair = lambda i: F.struct(F.round(F.get("e", 2 * i), 4).alias("x"), F.round(F.get("e", 2 * i + 1), 4).alias("y"))
    return vectors.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), pair).alias("points"))


_POINTS_SQL = "WITH p AS (SELECT vec_id, list_transform(range(0, 32), lambda i: {'x': round(embedding[2 * i + 1]::DOUBLE, 4), 'y': round(embedding[2 * i + 2]::DOUBLE, 4)}) AS p FROM embeddings)"


@_query(
    _POINTS_SQL
    + """ SELECT vec_id, round(abs(list_sum(list_transform(range(1, 33), lambda i: p[i].x * p[1 + (i % 32)].y - p[1 + (i % 32)].x * p[i].y))) / 2, 4) AS area,
  round(list_sum(list_transform(range(1, 32), lambda i: sqrt((p[i + 1].x - p[i].x) * (p[i + 1].x - p[i].x) + (p[i + 1].y - p[i].y) * (p[i + 1].y - p[i].y)))), 4) AS length FROM p"""
)
def shoelace(spark, sf_dir):
    """F10"""
    p = F.col("points")
    return _points(spark, sf_dir).select("vec_id", F.round(geometry.shoelace_area(p), 4).alias("area"), F.round(geometry.polyline_length(p), 4).alias("length"))


@_query("SELECT p_partkey, round_even((p_retailprice + 0.0137::DOUBLE) * (p_size / 72.0::DOUBLE), 1) AS length_ft, round_even((p_retailprice + 0.0137::DOUBLE) * pow(p_size / 72.0::DOUBLE, 2), 1) AS area_sf FROM part")
def scale_recompute(spark, sf_dir):
    """D21"""
    raw, fpi = F.col("p_retailprice") + 0.0137, F.col("p_size").cast("double")
    return _t(spark, sf_dir, "part").select("p_partkey", geometry.rescaled(raw, fpi, 1).alias("length_ft"), geometry.rescaled(raw, fpi, 2).alias("area_sf"))


@_query("""
WITH s AS (SELECT vec_id, label, (embedding[1]::DOUBLE + embedding[3]::DOUBLE) / 2 AS x, (embedding[2]::DOUBLE + embedding[4]::DOUBLE) / 2 AS y FROM embeddings),
a AS (SELECT vec_id AS anchor, label, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay FROM embeddings WHERE embedding[7] > 0.2::FLOAT)
SELECT label, vec_id AS seg, anchor FROM s JOIN a USING (label) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY (ax - x) * (ax - x) + (ay - y) * (ay - y), anchor) = 1
""")
def nearest_anchor(spark, sf_dir):
    """J19"""
    vectors = _t(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    segments = vectors.select("label", F.col("vec_id").alias("seg"), at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"))
    anchors = vectors.where(F.get("embedding", F.lit(6)) > F.lit(0.2).cast("float")).select("label", F.col("vec_id").alias("anchor"), at(0).alias("ax"), at(1).alias("ay"), F.col("vec_id").alias("ord"))
    return pages.nearest_anchor(segments, anchors, ["label"]).select("label", "seg", "anchor")


@_query("""
WITH r AS (SELECT l_suppkey % 20 AS page, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey % 20) AS n FROM lineitem)
SELECT page, max(CASE WHEN i = least(floor(n * 0.5 / 100), n - 1) THEN v END) AS low, max(CASE WHEN i = least(floor(n * 99.5 / 100), n - 1) THEN v END) AS high, count(*) AS n FROM r GROUP BY page
""")
def trimmed_extent(spark, sf_dir):
    """A12"""
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("page"), F.col("l_extendedprice").alias("v"))
    return aggregate.trimmed_extent(rows, ["page"], "v").select("page", "low", "high", "n")


@_query("""
WITH c AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY ALL)
SELECT p_brand, p_size, n, CAST(n / sum(n) OVER (PARTITION BY p_brand) AS DOUBLE) AS share, n / sum(n) OVER (PARTITION BY p_brand) >= 0.66 AS sure FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, seen) = 1
""")
def mode_share(spark, sf_dir):
    """A11"""
    return aggregate.mode_share(_t(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_partkey")


@_query("SELECT p_type, median(p_retailprice) AS ratio, count(*) AS n FROM part GROUP BY p_type HAVING count(*) >= 3")
def median_ratio(spark, sf_dir):
    """A13"""
    return _t(spark, sf_dir, "part").groupBy("p_type").agg(F.median("p_retailprice").alias("ratio"), F.count("*").alias("n")).where("n >= 3")


@_query("""
WITH c AS (SELECT p_brand AS doc, p_partkey AS row_ord, CASE WHEN p_size % 6 = 0 THEN 'DOOR' ELSE chr(65 + (p_size % 3)) || '-' || CAST(100 + p_size AS VARCHAR) END AS tag,
    ['HM', 'WD', 'GL', 'XX'][1 + CAST(p_partkey % 4 AS INT)] AS panel, ['HM', 'ALUM', 'ZZ'][1 + CAST(p_partkey % 3 AS INT)] AS frame FROM part),
d AS (SELECT * FROM c WHERE tag <> 'DOOR' QUALIFY row_number() OVER (PARTITION BY doc, tag ORDER BY row_ord) = 1)
SELECT doc, kind, material, count(*) AS count FROM (SELECT doc, 'openings' AS kind, '' AS material FROM d UNION ALL SELECT doc, 'panel', panel FROM d WHERE panel <> 'XX' UNION ALL SELECT doc, 'frame', frame FROM d WHERE frame <> 'ZZ') GROUP BY ALL
""")
def door_schedule_counts(spark, sf_dir):
    """A9"""
    pick = lambda words, c: F.get(F.array(*map(F.lit, words)), c.cast("int"))
    tag = F.when(F.col("p_size") % 6 == 0, "DOOR").otherwise(F.concat(F.chr(65 + F.col("p_size") % 3), F.lit("-"), 100 + F.col("p_size")))
    cells = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("row_ord"), tag.alias("tag"), pick(("HM", "WD", "GL", "XX"), F.col("p_partkey") % 4).alias("panel"), pick(("HM", "ALUM", "ZZ"), F.col("p_partkey") % 3).alias("frame"))
    return pages.door_counts(cells, ["doc"])


@_query("""
WITH f AS (SELECT p_type AS tab, unnest([0, 1, 2]) AS col, unnest([p_name, 'D' || CAST(p_size AS VARCHAR), CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'n/a' END]) AS cell FROM part),
g AS (SELECT tab, col, count(*) FILTER (regexp_matches(cell, '^[A-Z]{0,2}[-]?\\d{1,4}[A-Z]?$|^T\\d+[A-Z]?$')) AS hits, count(*) AS rows FROM f GROUP BY tab, col)
SELECT * FROM g WHERE hits >= 3 AND hits >= 0.4 * rows QUALIFY row_number() OVER (PARTITION BY tab ORDER BY hits DESC, col) = 1
""")
def column_inference(spark, sf_dir):
    """A10"""
    size = F.col("p_size").cast("string")
    cells = F.array("p_name", F.concat(F.lit("D"), size), F.when(F.col("p_size") % 3 == 0, size).otherwise("n/a"))
    return pages.tag_column(_t(spark, sf_dir, "part").select(F.col("p_type").alias("tab"), cells.alias("cells")), ["tab"])


@_query("""
WITH l AS (SELECT p_partkey, 1 AS n, p_name AS item, CAST(p_size AS DOUBLE) AS quantity, 'EA' AS unit FROM part UNION ALL SELECT p_partkey, 2, p_brand || ' run', p_retailprice, 'LF' FROM part)
SELECT p_partkey, item, quantity, unit FROM l
""")
def legend_text_lines(spark, sf_dir):
    """D14"""
    line = F.concat_ws("\n", F.lit("TAKE-OFF 2024:"), "p_name", F.lit(""), F.concat("p_size", F.lit(" EA")), F.lit("general notes"), F.concat("p_brand", F.lit(" run "), F.col("p_retailprice").cast("decimal(20,2)"), F.lit(" LF")))
    found = pages.legend_lines(_t(spark, sf_dir, "part").select("p_partkey", line.alias("text")), ["p_partkey"])
    return found.select("p_partkey", "item", "quantity", "unit")


@_query("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def page_history(spark, sf_dir):
    """O1-O6"""
    page = history.history_page(_t(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 50, 20, F.col("o_orderstatus") == "F")
    return page.select("o_orderkey", "o_orderdate", "o_orderpriority")


@_query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def top1_per_group(spark, sf_dir):
    """S3, S16"""
    return match.first_rows(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY lower(l_returnflag), upper(l_linestatus), round(l_quantity, 2), l_suppkey ORDER BY l_orderkey, l_linenumber) = 1")
def dedupe_first(spark, sf_dir):
    """A20"""
    keys = [F.lower("l_returnflag"), F.upper("l_linestatus"), F.round("l_quantity", 2), "l_suppkey"]
    return match.first_rows(_t(spark, sf_dir, "lineitem"), keys, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@_query("SELECT event_id, epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) <= 72 * 3600000000 AS fresh, (epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) / 1e6 AS age_sec FROM events")
def freshness(spark, sf_dir):
    """F19, F20"""
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return _t(spark, sf_dir, "events").select("event_id", history.fresh(F.col("ts"), now, 72).alias("fresh"), history.duration_seconds(F.col("ts"), now).alias("age_sec"))


@_query("""
WITH s AS (SELECT n_regionkey AS project, n_nationkey AS folder_id, n_name AS name, n_nationkey % 3 AS sheet_count FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey + 100, 'Plans ' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 3 ELSE 9 END FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey + 200, CASE WHEN n_nationkey % 2 = 0 THEN 'Trash' ELSE n_name || ' v1 v2' END, 1 FROM nation)
SELECT project, folder_id, name FROM s WHERE lower(name) <> 'trash' AND NOT (lower(name) LIKE '% v1%' AND lower(name) LIKE '% v2%')
  AND NOT EXISTS (SELECT 1 FROM s AS o WHERE o.project = s.project AND 'plans ' || lower(o.name) = lower(s.name) AND o.sheet_count = s.sheet_count AND o.folder_id <> s.folder_id AND o.folder_id < 100)
""")
def plan_set_normalise(spark, sf_dir):
    """P23"""
    nation = _t(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    of = lambda id_, name, n: nation.select(F.col("n_regionkey").alias("project"), id_.alias("folder_id"), name.alias("name"), n.cast("int").alias("sheet_count"))
    sets = of(key, F.col("n_name"), key % 3).union(of(key + 100, F.concat(F.lit("Plans "), "n_name"), F.when(key % 2 == 0, key % 3).otherwise(9)))
    sets = sets.union(of(key + 200, F.when(key % 2 == 0, "Trash").otherwise(F.concat("n_name", F.lit(" v1 v2"))), F.lit(1)))
    return lookup.normalised_plan_sets(sets, ["trash"]).select("project", "folder_id", "name")


@_query("""
WITH g AS (SELECT p_brand AS project, p_name AS item, CAST(sum(p_size) AS DOUBLE) AS q FROM part GROUP BY ALL),
s AS (SELECT project, CASE WHEN length(item) % 3 = 0 THEN upper(item) WHEN length(item) % 3 = 1 THEN replace(item, ' ', '-') ELSE 'other ' || item END AS item, q + CASE WHEN q > 40 THEN 2 ELSE 0 END AS q FROM g)
SELECT project, count(*) AS n, round(avg((length(item) % 3 < 2)::INT::DOUBLE), 4) AS name_found_rate, round(avg((length(item) % 3 < 2 AND CASE WHEN length(item) % 2 = 0 THEN q <= 40 ELSE CASE WHEN q > 40 THEN 2 ELSE 0 END <= q * 3 / 100 END)::INT::DOUBLE), 4) AS quantity_ok_rate FROM g GROUP BY project
""")
def golden_score(spark, sf_dir):
    """J16, A16 without character similarity"""
    golden = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("project"), F.col("p_name").alias("item_name")).agg(F.sum("p_size").cast("double").alias("quantity"))
    n = F.length("item_name")
    golden = golden.withColumns({"match_mode": F.when(n % 2 == 0, "exact_or_within_1").otherwise("pct"), "tolerance_pct": F.lit(3.0)})
    item = F.when(n % 3 == 0, F.upper("item_name")).when(n % 3 == 1, F.replace("item_name", F.lit(" "), F.lit("-"))).otherwise(F.concat(F.lit("other "), "item_name"))
    summary = golden.select("project", item.alias("item"), (F.col("quantity") + F.when(F.col("quantity") > 40, 2).otherwise(0)).alias("quantity"), F.lit("EA").alias("unit"))
    return scoring.rates(scoring.judged(scoring.matched(golden, summary, ["project"], fuzzy=False)), ["project"])


def _golden(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("project"), F.col("p_name").alias("item_name")).agg(F.sum("p_size").cast("double").alias("quantity"))


@_query()
def golden_fuzzy(spark, sf_dir):
    """J16 with Ratcliff-Obershelp similarity, which SQL lacks; tests hold it against difflib"""
    golden = _golden(spark, sf_dir)
    summary = golden.select("project", F.concat("item_name", F.lit("s")).alias("item"), "quantity", F.lit("EA").alias("unit"))
    return scoring.matched(golden, summary, ["project"]).select("project", "item_name", "found", "found_quantity")


@_query()
def similar_names(spark, sf_dir):
    """F16 over one large group: every supplier-like name against all sheet names of the catalogue; tests hold it against difflib"""
    asked = _t(spark, sf_dir, "part").select(F.lit(1).alias("project"), F.reverse("p_name").alias("a"))
    known = _t(spark, sf_dir, "customer").select(F.lit(1).alias("project"), F.concat_ws(" ", F.lower("c_mktsegment"), F.col("c_custkey") % 997).alias("b"))
    return similar.most_similar(asked, known.unionByName(_t(spark, sf_dir, "part").select(F.lit(1).alias("project"), F.concat_ws(" ", "p_name", "p_size").alias("b"))), ["project"], 0.4)


@_query()
def benchmark_matches(spark, sf_dir):
    """Contained words first, else words or characters; tests hold it against a plain loop"""
    golden = _golden(spark, sf_dir)
    n = F.length("item_name") % 4
    item = F.when(n == 0, F.concat(F.lit("new "), "item_name")).when(n == 1, F.reverse("item_name")).when(n == 2, F.concat("item_name", F.lit("es"))).otherwise(F.upper("item_name"))
    summary = golden.select("project", item.alias("item"), "quantity", F.xxhash64("item_name").alias("ord"))
    return scoring.token_matched(golden, summary, ["project"]).select("project", "item_name", "found", "found_quantity")


@_query("""
WITH g AS (SELECT DISTINCT p_brand AS project, p_name AS item FROM part)
SELECT project, CASE WHEN length(item) % 3 = 0 THEN upper(item) ELSE item || ' 9' END AS item FROM g WHERE length(item) % 3 <> 0
""")
def extra_items(spark, sf_dir):
    """Summary rows that no golden item was matched with, by names alone"""
    golden = _golden(spark, sf_dir)
    summary = golden.select("project", F.when(F.length("item_name") % 3 == 0, F.upper("item_name")).otherwise(F.concat("item_name", F.lit(" 9"))).alias("item"), "quantity", F.lit("EA").alias("unit"))
    return scoring.extra_rows(summary, scoring.matched(golden, summary, ["project"], fuzzy=False), ["project"]).select("project", "item")


_LINKED_SQL = """
WITH r AS (SELECT c_nationkey AS g, CASE c_custkey % 4 WHEN 0 THEN 'C-' || (c_custkey % 50) WHEN 1 THEN 'c.' || (c_custkey % 50) WHEN 2 THEN 'A/' || (c_custkey % 7) ELSE 'CC-' || (c_custkey % 50) || 'X' END AS ref, c_custkey FROM customer),
asked AS (SELECT g, upper(ref) AS ref, replace(replace(upper(ref), '/', '-'), '.', '-') AS n, c_custkey FROM r QUALIFY row_number() OVER (PARTITION BY g, upper(ref) ORDER BY c_custkey) = 1),
names AS (SELECT s_nationkey AS g, s_suppkey AS page_id, CASE WHEN s_suppkey % 3 = 0 THEN 'C-' || (s_suppkey % 50) || ' - PLAN' WHEN s_suppkey % 3 = 1 THEN 'DETAILS C-' || (s_suppkey % 50) ELSE 'A/' || (s_suppkey % 7) || '1 SECTION' END AS sheet_name FROM supplier),
k AS (SELECT *, replace(replace(upper(sheet_name), '/', '-'), '.', '-') AS name FROM names),
m AS (SELECT asked.*, page_id, sheet_name, CASE WHEN split_part(name, ' - ', 1) = n THEN 3 ELSE 2 END AS score FROM asked JOIN k USING (g) WHERE contains(name, n)),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY g, ref ORDER BY score DESC, length(sheet_name), page_id) = 1)
"""


def _linked(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    label = F.when(k % 4 == 0, F.concat(F.lit("C-"), k % 50)).when(k % 4 == 1, F.concat(F.lit("c."), k % 50)).when(k % 4 == 2, F.concat(F.lit("A/"), k % 7)).otherwise(F.concat(F.lit("CC-"), k % 50, F.lit("X")))
    refs = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), label.alias("ref"), F.concat(F.lit("S"), k).alias("from_sheet"), F.lit(0).alias("source_ord"), k.alias("ord"))
    name = F.when(s % 3 == 0, F.concat(F.lit("C-"), s % 50, F.lit(" - PLAN"))).when(s % 3 == 1, F.concat(F.lit("DETAILS C-"), s % 50)).otherwise(F.concat(F.lit("A/"), s % 7, F.lit("1 SECTION")))
    return refs, _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), s.alias("page_id"), name.alias("sheet_name"))


@_query(_LINKED_SQL + "SELECT g, ref, page_id, score FROM best")
def held_references(spark, sf_dir):
    """C-4 within C-41, slashes and dots, equal names first"""
    refs, catalog = _linked(spark, sf_dir)
    return lookup.reference_pages(lookup.unresolved_references(refs, ["g"]), catalog, ["g"]).select("g", "ref", "page_id", "score")


@_query(
    _LINKED_SQL
    + """, fresh AS (SELECT * FROM best WHERE page_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY g, page_id ORDER BY c_custkey) = 1),
ranked AS (SELECT g, page_id, sheet_name, 'S' || c_custkey AS ref_from, row_number() OVER (PARTITION BY g ORDER BY c_custkey, page_id) AS place FROM fresh)
SELECT g, page_id, sheet_name, ref_from, CAST(place AS INT) AS place, g % 2 = 1 AS suggested_only FROM ranked WHERE place <= 10"""
)
def linked_queue(spark, sf_dir):
    """Pages not in the run yet, the first ten of a project, included or only suggested"""
    refs, catalog = _linked(spark, sf_dir)
    in_run = catalog.where("page_id % 5 = 0").select("g", "page_id")
    of = lambda odd, include: lookup.linked_sheets(refs.where(F.col("g") % 2 == odd), catalog, in_run, ["g"], 10, include)
    return of(0, True).unionByName(of(1, False))


@_query()
def near_references(spark, sf_dir):
    """J11's fallback: misspelt references and the names most like them; tests hold it against difflib"""
    refs, catalog = _linked(spark, sf_dir)
    misspelt = refs.withColumn("ref", F.concat(F.lit("Q"), "ref")).select("g", "ref").distinct()
    return lookup.near_references(misspelt, catalog, ["g"])


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_rows(spark, sf_dir):
    """S1, F24"""
    parsed = _t(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return parsed.where("p.k IS NOT NULL").select("event_id", F.col("p.k").alias("k"), "event_type")


@_query("SELECT coalesce(nullif(l_returnflag, ''), 'unknown') AS \"group\", count(*) AS n FROM lineitem GROUP BY 1")
def group_count_items(spark, sf_dir):
    """A5: counts; a report's listed items are a bounded report's own"""
    key = F.coalesce(F.nullif("l_returnflag", F.lit("")), F.lit("unknown"))
    return _t(spark, sf_dir, "lineitem").groupBy(key.alias("group")).agg(F.count("*").alias("n"))


@_query("""
SELECT p_type, count(*) AS n, count(*) FILTER (p_size % 4 = 0 OR p_size > 40) AS n_review, round(100 * (count(*) - count(*) FILTER (p_size % 4 = 0 OR p_size > 40)) / count(*), 1) AS pct_verified FROM part GROUP BY p_type
""")
def review_counts(spark, sf_dir):
    """P18, A17"""
    rows = _t(spark, sf_dir, "part").select("p_type", F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("quantity"), (F.col("p_size") > 40).alias("needs_review"))
    return history.review_counts(rows, ["p_type"])


@_query("SELECT doc_id, regexp_replace(upper(source || '-' || lang || '. 1'), '[\\s._-]+', '', 'g') AS key FROM documents")
def sheet_keys(spark, sf_dir):
    """F15"""
    return _t(spark, sf_dir, "documents").select("doc_id", text.sheet_key(F.concat("source", F.lit("-"), "lang", F.lit(". 1"))).alias("key"))
