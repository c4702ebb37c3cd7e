"""Catalogs, manifests, runs and files over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, numeric, text
from ..operators import aggregate, catalog, history, lookup, pages, scales, tables
from ..sources import manifest, runs
from ..streaming import feed
from .registry import query, table


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'old') OR contains(lower(p_brand), 'old') OR contains(lower(p_type), 'old')")
def rows_with(spark, sf_dir):
    """P20"""
    return catalog.rows_with(table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", "p_partkey"), " OLD ").select("p_partkey", "p_name")


@query("SELECT DISTINCT l_suppkey AS page_id, l_partkey AS folder_id FROM lineitem WHERE l_returnflag = 'R' AND (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')")
def foreign_pages(spark, sf_dir):
    """P22"""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("folder_id"), F.col("l_suppkey").alias("page_id"), "l_returnflag")
    return catalog.foreign_pages(rows.where("l_returnflag = 'R'").drop("l_returnflag").distinct(), rows.where("l_returnflag != 'R'")).select("page_id", "folder_id")


@query("SELECT s_suppkey AS page, s_name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer) AND s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def selected_pages(spark, sf_dir):
    """S7, P21"""
    known = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey")).distinct(), "s_nationkey", "left_semi")
    return catalog.selected_pages(known.select(F.col("s_suppkey").alias("page"), "s_name"), table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page")))


@query("SELECT p_brand, avg((p_size > 25)::INT) AS share, avg((p_size > 25)::INT) > 0.5 AS placeholders FROM part GROUP BY p_brand")
def placeholder_names(spark, sf_dir):
    """P24"""
    name = F.when(F.col("p_size") > 25, F.concat(F.lit("Project_"), "p_partkey")).otherwise(F.col("p_name"))
    return catalog.mostly_placeholders(table(spark, sf_dir, "part").select("p_brand", name.alias("name")), ["p_brand"])


@query("SELECT row_number() OVER (ORDER BY lower(n), p_partkey) AS place, p_partkey FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part)")
def names_in_order(spark, sf_dir):
    """O1, O2: every name's place, whatever its case"""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return catalog.placed(rows, [F.lower("name"), F.col("p_partkey")]).select("place", "p_partkey")


@query("""
SELECT c, row_number() OVER (ORDER BY c = '', TRY_CAST(replace(c, ',', '') AS DOUBLE) IS NULL, TRY_CAST(replace(c, ',', '') AS DOUBLE), lower(c), c) AS place
FROM (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE format('{:,}', p_size * 100) END AS c FROM part)
""")
def grid_order(spark, sf_dir):
    """Numbers by value, then texts, then empty cells"""
    cell = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise(F.format_number(F.col("p_size") * 100, 0))
    rows = table(spark, sf_dir, "part").select(cell.alias("c")).distinct()
    return catalog.placed(rows, [*catalog.grid_order("c"), F.col("c")]).select("c", "place")


@query("SELECT p_partkey, q FROM (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN CAST(p_retailprice AS VARCHAR) ELSE 'n/a' END AS q, p_retailprice, p_size FROM part) ORDER BY CASE WHEN p_size % 3 > 0 THEN p_retailprice ELSE -1 END DESC, p_partkey LIMIT 60")
def impact_order(spark, sf_dir):
    """O9"""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("q"))
    return rows.orderBy(*catalog.impact_order("q"), "p_partkey").limit(60)


@query("""
WITH s AS (SELECT DISTINCT n_regionkey AS project, c_nationkey AS folder FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000)
SELECT r_regionkey AS project, count(folder) AS plan_sets, CASE count(folder) WHEN 0 THEN 'no_sets_found' WHEN 1 THEN 'single_set' ELSE 'multi_set' END AS pattern FROM region LEFT JOIN s ON r_regionkey = project GROUP BY 1
""")
def audit_patterns(spark, sf_dir):
    """A19"""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sets = rich.select(F.col("n_regionkey").alias("project"), F.col("c_nationkey").alias("folder_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    return catalog.audit_patterns(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("project")), sets)


@query("""
WITH n AS (SELECT c_custkey AS id, 'new ' || c_name AS name, 1 AS synced, 9 AS created FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey + 1000000, c_name, 1, 9 FROM customer WHERE c_acctbal < 0)
SELECT coalesce(n.id, c_custkey) AS id, coalesce(n.name, c_name) AS name, coalesce(n.synced, 0) AS synced, coalesce(CASE WHEN c_custkey IS NOT NULL THEN 0 END, n.created) AS created FROM customer FULL JOIN n ON c_custkey = n.id
""")
def upsert(spark, sf_dir):
    """Q1: what is new wins, but a known row keeps when it was created"""
    customer = table(spark, sf_dir, "customer")
    row = lambda df, id_, name, synced, created: df.select(id_.alias("id"), name.alias("name"), F.lit(synced).alias("synced"), F.lit(created).alias("created"))
    fresh = row(customer.where("c_acctbal > 5000"), F.col("c_custkey"), F.concat(F.lit("new "), "c_name"), 1, 9).union(row(customer.where("c_acctbal < 0"), F.col("c_custkey") + 1_000_000, F.col("c_name"), 1, 9))
    return catalog.upserted(row(customer, F.col("c_custkey"), F.col("c_name"), 0, 0), fresh, ["id"], ["created"])


@query("""
WITH r AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'cancelled' ELSE 'completed' END AS status, CASE WHEN o_custkey % 5 = 0 THEN 'boom' END AS error, o_orderdate AS finished_at FROM orders)
SELECT job_id, CASE WHEN status = 'cancelled' THEN 'cancelled' WHEN error IS NOT NULL THEN 'failed' ELSE 'success' END AS outcome FROM r WHERE finished_at IS NULL OR floor((epoch_us(TIMESTAMP '1998-01-01 00:00:00') - epoch_us(finished_at)) / 86400000000) < 800
""")
def saved_runs(spark, sf_dir):
    """Runs saved over a history of the same jobs, old ones dropped"""
    row = lambda status, error: table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), error.alias("error"), F.lit(None).cast("string").alias("warning"), F.col("o_orderdate").alias("finished_at"))
    runs_ = row(F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("completed"), F.when(F.col("o_custkey") % 5 == 0, "boom")).withColumn("failed_pages", F.lit(0))
    known = row(F.lit("running"), F.lit(None).cast("string")).withColumn("outcome", F.lit(None).cast("string")).where("job_id < 100")
    return catalog.saved_runs(known, runs_, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 800).select("job_id", "outcome")


@query("SELECT s_nationkey AS folder, s_name || ' plans.pdf' AS file, s_name || ' take-off.pdf' AS companion, CAST(2 AS BIGINT) AS shared FROM supplier")
def companions(spark, sf_dir):
    """S11"""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("folder"), F.regexp_replace("s_name", "#", " ").alias("n"), "s_name")
    plans = supplier.select("folder", F.concat("s_name", F.lit(" plans.pdf")).alias("file"))
    files = supplier.select("folder", F.concat("s_name", F.lit(" take-off.pdf")).alias("file")).union(supplier.select("folder", F.concat("s_name", F.lit(" notes.pdf"))))
    return catalog.companions(plans, files).select("folder", "file", "companion", "shared")


@query("SELECT n_regionkey AS project, n_nationkey AS page_id, CASE WHEN n_nationkey % 3 = 0 THEN '_debug_' || n_nationkey || '.png' ELSE '001_' || n_name || '.png' END AS file FROM nation WHERE n_nationkey % 5 <> 0")
def sheet_images(spark, sf_dir):
    """S16"""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("page_id"), F.concat(F.lit(" "), F.upper("n_name")).alias("sheet_name"), "n_name")
    of = lambda df, name, when: df.select("project", name.alias("file"), F.lit(when).alias("modified"))
    kept = nation.where("page_id % 5 != 0")
    files = of(kept, F.concat(F.lit("001_"), "n_name", F.lit(".png")), 1).union(of(kept.where("page_id % 3 = 0"), F.concat(F.lit("_debug_"), "page_id", F.lit(".png")), 2)).union(of(nation, F.lit("notes.txt"), 3))
    return catalog.sheet_images(nation.select("project", "page_id", "sheet_name"), files)


@query("SELECT replace(c_name, '#', '_') || '_20260525_203144' AS folder, replace(replace(c_name, '#', '_'), '_', ' ') AS project, '20260525_203144' AS timestamp FROM customer WHERE c_acctbal > 0")
def listed_reports(spark, sf_dir):
    """S18"""
    folders = table(spark, sf_dir, "customer").select(F.concat(F.replace("c_name", F.lit("#"), F.lit("_")), F.lit("_20260525_203144")).alias("folder"), F.col("c_custkey").alias("created"), (F.col("c_acctbal") > 0).cast("int").alias("n_files"))
    return catalog.listed_reports(folders).select("folder", "project", "timestamp")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CAST(p_size * 1000 AS DOUBLE) WHEN 1 THEN NULL WHEN 2 THEN CAST(p_size AS DOUBLE) END AS quantity FROM part")
def summary_quantities(spark, sf_dir):
    """S17, S19"""
    k = F.col("p_size") % 4
    printed = F.when(k == 0, F.format_number(F.col("p_size") * 1000, 0)).when(k == 1, F.when(F.col("p_size") % 8 == 1, "—").otherwise(" n/a ")).when(k == 2, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("some")
    return table(spark, sf_dir, "part").select("p_partkey", catalog.summary_quantity(printed).alias("quantity"))


@query("""
WITH c AS (SELECT event_type, user_id, event_id % 1000 AS ti, event_id % 77 AS tout, CASE WHEN user_id % 2 = 0 THEN 0.8 ELSE 3.0 END AS pi, CASE WHEN user_id % 2 = 0 THEN 4.0 ELSE 15.0 END AS po FROM events)
SELECT event_type, CAST(sum(ti) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, round(sum((ti * pi + tout * po) / 1e6), 4) AS cost, round(sum((ti * pi + tout * po) / 1e6) / count(*), 4) AS cost_per_sheet FROM c GROUP BY event_type
""")
def usage_cost(spark, sf_dir):
    """F22, A6"""
    model = F.when(F.col("user_id") % 2 == 0, "small-1").otherwise("large-1")
    calls = table(spark, sf_dir, "events").select("event_type", model.alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 77).alias("tokens_out"))
    calls = calls.withColumn("cost", catalog.call_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), {"small": (0.8, 4.0)}))
    return aggregate.usage(calls, ["event_type"]).drop("models")


_ENTRIES_SQL = """
WITH e AS (SELECT p_partkey AS ord, 'Item ' || p_partkey || ' ' || p_name AS entry, CASE WHEN p_size % 2 = 0 THEN 'SF' ELSE '' END AS unit, CASE WHEN p_size % 3 = 0 THEN [p_type, p_brand] WHEN p_size % 3 = 1 THEN [p_type] ELSE [] END AS aliases,
  CASE p_partkey % 5 WHEN 0 THEN 'count' WHEN 1 THEN 'area' WHEN 2 THEN 'length' WHEN 3 THEN 'volume' ELSE 'wall_area' END AS measure, CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS DOUBLE) END AS height, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS scale FROM part)
"""


def _entries(spark, sf_dir):
    """Every part as a row of a manifest, texts and numbers as a spreadsheet has them."""
    size, key = F.col("p_size"), F.col("p_partkey")
    measure = F.get(F.array(*map(F.lit, ("count", "Area", "length", " VOLUME ", "wall_area"))), (key % 5).cast("int"))
    aliases = F.when(size % 3 == 0, F.concat("p_type", F.lit("; "), "p_brand")).when(size % 3 == 1, F.concat("p_type", F.lit("|"))).otherwise("")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("Item "), key, F.lit(" "), "p_name").alias("name"), F.when(size % 2 == 0, "sf").otherwise("").alias("unit"), aliases.alias("aliases"), measure.alias("measure"),
        F.when(size % 7 == 0, size.cast("string")).otherwise("n/a").alias("height_ft"), F.when(size % 4 == 0, size.cast("string")).alias("scale_ft_per_in"), key.alias("ord"),
    )
    return manifest.entries(rows)


@query(_ENTRIES_SQL + """
SELECT entry, '  - ' || array_to_string(list_prepend(entry, aliases), ' / ') || CASE WHEN measure = 'count' THEN '' ELSE ' [' || coalesce(nullif(unit, ''), measure) || ']'
  || CASE WHEN height IS NOT NULL OR scale IS NOT NULL THEN ' (assume ' || concat_ws(', ', 'height_ft=' || CAST(height AS VARCHAR), 'scale_ft_per_in=' || CAST(scale AS VARCHAR)) || ')' ELSE '' END END AS line,
  CASE WHEN measure = 'count' THEN 'count' ELSE 'measure' END AS pass FROM e WHERE measure <> 'wall_area'
""")
def manifest_hints(spark, sf_dir):
    """S3, P25: what each pass is told to look for, over a manifest of all parts"""
    found = _entries(spark, sf_dir)
    return manifest.count_hints(found).withColumn("pass", F.lit("count")).unionByName(manifest.measure_hints(found).withColumn("pass", F.lit("measure"))).drop("ord")


@query(_ENTRIES_SQL + """SELECT measure, arg_min(scale, ord) FILTER (scale IS NOT NULL) AS feet_per_inch, coalesce(max(height), 9.0) AS wall_height FROM e GROUP BY measure""")
def manifest_scalars(spark, sf_dir):
    """The first scale and the greatest height that the entries of each kind assume"""
    return manifest.assumed_scale(_entries(spark, sf_dir), ["measure"])


@query("""
WITH f AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) || '.json' ELSE lower(n_name) || '_phase.csv' END AS file FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT 'default.json'),
s AS (SELECT file, regexp_replace(regexp_replace(file, '\\..*$', ''), '[^a-z0-9]', '', 'g') AS stem FROM f),
p AS (SELECT n_name AS project, file, stem, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS slug FROM nation, s),
x AS (SELECT *, CASE WHEN stem = 'default' THEN 0 WHEN stem = slug THEN 3 WHEN contains(stem, slug) OR contains(slug, stem) THEN 2 END AS score FROM p)
SELECT project, 'm/' || file AS path FROM x WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY score DESC, length(stem) DESC, file DESC) = 1
""")
def manifest_discovery(spark, sf_dir):
    """S5, F15"""
    nation = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 3
    files = nation.where(k == 0).select(F.concat(F.lit("m/"), F.lower("n_name"), F.lit(".json")).alias("path")).union(nation.where(k == 1).select(F.concat(F.lit("m/"), F.lower("n_name"), F.lit("_phase.csv"))))
    files = files.union(spark.createDataFrame([("m/default.json",), ("m/readme.txt",)], "path string"))
    return manifest.discovered(nation.select(F.concat("n_name", F.lit("")).alias("project")), files).select("project", "path")


@query("""
SELECT o_custkey AS project_id, o_orderkey AS page_id, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'failed' ELSE 'pending' END AS capture_status FROM orders
""")
def run_manifests(spark, sf_dir):
    """Written as JSON and read again; what isn't stated is pending"""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed")
    null = lambda name: F.lit(None).cast("string").alias(name)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.lit("P").alias("project_name"), F.lit(1).cast("long").alias("folder_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("sheet_name"), null("screenshot_rel"), status.alias("capture_status"), null("analysis_status"), null("source"))
    return runs.parsed(runs.as_json(rows)).select("project_id", "page_id", "capture_status")


@query("""
WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_id, event_type FROM l
""")
def latest_events(spark, sf_dir):
    """The state that a feed of all events ends in"""
    return feed.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'click')")
def still_to_do(spark, sf_dir):
    """T2, S2"""
    states = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") == "click", "ok").otherwise("failed").alias("status"))
    return feed.still_to_do(table(spark, sf_dir, "customer").select("c_custkey"), states, ["c_custkey"])


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'verified' WHEN p_size % 5 = 1 THEN 'auto' WHEN p_size % 5 = 2 THEN 'measured' WHEN p_size % 5 = 3 THEN 'review' ELSE 'ok' END AS status,
  CASE WHEN p_size >= 25 THEN 95.0::DOUBLE ELSE round(40.0 * 50 / 50 + 50.0 * p_size / 25, 1) END AS progress, round_even(100.0::DOUBLE / p_size * 72, 4) AS feet_per_inch, CASE WHEN p_size % 2 = 0 THEN 'area' ELSE 'count' END AS measure, replace(p_name, ' ', '_') AS slug
FROM part
""")
def small_functions(spark, sf_dir):
    """P19, F11, F14, F15, F21"""
    k, size = F.col("p_size") % 5, F.col("p_size").cast("double")
    status = history.row_status(k == 0, k == 1, F.when(k == 2, "measured_verified"), F.when(k != 3, size), F.lit(False))
    return table(spark, sf_dir, "part").select(
        "p_partkey", status.alias("status"), history.weighted_progress(F.lit(25), F.col("p_size"), F.lit(25)).alias("progress"), geometry.calibrated(size, F.lit(100.0)).alias("feet_per_inch"),
        numeric.measure_of_unit(F.when(F.col("p_size") % 2 == 0, "SF").otherwise("box")).alias("measure"), text.slug(F.col("p_name")).alias("slug"),
    )


@query("""
SELECT l_returnflag AS "group", count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS items FROM lineitem GROUP BY 1
""")
def grouped_rows(spark, sf_dir):
    """A5: members stay rows beside their group's count"""
    rows = aggregate.grouped_items(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"))
    return rows.groupBy("group", "n").agg(F.sum("l_linenumber").alias("items"))


@query("""
WITH s AS (SELECT n_regionkey AS project, n_nationkey AS page, 100::DOUBLE + n_nationkey AS w, 60::DOUBLE + n_nationkey AS d FROM nation)
SELECT project, page, w AS width, d AS depth, w * d AS area FROM s
""")
def page_footprints(spark, sf_dir):
    """A15"""
    nation = table(spark, sf_dir, "nation")
    side = lambda axis, feet: nation.select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("page"), F.lit(axis).alias("axis"), feet.cast("double").alias("feet"))
    key = F.col("n_nationkey")
    dims = side("x", 100 + key).union(side("x", F.lit(20))).union(side("y", 60 + key)).union(side("y", F.lit(10)))
    return pages.footprint(dims, ["project", "page"]).select("project", "page", "width", "depth", "area")


@query("""
SELECT r_regionkey AS project, item, 5000.0::DOUBLE AS quantity, 'SF' AS unit FROM region, (SELECT unnest(['Sealed Concrete', 'Roof Deck']) AS item) WHERE r_regionkey % 2 = 0
""")
def footprint_items(spark, sf_dir):
    """No areas where a companion take-off states them"""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("project"))
    named = spark.createDataFrame([("Sealed Concrete", "SF", [], "area"), ("Roof Deck", None, ["decking"], "Area"), ("CMU Wall", "SF", ["concrete block"], "area"), ("Bollards", "EA", [], "count")], "entry string, entry_unit string, aliases array<string>, measure string")
    items = scales.footprint_items(region.select("project", F.lit(5000.0).alias("area_sf"), F.lit("high").alias("confidence")), region.join(F.broadcast(named)))
    legends = tables.deterministic_legends(items.limit(0).drop("confidence"), items, region.where("project % 2 = 1"))
    return legends.select("project", "item", "quantity", "unit")


@query("""
WITH t AS (SELECT doc_id, regexp_matches(lower(text), 'access\\s+ladder') AS a, regexp_matches(lower(text), '\\bmobilization\\b') AS m FROM documents)
SELECT doc_id, name FROM (SELECT doc_id, 'Access Ladder' AS name FROM t UNION ALL SELECT doc_id, 'Mobilization' FROM t WHERE doc_id % 2 = 0)
""")
def named_in_text(spark, sf_dir):
    """What a text names and its components lack"""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" ACCESS  ladder; Mobilization")).alias("text"))
    have = docs.where("doc_id % 2 = 1").select("doc_id", F.lit("MOBILIZATION").alias("name"))
    return pages.found_in_text(docs, have, ["doc_id"]).select("doc_id", "name")


@query("SELECT n_regionkey AS project, min(n_nationkey) AS sheet_ord FROM nation GROUP BY 1")
def legend_hosts(spark, sf_dir):
    """The sheet that takes a project's legends"""
    sheets = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("sheet_ord"), F.lit("floor_plan").alias("sheet_type"), F.lit(False).alias("skipped"), F.lit(False).alias("has_error"), F.array().cast("array<string>").alias("schedules"))
    legends = sheets.select("project", F.array(F.lit("legend")).alias("legends")).distinct()
    return pages.with_legend(sheets, legends, ["project"]).where("size(schedules) > 0").select("project", "sheet_ord")


@query("SELECT n_regionkey AS project, n_nationkey AS folder_id, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 1 OR n_nationkey % 2 = 0")
def replaced_partitions(spark, sf_dir):
    """Q1: a project's plan sets replaced as a whole"""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("folder_id"), F.col("n_name").alias("name"))
    return lookup.replaced_partitions(nation, nation.where("project = 1 AND folder_id % 2 = 0").withColumn("name", F.lit("new")), ["project"])
