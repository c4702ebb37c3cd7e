"""The stored catalog, old cache files and progress feeds over the test tables: each query writes its tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import shared_path
from ..sources import extraction, store
from ..streaming import feed
from .registry import query, table


def _synced(spark, sf_dir):
    """A store after two syncs: nations are plan sets, suppliers their plans; then the sets of region 1 are synced anew."""
    path = shared_path(spark, "catalog")
    stamp = F.lit("2024-01-15 00:00:00").cast("timestamp")
    region = table(spark, sf_dir, "region")
    store.upsert_projects(region.where("r_regionkey != 4").select(F.col("r_regionkey").alias("project"), F.col("r_name").alias("name")), path)
    nation = table(spark, sf_dir, "nation")
    sets = nation.select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("folder"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("name"), F.lit(None).cast("long").alias("sheet_count"), stamp.alias("synced_at"))
    store.synced_plan_sets(sets, path)
    store.synced_plan_sets(sets.where("project = 1 AND folder % 2 = 0").withColumn("name", F.lit("again")), path)
    suppliers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    plans = suppliers.select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("folder"), F.col("s_suppkey").alias("page_id"), F.col("s_name").alias("sheet_name"), F.col("s_suppkey").cast("int").alias("ord"), stamp.alias("synced_at"))
    store.synced_plans(plans, path)
    # Folders divisible by three lose their odd pages; the rest stays as it was.
    store.synced_plans(plans.where("folder % 3 = 0 AND page_id % 2 = 0"), path)
    return path


_STORE_SQL = """
WITH sets AS (SELECT n_regionkey AS project, n_nationkey AS folder, CASE WHEN n_regionkey = 1 THEN 'again' WHEN n_nationkey % 4 = 0 THEN 'Folder_' || n_nationkey ELSE n_name END AS name FROM nation WHERE n_regionkey <> 1 OR n_nationkey % 2 = 0),
p AS (SELECT n_regionkey AS project, n_nationkey AS folder, s_suppkey AS page_id, s_name AS sheet_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE n_nationkey % 3 <> 0 OR s_suppkey % 2 = 0 OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0))
"""


@query(_STORE_SQL + "SELECT project, folder, name FROM sets")
def stored_plan_sets(spark, sf_dir):
    """A project's plan sets replaced as a whole, others kept, names made up where there is none"""
    path = _synced(spark, sf_dir)
    return store.read(spark, path, "plan_sets").select("project", "folder", "name")


@query(_STORE_SQL + "SELECT project, folder, page_id, sheet_name, TIMESTAMP '2024-01-15 00:00:00' = max(TIMESTAMP '2024-01-15 00:00:00') OVER (PARTITION BY project, folder) AS fresh FROM p")
def stored_plans(spark, sf_dir):
    """Dynamic partition overwrite by project and folder"""
    path = _synced(spark, sf_dir)
    rows = store.read(spark, path, "plans").join(store.last_sync(spark, path).withColumnRenamed("synced_at", "last"), ["project", "folder"])
    return rows.select("project", "folder", "page_id", "sheet_name", (F.col("synced_at") == F.col("last")).alias("fresh"))


@query(
    _STORE_SQL
    + """SELECT r_regionkey AS project, CASE WHEN r_regionkey = 4 THEN 'Project_4' ELSE r_name END AS name, (SELECT nullif(count(*), 0) FROM p WHERE project = r_regionkey) AS sheet_count, (SELECT count(*) FROM sets WHERE project = r_regionkey) AS plan_set_count FROM region"""
)
def stored_projects(spark, sf_dir):
    """Names that are known stay, counts follow the syncs"""
    path = _synced(spark, sf_dir)
    return store.listed_projects(spark, path).join(store.sheet_counts(spark, path).select("project"), "project", "left_semi").select("project", "name", "sheet_count", "plan_set_count")


@query("SELECT n_nationkey AS project, n_name AS name, CAST(NULL AS BIGINT) AS sheet_count, CAST(NULL AS BIGINT) AS plan_set_count, 0::BIGINT AS plans FROM nation")
def migrated_catalog(spark, sf_dir):
    """Q4: version 1 to version 2: columns added, counts forgotten, plans to be synced anew"""
    path = shared_path(spark, "catalog")
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    store.upsert_projects(nation.select(F.col("n_nationkey").alias("project"), F.col("n_name").alias("name"), F.lit(7).alias("sheet_count")), path, 1)
    store.replace(supplier.select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("page_id"), F.col("s_name").alias("sheet_name"), F.lit(0).alias("ord"), F.lit(None).alias("synced_at")), path, "plans", 1)
    store.migrate(spark, path)
    plans = store.read(spark, path, "plans").groupBy("project").agg(F.count("*").alias("plans"))
    rows = store.projects(spark, path).join(plans, "project", "left").na.fill(0, ["plans"])
    return rows.select("project", "name", "sheet_count", "plan_set_count", "plans")


@query("SELECT s_nationkey AS project, s_suppkey AS page_id, CASE WHEN s_nationkey % 4 = 3 THEN s_name || ' b' ELSE s_name END AS sheet_name FROM supplier WHERE s_nationkey % 4 <> 0")
def imported_caches(spark, sf_dir):
    """Files once each, names that begin with an underscore never, a later change again"""
    path, source = shared_path(spark, "catalog"), shared_path(spark, "caches")
    supplier = table(spark, sf_dir, "supplier")

    def written(rows, name):
        """One file a project, named as old caches were."""
        lists = rows.groupBy(F.col("s_nationkey").alias("project_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("page_id"), F.col("s_name").alias("sheet_name")))).alias("plans"))
        text = lists.select("project_id", F.to_json(F.struct(F.col("project_id").cast("string").alias("project_id"), F.lit("2024-01-15T00:00:00").alias("fetched_at"), "plans")).alias("value"))
        text.write.partitionBy("project_id").text(f"{source}/{name}")
        # Spark names its files itself; they become caches by their new names.
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for r in lists.select("project_id").collect():  # at most the nations
            folder = fs_path(f"{source}/{name}/project_id={r[0]}")
            part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
            fs.rename(part, fs_path(f"{source}/{'_' if r[0] % 4 == 0 else ''}{r[0]}{name}.json"))

    written(supplier, "")
    store.import_caches(spark, source, path, "2024-01-16")
    store.import_caches(spark, source, path, "2024-01-17")
    written(supplier.where("s_nationkey % 4 = 3").withColumn("s_name", F.concat("s_name", F.lit(" b"))), "b")
    store.import_caches(spark, source, path, "2024-01-18")
    return store.read(spark, path, "plans").select("project", "page_id", "sheet_name")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def kept_feed(spark, sf_dir):
    """The events in three batches, one of them twice, laid over a kept table"""
    path = shared_path(spark, "feed")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    for number, share in ((0, 0), (1, 1), (1, 1), (2, 2)):
        feed.upsert_batch(events.where(F.col("event_id") % 3 == share), number, path, ["user_id"], ["ts", "event_id"])
    return feed.kept(spark, path, events.schema).select("user_id", "event_id", "event_type")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, CAST(count(*) FILTER (l_orderkey % 2 = 0 OR i < n) AS INT) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY i) FILTER (l_orderkey % 2 = 0 OR i < n) AS parts FROM l GROUP BY l_orderkey
""")
def repaired_records(spark, sf_dir):
    """Every odd record breaks off within its last component, and keeps those before it"""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    parts = F.transform("lines", lambda x: F.struct(F.struct(F.lit('a "[{,').alias("b")).alias("extra"), x["l_partkey"].cast("string").alias("name")))
    records = lines.select("l_orderkey", F.to_json(F.struct(F.concat(F.lit("S"), "l_orderkey").alias("sheet"), parts.alias("components"))).alias("text"))
    text = F.col("text")
    # The last component begins with its bracket; all that is left of it is part of its first field.
    last = F.length(F.substring_index(text, '{"extra"', -1))
    cut = F.when(F.col("l_orderkey") % 2 == 0, text).otherwise(F.substring(text, F.lit(1), F.length(text) - last + 9))
    rows = extraction.parsed(records.select("l_orderkey", cut.alias("value")), "value", ["l_orderkey"])
    known = F.filter("components", lambda c: c["name"].isNotNull())
    return rows.where("NOT has_error").select("l_orderkey", F.size(known).alias("n"), F.nullif(F.array_join(F.transform(known, lambda c: c["name"]), ","), F.lit("")).alias("parts"))
