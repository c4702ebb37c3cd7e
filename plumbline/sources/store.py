"""The catalog as stored tables: projects, plan sets and plans, in partitions that a sync replaces as a whole.

A store is a folder with a table `meta` (version) and, for each version, its tables.  Version 1 had
one list of plans a project; version 2 has plan sets, so its plans belong to a folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import first_rows

VERSION = 2
#: Columns of each version's tables; the first `partitions` of plan sets and plans are their folders on disk.
TABLES = {
    1: {"projects": "project long, name string, url string, sheet_count long, plans_synced_at timestamp", "plans": "project long, page_id long, sheet_name string, ord int, synced_at timestamp"},
    2: {
        "projects": "project long, name string, url string, sheet_count long, plans_synced_at timestamp, plan_set_count long",
        "plan_sets": "project long, folder long, name string, sheet_count long, synced_at timestamp",
        "plans": "project long, folder long, page_id long, sheet_name string, ord int, synced_at timestamp",
    },
}
PARTITIONS = {"projects": (), "plan_sets": ("project",), "plans": ("project", "folder")}


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in schema.split(", ")]


def version(spark: SparkSession, path: str) -> int | None:
    """A store's version, none before anything was written."""
    try:
        return spark.read.schema("version int").parquet(f"{path}/meta").agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _mark(spark: SparkSession, path: str, number: int) -> None:
    spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("append").parquet(f"{path}/meta")


def read(spark: SparkSession, path: str, table: str, number: int = VERSION) -> DataFrame:
    """A table of a store, empty before its first write."""
    schema = TABLES[number][table]
    try:
        return spark.read.schema(schema).parquet(f"{path}/v{number}/{table}").select(*(c for c, _ in _columns(schema)))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace(rows: DataFrame, path: str, table: str, number: int = VERSION) -> None:
    """Writes rows in place of whatever the store has of their partitions: of their projects, or projects and folders.

    Other partitions stay as they are.  A repeated write of the same rows changes nothing.
    """
    spark = rows.sparkSession
    parts = PARTITIONS[table] if number == VERSION else ("project",) if table == "plans" else ()
    out = rows.select(*(F.col(c).cast(t).alias(c) for c, t in _columns(TABLES[number][table])))
    if not parts:
        raise ValueError(f"{table} is laid over by key, see upsert_projects")
    out.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/v{number}/{table}")
    if version(spark, path) is None:
        _mark(spark, path, number)


def upsert_projects(rows: DataFrame, path: str, number: int = VERSION) -> None:
    """Adds a layer of project rows; of a project's layers the newest counts column by column, where it says anything."""
    spark = rows.sparkSession
    have = rows.columns
    out = rows.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _columns(TABLES[number]["projects"])), F.current_timestamp().alias("layered_at"))
    out.write.mode("append").parquet(f"{path}/v{number}/projects")
    if version(spark, path) is None:
        _mark(spark, path, number)


def projects(spark: SparkSession, path: str, number: int = VERSION) -> DataFrame:
    """One row a project, out of its layers."""
    schema = TABLES[number]["projects"]
    try:
        layers = spark.read.schema(f"{schema}, layered_at timestamp").parquet(f"{path}/v{number}/projects")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    said = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("layered_at"))).alias(c)
    return layers.groupBy("project").agg(*(said(c) for c, _ in _columns(schema)[1:]))


def migrate(spark: SparkSession, path: str) -> None:
    """Brings a store of version 1 to version 2: projects get the new columns and lose their counts, plans are to be synced anew.

    Version 2 is written beside version 1 and marked last; a migration that dies is simply run again.
    """
    if version(spark, path) != 1:
        return
    old = projects(spark, path, 1)
    grown = old.withColumns({"sheet_count": F.lit(None).cast("long"), "plans_synced_at": F.lit(None).cast("timestamp"), "plan_set_count": F.lit(None).cast("long")})
    grown.withColumn("layered_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/v2/projects")
    _mark(spark, path, VERSION)


def listed_projects(spark: SparkSession, path: str) -> DataFrame:
    """Projects by name, whatever its case."""
    return projects(spark, path).orderBy(F.lower("name"), "project")


def plan_sets(spark: SparkSession, path: str, project: int) -> DataFrame:
    return read(spark, path, "plan_sets").where(F.col("project") == project).orderBy(F.lower("name"), "folder")


def plans(spark: SparkSession, path: str, project: int, folder: int | None = None) -> DataFrame:
    """A project's plans, or those of one folder: only their partitions are read."""
    rows = read(spark, path, "plans").where(F.col("project") == project)
    return (rows if folder is None else rows.where(F.col("folder") == folder)).orderBy("folder", "ord", "page_id")


def sheet_counts(spark: SparkSession, path: str) -> DataFrame:
    """Projects of which sheets or plan sets were counted."""
    return projects(spark, path).where("sheet_count IS NOT NULL OR plan_set_count IS NOT NULL").select("project", "sheet_count", "plan_set_count")


def project_count(spark: SparkSession, path: str) -> int:
    return projects(spark, path).count()


def last_sync(spark: SparkSession, path: str) -> DataFrame:
    """When each folder of each project was synced last."""
    return read(spark, path, "plans").groupBy("project", "folder").agg(F.max("synced_at").alias("synced_at"))


def synced_plan_sets(rows: DataFrame, path: str) -> None:
    """A sync of projects' plan sets (project, folder, name, sheet_count, synced_at): each project's are replaced, and counted.

    A project that the store lacks gets a placeholder's name; a known one keeps its own.
    """
    spark = rows.sparkSession
    replace(rows.withColumn("name", F.coalesce("name", F.concat(F.lit("Folder_"), "folder"))), path, "plan_sets")
    counts = rows.groupBy("project").agg(F.count("*").alias("plan_set_count"))
    named = projects(spark, path).where("name IS NOT NULL").select("project", F.lit(True).alias("known"))
    placeholder = F.when(F.col("known").isNull(), F.concat(F.lit("Project_"), "project"))
    upsert_projects(counts.join(named, "project", "left").select("project", "plan_set_count", placeholder.alias("name")), path)


def synced_plans(rows: DataFrame, path: str) -> None:
    """A sync of folders' plans (project, folder, page_id, sheet_name, ord, synced_at): each folder's are replaced; of a repeated page the last."""
    once = first_rows(rows, ["project", "folder", "page_id"], [F.desc("ord"), "sheet_name"])
    replace(once, path, "plans")
    totals = read(rows.sparkSession, path, "plans").join(rows.select("project").distinct(), "project", "left_semi").groupBy("project").agg(F.count("*").alias("sheet_count"), F.max("synced_at").alias("plans_synced_at"))
    upsert_projects(totals, path)


CACHE = "project_id string, fetched_at timestamp, plans array<struct<page_id:long,sheet_name:string>>"


def import_caches(spark: SparkSession, source: str, path: str, now) -> int:
    """Takes old JSON plan lists (one file a project, named by it) under source into the store, each file once; how many.

    Files taken are listed in the store's ledger, by path and time of change; those already there are left
    out, names that begin with an underscore are skipped, and files that are no such list count as
    taken with nothing in them.  A run that dies before its ledger is written is simply repeated.
    """
    from ..functions.storage import materialised

    try:
        files = spark.read.text(source, wholetext=True, pathGlobFilter="*.json")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    files = files.where(~F.startswith("file_name", F.lit("_")))
    taken = ledger(spark, path).select("file", "modified")
    fresh = materialised(files.join(taken, ["file", "modified"], "left_anti"), "imports")
    if fresh.isEmpty():
        return 0
    parsed = fresh.withColumn("j", F.from_json("value", CACHE))
    stem = F.regexp_extract("file_name", r"^(.*)\.json$", 1)
    project = F.coalesce(F.col("j.project_id").try_cast("long"), stem.try_cast("long"))
    rows = parsed.select("file", project.alias("project"), F.coalesce("j.fetched_at", F.lit(now).cast("timestamp")).alias("synced_at"), F.posexplode("j.plans").alias("ord", "p")).where("project IS NOT NULL AND p IS NOT NULL")
    # Of two files of one project the last by name counts.
    last = rows.groupBy("project").agg(F.max("file").alias("file"))
    rows = rows.join(last, ["project", "file"]).select("project", F.lit(0).alias("folder"), F.col("p.page_id").alias("page_id"), F.col("p.sheet_name").alias("sheet_name"), "ord", "synced_at")
    synced_plans(materialised(rows, "imported-plans"), path)
    fresh.select("file", "modified").write.mode("append").parquet(f"{path}/ledger")
    return fresh.count()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The files that were taken into a store."""
    try:
        return spark.read.schema("file string, modified timestamp").parquet(f"{path}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, modified timestamp")
