"""Run manifests: which pages of a run are captured and analysed, read from and written to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = "struct<page_id:bigint,sheet_name:string,screenshot_rel:string,capture_status:string,analysis_status:string,source:string>"
RUN = f"project_id bigint, project_name string, folder_id bigint, pages array<{_PAGE}>"


def parsed(rows: DataFrame, column: str = "value") -> DataFrame:
    """A row for each page of each run; a status that isn't there is ``pending``."""
    runs = rows.select(F.from_json(column, RUN).alias("r")).where("r.project_id IS NOT NULL")
    pages = runs.select("r.project_id", "r.project_name", "r.folder_id", F.posexplode("r.pages").alias("ord", "p"))
    status = lambda c: F.coalesce(f"p.{c}", F.lit("pending")).alias(c)
    return pages.select("project_id", "project_name", "folder_id", "ord", "p.page_id", "p.sheet_name", "p.screenshot_rel", status("capture_status"), status("analysis_status"), "p.source")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path, wholetext=True))


def as_json(pages: DataFrame) -> DataFrame:
    """One JSON text a run; a run's pages are its sheets, so they are gathered."""
    page = F.struct("page_id", "sheet_name", "screenshot_rel", "capture_status", "analysis_status", "source")
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("ord", page.alias("page")))), lambda p: p["page"])
    runs = pages.groupBy("project_id", "project_name", "folder_id").agg(gathered.alias("pages"))
    return runs.select("project_id", F.to_json(F.struct("project_id", "project_name", "folder_id", "pages")).alias("value"))


def save(pages: DataFrame, path: str) -> None:
    """Written by Spark's committer: what readers see is the old run or the whole new one."""
    as_json(pages).select("value").write.mode("overwrite").text(path)
