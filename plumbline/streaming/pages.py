"""Sheet extractions as they arrive: a file stream of JSON records, resumed by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import extraction


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Every new line of JSON under a path as a typed sheet row."""
    return extraction.parsed(spark.readStream.format("text").load(path))


def status_counts(events: DataFrame, stamp: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Rows of each status in tumbling windows; what comes later than `late` is dropped."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, every), "status").count().select("window.start", "status", "count")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """What has arrived, appended to Parquet exactly once; a later start goes on where this one ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
