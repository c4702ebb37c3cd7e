"""Progress feeds: the last event of every page, kept up to date as events arrive, and runs that go on where they ended."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.match import first_rows

#: Parts of a kept table; a batch writes those anew that its keys fall into.
PARTS = 32


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key."""
    return first_rows(events, keys, [F.desc(c) for c in order])


def _versions(spark: SparkSession, path: str, before: int | None) -> dict[int, int]:
    """The newest batch that each part was written by, of finished batches before one; at most PARTS rows come here."""
    try:
        done = spark.read.schema("batch long, part int").parquet(f"{path}/done/*")
        if before is not None:
            done = done.where(F.col("batch") < before)
        return {r["part"]: r["batch"] for r in done.groupBy("part").agg(F.max("batch").alias("batch")).collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}  # no batch has finished yet


def kept(spark: SparkSession, path: str, schema: StructType, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """The table as finished batches left it (those before one, and some of its parts, if asked)."""
    found = [f"{path}/rows/batch={batch}/part={part}" for part, batch in sorted(_versions(spark, path, before).items()) if parts is None or part in parts]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def upsert_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: list[str]) -> None:
    """Lays a batch over the table at path, as a new version of the parts that its keys fall into.

    Versions bear the batch's number, and one counts only when the batch's own list of parts, which is
    written last, is there; so a batch that dies leaves the table as it was, and when it runs again
    it reads what stood before it and writes the same rows in the same place.
    """
    spark = batch.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
    fresh = latest(batch, keys, order)
    touched = [r[0] for r in fresh.select(part).distinct().collect()]
    merged = latest(kept(spark, path, batch.schema, number, touched).unionByName(fresh), keys, order)
    merged.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows/batch={number}")
    finished = spark.createDataFrame([(number, p) for p in touched], "batch long, part int")
    finished.coalesce(1).write.mode("overwrite").parquet(f"{path}/done/batch={number}")


def upsert_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]):
    """A table at path (read it with `kept`) that holds the last event of each key, batch for batch, exactly once."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: upsert_batch(batch, number, path, keys, order))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def still_to_do(pages: DataFrame, states: DataFrame, keys: list[str], done: tuple[str, ...] = ("ok", "skipped")) -> DataFrame:
    """The pages of a run whose last state isn't final: a run that starts again begins with these."""
    return pages.join(states.where(F.col("status").isin(*done)).select(*keys).distinct(), keys, "left_anti")
