"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_FOLDER = "/tmp/checkpoints/plumbline"
#: What this process has written and not removed.
_written: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = LOCAL_FOLDER
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_intermediate(spark: SparkSession) -> int:
    """Removes the intermediate tables that this process has written, once nothing reads them any more; how many."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def materialised(df: DataFrame, label: str) -> DataFrame:
    """df written once and read back: what follows plans anew from plain columns, and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
