"""Helpers shared by the training-data operators: tables, the shared folder, Arrow streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/plumbline"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_CHECKPOINTS


#: What this process has written to the shared folder and not removed.
_written: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    _written.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def clear_intermediate(spark: SparkSession) -> int:
    """Removes the tables that this process has written to the shared folder, once nothing reads them any more; how many."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of at most n rows while a table of wide rows is written; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A key is hot if it bears more than one in so many of all rows; so there are at most that many.
HOT_SHARE = 1024


def joined_by_key(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """rows with the columns of facts, which has one row a key and the number of rows that bear it (weight, not kept).

    Hot keys, at most HOT_SHARE by their definition, are broadcast, so their rows stay where they are;
    all other keys are joined by a shuffle.  Rows whose key facts lacks go.  facts is read
    three times and should be a stored table.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot = facts.where(is_hot).drop(weight)
    often = rows.join(F.broadcast(hot), key)
    seldom = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(~is_hot).drop(weight), key)
    return often.unionByName(seldom)


#: Positions of a Bloom filter (powers of two) at least and at most, those a hash gets, and the shifts that are its functions.
BLOOM_BITS, BLOOM_PLACES, BLOOM_SHIFTS = (20, 27), 16, (37, 11)


def bloom(rows: DataFrame, column: str) -> np.ndarray:
    """The bytes of a Bloom filter over a column of 64-bit hashes, to be broadcast: 16 MB at most, whatever there is.

    Tasks put it together; a row for each 64 places comes to the driver.  It grows with the hashes up
    to its bound; beyond that it lets more pass.
    """
    wanted = BLOOM_PLACES * rows.select(column).distinct().count()
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], wanted.bit_length()))
    places = F.explode(F.array(*(F.shiftrightunsigned(column, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in BLOOM_SHIFTS)))
    one = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    words = rows.select(places.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets pass: all that it was made of, and few others."""
    hashes, last = hashes.view(np.uint64), np.uint64(len(packed) * 8 - 1)
    left = np.arange(len(hashes))
    for shift in BLOOM_SHIFTS:  # the few that pass one function are tried with the next
        place = (hashes if len(left) == len(hashes) else hashes[left]) >> np.uint64(shift) & last
        left = left[(packed[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(hashes), bool)
    out[left] = True
    return out


def ascii_lower(column):
    """A-Z lower-cased and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def arrow_schema(**columns: pa.DataType) -> pa.Schema:
    return pa.schema(list(columns.items()))


def spark_schema(schema: pa.Schema) -> StructType:
    return from_arrow_schema(schema)


def portions(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column's texts have at most `most` bytes each, or one longer text.

    A batch holds many rows and texts of any length; what a task makes out of a text (Python strings,
    words, hashes) is many times larger, so it is made for one portion at a time.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes.astype(np.int64) + 64), 0  # an empty text counts for something, too
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end


def record_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of at most size rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
