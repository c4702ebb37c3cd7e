"""Token-id shards: a concatenated id array with Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id and sorted there; each task encodes its documents in order
and closes a shard image every `shard_ids` ids.  An image holds, after a fixed header, the
boundaries (start of every document and the end of the last), the doc_ids as differences from the
first, both Elias-Fano coded, and the ids, in 16 bits if the vocabulary allows.  Images are the
payload column of a Parquet table that Spark writes, so any store will do, a lost task leaves no
half file, and a shard can be copied out as a file of its own.

A shard knows how many ids lie before it in its range.  Offsets over the whole corpus need the
ranges' totals only: one row a range.

Defined results: null text is empty, its ids the end id alone; null doc_ids come first; repeated
doc_ids are ordered by text; further columns are ignored; an empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, portions, record_batches, spark_schema
from .elias_fano import EliasFano
from .encoding import encoder

END_ID = (0).to_bytes(4, "little")
MAGIC = b"EFTK"
#: Documents whose offsets are selected at once when a shard is read from end to end.
RUN = 256
#: magic, bytes an id, documents, documents without doc_id, first doc_id, ids before in the range, lengths of both codes
_HEAD = struct.Struct("<4sBQQqQQQ")

SHARDS = arrow_schema(range=pa.int32(), shard=pa.int32(), n_docs=pa.int64(), n_ids=pa.int64(), payload=pa.binary())
ROWS = arrow_schema(range=pa.int32(), doc_id=pa.int64(), local_start=pa.int64(), n_tokens=pa.int64(), ids_crc32=pa.int64())


def shard_image(doc_ids: list[int | None], ids: list[bytes], before: int, id_bytes: int) -> bytes:
    """doc_ids ascending, nulls first; ids as 32-bit bytes; before: ids that precede in the range."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    bounds = EliasFano.encode(np.cumsum([0, *(len(x) // 4 for x in ids)])).to_bytes()
    names = EliasFano.encode(np.array([d - first for d in known], dtype=np.uint64)).to_bytes()
    body = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{id_bytes}").tobytes()
    head = _HEAD.pack(MAGIC, id_bytes, len(doc_ids), len(doc_ids) - len(known), first, before, len(bounds), len(names))
    return head + bounds + names + body


class Shard:
    """A shard image opened for reading."""

    def __init__(self, image: bytes):
        magic, id_bytes, self.n_docs, self.n_null, self.first, self.before, n_bounds, n_names = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        self.bounds = EliasFano.from_bytes(image[at : at + n_bounds])
        self.names = EliasFano.from_bytes(image[at + n_bounds : at + n_bounds + n_names])
        self.ids = np.frombuffer(image, f"<u{id_bytes}", -1, at + n_bounds + n_names)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, by two selects."""
        return self.ids[self.bounds.select(k) : self.bounds.select(k + 1)]

    def doc_ids(self, k: int, end: int) -> list[int | None]:
        """The doc_ids of the documents k to end - 1."""
        nulls, first, last = max(0, min(end, self.n_null) - k), max(0, k - self.n_null), end - self.n_null
        return [None] * nulls + ([self.first + d for d in self.names.select_run(first, last).tolist()] if last > first else [])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, ids before it in the range, ids: offsets are selected for RUN documents at a time, never as one table."""
        for k in range(0, self.n_docs, RUN):
            end = min(k + RUN, self.n_docs)
            bounds = self.bounds.select_run(k, end + 1).tolist()
            for doc_id, a, b in zip(self.doc_ids(k, end), bounds, bounds[1:], strict=False):
                yield doc_id, self.before + a, self.ids[a:b]


def write_shards(docs: DataFrame, path: str, vocabulary: str, shard_ids: int = 1 << 18) -> None:
    """Every document of (doc_id, text) encoded into shards at path, in ascending doc_id order."""

    def encode_range(batches):
        encode, task = encoder(vocabulary).encode, TaskContext.get().partitionId()
        id_bytes = 2 if len(encoder(vocabulary).id_bytes) <= 1 << 16 else 4

        def rows():
            names, held, size, before, k = [], [], 0, 0, 0
            for batch in portions(batches):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encode(text or "") + END_ID
                    names.append(doc_id)
                    held.append(ids)
                    size += len(ids) // 4
                    if size >= shard_ids:
                        yield task, k, len(names), size, shard_image(names, held, before, id_bytes)
                        names, held, size, before, k = [], [], 0, before + size, k + 1
            if names:
                yield task, k, len(names), size, shard_image(names, held, before, id_bytes)

        yield from record_batches(rows(), SHARDS, 1)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode_range, spark_schema(SHARDS)).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (over the whole corpus), n_tokens and ids_crc32 of every document in the shards."""
    shards = spark.read.parquet(path)

    def decode(batches):
        def rows():
            for batch in batches:
                for at, image in zip(batch.column("range").to_pylist(), batch.column("payload"), strict=True):
                    for doc_id, start, ids in Shard(image.as_py()).documents():
                        yield at, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

        yield from record_batches(rows(), ROWS)

    totals = shards.groupBy("range").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begins = totals.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    rows = shards.select("range", "payload").mapInArrow(decode, spark_schema(ROWS)).join(begins, "range")
    return rows.select("doc_id", (F.col("begin") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
