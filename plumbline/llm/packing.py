"""Best-fit packing of token pieces into sequences of a fixed capacity by minimum bin slack.

Only lengths decide a packing, and there are at most `capacity` of them.  So the pieces are
counted by length where they lie, the counts (at most `capacity` rows) give a plan, and the plan
goes back to the pieces by their rank within their length.  A bin takes the longest length left,
then a bitset subset-sum over the lengths left finds the fullest feasible company for it; that
combination is taken as often as the counts allow, which makes the next bins at once.

Ranks need no window over a length (one length may be a third of all pieces): each task numbers
its own pieces by length, and a running sum over tasks gives where its numbers begin.

Defined results: null text is empty, and an empty document is its end id alone; repeated rows and
null doc_ids are packed like any other; further columns are ignored; an empty table packs nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, portions, record_batches, spark_schema, stored
from .encoding import encoder

END_ID = (0).to_bytes(4, "little")
#: Rows of a plan that are broadcast at most; a longer one is joined by a shuffle.
BROADCAST_SLOTS = 1 << 17
PIECES = arrow_schema(
    doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int32(), ids_crc32=pa.int64(), ids=pa.binary(), task=pa.int32(), nth=pa.int64()
)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text) to pieces of at most capacity ids; ids, if kept, as little-endian 32-bit bytes."""
    width = 4 * capacity

    def cut(batches):
        encode, task, seen = encoder(vocabulary).encode, TaskContext.get().partitionId(), Counter()

        def rows():
            for batch in portions(batches):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encode(text or "") + END_ID
                    for k, at in enumerate(range(0, len(ids), width)):
                        part = ids[at : at + width]
                        length = len(part) // 4
                        yield doc_id, k, at // 4, length, zlib.crc32(part), part if keep_ids else None, task, seen[length]
                        seen[length] += 1

        yield from record_batches(rows(), PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, spark_schema(PIECES))


def fullest(lengths: list[tuple[int, int]], room: int) -> Counter:
    """The multiset of (length, count), longest first, with the greatest sum up to room.

    Bit s of the bitset says that s can be reached; counts go in by powers of two.  The search
    ends as soon as room itself is reached.
    """
    reach, keep, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in lengths:
        if length > room:
            continue
        left, chunk = min(count, room // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach = (reach | reach << (length * take)) & keep
            left, chunk = left - take, chunk * 2
            if reach >> room:
                break
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return used


def plan(counts: dict[int, int], capacity: int) -> Iterable[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) of each distinct bin, by minimum slack around the longest length left.

    A combination is repeated until some length of it runs short, so there are at most about
    capacity * ln(capacity) of them, whatever the number of pieces.
    """
    left = dict(sorted(((k, v) for k, v in counts.items() if v), reverse=True))
    while left:
        longest = next(iter(left))
        others = [(k, v - (k == longest)) for k, v in left.items()]
        used = fullest(others, capacity - longest)
        used[longest] += 1
        times = min(left[k] // n for k, n in used.items())
        yield times, dict(sorted(used.items(), reverse=True))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset for pieces that bear length, task and nth (0, 1, ... of a length in a task)."""
    pieces = stored(pieces, "packing-pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    taken, slots, sequence = Counter(), [], 0
    for times, used in plan(counts, capacity):
        at = 0
        for length, copies in used.items():
            slots.append((length, taken[length], taken[length] + copies * times, copies, sequence, at))
            taken[length] += copies * times
            at += length * copies
        sequence += times
    # Slots and ranks meet by length and stretch of ranks: a length has as many stretches as slots, so each piece meets about two.
    wide = {length: -(-counts[length] // n) for length, n in Counter(s[0] for s in slots).items()}
    slots = [(*s, stretch) for s in slots for stretch in range(s[1] // wide[s[0]], (s[2] - 1) // wide[s[0]] + 1)]
    schema = "length int, low long, high long, copies int, first long, at long, stretch long"
    bounded = F.broadcast if len(slots) <= BROADCAST_SLOTS else (lambda df: df)
    slots = bounded(pieces.sparkSession.createDataFrame(slots, schema))
    widths = F.broadcast(pieces.sparkSession.createDataFrame(list(wide.items()), "length int, wide long"))  # at most capacity rows
    ranked = pieces.join(begins, ["task", "length"]).withColumn("rank", F.col("begin") + F.col("nth")).join(widths, "length")
    ranked = ranked.withColumn("stretch", F.expr("rank div wide"))
    placed = ranked.join(slots, ["length", "stretch"]).where("rank >= low AND rank < high")
    nth = F.col("rank") - F.col("low")
    return placed.select(
        *[c for c in pieces.columns if c not in ("task", "nth")],
        (F.col("first") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )
