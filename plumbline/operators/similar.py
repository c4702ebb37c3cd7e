"""Most similar names by the Ratcliff-Obershelp ratio, without comparing most of them.

The ratio is 2 * M / (length + length), where M counts the characters of matching blocks.  Blocks
stand in order in both names, so M is at most the length of a longest common subsequence, and that
is at most the number of characters the names share at all.  Names of one group (a project) meet in
blocks of bounded size, by feasible lengths where a group is large; whole blocks are bounded by
arrays, first by shared characters, then by subsequences (bit-parallel); only what may still be the
best of its name is given to difflib, most promising first.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .match import first_rows

#: Names of a side that meet at once; smaller groups share a task until they have MANY names.
BLOCK, MANY = 1024, 16_384
#: Characters are told apart by their low bits: names can only seem to share more than they do.
CODES = 128
#: Length from which subsequences are not counted (a machine word), and pairs whose subsequences are counted together.
WORD, PAIRS = 64, 1 << 16


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two strings that are a pair already."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def _coded(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of character codes for each name, CODES where it has ended, and the lengths."""
    lengths = np.array([len(n) for n in names], np.int64)
    codes = np.full((len(names), max(1, int(lengths.max(initial=0)))), CODES, np.uint8)
    for row, name in zip(codes, names, strict=True):
        row[: len(name)] = np.frombuffer(name.encode("utf-32-le"), "<u4") % CODES
    return codes, lengths


def shared_characters(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many characters each left row shares with each right row, repeats included."""
    count = lambda codes: np.stack([(codes == c).sum(axis=1) for c in range(CODES)], axis=1)
    a, b = count(left), count(right)
    out = np.zeros((len(a), len(b)), np.int64)
    for c in np.flatnonzero(a.any(axis=0) & b.any(axis=0)):
        out += np.minimum.outer(a[:, c], b[:, c])
    return out


def common_subsequences(left: np.ndarray, lengths: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows of codes, pair by pair; left lengths at most WORD.

    A bit of a word for each left character; a step for each right character.
    """
    masks = np.zeros((len(left), CODES + 1), np.uint64)
    rows = np.arange(len(left))
    for at in range(min(left.shape[1], WORD)):
        masks[rows, left[:, at]] |= np.uint64(1) << np.uint64(at)
    masks[:, CODES] = 0
    state = np.full(len(left), np.iinfo(np.uint64).max, np.uint64)
    for at in range(right.shape[1]):
        met = state & masks[rows, right[:, at]]
        state = (state + met) | (state - met)
    own = np.where(lengths >= WORD, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(lengths, WORD - 1).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & own).astype(np.int64)


def best_of_block(left: list[str], right: list[str], cutoff: float, query_second: bool, n: int | None = None) -> list[tuple[int, int, float]]:
    """(left, right, ratio) of each left name's most similar right names, all that tie, at cutoff or above.

    With n those of the n greatest ratios instead, of equal ratios the greater names.
    """
    if not left or not right:
        return []
    a, a_lengths = _coded(left)
    b, b_lengths = _coded(right)
    both = np.add.outer(a_lengths, b_lengths)
    top = lambda m, n: np.where(n > 0, 2.0 * m / np.maximum(n, 1), 1.0)
    bound = top(np.minimum.outer(a_lengths, b_lengths), both)
    bound = np.where(bound >= cutoff, np.minimum(bound, top(shared_characters(a, b), both)), 0.0)
    x, y = np.nonzero((bound >= cutoff) & (bound > 0))
    bounds = bound[x, y]
    for k in range(0, len(x), PAIRS):
        i, j = x[k : k + PAIRS], y[k : k + PAIRS]
        short = a_lengths[i] <= WORD
        found = common_subsequences(a[i[short]], a_lengths[i[short]], b[j[short]])
        bounds[k : k + PAIRS][short] = np.minimum(bounds[k : k + PAIRS][short], top(found, both[i[short], j[short]]))
    order = np.lexsort((-bounds, x))
    order = order[bounds[order] >= cutoff]
    out, matcher, now, least, held = [], difflib.SequenceMatcher(None), -1, cutoff, []
    for i, j, most in zip(x[order].tolist(), y[order].tolist(), bounds[order].tolist(), strict=True):
        if i != now:
            out += [(now, k, ratio) for ratio, _, k in held]
            now, least, held = i, cutoff, []
            if query_second:
                matcher.set_seq2(left[i])
        if most < least:
            continue
        if query_second:
            matcher.set_seq1(right[j])
        else:
            matcher.set_seqs(left[i], right[j])
        ratio = matcher.ratio()
        if ratio < least:
            continue
        held.append((ratio, right[j], j))
        if n is None:
            held = [h for h in held if h[0] == max(held)[0]]
            least = held[0][0]
        elif len(held) >= n:
            held = sorted(held, reverse=True)[:n]
            least = held[-1][0]
    return out + [(now, k, ratio) for ratio, _, k in held]


def most_similar(left: DataFrame, right: DataFrame, on: Sequence[str], cutoff: float, query_second: bool = False, n: int | None = None) -> DataFrame:
    """on, a, b, ratio: for each distinct name a of left the names b of right, of the same group, of greatest ratio.

    left: on, a; right: on, b.  Names below the cutoff (above 0) are no match; all that tie are
    given; with n the n greatest by ratio and name instead.  The ratio depends on the order of its two names: a comes first unless query_second.
    Null names and groups match nothing.
    """
    on = list(on)
    group = F.to_json(F.struct(*on)) if on else F.lit("")
    present = " AND ".join(f"`{c}` IS NOT NULL" for c in on) or "true"
    queries = left.where(present).where("a IS NOT NULL").select(*on, "a", group.alias("_on")).distinct()
    names = right.where(present).where("b IS NOT NULL").select(*on, "b", group.alias("_on")).distinct()
    sizes = queries.groupBy("_on").agg(F.count("*").alias("_nl")).join(names.groupBy("_on").agg(F.count("*").alias("_nr")), "_on")
    sizes = sizes.withColumn("_large", (F.col("_nl") > BLOCK) | (F.col("_nr") > BLOCK))
    tasks = max(1, -(-(sizes.where("NOT _large").agg(F.sum(F.col("_nl") + F.col("_nr"))).first()[0] or 0) // MANY))
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    hashed = lambda c, n: F.pmod(F.xxhash64(c), n)
    none, sized_queries, sized_names = F.lit(0).cast("long"), queries.join(sizes, "_on"), names.join(sizes, "_on")

    # Small groups share tasks as they are.
    key = ("_task", "_length", "_rb", "_lb")
    whole = lambda rows, name: rows.where("NOT _large").select(*on, "_on", name, hashed("_on", F.lit(tasks)).alias("_task"), *(none.alias(k) for k in key[1:]))
    # Large ones are cut into blocks: names by length, queries meet blocks of feasible lengths.
    cut = sized_names.where("_large").withColumn("_length", F.length("b").cast("long"))
    per_length = cut.groupBy("_on", "_length").agg(blocks(F.count("*")).alias("_blocks"))
    large_names = cut.join(per_length, ["_on", "_length"]).withColumn("_rb", hashed("b", F.col("_blocks"))).withColumn("_lb", F.explode(F.sequence(none, blocks(F.col("_nl")) - 1)))
    length = F.length("a")
    feasible = 2 * F.least(length, F.col("_length")) >= F.lit(cutoff) * (length + F.col("_length"))
    large_queries = sized_queries.where("_large").withColumn("_lb", hashed("a", blocks(F.col("_nl")))).join(per_length, "_on").where(feasible | (length + F.col("_length") == 0)).withColumn("_rb", F.explode(F.sequence(none, F.col("_blocks") - 1)))
    task = F.xxhash64("_on").alias("_task")
    asked = whole(sized_queries, "a").unionByName(large_queries.select(*on, "_on", "a", task, *key[1:]))
    known = whole(sized_names, "b").unionByName(large_names.select(*on, "_on", "b", task, *key[1:]))
    known = known.select(*(F.col(c).alias(c) for c in known.columns))  # both sides may come from one table

    fields = [left.schema[c] for c in on]
    schema = StructType([*fields, StructField("a", StringType()), StructField("b", StringType()), StructField("ratio", DoubleType())])
    arrow = to_arrow_schema(schema)

    def compared(some: pa.Table, others: pa.Table) -> pa.Table:
        at: dict[str, list[int]] = {}
        for k, name in enumerate(others.column("_on").to_pylist()):
            at.setdefault(name, []).append(k)
        mine: dict[str, list[int]] = {}
        for k, name in enumerate(some.column("_on").to_pylist()):
            mine.setdefault(name, []).append(k)
        a, b = some.column("a").to_pylist(), others.column("b").to_pylist()
        rows, pairs = [], []
        for name in mine.keys() & at.keys():
            for i, j, ratio in best_of_block([a[k] for k in mine[name]], [b[k] for k in at[name]], cutoff, query_second, n):
                rows.append(mine[name][i])
                pairs.append((b[at[name][j]], ratio))
        taken = some.take(pa.array(rows, pa.int64()))
        return pa.Table.from_arrays([*(taken.column(c) for c in (*on, "a")), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())], schema=arrow)

    found = asked.groupBy(*key).cogroup(known.groupBy(*key)).applyInArrow(compared, schema)
    if n is not None:
        return first_rows(found, [*on, "a"], [F.desc("ratio"), F.desc("b")], n)
    best = found.groupBy(*on, "a").agg(F.max("ratio").alias("_best"))
    return found.join(best, [*on, "a"]).where("ratio = _best").drop("_best")
