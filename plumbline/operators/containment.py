"""Which text holds another: a join through an index of character q-grams instead of all pairs of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import first_rows

#: Characters of a gram; shorter needles are looked up whole.
Q = 3


def _grams(text: str, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    size = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(F.col(text), i, F.lit(n)))
    return F.when(size >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def first_holding(needles: DataFrame, texts: DataFrame, on: Sequence[str], order: Sequence) -> DataFrame:
    """on, needle and the columns of texts: for each distinct needle the first text of its group, in an order, that holds it.

    needles: on, needle; texts: on, text and anything else.  A needle of up to Q characters equals a
    gram, whose first text is known without pairs; a longer one meets only the texts that hold the
    rarest of its grams, and those are looked at.  Nulls and empty needles find nothing.
    """
    on = list(on)
    asked = needles.where("needle != ''").select(*on, "needle").distinct()
    short, long = asked.where(F.length("needle") <= Q), asked.where(F.length("needle") > Q)

    pieces = F.concat(*(_grams("text", n) for n in range(1, Q + 1)))
    met = texts.select("*", F.explode(pieces).alias("needle")).join(short, [*on, "needle"], "left_semi")
    both = met.unionByName(_held(long, texts, on))  # ranked together: each task keeps the first text of a needle that it sees
    return first_rows(both, [*on, "needle"], order).select(*on, "needle", *(c for c in texts.columns if c not in on))


def holding(needles: DataFrame, texts: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, needle and the columns of texts: all texts of a needle's group that hold it; as many rows as there are such pairs."""
    on = list(on)
    asked = needles.where("needle != ''").select(*on, "needle").distinct()
    pieces = F.concat(*(_grams("text", n) for n in range(1, Q + 1)))
    met = texts.select("*", F.explode(pieces).alias("needle")).join(asked.where(F.length("needle") <= Q), [*on, "needle"], "left_semi")
    return met.unionByName(_held(asked.where(F.length("needle") > Q), texts, on)).select(*on, "needle", *(c for c in texts.columns if c not in on))


def _held(long: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of needles longer than Q and the texts that hold them, through the rarest gram of each needle."""
    index = texts.select(*on, F.xxhash64("text").alias("_text"), F.explode(_grams("text", Q)).alias("_gram")).distinct()
    counts = index.groupBy(*on, "_gram").agg(F.count("*").alias("_n"))
    parts = long.select(*on, "needle", F.explode(_grams("needle", Q)).alias("_gram")).join(counts, [*on, "_gram"], "left")
    rare = parts.groupBy(*on, "needle").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.bool_and(F.col("_n").isNotNull()).alias("_all")).where("_all").drop("_all")
    pairs = rare.join(index, [*on, "_gram"]).select(*on, "needle", "_text").distinct()
    return pairs.join(texts.withColumn("_text", F.xxhash64("text")), [*on, "_text"]).where(F.contains("text", F.col("needle"))).drop("_text")
