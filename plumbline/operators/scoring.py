"""Accuracy against a golden reference, with exact, token and character similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..plans import rules
from .match import first_rows
from .similar import most_similar


def plain_name(name: Column) -> Column:
    """Lower case, with one space for each run of separators."""
    return F.trim(F.regexp_replace(F.lower(name), "[-_/]+", " "))


def matched(golden: DataFrame, summary: DataFrame, on: Sequence[str], cutoff: float = 0.70, fuzzy: bool = True) -> DataFrame:
    """Each golden item's summary row: equal names, then equal plain names, then the most similar plain name.

    Of several rows of one name the last in order of the name counts; of equally similar names the greatest.
    """
    right = summary.select(*on, F.col("item").alias("found"), F.col("quantity").alias("found_quantity"), F.col("unit").alias("found_unit"))
    names, tiers = golden.select(*on, "item_name").distinct(), []
    left = names
    # Equal names are joined by value; only what they leave is compared.
    for key in (F.lower, plain_name):
        pairs = left.withColumn("_key", key("item_name")).join(right.withColumn("_key", key("found")), [*on, "_key"]).drop("_key")
        tiers.append(pairs)
        left = left.join(pairs.select(*on, "item_name").distinct(), [*on, "item_name"], "left_anti")
    if fuzzy:
        asked, known = left.withColumn("a", plain_name(F.col("item_name"))), right.withColumn("b", plain_name(F.col("found")))
        near = most_similar(asked, known, on, cutoff, query_second=True, n=1).drop("ratio")
        tiers.append(asked.join(near, [*on, "a"]).join(known, [*on, "b"]).drop("a", "b"))
    ranked = [pairs.select(*on, "item_name", "found", "found_quantity", "found_unit", F.lit(k).alias("_tier")) for k, pairs in enumerate(tiers)]
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    best = first_rows(every, [*on, "item_name"], ["_tier", F.desc("found")])
    return golden.join(best.select(*on, "item_name", "found", "found_quantity", "found_unit"), [*on, "item_name"], "left")


def benchmark_tokens(name: Column) -> Column:
    """A name's distinct words, sorted, without stop words and whole numbers."""
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), r"[-_/\s'\"]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*rules.BENCHMARK_STOP_WORDS) & ~w.rlike(r"^\p{Nd}+$"))))


def _rarest_first(rows: DataFrame, on: Sequence[str], words: str, counts: DataFrame) -> DataFrame:
    """rows with words in order of how few names of the group have them."""
    listed = rows.select(*on, "_id", F.explode(words).alias("_word")).join(counts, [*on, "_word"])
    ordered = listed.groupBy(*on, "_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_word"))), lambda w: w["_word"]).alias("_rare"))  # the words of one name
    return rows.join(ordered, [*on, "_id"])


def token_candidates(left: DataFrame, right: DataFrame, on: Sequence[str], least: float) -> DataFrame:
    """on, _left, _right, contained and jaccard of pairs whose word sets contain one another or are that similar.

    left and right: on, _id, _words, each word set once.  An inverted index over rare words: a set that another
    contains has its rarest word in it, and two sets of the similarity share one of their first
    n - ceil(least * n) + 1.
    """
    words = left.select(*on, F.explode("_words").alias("_word")).unionByName(right.select(*on, F.explode("_words").alias("_word")))
    counts = words.groupBy(*on, "_word").agg(F.count("*").alias("_n"))
    a, b = _rarest_first(left, on, "_words", counts), _rarest_first(right, on, "_words", counts)
    n = F.size("_rare")
    prefix = F.slice("_rare", F.lit(1), n - F.ceil(F.lit(least) * n - 1e-9).cast("int") + 1)
    indexed = lambda rows, name, kept: rows.select(*on, F.col("_id").alias(f"_{name}"), F.explode(kept).alias("_word"))
    one, whole = F.slice("_rare", 1, 1), F.col("_rare")
    joins = [(prefix, prefix), (one, whole), (whole, one)]
    pairs = None
    for x, y in joins:
        met = indexed(a, "left", x).join(indexed(b, "right", y), [*on, "_word"]).select(*on, "_left", "_right")
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = pairs.distinct().join(left.select(*on, F.col("_id").alias("_left"), F.col("_words").alias("_a")), [*on, "_left"]).join(right.select(*on, F.col("_id").alias("_right"), F.col("_words").alias("_b")), [*on, "_right"])
    contained = (F.size(F.array_except("_a", "_b")) == 0) | (F.size(F.array_except("_b", "_a")) == 0)
    return pairs.withColumns({"contained": contained, "jaccard": jaccard(F.col("_a"), F.col("_b"))}).where(F.col("contained") | (F.col("jaccard") >= least)).drop("_a", "_b")


def token_matched(golden: DataFrame, summary: DataFrame, on: Sequence[str], cutoff: float = 0.6) -> DataFrame:
    """The benchmark's matching: the first row whose words contain the item's or are contained, else the best by Jaccard or character similarity.

    Characters are those of the sorted words.  Of equal scores the first row counts.
    """
    on = list(on)
    left = golden.withColumn("_words", benchmark_tokens(F.col("item_name"))).where(F.size("_words") > 0).withColumn("a", F.array_join("_words", " "))
    right = summary.select(*on, F.col("item").alias("found"), F.col("quantity").alias("found_quantity"), F.col("ord").alias("found_ord"), benchmark_tokens(F.col("item")).alias("_words"))
    right = right.where(F.size("_words") > 0).withColumn("b", F.array_join("_words", " "))
    first = first_rows(right, [*on, "b"], ["found_ord"])  # of equal word sets the first row is the only one that counts
    sets = lambda rows, name: rows.select(*on, F.col(name).alias("_id"), "_words").distinct()
    met = token_candidates(sets(left, "a"), sets(first, "b"), on, cutoff).withColumnsRenamed({"_left": "a", "_right": "b"})
    by_words = met.select(*on, "a", "b", "contained", F.col("jaccard").alias("score"))
    by_letters = most_similar(left.select(*on, "a"), first.select(*on, "b"), on, cutoff).select(*on, "a", "b", F.lit(False).alias("contained"), F.col("ratio").alias("score"))
    scored = by_words.unionByName(by_letters).join(first.drop("_words"), [*on, "b"])
    order = [F.desc("contained"), F.when(F.col("contained"), F.col("found_ord")), F.desc("score"), "found_ord"]
    best = first_rows(scored, [*on, "a"], order).select(*on, "a", "found", "found_quantity")
    items = left.select(*on, "item_name", "a").distinct().join(best, [*on, "a"]).drop("a")
    return golden.join(items, [*on, "item_name"], "left")


def judged(pairs: DataFrame) -> DataFrame:
    """name_found and quantity_ok: counted things within 1, others within the tolerance in percent."""
    off = F.abs(F.col("found_quantity") - F.col("quantity"))
    within = F.when(F.col("match_mode") == "exact_or_within_1", off <= 1).otherwise(off <= F.abs(F.col("quantity")) * F.col("tolerance_pct") / 100)
    return pairs.withColumns({"name_found": F.col("found").isNotNull(), "quantity_ok": F.coalesce(within, F.lit(False))})


def rates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of names found and quantities right."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 4).alias(f"{c}_rate")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), share("name_found"), share("quantity_ok"))


def extra_rows(summary: DataFrame, pairs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Summary items that no golden item was matched with."""
    return summary.join(pairs.select(*on, F.col("found").alias("item")).where("item IS NOT NULL").distinct(), [*on, "item"], "left_anti")
