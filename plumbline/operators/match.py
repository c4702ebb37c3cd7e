"""The joins and rankings that other operators are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialised
from ..functions.text import name_tokens, token_score
from ..plans import rules


def first_rows(df: DataFrame, keys: Sequence, order: Sequence, n: int = 1) -> DataFrame:
    """The first n rows of each key in an order; cut down in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", rank).where(F.col("_nth") <= n).drop("_nth")


def ranked_match(left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column, order: Sequence, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Each left row's best right row under a condition, within equal `on` columns.

    key names a left row; the `on` columns bound what is compared (a project, a page), so that no
    side is crossed with all of the other.
    """
    best = first_rows(left.join(right, list(on)).where(condition), key, order)
    if how == "inner":
        return best
    added = [c for c in right.columns if c not in on]
    return left.join(best.select(*key, *added), list(key), "left")


def overlay(base: DataFrame, layers: Sequence[DataFrame], key: str, columns: Sequence[str], source: str = "source") -> DataFrame:
    """base with each layer's non-null columns laid over it by key; later layers win, unknown keys are appended.

    Every layer holds key, columns and source, one row a key.  The base is never changed, so the
    same layers give the same result again.
    """
    out = base.select(key, *columns, source)
    for layer in layers:
        over = layer.select(key, *(F.col(c).alias(f"_{c}") for c in (*columns, source)))
        out = out.join(over, key, "full_outer").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in (*columns, source)))
    return out


def resolve_names(names: DataFrame, entries: DataFrame, cutoff: float = rules.RESOLVE_CUTOFF) -> DataFrame:
    """(name, unit) to the entry that it means: (name, unit, entry, entry_unit, score), where one is near enough.

    entries: entry, entry_unit, aliases, ord.  Whatever scores above zero shares a word, so names
    and phrases meet by equal words; distinct names only.  Order: score to three digits,
    equal unit, longer entry, earlier entry.
    """
    asked = names.select("name", "unit").distinct().withColumn("words", name_tokens(F.col("name")))
    phrases = entries.select("entry", "entry_unit", "ord", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("entry"))).alias("phrase"))
    phrases = phrases.withColumn("phrase_words", name_tokens(F.col("phrase"))).drop("phrase").distinct()
    shared = asked.withColumn("word", F.explode("words")).join(phrases.withColumn("word", F.explode("phrase_words")), "word").drop("word").distinct()
    scored = shared.withColumn("score", token_score(F.col("words"), F.col("phrase_words"))).where(F.col("score") >= cutoff)
    unit = F.upper(F.trim(F.coalesce("unit", F.lit(""))))
    order = [F.desc(F.round("score", 3)), F.desc((unit != "") & (unit == F.col("entry_unit"))), F.desc(F.length("entry")), F.asc("ord"), F.desc("score")]
    return first_rows(scored, ["name", "unit"], order).select("name", "unit", "entry", "entry_unit", "score")


def missing_entries(entries: DataFrame, names: DataFrame, cutoff: float = rules.RESOLVE_CUTOFF) -> DataFrame:
    """The entries that no name means: neither by key nor by similarity."""
    asked = names.select("name").distinct().withColumn("words", name_tokens(F.col("name")))
    phrases = entries.select("entry", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("entry"))).alias("phrase"))
    phrases = phrases.withColumn("phrase_words", name_tokens(F.col("phrase")))
    met = phrases.withColumn("word", F.explode("phrase_words")).join(asked.withColumn("word", F.explode("words")), "word")
    found = met.where(token_score(F.col("words"), F.col("phrase_words")) >= cutoff).select("entry").distinct()
    return entries.join(found, "entry", "left_anti")


def suppressed(rows: DataFrame, covered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose name an authoritative name doesn't cover: equal, or one the other's beginning before a dash.

    Names meet by their beginnings, so there is no comparison of all with all.
    """
    begins = lambda name: F.transform(F.sequence(F.lit(1), F.size(F.split(name, "-"))), lambda n: F.array_join(F.slice(F.split(name, "-"), F.lit(1), n), "-"))
    covered = covered.select(*keys, F.col("name").alias("_covered")).distinct()
    names = rows.select(*keys, "name").distinct()
    below = names.withColumn("_covered", F.explode(begins(F.col("name")))).join(covered, [*keys, "_covered"], "left_semi")
    above = covered.withColumn("name", F.explode(begins(F.col("_covered")))).join(names, [*keys, "name"], "left_semi")
    # Recorded, so that its size is known before the join.
    hidden = materialised(below.select(*keys, "name").union(above.select(*keys, "name")).distinct(), "hidden-names")
    return rows.join(hidden, [*keys, "name"], "left_anti")


def pass_merge(measured: DataFrame, counted: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """Two passes over the same things joined by key.

    Every measured row stays; the last of a key takes the first counted value where its own is
    null and the count's confidence is high.  Counted keys that were not measured are appended once.
    """
    norm = F.lower(F.trim(F.col(key)))
    first = first_rows(counted.withColumn("_k", norm), ["_k"], [ordinal]).select("_k", *(F.col(c).alias(f"_c_{c}") for c in counted.columns))
    last = F.row_number().over(Window.partitionBy("_k").orderBy(F.desc(ordinal))) == 1
    base = measured.withColumn("_k", norm).withColumn("_last", last)
    joined = base.join(first, "_k", "full_outer")
    upgrade = F.col("_last") & F.col(value).isNull() & (F.lower("_c_confidence") == "high")
    out = [F.when(F.col("_last").isNull(), F.col(f"_c_{c}")).otherwise(F.when(upgrade, F.col(f"_c_{c}")).otherwise(F.col(c)) if c == value else F.col(c)).alias(c) for c in measured.columns]
    return joined.select(*out, F.when(F.col("_last").isNull(), "counted").when(upgrade, "upgraded").otherwise("measured").alias("merged_from"))
