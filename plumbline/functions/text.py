"""Names, tokens and ordered pattern rules, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules


def first_match(text: Column, choices: Iterable[tuple[str, object]], default: object = None) -> Column:
    """The value of the first pattern found in text; rules stay in one CASE, without a shuffle."""
    out, value = F, lambda v: v if isinstance(v, Column) else F.lit(v)
    for pattern, v in choices:
        out = out.when(text.rlike(pattern), value(v))
    return out.otherwise(value(default)) if out is not F else value(default)


def name_tokens(text: Column, stop: Sequence[str] = rules.STOP_WORDS) -> Column:
    """A name's significant words, singular, distinct and sorted; numbers stay, they tell items apart."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[-_/\s'\".,()]+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*stop))
    singular = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss") & ~w.rlike("^[0-9]+$"), F.left(w, F.length(w) - 1)).otherwise(w)  # noqa: E731, E501
    return F.array_sort(F.array_distinct(F.transform(kept, singular)))


def name_key(text: Column) -> Column:
    """Names that differ in word order, case or plural share a key."""
    return F.array_join(name_tokens(text), " ")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def token_score(a: Column, b: Column) -> Column:
    """1 for equal token sets, 0.9 if one holds the other, else their Jaccard similarity; 0 if either is empty."""
    contained = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    score = F.when(a == b, 1.0).when(contained, 0.9).otherwise(jaccard(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score)


def sheet_key(name: Column) -> Column:
    """A sheet's name without case, spaces and separators."""
    return F.regexp_replace(F.upper(name), r"[\s._-]+", "")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), F.lit("_"))


def title_case(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))
