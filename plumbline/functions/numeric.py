"""Numbers and units out of drawing text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules


def literal_map(pairs: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(text: Column, pattern: str, roles: tuple[str, ...]) -> Column:
    """The value of a form's parts: feet in inches, inches and wholes as they are, one part over another."""
    part = {role: F.replace(F.regexp_extract(text, pattern, k), F.lit(","), F.lit("")).cast("double") for k, role in enumerate(roles, 1)}
    value = F.lit(0.0)
    for role, weight in (("feet", 12.0), ("inches", 1.0), ("whole", 1.0)):
        if role in part:
            value = value + part[role] * weight
    return value + F.try_divide(part["up"], part["down"]) if "up" in part else value


def parse_numeric(text: Column) -> Column:
    """The quantity that a text states, or null if it states none.

    What rules.NOT_QUANTITIES names, and texts of more than two letters a digit, are no quantities.  Else the first of
    rules.QUANTITY_FORMS that fits is read: feet and inches come out in inches, fractions as decimals, thousands
    separators go.
    """
    return bound(F.translate(F.trim(text.cast("string")), "\u2032\u2033", "'\""), _numeric)


def _numeric(said: Column) -> Column:
    count = lambda kind: F.length(F.regexp_replace(said, rf"[^{kind}]", ""))
    wordy = count(r"\p{L}") > 2 * count(r"\p{Nd}")
    refused = said.rlike("|".join(f"(?:{p})" for p in rules.NOT_QUANTITIES.values())) | wordy
    # Plain digits, the most usual text, meet no other rule than the last form's: they are read first, without the patterns.
    out = F.when(said.rlike(r"^[0-9]{1,15}$"), said.try_cast("double")).when(refused, F.lit(None).cast("double"))
    for pattern, roles in rules.QUANTITY_FORMS:
        out = out.when(said.rlike(pattern), _parts(said, pattern, roles))
    return out


def area_from_dimensions(text: Column, compatible: bool = True) -> Column:
    """Width times depth of ``a x b``.

    compatible keeps inches times inches where both sides are in feet and inches; otherwise such a
    product is divided into square feet.
    """
    sides = F.split(text, r"\s*[x×X]\s*")
    product = F.nullif(parse_numeric(sides[0]), F.lit(0.0)) * F.nullif(parse_numeric(sides[1]), F.lit(0.0))
    if not compatible:
        product = F.when(sides[0].rlike("['′]") & sides[1].rlike("['′]"), product / 144).otherwise(product)
    return F.when(F.size(sides) == 2, product)


def unit_name(unit: Column, names: Mapping[str, str] = rules.UNIT_NAMES) -> Column:
    """The estimating unit; an unknown one stays, none is ``unit``."""
    key = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return F.coalesce(literal_map(names)[key], F.nullif(key, F.lit("")), F.lit("unit"))


def measure_of_unit(unit: Column) -> Column:
    return F.coalesce(literal_map(rules.UNIT_MEASURES)[F.upper(F.trim(unit))], F.lit("count"))


def round_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def quantity_text(value: Column) -> Column:
    """A quantity for people: whole numbers without a fraction, others with one digit, a dash if unknown."""
    whole = value == F.floor(value)
    return F.when(value.isNull(), "—").when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 1))
