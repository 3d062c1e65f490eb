"""Name and city predicates used at ingest and in clean-up."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions.text import strip


def _grouped(patterns: tuple[str, ...]) -> str:
    """All patterns as one search, sorted by how they begin.

    Those bound to the start of the text or to the start of a word share that test, so
    most positions of a text are rejected by it alone. Patterns written for exact case
    hold no letters, so one flag fits all.
    """
    heads: dict[str, list[str]] = {"^": [], r"\b": [], "": []}
    for p in patterns:
        head = next(h for h in heads if p.startswith(h))
        heads[head].append(p.removeprefix(head))
    groups = [f"{head}(?:{'|'.join(f'(?:{p})' for p in tails)})" for head, tails in heads.items() if tails]
    return "(?i)" + "|".join(groups)


STUB_REGEX = _grouped(K.STUB_PATTERNS)


def is_address_stub(name: Column) -> Column:
    text = strip(F.coalesce(name, F.lit("")))
    kept = text.rlike(K.STUB_KEEP_PREFIX_PATTERN) | text.rlike(f"(?i){K.STUB_KEEP_DBA_PATTERN}")
    return (text != "") & ~kept & text.rlike(STUB_REGEX)


def is_garbage_company(name: Column) -> Column:
    short = (F.length(name) <= 2) & ~name.isin(*K.SHORT_NAMES_KEPT)
    return F.coalesce(short | name.isin(*K.GARBAGE_NAMES), F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive search; a null text does not match."""
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    upper = F.upper(F.coalesce(c, F.lit("")))
    return reduce(or_, [upper.contains(phrase) for phrase in phrases])


def is_non_site_city(city: Column) -> Column:
    return contains_any(city, K.NON_SITE_CITIES)


def is_cross_brand(name: Column, brands: tuple[str, ...] = K.CROSS_BRANDS) -> Column:
    """``OPERATOR - ... BRAND``: the brand is equipment on somebody else's site."""
    return F.coalesce(name.rlike(f"^[A-Z].+ - .*({'|'.join(brands)})"), F.lit(False))


def is_other_operator(name: Column, brand: str = "CATERPILLAR") -> Column:
    """A dash before the brand in a name that does not begin with the brand."""
    return matches(name, rf"^(?!{brand}).+\s*-\s*.*{brand}")


def looks_like_equipment(name: Column, city: Column) -> Column:
    in_city = F.coalesce(city.isin(*K.NON_SITE_CITIES), F.lit(False))
    return matches(name, K.MODEL_NUMBER_PATTERN) | is_other_operator(name) | in_city


def is_unit_registration(name: Column, city: Column) -> Column:
    named = F.coalesce(name.rlike("|".join(K.UNIT_REGISTRATION_PATTERNS)), F.lit(False))
    return named | is_non_site_city(city)


def unlinked_class(name: Column) -> Column:
    label, pattern = K.UNLINKED_CLASSES[0]
    result = F.when(name.rlike(pattern), label)
    for label, pattern in K.UNLINKED_CLASSES[1:]:
        result = result.when(name.rlike(pattern), label)
    return result.when(F.length(name) < K.VERY_SHORT_NAME, "very_short").otherwise("other")
