"""Filter builders for golden rows and companies: one Column per request."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave import constants as K


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def has_prefix(c: Column, prefixes: Sequence[str]) -> Column:
    return _any([c.startswith(p) for p in prefixes])


def category_prefixes(text: str) -> tuple[str, ...] | None:
    """Code prefixes of the category with this key or label."""
    for key, label, prefixes in K.CATEGORIES:
        if key == text.lower() or label.lower() == text.lower():
            return prefixes
    return None


def naics_prefixes(text: str) -> tuple[str, ...]:
    """A category key (as written), a category label, or a code prefix."""
    text = text.strip()
    for key, label, prefixes in K.CATEGORIES:
        if key == text or label.lower() == text.lower():
            return prefixes
    return (text,)


def like_any_case(c: Column, text: str) -> Column:
    """Contains, ignoring case; ``%`` and ``_`` act as wildcards."""
    return c.ilike(f"%{text}%")


@dataclass(frozen=True)
class FacilityFilter:
    search: str | None = None
    state: str | None = None
    naics: str | None = None
    company: str | None = None
    min_sources: int | None = None

    def condition(self) -> Column:
        parts = []
        if self.search:
            text = self.search.strip()
            prefixes = category_prefixes(text)
            if prefixes:
                parts.append(has_prefix(F.col("primary_naics"), prefixes))
            else:
                parts.append(like_any_case(F.col("name"), text) | like_any_case(F.col("company_name"), text))
        if self.state:
            parts.append(F.col("state") == self.state)
        if self.naics:
            parts.append(has_prefix(F.col("primary_naics"), naics_prefixes(self.naics)))
        if self.company:
            parts.append(like_any_case(F.col("company_name"), self.company))
        if self.min_sources and self.min_sources > 1:
            parts.append(F.col("source_count") >= self.min_sources)
        return _all(parts)


@dataclass(frozen=True)
class CompanyFilter:
    search: str | None = None
    status: str | None = None

    def condition(self) -> Column:
        parts = []
        if self.search:
            text = self.search.strip()
            hit = next(
                (label for key, label, _ in K.CATEGORIES if text.lower() in label.lower() or key == text.lower()),
                None,
            )
            if hit:
                parts.append(like_any_case(F.col("sector"), hit))
            else:
                parts.append(like_any_case(F.col("name"), text) | like_any_case(F.col("sector"), text))
        if self.status in ("unverified", "verified", "rejected"):
            parts.append(F.col("status") == self.status)
        return _all(parts)


@dataclass(frozen=True)
class ExportFilter:
    """Filter of exports. ``categories=True`` also accepts a category key or label as code prefix."""

    states: tuple[str, ...] = ()
    naics_prefix: str | None = None
    min_sources: int | None = None
    min_confidence: int | None = None
    has_company: bool = False
    has_coordinates: bool = False
    companies: tuple[str, ...] = ()
    categories: bool = False

    def _shared(self) -> list[Column]:
        parts = []
        if self.states:
            parts.append(F.col("state").isin(*self.states))
        if self.naics_prefix:
            prefixes = naics_prefixes(self.naics_prefix) if self.categories else (self.naics_prefix,)
            parts.append(has_prefix(F.col("primary_naics"), prefixes))
        if self.min_confidence:
            parts.append(F.col("confidence") >= self.min_confidence)
        if self.has_company:
            parts.append(F.col("company_id").isNotNull())
        if self.has_coordinates:
            parts.append(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        return parts

    def for_export(self) -> Column:
        parts = self._shared()
        if self.min_sources and self.min_sources > 1:
            parts.append(F.col("source_count") >= self.min_sources)
        return _all(parts)

    def for_preview(self) -> Column:
        parts = [F.col("state").isin(*K.EXPORT_STATE_CODES), *self._shared()]
        if self.companies:
            parts.append(_any([like_any_case(F.col("company_name"), name) for name in self.companies]))
        return _all(parts)


def in_listed_states(c: Column) -> Column:
    return F.coalesce(c.isin(*K.STATE_CODES), F.lit(False))


def same_city(c: Column, city: str) -> Column:
    return F.lower(c) == city.lower()


def category_table(spark: SparkSession) -> DataFrame:
    rows = [(i, key, label, list(prefixes)) for i, (key, label, prefixes) in enumerate(K.CATEGORIES)]
    return spark.createDataFrame(rows, "position int, key string, label string, prefixes array<string>")


def category_search(spark: SparkSession, text: str, limit: int = 3) -> DataFrame:
    """The first categories whose label or key contains the text; texts below two letters find none."""
    low = text.lower()
    table = category_table(spark)
    hit = F.lower("label").contains(low) | F.col("key").contains(low)
    return table.filter(hit & F.lit(len(text) >= 2)).orderBy("position").limit(limit)
