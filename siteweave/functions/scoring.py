"""Pair scores between 0 and 100, over normalised columns of two records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions.text import round_half_up, starts


@dataclass(frozen=True)
class MatchConfig:
    auto: int = K.AUTO_MATCH_THRESHOLD
    review: int = K.REVIEW_THRESHOLD
    max_block: int = K.MAX_BLOCK
    weights: dict[str, float] = field(default_factory=lambda: dict(K.WEIGHTS))
    aggregate_sources: tuple[str, ...] = K.AGGREGATE_SOURCES
    merge_statuses: tuple[str, ...] = ("auto_matched",)
    registry_cross_state: bool = False


def text_similarity(a: Column, b: Column, least: Column | None = None) -> Column:
    """Edit similarity of two upper-case texts; 0 when one is missing.

    With ``least``, similarities below it may come out as 0: the distance is then only
    followed as far as it matters.
    """
    longest = F.greatest(F.length(a), F.length(b))
    if least is None:
        distance = F.levenshtein(a, b)
    else:
        # Rounding can lift a similarity by half a point.
        most = F.floor((F.lit(100.5) - F.greatest(least, F.lit(0.0))) / 100 * longest) + 1
        found = F.call_function("levenshtein", a, b, most.cast("int"))
        distance = F.when(found < 0, longest).otherwise(found)
    similar = round_half_up((F.lit(1.0) - distance / longest) * 100)
    return F.coalesce(F.when(a == b, 100).when(longest > 0, similar), F.lit(0))


def naics_score(a: Column, b: Column) -> Column:
    score = F.when(a == b, 100)
    for length, points in K.NAICS_STEPS:
        score = score.when(starts(a, length) == starts(b, length), points)
    return F.coalesce(score, F.lit(0))


def address_score(a, b) -> Column:
    """``a`` and ``b`` give the columns street, city and zip5 of each side."""
    street = F.when(a("street") == b("street"), 40).otherwise(
        F.when(
            a("street").isNotNull() & b("street").isNotNull(),
            round_half_up(text_similarity(a("street"), b("street")) * F.lit(0.3)),
        ).otherwise(0)
    )
    return F.least(F.lit(100), street + city_points(a, b) + zip_points(a, b))


def city_points(a, b) -> Column:
    return F.when(a("city") == b("city"), 30).otherwise(0)


def zip_points(a, b) -> Column:
    return (
        F.when(a("zip5") == b("zip5"), 30)
        .when(starts(a("zip5"), 3) == starts(b("zip5"), 3), 15)
        .otherwise(0)
    )


def weighted(name: Column, geo: Column, address: Column, naics: Column, weights: dict[str, float]) -> Column:
    return (
        name * F.lit(weights["name"])
        + geo * F.lit(weights["geo"])
        + address * F.lit(weights["address"])
        + naics * F.lit(weights["naics"])
    )


def match_status(score: Column, config: MatchConfig) -> Column:
    return F.when(score >= config.auto, "auto_matched").when(score >= config.review, "pending")
