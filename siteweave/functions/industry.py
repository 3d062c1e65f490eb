"""Industry codes: manufacturing tests, titles, categories and approximations from other codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions.text import blank_to_null, leading_int, lookup, starts, strip


def is_manufacturing_naics(c: Column) -> Column:
    return F.coalesce(starts(c, 2).isin(*K.SECTOR_CODES), F.lit(False))


def is_manufacturing_sic(c: Column) -> Column:
    return F.coalesce(leading_int(c).between(2000, 3999), F.lit(False))


def code_tokens(c: Column) -> Column:
    """Codes of a multi-valued field, split on blanks and commas."""
    return F.filter(F.split(c, r"[\s,]+"), lambda code: F.length(code) >= 2)


def validate_naics(raw: Column) -> Column:
    first = F.split(strip(blank_to_null(raw)), r"[\s,]+")[0]
    return F.when(first.rlike(r"^\d{2,6}$") & is_manufacturing_naics(first), first)


def describe_naics(c: Column) -> Column:
    return lookup(K.SUBSECTORS, F.when(F.length(c) >= 3, starts(c, 3)))


def _by_prefix(c: Column, pick: int) -> Column:
    pairs = [(prefix, row[pick]) for row in K.CATEGORIES for prefix in row[2]]
    four = [p for p in pairs if len(p[0]) == 4]
    three = [p for p in pairs if len(p[0]) == 3]
    return F.coalesce(lookup(four, starts(c, 4)), lookup(three, starts(c, 3)))


def category_key(c: Column) -> Column:
    return _by_prefix(c, 0)


def category_label(c: Column) -> Column:
    return F.coalesce(_by_prefix(c, 1), F.lit(K.DEFAULT_CATEGORY_LABEL))


def sic_to_naics(c: Column) -> Column:
    code = leading_int(c)
    return F.when(code.between(2000, 3999), lookup(K.SIC_GROUP_TO_NAICS, F.floor(code / 100).cast("string")))


# Words of a food inspection activity and the code they stand for, first match wins.
ACTIVITY_CODES = (
    ("POULTRY", "311615"), ("SLAUGHTER", "311611"), ("PROCESSING|CURING|SAUSAGE", "311612"), ("RENDERING", "311613"),
    ("EGG", "311999"),
)
ACTIVITY_DEFAULT_CODE = "311611"


def activity_to_naics(activities: Column) -> Column:
    """Food inspection activities to a code."""
    text = F.upper(F.coalesce(activities, F.lit("")))
    tests = [F.when(text.rlike(words), code) for words, code in ACTIVITY_CODES]
    return F.coalesce(*tests, F.lit(ACTIVITY_DEFAULT_CODE))


# Size classes of an establishment.
SIZE_CLASSES = ("Large", "Small", "Very Small")


def size_category(size: Column) -> Column:
    text = F.lower(F.coalesce(size, F.lit("")))
    plain = ~text.contains("very")
    return (
        F.when(text.contains("large") & plain, SIZE_CLASSES[0])
        .when(text.contains("small") & plain, SIZE_CLASSES[1])
        .when(text.rlike("very[ _]small"), SIZE_CLASSES[2])
    )


# Words in a vehicle type name and the code they stand for, first match wins.
VEHICLE_TYPE_CODES = (
    ("motorcycle", "336991"), ("trailer", "336212"), ("bus", "336120"), ("truck|heavy", "336120"),
    ("passenger", "336111"), ("low speed", "336999"), ("multipurpose", "336112"),
    ("equipment|component", "336390"),
)
VEHICLE_DEFAULT_CODE = "336110"


def vehicle_types_to_naics(names: Column) -> Column:
    """Array of vehicle type names to a code."""

    def named(words: str) -> Column:
        return F.exists(names, lambda name: F.lower(name).rlike(words))

    result = F.lit(VEHICLE_DEFAULT_CODE)
    for words, code in reversed(VEHICLE_TYPE_CODES):
        result = F.when(named(words), code).otherwise(result)
    return result


def sector_label(prefix: Column, labels: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(lookup(labels, prefix), F.lit(K.DEFAULT_SECTOR_LABEL))
