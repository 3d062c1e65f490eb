"""Text clean-up as Column expressions: names, addresses, cities, postal codes, numbers in text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteweave import constants as K

# Source files carry no-break and other wide spaces that Java's \s leaves out.
# The wide ones stand behind a test of their own, so that a plain letter is told by two looks.
SPACE = r"[\t\n\x0B\f\r \xA0[\x{100}-\x{ffff}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]]"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_map(pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal map, built in one call: long lists of literals are slow to hand over one by one."""
    return F.expr("map(" + ", ".join(_sql_text(part) for pair in pairs for part in pair) + ")")


def one_of(c: Column, values: Iterable[str]) -> Column:
    """Membership in a fixed list of texts."""
    return F.array_contains(F.expr("array(" + ", ".join(_sql_text(v) for v in values) + ")"), c)


def lookup(pairs: Iterable[tuple[str, str]], key: Column) -> Column:
    """Literal map lookup, null when the key is null or not listed."""
    return F.when(key.isNotNull(), F.try_element_at(text_map(pairs), key))

SPACE_CHARS = "\t\n\v\f\r " + "".join(
    chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def starts(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("int")


def leading_number(c: Column) -> Column:
    """Number at the start of a text, ignoring what follows it ("12.3N" is 12.3)."""
    found = F.regexp_extract(c, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return blank_to_null(found).try_cast("double")


def leading_int(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"^\s*([-+]?\d+)", 1)).try_cast("bigint")


def normalize_address(raw: Column, strict_units: bool = False) -> Column:
    """Comparable street line: upper case, no unit, directions and street types spelled out.

    ``strict_units`` asks for a space after the unit word, so that ``FLORIDA``
    is not read as ``FL`` followed by a unit.
    """
    unit = K.UNIT_PATTERN.replace(r"\s*\.?\s*", r"(?:\.\s*|\s+)") if strict_units else K.UNIT_PATTERN
    # The words' first letters are looked at before the words, which tells most places apart.
    firsts = "".join(sorted({word[0] for word in K.UNIT_PATTERN.partition("(")[2].partition(")")[0].split("|")}))
    text = F.regexp_replace(strip(F.upper(raw)), unit.replace("(", f"(?=[{firsts}])(", 1), "")
    any_direction = r"\b(?:" + "|".join(short for short, _ in K.DIRECTIONALS) + r")\b"

    def directed(word: Column) -> Column:
        """Directions spelled out; most words hold none and are asked once."""
        spelled = word
        for short, full in K.DIRECTIONALS:
            spelled = F.regexp_replace(spelled, rf"\b{short}\b", full)
        return F.when(word.rlike(any_direction), spelled).otherwise(word)

    types = text_map(K.STREET_TYPES)
    longest = max(len(short) for short, _ in K.STREET_TYPES)

    def typed(word: Column) -> Column:
        plain = F.when(word.endswith(".") | word.endswith(","), F.left(word, F.length(word) - 1)).otherwise(word)
        return F.coalesce(F.when(F.length(plain) <= longest, F.try_element_at(types, plain)), word)

    words = F.transform(F.transform(F.split(text, f"{SPACE}+"), directed), typed)
    # Words hold no space, so only blanks at the ends are left.
    return blank_to_null(F.trim(F.array_join(words, " ")))


def normalize_city(raw: Column) -> Column:
    return blank_to_null(collapse_spaces(strip(F.upper(raw))))


def normalize_zip(raw: Column) -> Column:
    digits = F.substring_index(F.regexp_replace(raw, "[^0-9-]", ""), "-", 1)
    return F.when(F.length(digits) >= 5, starts(digits, 5))


def zip_prefix(zip5: Column) -> Column:
    return F.when(F.length(zip5) >= 3, starts(zip5, 3))


def decode_entities(c: Column) -> Column:
    """Named entities first, then decimal ones, each in one pass."""
    text = c
    for entity, char in (("AMP", "&"), ("LT", "<"), ("GT", ">"), ("QUOT", '"'), ("APOS", "'")):
        text = F.regexp_replace(text, f"(?i)&{entity};", char)
    codes = F.regexp_extract_all(text, F.lit(r"&#(\d+);"), F.lit(1))
    # A code unit is two bytes; chr() would stop at 255.
    chars = F.transform(
        codes,
        lambda n: F.decode(
            F.unhex(F.lpad(F.hex(F.pmod(n.try_cast("decimal(38,0)"), F.lit(65536)).cast("bigint")), 4, "0")),
            "UTF-16BE",
        ),
    )
    parts = F.split(text, r"&#\d+;", -1)
    joined = F.zip_with(parts, chars, lambda part, char: F.concat(part, F.coalesce(char, F.lit(""))))
    return F.when(F.size(codes) > 0, F.array_join(joined, "")).otherwise(text)


def normalize_facility_name(raw: Column) -> Column:
    name = collapse_spaces(strip(decode_entities(raw)))
    return blank_to_null(strip(F.regexp_replace(name, "[,;.]+$", "")))


def state_from_name(c: Column) -> Column:
    """Two-letter code for a state name or code of the 52 listed states, else null."""
    pairs = [(name.lower(), code) for code, name in K.US_STATES]
    pairs += [(code.lower(), code) for code, _ in K.US_STATES]
    return lookup(pairs, F.lower(strip(c)))


def state_loose(c: Column) -> Column:
    """Any text of at most two characters is kept as a code, names are looked up."""
    text = F.upper(strip(blank_to_null(c)))
    names = [(name.upper(), code) for code, name in K.US_STATES]
    return F.when(F.length(text) == 2, text).otherwise(
        F.coalesce(lookup(names, text), F.when(F.length(text) < 2, text))
    )


def state_seed(c: Column) -> Column:
    """Names, two territories more, then any two-letter code."""
    text = F.upper(strip(blank_to_null(c)))
    names = [(name.upper(), code) for code, name in (*K.US_STATES, *K.EXTRA_TERRITORIES)]
    return F.coalesce(lookup(names, text), F.when(F.length(text) == 2, text))


def cursor(value: Column, key: Column) -> Column:
    """Keyset cursor ``value:key``."""
    return F.concat_ws(":", value.cast("string"), key)


def parse_cursor(text: str) -> tuple[int, str]:
    value, key = text.split(":", 1)
    return int(value), key


def merge_json_objects(base: Column, extra: Column) -> Column:
    """JSON text objects merged key by key, the second one wins; values keep their types, nulls included.

    A text that is no object counts as an empty one.
    """
    empty = F.create_map().cast("map<string,variant>")

    def entries(text: Column) -> Column:
        value = F.try_parse_json(text)
        is_object = F.schema_of_variant(value).startswith("OBJECT")
        return F.coalesce(F.when(is_object, value.cast("map<string,variant>")), empty)

    merged = F.map_zip_with(entries(base), entries(extra), lambda _, old, new: F.coalesce(new, old))
    return F.to_json(merged)


def text_array(c: Column) -> Column:
    """Array of texts held as JSON; malformed text becomes null."""
    return F.from_json(c, "array<string>")
