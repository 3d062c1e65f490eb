"""Company names: blocked values, ordered rules, clean-up and extraction from site names.

The rules are a parameter: an ordered list of patterns with the name they stand
for. They are evaluated inside the executors' expressions, pattern by pattern
with early exit, behind one search that rejects most names at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions.text import blank_to_null, collapse_spaces, one_of, starts, strip

MAX_RULES = 5000


@dataclass(frozen=True)
class CompanyRule:
    pattern: str
    company: str
    exact_case: bool = False

    @property
    def regex(self) -> str:
        return self.pattern if self.exact_case else f"(?i){self.pattern}"


Rules = Sequence[CompanyRule]


def rules_from_table(table: DataFrame, max_rules: int = MAX_RULES) -> tuple[CompanyRule, ...]:
    """Rules held as a table (rule_no, pattern, company, exact_case), in rule order.

    The table is a code list, not data: its size is checked before it becomes
    part of the plan.
    """
    rows = table.select("rule_no", "pattern", "company", "exact_case").limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} company rules; split the list and resolve in passes")
    ordered = sorted(rows, key=lambda row: row["rule_no"])
    return tuple(CompanyRule(r["pattern"], r["company"], bool(r["exact_case"])) for r in ordered)


def is_blocked(c: Column) -> Column:
    return _is_blocked_text(strip(c))


def _is_blocked_text(text: Column) -> Column:
    """Test of a text without blanks around it."""
    return F.coalesce(
        (F.length(text) <= 1) | one_of(F.lower(text), K.BLOCKED_NAMES) | text.rlike(r"^[\d\s.,-]+$"),
        F.lit(True),
    )


def rule_company(c: Column, rules: Rules) -> Column:
    """Company of the first rule whose pattern is found, else null."""
    if not rules:
        return F.lit(None).cast("string")
    first_match = F.coalesce(*[F.when(c.rlike(rule.regex), rule.company) for rule in rules])
    any_match = "|".join(f"(?:{rule.pattern})" if rule.exact_case else f"(?i:{rule.pattern})" for rule in rules)
    return F.when(c.rlike(any_match), first_match)


def title_case(c: Column) -> Column:
    """Word by word: known short forms upper, small words lower unless first."""
    listed = max(map(len, (*K.TITLE_UPPER_WORDS, *K.TITLE_LOWER_WORDS)))

    def cased(word: Column, i: Column) -> Column:
        # Upper case never shortens a word, so longer words are in no list.
        short = F.when(one_of(F.upper(word), K.TITLE_UPPER_WORDS), F.upper(word)).when((i > 0) & one_of(word, K.TITLE_LOWER_WORDS), word)
        return F.coalesce(F.when(F.length(word) <= listed, short), F.concat(F.upper(starts(word, 1)), F.substring(word, 2, 1 << 30)))

    return F.array_join(F.transform(F.split(F.lower(c), " ", -1), cased), " ")


def _without_suffix(c: Column) -> Column:
    text = F.regexp_replace(blank_to_null(c), f"(?i){K.TRAILING_SUFFIX_PATTERN}", "")
    return strip(collapse_spaces(F.regexp_replace(text, r"(?i)^THE\s+", "")))


def clean_company(c: Column) -> Column:
    text = _without_suffix(c)
    return F.when(~_is_blocked_text(text), title_case(text))


def normalize_company(c: Column, rules: Rules) -> Column:
    text = strip(c)
    return F.when(~_is_blocked_text(text), F.coalesce(rule_company(text, rules), clean_company(text)))


def has_corporate_form(c: Column) -> Column:
    return F.coalesce(c.rlike(f"(?i){K.CORPORATE_PATTERN}"), F.lit(False))


# --- staged evaluation -----------------------------------------------------------------------
#
# A site name gives a handful of candidate texts. Rules and clean-up run once over the array of
# candidates; the strategies then only pick from the results. The array passes through a one-row
# explode, so that later filters cannot copy its expression into every place that reads it.

_SLOTS = (
    "whole", "whole_stripped", *[f"sep{i}" for i in range(5)], "division", "a_division", "dba", "colon", "hash",
    "no_city", "stripped", "hyphen",
)


def _before(c: Column, separator: str) -> Column:
    """Text before the first separator, null when it is missing or comes first."""
    at = F.instr(c, separator)
    return F.when(at > 1, strip(F.substring_index(c, separator, 1)))


def _after(c: Column, separator: str) -> Column:
    return strip(F.substring(c, F.instr(c, F.lit(separator)) + F.lit(len(separator)), F.length(c)))


def _group(c: Column, pattern: str, flags: str = "(?i)") -> Column:
    regex = flags + pattern
    return F.when(c.rlike(regex), strip(F.regexp_extract(c, regex, 1)))


def _sited(df: DataFrame, name: str) -> DataFrame:
    """Adds the site name, and it without its trailing words, each computed once a row: the candidates read them many times."""
    site = blank_to_null(F.col(name))
    staged = df.select("*", F.inline(F.array(F.struct(site.alias("_site")))))
    trimmed = strip(F.regexp_replace("_site", F.lit(f"(?i){K.TRAILER_PATTERN}"), F.lit("")))
    return staged.select("*", F.inline(F.array(F.struct(strip(F.col("_site")).alias("_bare_site"), trimmed.alias("_trimmed")))))


def _candidates(name: Column) -> list[Column]:
    rest = F.regexp_replace(name, f"(?i){K.A_DIVISION_OF_PATTERN}", "")
    bare, trimmed = F.col("_bare_site"), F.col("_trimmed")
    stripped = F.when(trimmed != name, trimmed)
    no_city = strip(F.regexp_replace(stripped, r"\s+[A-Z][A-Za-z]+$", ""))
    return [
        name,
        # Most names have no blanks around them: then the whole name's results hold.
        F.when(bare != name, bare),
        *[_before(name, sep) for sep in (*K.DASH_SEPARATORS, *K.SOFT_SEPARATORS)],
        _group(name, K.DIVISION_OF_PATTERN),
        F.when(name.rlike(f"(?i){K.A_DIVISION_OF_PATTERN}"), blank_to_null(strip(rest))),
        _group(name, K.DBA_PATTERN),
        F.when(F.instr(name, ":") > 3, strip(F.substring_index(name, ":", 1))),
        _group(name, K.HASH_PATTERN),
        F.when(F.length(no_city) > 2, no_city),
        stripped,
        _group(name, K.HYPHEN_PATTERN, flags=""),
    ]


def _evaluated(name: Column, rules: Rules) -> Column:
    """array of (text, rule, cleaned, company) for every slot; each step reads the one before."""
    read = F.transform(
        F.array(*_candidates(name)),
        lambda text: F.struct(
            text.alias("text"), rule_company(text, rules).alias("rule"), _without_suffix(text).alias("bare")
        ),
    )
    cleaned = F.transform(
        read,
        lambda s: F.struct(
            s["text"].alias("text"),
            s["rule"].alias("rule"),
            F.when(~_is_blocked_text(s["bare"]), title_case(s["bare"])).alias("cleaned"),
        ),
    )
    # Every slot but the whole name is a text without blanks around it.
    return F.transform(
        cleaned,
        lambda s: F.struct(
            s["text"].alias("text"),
            s["rule"].alias("rule"),
            s["cleaned"].alias("cleaned"),
            F.when(~_is_blocked_text(s["text"]), F.coalesce(s["rule"], s["cleaned"])).alias("company"),
        ),
    )


def _extracted(name: Column, slots: Column) -> Column:
    """First strategy that settles the name. A strategy may settle it as "no company"."""

    def slot(key: str) -> Column:
        return slots[_SLOTS.index(key)]

    def settle(condition: Column, value: Column) -> Column:
        return F.when(condition, F.struct(value.alias("company")))

    def differs(s: Column) -> Column:
        return ~s["company"].eqNullSafe(s["cleaned"])

    def before_separator(key: str, equipment: Column) -> Column:
        s = slot(key)
        taken = s["company"].isNotNull() & (equipment | (s["company"] != s["text"]))
        value = F.when(taken, s["company"]).otherwise(s["cleaned"])
        return settle(value.isNotNull(), value)

    def ruled(key: str, corporate_too: bool) -> list[Column]:
        s = slot(key)
        found = s["text"].isNotNull()
        out = [settle(found & differs(s), s["company"])]
        if corporate_too:
            out.append(settle(found & has_corporate_form(s["text"]), s["cleaned"]))
        return out

    no = F.lit(False)
    steps = [settle(name.rlike(f"(?i){K.NON_COMPANY_PATTERN}"), F.lit(None).cast("string"))]
    for i, sep in enumerate(K.DASH_SEPARATORS):
        equipment = F.coalesce(_after(name, sep).rlike(f"(?i){K.EQUIPMENT_PATTERN}"), no)
        steps.append(before_separator(f"sep{i}", equipment))
    steps += [before_separator(f"sep{i}", no) for i in (3, 4)]
    whole = slot("whole")
    steps.append(settle(whole["rule"].isNotNull(), whole["rule"]))
    for key in ("division", "a_division", "dba"):
        steps += ruled(key, corporate_too=True)
    steps += ruled("colon", corporate_too=False)
    steps += ruled("hash", corporate_too=True)
    for key in ("no_city", "stripped", "hyphen"):
        steps += ruled(key, corporate_too=False)
    words = F.size(F.split(name, r"\s+", -1))
    by_term = name.rlike(f"(?i){K.INDUSTRY_TERM_PATTERN}") & (words >= 2)
    steps.append(settle(has_corporate_form(name) | by_term, whole["cleaned"]))
    return F.coalesce(*steps)["company"]


def with_company(
    df: DataFrame,
    out: str,
    rules: Rules,
    name: str,
    parent: str | None = None,
    aggressive: bool = False,
) -> DataFrame:
    """Adds the company resolved from a known parent and the site name.

    Order: the parent, the name's own structure, a rule hit on the whole name.
    ``aggressive`` goes on with looser readings of the name.
    """
    columns = df.columns
    parent_col = F.col(parent) if parent else F.lit(None).cast("string")
    site = F.col("_site")
    read = F.struct(_evaluated(site, rules).alias("slots"), normalize_company(parent_col, rules).alias("parent"))
    staged = _sited(df, name).select("*", F.explode(F.array(read)).alias("_read"))
    staged = staged.select("*", F.col("_read.slots").alias("_slots"), F.col("_read.parent").alias("_parent"))
    whole, whole_stripped = F.col("_slots")[0], F.col("_slots")[1]
    staged = staged.withColumn("_extracted", _extracted(site, F.col("_slots")))
    settled = F.when(whole_stripped["text"].isNotNull(), whole_stripped["company"]).otherwise(whole["company"])
    ruled_whole = F.when(~settled.eqNullSafe(whole["cleaned"]), settled)
    resolved = F.coalesce(F.col("_parent"), F.col("_extracted"), ruled_whole)
    if aggressive:
        resolved = F.coalesce(resolved, *_loose_readings(site, rules))
    return staged.select(*columns, resolved.alias(out))


def _loose_readings(site: Column, rules: Rules) -> list[Column]:
    upper = strip(F.upper(site))
    head = F.regexp_extract(upper, f"(?is)^.*?{K.FIRST_SUFFIX_PATTERN}", 0)
    part = strip(F.substring(site, F.lit(1), F.length(head)))
    out = [rule_company(upper, rules), F.when(F.length(part) >= 3, normalize_company(part, rules))]
    for sep in K.EXTRA_SEPARATORS:
        left = F.when(F.instr(site, sep) > 3, strip(F.substring_index(site, sep, 1)))
        out.append(F.when(F.length(left) >= 3, clean_company(left)))
    tail = r"\(([^)]+)\)\s*$"
    inner = F.when(site.rlike(tail), F.regexp_extract(site, tail, 1))
    out.append(F.when(F.length(inner) >= 3, normalize_company(inner, rules)))
    return out


def extract_company(df: DataFrame, out: str, rules: Rules, name: str) -> DataFrame:
    """Company read from the structure of the site name alone."""
    columns = df.columns
    site = F.col("_site")
    staged = _sited(df, name).select("*", F.explode(F.array(_evaluated(site, rules))).alias("_slots"))
    return staged.withColumn(out, _extracted(site, F.col("_slots"))).select(*columns, out)


def ticker_forms(c: Column, pattern: str) -> Column:
    return blank_to_null(strip(F.regexp_replace(c, f"(?i){pattern}", "")))


