"""SQL texts of the scalar rules for the checking database, written from the rules themselves.

They share fixed values with the Spark side, and nothing else.
"""

from __future__ import annotations

from siteweave import constants as K
from siteweave import fixtures as X
from siteweave.functions.company import Rules


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def map_of(pairs) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in pairs) + "}"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def collapse(c: str) -> str:
    return f"regexp_replace({c}, '\\s+', ' ', 'g')"


def address(c: str) -> str:
    text = f"regexp_replace({strip(f'upper({c})')}, {quote(K.UNIT_PATTERN)}, '', 'g')"
    for short, full in K.DIRECTIONALS:
        text = f"regexp_replace({text}, {quote(rf'{chr(92)}b{short}{chr(92)}b')}, {quote(full)}, 'g')"
    types = map_of(K.STREET_TYPES)
    words = (
        f"list_transform(string_split_regex({text}, '\\s+'), "
        f"lambda w: coalesce({types}[regexp_replace(w, '[.,]$', '')], w))"
    )
    return f"nullif({strip(collapse(f'array_to_string({words}, chr(32))'))}, '')"


def city(c: str) -> str:
    return f"nullif({collapse(strip(f'upper({c})'))}, '')"


def zip5(c: str) -> str:
    digits = f"split_part(regexp_replace({c}, '[^0-9-]', '', 'g'), '-', 1)"
    return f"case when length({digits}) >= 5 then left({digits}, 5) end"


def similarity(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return (
        f"case when {a} is null or {b} is null then 0 when {a} = {b} then 100 else "
        f"cast(floor((1::double - levenshtein({a}, {b})::double / {longest}) * 100 + 0.5::double) as int) end"
    )


def proximity(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    half = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    )
    meters = f"(6371000 * 2 * atan2(sqrt({half}), sqrt(1 - {half})))"
    steps = " ".join(f"when {meters} < {limit} then {points}" for limit, points in K.GEO_STEPS)
    return f"coalesce(case when {lat1} is null or {lat2} is null then 0 {steps} else 0 end, 0)"


def blocked(c: str) -> str:
    text = strip(c)
    return (
        f"coalesce(length({text}) <= 1 or lower({text}) in {in_list(K.BLOCKED_NAMES)} "
        f"or regexp_matches({text}, '^[\\d\\s.,-]+$'), true)"
    )


def title(c: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w, i: "
        f"case when upper(w) in {in_list(K.TITLE_UPPER_WORDS)} then upper(w) "
        f"when i > 1 and w in {in_list(K.TITLE_LOWER_WORDS)} then w "
        f"else upper(left(w, 1)) || substr(w, 2) end), ' ')"
    )


def clean_company(c: str) -> str:
    cut = f"regexp_replace(nullif({c}, ''), {quote('(?i)' + K.TRAILING_SUFFIX_PATTERN)}, '')"
    text = strip(collapse(f"regexp_replace({cut}, '(?i)^THE\\s+', '')"))
    return f"case when not {blocked(text)} then {title(text)} end"


def rule_company(c: str, rules: Rules) -> str:
    if not rules:
        return "cast(null as varchar)"
    whens = " ".join(f"when regexp_matches({c}, {quote(r.regex)}) then {quote(r.company)}" for r in rules)
    return f"case {whens} end"


def normalize_company(c: str, rules: Rules) -> str:
    text = strip(c)
    return (
        f"case when not {blocked(text)} then coalesce({rule_company(text, rules)}, {clean_company(text)}) end"
    )


def matches(c: str, pattern: str, flags: str = "(?i)") -> str:
    return f"coalesce(regexp_matches({c}, {quote(flags + pattern)}), false)"


def stub(c: str) -> str:
    text = strip(f"coalesce({c}, '')")
    any_of = " or ".join(f"regexp_matches({text}, {quote('(?i)' + p)})" for p in K.STUB_PATTERNS)
    return (
        f"({text} <> '' and not regexp_matches({text}, {quote(K.STUB_KEEP_PREFIX_PATTERN)}) "
        f"and not regexp_matches({text}, {quote('(?i)' + K.STUB_KEEP_DBA_PATTERN)}) and ({any_of}))"
    )


def category(c: str, pick: int) -> str:
    pairs = [(p, row[pick]) for row in K.CATEGORIES for p in row[2]]
    whens = " ".join(f"when starts_with({c}, {quote(p)}) then {quote(v)}" for p, v in sorted(pairs, key=lambda x: -len(x[0])))
    return f"case {whens} end"


def lookup(pairs, c: str) -> str:
    return f"case {c} " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in pairs) + " end"


# --- shared CTE texts ------------------------------------------------------------------------


def raw_cte() -> str:
    return f"raw_records as ({X.for_oracle(X.RAW_RECORDS)})"


def facilities_cte() -> str:
    return f"facilities as ({X.for_oracle(X.FACILITIES)})"


def companies_cte() -> str:
    return f"companies as ({X.for_oracle(X.COMPANIES)})"


def lineage_cte() -> str:
    return f"lineage as ({X.for_oracle(X.LINEAGE)})"


def census_cte() -> str:
    return f"census as ({X.for_oracle(X.CENSUS)})"


def names_cte() -> str:
    return f"names as ({X.for_oracle(X.NAMES)})"


def linkable_cte() -> str:
    """Raw records with one inspection per establishment."""
    return f"""{raw_cte()}, linkable as (
  select * from raw_records where source <> 'osha' union all
  select * exclude (rn) from (select *, row_number() over (
    partition by upper(raw_name), upper(raw_city), upper(raw_state) order by osha_inspection_date desc nulls last, id) as rn
    from raw_records where source = 'osha') where rn = 1),
distinct_linkable as (select * exclude (rn) from (select *, row_number() over (partition by source, source_record_id order by id) as rn
  from linkable) where rn = 1)"""


def prepared_cte(rows: str = "linkable") -> str:
    return f"""{linkable_cte()}, fields as (
  select id, source, raw_state as state, coalesce(left({zip5('raw_zip')}, 3), '000') as area,
    {strip('upper(raw_name)')} as name, {address('raw_address')} as street, {city('raw_city')} as city,
    left({strip('raw_zip')}, 5) as zip5, try_cast(raw_latitude as double) as lat, try_cast(raw_longitude as double) as lng,
    raw_naics_code as naics, registry_id from {rows}),
prepared as (select *, min(id) over (partition by source, state, area, name, street, city, zip5, lat, lng, naics, registry_id) as fold,
  min(id) over (partition by source, state, registry_id) as registry_fold from fields)"""


def candidates_cte(rows: str = "linkable") -> str:
    """Every cross-source pair of every block, scored one by one; equal records then count as one."""
    naics = (
        "case when a.naics = b.naics then 100 when left(a.naics, 4) = left(b.naics, 4) then 70 "
        "when left(a.naics, 3) = left(b.naics, 3) then 50 when left(a.naics, 2) = left(b.naics, 2) then 30 else 0 end"
    )
    street = (
        "case when a.street = b.street then 40 when a.street is not null and b.street is not null then "
        f"cast(floor(({similarity('a.street', 'b.street')}) * 0.3::double + 0.5::double) as int) else 0 end"
    )
    zips = "case when a.zip5 = b.zip5 then 30 when left(a.zip5, 3) = left(b.zip5, 3) then 15 else 0 end"
    scores = f"""a.id as a_id, b.id as b_id, a.source as a_source, b.source as b_source, a.state, a.fold as a_fold, b.fold as b_fold,
    a.registry_fold as a_reg, b.registry_fold as b_reg,
    {similarity('a.name', 'b.name')} as name_score, {proximity('a.lat', 'a.lng', 'b.lat', 'b.lng')} as geo_score,
    least(100, {street} + case when a.city = b.city then 30 else 0 end + {zips}) as address_score, {naics} as naics_score,
    coalesce(a.registry_id = b.registry_id, false) as registered"""
    return f"""{prepared_cte(rows)}, compared as materialized (select * from prepared where state is not null),
pairs as (
  select {scores}
  from compared a join compared b on a.state = b.state and a.area = b.area and a.id < b.id and a.source <> b.source
  union all select {scores}
  from compared a join compared b on a.state = b.state and a.registry_id = b.registry_id and a.area <> b.area and a.id < b.id and a.source <> b.source),
scored as (select *, cast(floor(name_score * 0.35::double + geo_score * 0.30::double + address_score * 0.20::double
    + naics_score * 0.15::double + 0.5::double) as int) as composite from pairs),
matched as (
  select case when registered then a_reg else a_fold end as fa, case when registered then b_reg else b_fold end as fb, a_source, b_source, state,
    case when registered then 100 else name_score end as name_score, case when registered then 100 else geo_score end as geo_score,
    case when registered then 100 else address_score end as address_score,
    case when registered then 100 else naics_score end as naics_score,
    case when registered then 99 else composite end as confidence_score,
    case when registered then 'frs_id' else 'geo_name' end as match_type,
    case when registered or composite >= 90 then 'auto_matched' else 'pending' end as status
  from scored where registered or composite >= 60),
candidates as (
  select least(fa, fb) as record_a, greatest(fa, fb) as record_b, case when fa < fb then a_source else b_source end as source_a,
    case when fa < fb then b_source else a_source end as source_b, state, name_score, geo_score, address_score, naics_score,
    confidence_score, match_type, status, count(*) as pair_count from matched group by all)"""
