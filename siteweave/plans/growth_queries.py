"""Queries over tables that grow: kept breakdowns, searches by index, whole pages from one scan, and the repair job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave import fixtures as X
from siteweave.operators import breakdowns as B
from siteweave.operators import rules as R
from siteweave.operators import search
from siteweave.plans import jobs
from siteweave.plans import oracle_text as O
from siteweave.plans.analytic_queries import COM, FAC, RAW, STATES, com, fac, raw
from siteweave.plans.linkage_queries import RULES
from siteweave.plans.table_queries import EQ, equipment_names, slot_ctes, unlinked_sql
from siteweave.session import shared_folder
from siteweave.streaming import counters
from siteweave.streaming.counters import Breakdown
from siteweave.streaming.shelf import Shelf

BUCKETS = 8


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_breakdowns(s: SparkSession, d: str) -> DataFrame:
    """Golden rows by state and by subsector, kept over five batches: all rows come in under a wrong state and company, are put
    right in three batches, and some go in the last."""
    rows = fac(s, d).select("id", "state", F.substring("primary_naics", 1, 3).alias("subsector"), "company_id", "source_count").cache()
    first = rows.withColumns({"state": F.lit("TX"), "company_id": F.lit("c-first")})
    kept = Shelf(s, _folder(s, "kept"), counters.COUNTERS, BUCKETS)
    both = [Breakdown(c, (c,), ("company_id",), ("source_count",)) for c in ("state", "subsector")]
    counters.changed(kept, both, None, first, 0)
    for k in range(3):
        part = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3)) == k
        counters.changed(kept, both, first.filter(part), rows.filter(part), k + 1)
    counters.changed(kept, both, rows.filter("id like '%7'"), None, 4)
    shown = [
        counters.current(kept, b).select(
            F.lit(b.name).alias("breakdown"), F.col(b.name).alias("value"), F.col("n").alias("facilities"),
            F.col("distinct_company_id").alias("companies"), F.col("total_source_count").alias("sources"))
        for b in both
    ]
    return shown[0].unionByName(shown[1])


#: Search texts with and without wildcards, one without a trigram and one that nothing holds.
TERMS = ("anvil", "Brand#1%", "RED", "p_ant", "steel%plant", "lo", "zzzz")


def indexed_search(s: SparkSession, d: str) -> DataFrame:
    """Golden rows by name or company name for several search texts, found by trigrams."""
    rows = fac(s, d).select("id", "name", "company_name").cache()
    index = search.TextIndex(s, _folder(s, "trigrams"), BUCKETS)
    index.add(rows, ["name", "company_name"], 0)
    found = None
    for term in TERMS:
        own = search.search(rows, index, term, ["name", "company_name"]).select(F.lit(term).alias("term"), "id", "name")
        found = own if found is None else found.unionByName(own)
    return found


#: A rule list as long as the parts' names and brands are many, with one rule that has no letters.
RULE_TABLE = """
select 1000000 + min(p_partkey) as rule_no, upper(p_name) || '( -| INC|,| /| CO | LLC)' as pattern, 'Maker ' || p_name as company, false as exact_case
from {part} group by p_name
union all select min(p_partkey), upper(p_brand) || '( G[0-9]+| HOLD| )', 'Brand ' || p_brand, true from {part} group by p_brand
union all select 5000000, '^[0-9]+ ', 'Numbered', false"""


def rule_lookup(s: SparkSession, d: str) -> DataFrame:
    """The first rule of a long list for each site name."""
    return R.by_rules(X.derive(s, d, X.NAMES), X.derive(s, d, RULE_TABLE))


def state_panels(s: SparkSession, d: str) -> DataFrame:
    """The pages of all listed states: totals, codes, companies, sources and cities."""
    rows = fac(s, d)
    return B.place_panels(rows.filter(B.in_listed_states(F.col("state"))), com(s, d))


def repair_job(s: SparkSession, d: str) -> DataFrame:
    """Misattributed golden rows are unlinked, read anew and enriched."""
    owner = F.when(F.col("source") == "osha", F.concat(F.lit("f"), F.substring("id", 12, 8)))
    rows = fac(s, d).drop("name", "company_id", "company_name", "city").join(equipment_names(s, d), "id")
    store = jobs.repair(jobs.Store(raw(s, d).withColumn("facility_id", owner), rows, com(s, d)), RULES)
    return store.facilities.groupBy("company_name").agg(
        F.count(F.lit(1)).alias("facilities"), F.count("company_id").alias("linked"), F.sum("confidence").alias("confidence"),
        F.count_if(F.col("employee_count") > 0).alias("staffed"))


def _repair_sql() -> str:
    ctes, resolved, _ = slot_ctes("select id, nullif(name, '') as f, cast(null as varchar) as parent, company_id, company_name from freed")
    named = f"case when company_id is null and company_name is null then {resolved} else company_name end"
    return f"""with {EQ}, {FAC}, {RAW}, freed as ({unlinked_sql('select * from equipment', 'name,')}), {ctes},
  n as (select id, {named} as company_name from s4),
  staff as (select * from (select 'f' || substr(id, 12, 8) as id, osha_employee_count as n, row_number() over (
    partition by substr(id, 12, 8) order by osha_inspection_date desc nulls last, id) as rn from raw_records where source = 'osha' and osha_employee_count > 0) where rn = 1),
  e as (select n.company_name, f.source_count, f.latitude,
    case when coalesce(f.employee_count, 0) = 0 then coalesce(staff.n, f.employee_count) else f.employee_count end as people
    from n join facilities f on f.id = n.id left join staff on staff.id = n.id)
select company_name, count(*) as facilities, count(company_name) as linked, cast(sum(least(100,
  30 + case when source_count >= 3 then 30 when source_count >= 2 then 20 else 0 end + case when latitude is not null then 20 else 0 end
  + case when company_name is not null then 10 else 0 end + case when people > 0 then 10 else 0 end)) as bigint) as confidence,
  count(*) filter (where people > 0) as staffed from e group by 1"""


_LIKE = " union all ".join(
    f"select {O.quote(t)} as term, id, name from facilities where name ilike {O.quote(f'%{t}%')} or company_name ilike {O.quote(f'%{t}%')}" for t in TERMS
)

QUERIES = {
    "kept_breakdowns": (
        kept_breakdowns,
        f"""with {FAC}, f as (select state, substr(primary_naics, 1, 3) as subsector, company_id, source_count from facilities where id not like '%7')
        select 'state' as breakdown, state as value, count(*) as facilities, count(distinct company_id) as companies, cast(sum(source_count) as bigint) as sources
        from f group by state union all
        select 'subsector', subsector, count(*), count(distinct company_id), cast(sum(source_count) as bigint) from f group by subsector"""),
    "indexed_search": (indexed_search, f"with {FAC} {_LIKE}"),
    "state_panels": (
        state_panels,
        f"""with {FAC}, {COM}, l as (select * from facilities where state in {STATES}),
        e as (
          select state, 'total' as panel, cast(null as varchar) as key, cast(null as varchar) as label, company_id as company from l
          union all select state, 'codes', primary_naics, primary_naics_description, null from l where primary_naics is not null
          union all select l.state, 'companies', c.id, c.name, null from l join companies c on c.id = l.company_id
          union all select state, 'sources', unnest(from_json(sources, '["VARCHAR"]')), null, null from l
          union all select state, 'cities', city, null, company_id from l where city is not null),
        c as (select state, panel, key, label, count(*) as facilities, count(distinct company) as companies from e group by all),
        r as (select *, row_number() over (partition by state, panel order by facilities desc, key nulls first, label nulls last) as rank from c)
        select state, panel, rank, key, label, facilities, companies from r
        where rank <= case panel when 'codes' then 15 when 'companies' then 20 when 'cities' then 15 else rank end"""),
    "rule_lookup": (
        rule_lookup,
        f"""with {O.names_cte()}, rules as ({X.for_oracle(RULE_TABLE)}), own as (select distinct name from names where name is not null),
        hit as (select name, rule_no, company from own join rules on regexp_matches(name, case when exact_case then pattern else '(?i)' || pattern end))
        select name, min(rule_no) as rule_no, min_by(company, rule_no) as company from hit group by name"""),
    "repair_job": (repair_job, _repair_sql()),
}
