"""Queries over the golden, company, raw and census tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave import fixtures as X
from siteweave.functions import confidence as CF
from siteweave.operators import breakdowns as B
from siteweave.operators import dedup as D
from siteweave.operators import paging as P
from siteweave.operators import quality as Q
from siteweave.operators.filters import CompanyFilter, ExportFilter, FacilityFilter, in_listed_states
from siteweave.plans import oracle_text as O

fac = partial(X.derive, text=X.FACILITIES)
com = partial(X.derive, text=X.COMPANIES)
raw = partial(X.derive, text=X.RAW_RECORDS)
cen = partial(X.derive, text=X.CENSUS)
lin = partial(X.derive, text=X.LINEAGE)

FAC, COM, RAW, CEN, LIN = (
    O.facilities_cte(), O.companies_cte(), O.raw_cte(), O.census_cte(), O.lineage_cte(),
)
STATES = O.in_list(K.STATE_CODES)


def review_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate rows from the event stream: one per event, status by its kind."""
    status = F.when(F.col("event_type").isin("click", "purchase"), "confirmed").when(
        F.col("event_type") == "error", "rejected"
    )
    return X.table(spark, sf, "events").select(
        F.concat(F.lit("m"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("id"),
        F.coalesce(status, F.lit("pending")).alias("status"),
        F.col("value").cast("int").alias("confidence_score"),
        F.concat(F.lit("a"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("record_a"),
        F.concat(F.lit("b"), F.lpad((F.col("user_id") * 3).cast("string"), 8, "0")).alias("record_b"),
    )


REVIEW = """candidates as (select 'm' || lpad(cast(event_id as varchar), 9, '0') as id,
  case when event_type in ('click', 'purchase') then 'confirmed' when event_type = 'error' then 'rejected' else 'pending' end as status,
  cast(trunc(value) as int) as confidence_score, 'a' || lpad(cast(event_id as varchar), 8, '0') as record_a,
  'b' || lpad(cast(user_id * 3 as varchar), 8, '0') as record_b from events)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run ledger stand-in: one run per order, spread over the sources."""
    sources = F.expr("array('epa_echo', 'epa_tri', 'osha', 'manual')")
    return X.table(spark, sf, "orders").select(
        F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("id"),
        F.element_at(sources, (F.col("o_custkey") % 4 + 1).cast("int")).alias("source"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("started_at"),
    )


RUNS = """runs as (select 'run' || o_orderkey as id, ['epa_echo', 'epa_tri', 'osha', 'manual'][cast(o_custkey % 4 + 1 as int)] as source,
  o_orderstatus as status, o_orderdate as started_at from orders)"""


def facility_count(flt: FacilityFilter):
    return lambda s, d: B.facility_count(fac(s, d), flt.condition())


def count_sql(where: str) -> str:
    return f"with {FAC} select count(*) as facility_count from facilities where {where}"


def state_top(pick):
    return lambda s, d: pick(B.in_state(fac(s, d), "tx"))


def city_rows(s: SparkSession, d: str) -> DataFrame:
    return B.in_city(fac(s, d), "TX", "SPRINGFIELD 10")


_CITY = "facilities where state = 'TX' and lower(city) = lower('SPRINGFIELD 10')"


def confidences(s: SparkSession, d: str) -> DataFrame:
    rows = fac(s, d).withColumn("_factors", CF.display_factors())
    total = CF.display_total(F.col("_factors"))
    return rows.select(
        "id",
        CF.enrichment_confidence().alias("enrichment"),
        CF.completeness_confidence().alias("completeness"),
        total.alias("display"),
        CF.display_band(total).alias("band"),
        CF.display_label(total).alias("label"),
        F.size(F.filter("_factors", lambda f: f["met"])).alias("factors_met"),
    )


_SOURCE_STEP = "case when source_count >= 3 then 30 when source_count >= 2 then 20 else 0 end"
_CONF = f"""with {FAC}, parts as (select *, 30 + case when source_count >= 2 then 25 else 0 end
  + case when company_name is not null then 15 else 0 end
  + case when address is not null and city is not null and state is not null and zip is not null then 10 else 0 end
  + case when primary_naics <> '' then 10 else 0 end + case when latitude is not null and longitude is not null then 10 else 0 end as shown,
  1 + (source_count >= 2)::int + (company_name is not null)::int
  + (address is not null and city is not null and state is not null and zip is not null)::int + (primary_naics <> '')::int
  + (latitude is not null and longitude is not null)::int as met from facilities)
select id, least(100, 30 + {_SOURCE_STEP} + case when latitude is not null then 20 else 0 end
    + case when company_id is not null then 10 else 0 end + case when employee_count > 0 then 10 else 0 end) as enrichment,
  10 + case when address is not null then 10 else 0 end + case when city is not null and state is not null then 10 else 0 end
    + case when zip is not null then 5 else 0 end + case when latitude is not null and longitude is not null then 15 else 0 end
    + case when primary_naics <> '' then 10 else 0 end + case when company_id is not null then 10 else 0 end
    + case when source_count >= 2 then 15 else 0 end + case when source_count >= 3 then 10 else 0 end
    + case when employee_count > 0 then 5 else 0 end as completeness,
  shown as display, case when shown >= 70 then 'emerald' when shown >= 40 then 'amber' else 'red' end as band,
  case when shown >= 80 then 'High' when shown >= 50 then 'Medium' else 'Low' end as label, met as factors_met from parts"""

_COVERAGE = f"""{FAC}, {CEN}, cov as (select c.state, c.e as census_establishments, c.m as census_employees, c.p as census_payroll,
  coalesce(f.n, 0) as our_facilities,
  cast(least(case when c.e > 0 then floor(coalesce(f.n, 0)::double / c.e * 100 + 0.5) else 0 end, 999) as bigint) as coverage_percent,
  greatest(c.e - coalesce(f.n, 0), 0) as gap
  from (select raw_state as state, sum(census_establishment_count)::bigint as e, sum(census_employees)::bigint as m,
    sum(census_annual_payroll)::bigint as p from census group by 1) c
  left join (select state, count(*) as n from facilities where state is not null group by 1) f using (state))"""

_CATEGORY_UNIT = f"""case when left(primary_naics, 3) = '336' then left(primary_naics, 4) else left(primary_naics, 3) end"""
_CATEGORY_KEY = f"""case when left(primary_naics, 4) = '3364' then 'aerospace' when left(primary_naics, 3) = '336' then 'automobiles'
  else {O.category('left(primary_naics, 3)', 0)} end"""


def dedup_job(part: str, *columns: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        owned = X.derive(s, d, X.LINEAGE).select(
            F.col("raw_record_id").alias("id"), "facility_id", "source", "source_record_id"
        )
        return D.dedup_facilities(fac(s, d), owned, lin(s, d), com(s, d))[part].select(*columns)

    return run



_SURVIVE = f"""{FAC}, {LIN}, {COM}, survivors as (select id, first_value(id) over (
  partition by name, coalesce(city, ''), coalesce(state, '') order by source_count desc, confidence desc, id) as survivor from facilities),
moved as (select distinct s.survivor as facility_id, l.raw_record_id, l.source from lineage l join survivors s on s.id = l.facility_id)"""


QUERIES = {
    "overview": (
        lambda s, d: B.overview(fac(s, d), com(s, d), raw(s, d), review_candidates(s, d)),
        f"""with {FAC}, {COM}, {RAW}, {REVIEW} select (select count(*) from facilities) as total_facilities,
        (select count(*) from facilities where source_count >= 2) as multi_source, (select count(*) from companies) as total_companies,
        (select count(*) from raw_records) as total_raw_records,
        (select count(*) from candidates where status = 'pending') as pending_reviews"""),
    "by_source": (
        lambda s, d: B.by_source(raw(s, d)),
        f"with {RAW} select source, count(*) as records from raw_records group by 1"),
    "by_state": (
        lambda s, d: B.by_state(fac(s, d)),
        f"with {FAC} select state, count(*) as facilities from facilities where state in {STATES} group by 1"),
    "industries": (
        lambda s, d: B.industries(fac(s, d)),
        f"""with {FAC} select primary_naics as code, primary_naics_description as description, count(*) as facility_count,
        count(distinct company_id) as company_count, left(primary_naics, 3) as subsector from facilities
        where primary_naics <> '' group by 1, 2, 5"""),
    "sectors_subsectors": (
        lambda s, d: B.sectors_and_subsectors(fac(s, d)),
        f"""with {FAC}, m as (select *, left(primary_naics, 2) as s, left(primary_naics, 3) as t from facilities
        where left(primary_naics, 2) in ('31', '32', '33'))
        select 2 as digits, s as code, count(*) as facility_count, count(distinct company_id) as company_count from m group by s
        union all select 3, t, count(*), count(distinct company_id) from m group by t"""),
    "top_states_per_subsector": (
        lambda s, d: B.top_states_per_subsector(fac(s, d)),
        f"""with {FAC}, c as (select left(primary_naics, 3) as subsector, state, count(*) as facilities from facilities
        where primary_naics is not null and state is not null group by 1, 2), r as (select *, row_number() over (
        partition by subsector order by facilities desc, state) as position from c) select * from r where position <= 5"""),
    "categories": (
        lambda s, d: B.categories(fac(s, d)),
        f"""with {FAC}, m as (select {_CATEGORY_KEY} as key, {_CATEGORY_UNIT} as unit, company_id from facilities
        where left(primary_naics, 2) in ('31', '32', '33')),
        u as (select key, unit, count(*) as n, count(distinct company_id) as c from m group by 1, 2)
        select u.key, sum(n)::bigint as facility_count, sum(c)::bigint as company_count, max(x.d) as distinct_companies,
        {O.lookup([(k, lab) for k, lab, _ in K.CATEGORIES], 'u.key')} as label
        from u join (select key, count(distinct company_id) as d from m group by 1) x using (key)
        where u.key is not null group by u.key"""),
    "coverage": (
        lambda s, d: B.coverage(fac(s, d), cen(s, d)), f"with {_COVERAGE} select * from cov"),
    "coverage_summary": (
        lambda s, d: B.coverage_summary(B.coverage(fac(s, d), cen(s, d))),
        f"""with {_COVERAGE} select sum(census_establishments)::bigint as census_establishments,
        sum(our_facilities)::bigint as our_facilities,
        cast(floor(sum(our_facilities)::double / sum(census_establishments) * 100 + 0.5) as bigint) as overall_coverage,
        sum(census_employees)::bigint as manufacturing_employees from cov"""),
    "coverage_bands": (
        lambda s, d: B.coverage_bands(B.coverage(fac(s, d), cen(s, d))),
        f"""with {_COVERAGE} select case when coverage_percent >= 80 then 'good' when coverage_percent >= 40 then 'partial'
        else 'low' end as band, count(*) as states from cov group by 1"""),
    "company_status_pivot": (
        lambda s, d: B.company_status_counts(com(s, d)),
        f"""with {COM} select count(*) filter (where status = 'unverified') as unverified,
        count(*) filter (where status = 'verified') as verified, count(*) filter (where status = 'rejected') as rejected from companies"""),
    "company_states": (
        lambda s, d: B.company_states(fac(s, d)),
        f"""with {FAC} select company_id, state, count(*) as facilities from facilities
        where company_id is not null and state is not null group by 1, 2"""),
    "company_codes": (
        lambda s, d: B.company_codes(fac(s, d)),
        f"""with {FAC} select company_id, primary_naics as code, min(primary_naics_description) as description,
        count(*) as facilities from facilities where company_id is not null and primary_naics <> '' group by 1, 2"""),
    "company_sources": (
        lambda s, d: B.sources_of(fac(s, d).filter("company_id is not null"), "company_id"),
        f"""with {FAC} select company_id, source, count(*) as facilities from (select company_id,
        unnest(from_json(sources, '["VARCHAR"]')) as source from facilities where company_id is not null) group by 1, 2"""),
    "company_categories": (
        lambda s, d: B.company_categories(fac(s, d)).withColumn("codes", F.array_join("codes", ",")),
        f"""with {FAC}, c as (select company_id, primary_naics as code, count(*) as n, coalesce({O.category('primary_naics', 1)}, 'Manufacturing') as category
        from facilities where company_id is not null and primary_naics <> '' group by 1, 2)
        select company_id, category, sum(n)::bigint as facilities, string_agg(code, ',' order by n desc, code) as codes from c group by 1, 2"""),
    "source_breakdown": (
        lambda s, d: B.sources_of(B.in_state(fac(s, d), "TX")),
        f"""with {FAC} select source, count(*) as facilities from (select unnest(from_json(sources, '["VARCHAR"]')) as source
        from facilities where state = 'TX') group by 1"""),
    "state_summary": (
        lambda s, d: B.state_summary(fac(s, d)),
        f"""with {FAC} select state, count(*) as total_facilities, count(distinct company_id) as total_companies,
        {O.lookup(K.US_STATES, 'state')} as name from facilities where state in {STATES} group by state"""),
    "state_detail_naics": (
        state_top(B.top_codes),
        f"""with {FAC} select primary_naics as code, primary_naics_description as description, count(*) as facilities
        from facilities where state = 'TX' and primary_naics is not null group by 1, 2
        order by 3 desc, 1, 2 nulls last limit 15"""),
    "state_top_companies": (
        lambda s, d: B.top_companies(B.in_state(fac(s, d), "TX"), com(s, d)),
        f"""with {FAC}, {COM} select c.id, c.name, count(*) as facilities from facilities f join companies c on c.id = f.company_id
        where f.state = 'TX' group by 1, 2 order by 3 desc, 1 limit 20"""),
    "state_cities": (
        state_top(B.top_cities),
        f"""with {FAC} select city, count(*) as facilities, count(distinct company_id) as companies from facilities
        where state = 'TX' and city is not null group by 1 order by 2 desc, 1 limit 15"""),
    "city_shares": (
        lambda s, d: B.with_shares(B.top_cities(fac(s, d)), "facilities"),
        f"""with {FAC}, t as (select city, count(*) as facilities, count(distinct company_id) as companies from facilities
        where city is not null group by 1 order by 2 desc, 1 limit 15)
        select *, facilities::double / sum(facilities) over () as share, facilities::double / max(facilities) over () as share_of_largest from t"""),
    "city_detail": (
        lambda s, d: B.city_summary(city_rows(s, d)),
        f"""with {FAC} select min(city) as city, min(state) as state, count(*) as total_facilities,
        count(distinct company_id) as total_companies from {_CITY}"""),
    "city_companies": (
        lambda s, d: B.top_companies(city_rows(s, d), com(s, d), 15),
        f"""with {FAC}, {COM}, f as (select * from {_CITY}) select c.id, c.name, count(*) as facilities
        from f join companies c on c.id = f.company_id group by 1, 2 order by 3 desc, 1 limit 15"""),
    "city_sample": (
        lambda s, d: B.city_sample(city_rows(s, d), com(s, d)),
        f"""with {FAC}, {COM}, f as (select * from {_CITY} order by confidence desc, id limit 20)
        select f.id, f.name, f.company_id, c.name as company_name, primary_naics, primary_naics_description, confidence
        from f left join companies c on c.id = f.company_id"""),
    "review_stats": (
        lambda s, d: B.review_status_counts(review_candidates(s, d)),
        f"""with {REVIEW} select count(*) filter (where status = 'pending') as pending,
        count(*) filter (where status = 'confirmed') as confirmed, count(*) filter (where status = 'rejected') as rejected from candidates"""),
    "review_page": (
        lambda s, d: P.review_page(review_candidates(s, d), raw(s, d), "pending", 50, "90:m000009000"),
        f"""with {REVIEW}, {RAW}, open as materialized (select * from candidates where status = 'pending'
        and (confidence_score < 90 or (confidence_score = 90 and id < 'm000009000')) order by confidence_score desc, id desc limit 51),
        p as materialized (select * from open order by confidence_score desc, id desc limit 50),
        shown as materialized (select * from raw_records where id in (select record_a from p union all select record_b from p))
        select p.*, (select count(*) from open) > 50 as has_more,
        confidence_score || ':' || p.id as cursor,
        a.source as a_source, a.raw_name as a_name, a.raw_address as a_address, a.raw_city as a_city, a.raw_state as a_state,
        a.raw_zip as a_zip, a.raw_naics_code as a_naics_code, a.registry_id as a_registry_id,
        b.source as b_source, b.raw_name as b_name, b.raw_address as b_address, b.raw_city as b_city, b.raw_state as b_state,
        b.raw_zip as b_zip, b.raw_naics_code as b_naics_code, b.registry_id as b_registry_id
        from p left join shown a on a.id = p.record_a left join shown b on b.id = p.record_b"""),
    "facility_page": (
        lambda s, d: P.facility_page(fac(s, d), FacilityFilter(search="metals", min_sources=2).condition(), 50, "95:f00000900").select(
            "id", "name", "confidence", "has_more", "cursor"),
        f"""with {FAC}, r as (select * from facilities where (primary_naics like '331%' or primary_naics like '332%')
        and source_count >= 2 and (confidence, id) < (95, 'f00000900'))
        select id, name, confidence, (select count(*) from r) > 50 as has_more, confidence || ':' || id as cursor
        from r order by confidence desc, id desc limit 50"""),
    "company_page": (
        lambda s, d: P.company_page(com(s, d), CompanyFilter(search="brand#1", status="verified").condition(), 5),
        f"""with {COM}, r as (select * from companies where (name ilike '%brand#1%' or sector ilike '%brand#1%') and status = 'verified')
        select *, (select count(*) from r) > 5 as has_more, facility_count || ':' || id as cursor from r
        order by facility_count desc, id desc limit 5"""),
    "count_by_search": (
        facility_count(FacilityFilter(search="anvil")), count_sql("name ilike '%anvil%' or company_name ilike '%anvil%'")),
    "count_by_category": (
        facility_count(FacilityFilter(naics="Automobiles & vehicles", state="MI")),
        count_sql("left(primary_naics, 4) in ('3361','3362','3363','3365','3366','3367','3369') and state = 'MI'")),
    "count_by_company": (
        facility_count(FacilityFilter(company="BRAND#2", naics="33", min_sources=3)),
        count_sql("company_name ilike '%BRAND#2%' and primary_naics like '33%' and source_count >= 3")),
    "source_summary": (
        lambda s, d: B.source_summary(s, raw(s, d), runs(s, d)),
        f"""with {RAW}, {RUNS}, l as (select unnest([{', '.join(O.quote(x) for x in K.SOURCES)}]) as source),
        last as (select * from (select *, row_number() over (partition by source order by started_at desc, id desc) as rn from runs) where rn = 1)
        select l.source, (select count(*) from raw_records r where r.source = l.source) as raw_record_count, last.id as last_run_id,
        last.status as last_run_status, last.started_at as last_run_started_at from l left join last using (source)"""),
    "recent_runs": (
        lambda s, d: P.most_recent(runs(s, d).filter("source = 'osha'"), "started_at", "id"),
        f"with {RUNS} select * from runs where source = 'osha' order by started_at desc, id limit 20"),
    "export_preview": (
        lambda s, d: B.export_preview(fac(s, d), ExportFilter(states=("TX", "CA"), naics_prefix="33", min_confidence=40,
                                                               has_coordinates=True, companies=("brand#1", "brand#2"))),
        f"""with {FAC} select count(*) as facility_count, count(distinct state) as state_count, count(distinct company_id) as company_count
        from facilities where state in ('TX', 'CA') and primary_naics like '33%' and confidence >= 40 and latitude is not null
        and longitude is not null and (company_name ilike '%brand#1%' or company_name ilike '%brand#2%')"""),
    "export_preview_having": (
        lambda s, d: B.export_preview(fac(s, d), ExportFilter(has_company=True), 60),
        f"""with {FAC}, r as (select * from facilities where state in {O.in_list(K.EXPORT_STATE_CODES)} and company_id is not null)
        select count(*) as facility_count, count(distinct state) as state_count, (select count(*) from (select company_id from r
        group by 1 having count(*) >= 60)) as company_count from r"""),
    "global_search": (
        lambda s, d: B.global_search(s, fac(s, d), com(s, d), "man").select("id", "type", "name", "subtitle", "meta", "rank"),
        f"""with {FAC}, {COM},
        cat as (select 'cat_general' as id, 'categories' as type, 'General Manufacturing' as name, 'NAICS: 3' as subtitle,
          cast(null as varchar) as meta, 1 as rank),
        co as (select id, 'companies' as type, name, coalesce(sector, 'Manufacturing') as subtitle,
          facility_count || case when facility_count = 1 then ' factory' else ' factories' end as meta,
          row_number() over (order by facility_count desc, id desc) as rank from companies where sector ilike '%General Manufacturing%'),
        f as (select id, 'facilities' as type, name, company_name as subtitle, nullif(concat_ws(', ', city, state), '') as meta,
          row_number() over (order by confidence desc, id desc) as rank from facilities where name ilike '%man%' or company_name ilike '%man%')
        select * from cat union all select * from co where rank <= 5 union all select * from f where rank <= 8"""),
    "facility_search": (
        lambda s, d: B.global_search(s, fac(s, d), com(s, d), "brand#7").select("id", "type", "name", "subtitle", "meta", "rank"),
        f"""with {FAC}, {COM},
        co as (select id, 'companies' as type, name, coalesce(sector, 'Manufacturing') as subtitle,
          facility_count || case when facility_count = 1 then ' factory' else ' factories' end as meta,
          row_number() over (order by facility_count desc, id desc) as rank from companies where name ilike '%brand#7%' or sector ilike '%brand#7%'),
        f as (select id, 'facilities' as type, name, company_name as subtitle, nullif(concat_ws(', ', city, state), '') as meta,
          row_number() over (order by confidence desc, id desc) as rank from facilities where name ilike '%brand#7%' or company_name ilike '%brand#7%')
        select * from co where rank <= 5 union all select * from f where rank <= 8"""),
    "facility_detail": (
        lambda s, d: B.facility_detail(fac(s, d), lin(s, d), "f00000005").select(
            "id", "name", F.array_join("sources", ",").alias("sources"), "link_source", "raw_record_id", "source_record_id"),
        f"""with {FAC}, {LIN} select f.id, f.name, array_to_string(from_json(f.sources, '["VARCHAR"]'), ',') as sources,
        l.source as link_source, l.raw_record_id, l.source_record_id from facilities f left join lineage l on l.facility_id = f.id
        where f.id = 'f00000005'"""),
    "confidences": (confidences, _CONF),
    "confidence_distribution": (
        lambda s, d: Q.confidence_distribution(fac(s, d)),
        f"""with {FAC} select case when confidence >= 90 then '90-100' when confidence >= 70 then '70-89' when confidence >= 50 then '50-69'
        when confidence >= 30 then '30-49' else '0-29' end as bucket, count(*) as facilities from facilities group by 1"""),
    "average_confidence": (
        lambda s, d: Q.average_confidence(fac(s, d)),
        f"with {FAC} select round(avg(confidence), 1) as average_confidence from facilities"),
    "linked_counts": (
        lambda s, d: Q.linked_counts(fac(s, d)),
        f"""with {FAC} select count(*) as total, count(company_id) as linked, count(*) - count(company_id) as unlinked,
        count(company_name) as named, count(*) filter (where company_name is not null and company_id is null) as orphaned,
        count(*) filter (where company_name is null and company_id is null) as no_company from facilities"""),
    "sector_presence": (
        lambda s, d: Q.sector_presence(com(s, d)),
        f"with {COM} select count(sector) as with_sector, count(*) - count(sector) as without_sector from companies"),
    "store_stats": (
        lambda s, d: Q.store_stats(fac(s, d), com(s, d), raw(s, d)),
        f"""with {FAC}, {COM}, {RAW} select count(*) as facilities, (select count(*) from companies) as companies,
        (select count(*) from raw_records) as raw_records, count(company_id) as with_company, count(*) - count(company_id) as without_company,
        cast(floor(count(company_id)::double / count(*) * 100 + 0.5) as bigint) as percent_with_company,
        count(*) filter (where source_count >= 2) as multi_source from facilities"""),
    "top_unlinked": (
        lambda s, d: Q.top_unlinked(fac(s, d)),
        f"""with {FAC} select id, name, city, state, source_count from facilities where company_id is null
        order by source_count desc, name, id limit 30"""),
    "top_sectors": (
        lambda s, d: Q.top_sectors(com(s, d)),
        f"with {COM} select sector, count(*) as companies from companies where sector is not null group by 1 order by 2 desc, 1 limit 10"),
    "quality_summary": (
        lambda s, d: Q.quality_summary(fac(s, d), com(s, d)),
        f"""with {FAC}, {COM} select count(*) as facilities, (select count(*) from companies) as companies, count(company_id) as linked,
        count(*) - count(company_id) as unlinked, cast(round(avg(confidence)) as bigint) as average_confidence,
        (select count(*) from companies where sector <> 'Manufacturing') as companies_with_sector from facilities"""),
    "top_company_names": (
        lambda s, d: Q.top_company_names(fac(s, d)),
        f"""with {FAC} select company_name, count(*) as facilities from facilities where company_name is not null
        group by 1 order by 2 desc, 1 limit 25"""),
    "state_audit": (
        lambda s, d: Q.state_audit(fac(s, d)),
        f"""with {FAC} select state, count(*) as facilities, state in {STATES} as listed from facilities
        where state is not null group by 1"""),
    "state_code_count": (
        lambda s, d: Q.state_code_count(fac(s, d)), f"with {FAC} select count(distinct state) as states from facilities"),
    "unlisted_states": (
        lambda s, d: fac(s, d).filter("state is not null").filter(~in_listed_states(F.col("state"))).select("id", "state"),
        f"with {FAC} select id, state from facilities where state not in {STATES}"),
    "raw_per_facility": (
        lambda s, d: Q.raw_records_per_facility(fac(s, d), lin(s, d)),
        f"""with {FAC}, {LIN} select f.id, f.name, f.source_count, count(l.raw_record_id) as raw_count
        from facilities f left join lineage l on l.facility_id = f.id group by 1, 2, 3"""),
    "dedup_registry": (
        lambda s, d: D.registry_duplicates(fac(s, d)),
        f"""with {FAC} select count(*) as duplicates from (select row_number() over (partition by epa_registry_id
        order by source_count desc, confidence desc, created_at desc) as rn from facilities where epa_registry_id is not null) where rn > 1"""),
    "registry_survivors": (
        lambda s, d: D.registry_survivors(fac(s, d)),
        f"""with {FAC} select epa_registry_id, id from (select *, row_number() over (partition by epa_registry_id
        order by source_count desc, confidence desc, created_at desc, id) as rn from facilities where epa_registry_id is not null) where rn = 1"""),
    "dedup_name_city_state": (
        lambda s, d: D.name_duplicates(fac(s, d)),
        f"""with {FAC} select count(*) as duplicates from (select row_number() over (partition by name, coalesce(city, ''), coalesce(state, '')
        order by source_count desc, confidence desc) as rn from facilities) where rn > 1"""),
    "name_survivors": (
        lambda s, d: D.name_survivors(fac(s, d)).select("id", "survivor"),
        f"with {_SURVIVE} select id, survivor from survivors"),
    "dedup_raw": (
        lambda s, d: D.dedup_raw(raw(s, d)).select("id", "source", "source_record_id"),
        f"with {RAW} select min(id) as id, source, source_record_id from raw_records group by 2, 3"),
    "dedup_job_facilities": (
        dedup_job("facilities", "id", "name", "city", "state", "source_count", "sources"),
        f"""with {_SURVIVE}, n as (select facility_id, count(distinct source) as n, to_json(list_sort(list(distinct source)))::varchar as s
        from moved group by 1) select f.id, f.name, f.city, f.state, cast(coalesce(n.n, f.source_count) as int) as source_count,
        coalesce(n.s, f.sources) as sources
        from facilities f left join n on n.facility_id = f.id where f.id in (select survivor from survivors)"""),
    "dedup_job_lineage": (
        dedup_job("facility_sources", "facility_id", "raw_record_id", "source"), f"with {_SURVIVE} select * from moved"),
    "dedup_job_companies": (
        dedup_job("companies", "id", "name", "facility_count"),
        f"""with {_SURVIVE} select c.id, c.name, count(*) as facility_count from companies c join facilities f on f.company_id = c.id
        where f.id in (select survivor from survivors) group by 1, 2"""),
    "source_recount": (
        lambda s, d: D.source_counts(lin(s, d)).withColumn("sources", F.to_json("sources")),
        f"""with {LIN} select facility_id, cast(count(distinct source) as int) as source_count,
        to_json(list_sort(list(distinct source)))::varchar as sources from lineage group by 1"""),
    "company_recount": (
        lambda s, d: D.recount_companies(com(s, d), fac(s, d).filter("confidence >= 60"), verify=True),
        f"""with {COM}, {FAC}, n as (select company_id, count(*) as n from facilities where confidence >= 60 and company_id is not null group by 1)
        select c.id, c.name, c.sector, case when n.n > 0 then 'verified' else c.status end as status, coalesce(n.n, 0) as facility_count
        from companies c left join n on n.company_id = c.id"""),
}
