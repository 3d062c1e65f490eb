"""Stand-ins for the facility tables, derived from the given tables by one SQL text.

The same text runs in Spark and in the checking database, so both sides of a
comparison start from equal rows. See FIXTURES.md for what each stand-in covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteweave.session import spread

PARTS = """
  select p_partkey as k, upper(p_name) as nm, p_brand as br, p_size as sz,
    substr('TXCAOHILMIPANYGAWANC', 1 + 2*cast(p_partkey % 10 as int), 2) as st,
    cast((750 + (p_partkey * 7) % 23) * 100 + p_partkey % 100 as string) as zip,
    substr('311615332710325110336411334413326199', 1 + 6*cast(p_partkey % 6 as int), 6) as naics,
    cast(30 + p_partkey % 10 as string) || '.' || lpad(cast((p_partkey * 37) % 10000 as string), 4, '0') as lat,
    '-' || cast(80 + p_partkey % 20 as string) || '.' || lpad(cast((p_partkey * 53) % 10000 as string), 4, '0') as lng
  from {part}"""

RAW_RECORDS = f"""
with p as ({PARTS})
select 'a' || lpad(cast(k as string), 8, '0') as id, 'epa_echo' as source, cast(k as string) as source_record_id,
  nm || ' ' || br || ' PLANT' as raw_name, cast(100 + k % 900 as string) || ' N MAIN ST STE 5' as raw_address,
  'Springfield ' || cast(k % 50 as string) as raw_city, case when k % 97 = 0 then null else st end as raw_state,
  zip as raw_zip, lat as raw_latitude, lng as raw_longitude, naics as raw_naics_code,
  case when k % 2 = 0 then '1100' || cast(k as string) else null end as registry_id,
  cast(null as string) as tri_parent_company_name, cast(null as int) as osha_employee_count, cast(null as timestamp) as osha_inspection_date
from p
union all
select 'b' || lpad(cast(k as string), 8, '0'), 'epa_tri', 'TRI' || cast(k as string),
  nm || ' ' || br, cast(100 + k % 900 as string) || ' NORTH MAIN STREET', 'SPRINGFIELD ' || cast(k % 50 as string), st, zip, lat, lng, cast(null as string),
  case when k % 4 = 0 then '1100' || cast(k as string) else null end, nm || ' HOLDINGS INC', cast(null as int), cast(null as timestamp)
from p where k % 3 = 0
union all
select 'c' || lpad(cast(k as string), 8, '0'), 'manual', 'seed_' || cast(k as string),
  nm || ' ' || br || ' PLANT', cast(100 + k % 900 as string) || ' North Main Street', 'Springfield ' || cast(k % 50 as string), st, zip, lat, lng, naics,
  cast(null as string), nm, cast(null as int), cast(null as timestamp)
from p where k % 5 = 0
union all
select 'd' || lpad(cast(l_orderkey as string), 8, '0') || lpad(cast(l_linenumber as string), 2, '0') || lpad(cast(l_partkey as string), 8, '0') || lpad(cast(l_suppkey as string), 6, '0'),
  'osha', cast(l_orderkey as string) || '-' || cast(l_linenumber as string),
  nm || ' ' || br || ' PLANT', cast(100 + k % 900 as string) || ' MAIN ST', 'Springfield ' || cast(k % 50 as string), st, zip, cast(null as string), cast(null as string), naics,
  cast(null as string), cast(null as string), cast(l_quantity as int), l_shipdate
from {{lineitem}} join p on k = l_partkey"""

FACILITIES = """
with p as (
  select p_partkey as k, upper(p_name) as nm, p_brand as br, p_size as sz,
    substr('TXCAOHILMIPANYGAWANC', 1 + 2*cast(p_partkey % 10 as int), 2) as st,
    substr('311615332710325110336411336111326199', 1 + 6*cast(p_partkey % 6 as int), 6) as naics
  from {part})
select 'f' || lpad(cast(k as string), 8, '0') as id, nm || ' PLANT' as name,
  case when k % 6 = 5 then null else 'c-' || br end as company_id, case when k % 6 = 5 then null else br end as company_name,
  'Springfield ' || cast(k % 50 as string) as city, case when k % 97 = 0 then null when k % 41 = 0 then 'GU' else st end as state,
  case when k % 9 = 0 then null else '40.5' end as latitude, case when k % 9 = 0 then null else '-90.5' end as longitude,
  case when k % 13 = 0 then '' else naics end as primary_naics,
  case when k % 13 = 0 then null else 'Industry ' || substr(naics, 1, 3) end as primary_naics_description,
  case when k % 4 = 3 then null else sz end as employee_count,
  case when k % 2 = 0 then '1100' || cast(k - k % 4 as string) else null end as epa_registry_id,
  cast(1 + k % 3 as int) as source_count,
  case cast(k % 3 as int) when 0 then '["epa_echo"]' when 1 then '["epa_echo","epa_tri"]' else '["epa_echo","epa_tri","osha"]' end as sources,
  cast(30 + (k * 13) % 71 as int) as confidence,
  cast('2024-01-' || lpad(cast(1 + k % 28 as string), 2, '0') || ' 00:00:00' as timestamp) as created_at,
  case when k % 8 = 1 then null else cast(100 + k % 900 as string) || ' MAIN ST' end as address,
  case when k % 10 = 3 then null else cast(75000 + k % 100 as string) end as zip
from p"""

COMPANIES = """
select 'c-' || p_brand as id, p_brand as name,
  case when max(p_size) % 3 = 0 then null else 'Manufacturing' end as sector,
  case cast(min(p_partkey) % 3 as int) when 0 then 'verified' when 1 then 'unverified' else 'rejected' end as status,
  count(*) as facility_count
from {part} group by p_brand"""

CENSUS = """
select substr('TXCAOHILMIPANYGAWANC', 1 + 2*cast(c_nationkey % 10 as int), 2) as raw_state,
  lpad(cast(c_nationkey as string), 5, '0') as census_county_fips,
  cast(count(*) * 3 as int) as census_establishment_count, cast(count(*) * 40 as int) as census_employees,
  cast(count(*) * 900 as int) as census_annual_payroll
from {customer} group by c_nationkey"""

# Lineage of the facility stand-in: one raw record per source it lists.
LINEAGE = """
select 'f' || lpad(cast(p_partkey as string), 8, '0') as facility_id, 'a' || lpad(cast(p_partkey as string), 8, '0') as raw_record_id,
  'epa_echo' as source, cast(p_partkey as string) as source_record_id from {part}
union all
select 'f' || lpad(cast(p_partkey as string), 8, '0'), 'b' || lpad(cast(p_partkey as string), 8, '0'), 'epa_tri', 'TRI' || cast(p_partkey as string)
from {part} where p_partkey % 3 >= 1
union all
select 'f' || lpad(cast(l_partkey as string), 8, '0'),
  'd' || lpad(cast(l_orderkey as string), 8, '0') || lpad(cast(l_linenumber as string), 2, '0') || lpad(cast(l_suppkey as string), 6, '0'),
  'osha', cast(l_orderkey as string) || '-' || cast(l_linenumber as string)
from {lineitem} where l_partkey % 3 = 2"""

# Company and site names in the shapes that name extraction tells apart.
NAMES = """
with p as (select p_partkey as k, upper(p_name) as nm, upper(p_brand) as br, upper(p_type) as ty from {part})
select k as name_id,
  case cast(k % 24 as int)
    when 0 then nm || case when k % 48 = 0 then ' - CATERPILLAR ' else ' - ' end || br || ' G3516'
    when 1 then nm || ' INC - ' || ty || ' SITE'
    when 2 then nm || ' / ' || br
    when 3 then nm || ', ' || ty || ' INC'
    when 4 then br || ' ' || nm || ' PLANT'
    when 5 then 'WEST ' || ty || ' DIVISION OF ' || nm || ' CORP'
    when 6 then 'EAST ' || ty || ' A DIVISION OF ' || br || ' HOLDINGS'
    when 7 then nm || ' CO DBA ' || ty || ' WORKS LLC'
    when 8 then nm || ': ' || ty
    when 9 then nm || ' LLC #' || cast(k as string)
    when 10 then nm || ' SPRINGFIELD PLANT #' || cast(k % 9 as string)
    when 11 then 'Acme' || cast(k % 3 as string) || '-' || nm
    when 12 then 'THE ' || nm || ' COMPANY'
    when 13 then nm || ' STEEL'
    when 14 then 'CITY OF ' || nm
    when 15 then nm || ' (' || ty || ' CORP)'
    when 16 then nm || ' @ ' || ty
    when 17 then 'N/A'
    when 18 then nm || ' INC NORTH YARD'
    when 19 then cast(k as string) || ' ' || nm || ' AVE LLC'
    when 20 then '  ' || nm || '   OF THE ' || ty || ' USA  '
    when 21 then 'AC-' || nm || ' PORTABLE GENERATOR UNIT #' || cast(k as string)
    when 22 then ty || ' CATERPILLAR - ' || nm || ' 500 HP'
    else nm end as name,
  case when k % 5 = 0 then nm || ' HOLDINGS, INC.' when k % 5 = 1 then 'n/a' else null end as parent
from p"""

FSIS_ROWS = """
select 'M' || cast(s_suppkey - s_suppkey % 2 as string) as est_number, s_suppkey as ingest_seq, s_name as company,
  substr('TXCAOHILMIPANYGAWANC', 1 + 2*cast(s_nationkey % 10 as int), 2) as state,
  case cast(s_suppkey % 5 as int) when 0 then 'Poultry Slaughter' when 1 then 'Meat Processing' when 2 then 'Egg Product' when 3 then 'Rendering' else '' end as activities,
  case cast(s_suppkey % 4 as int) when 0 then 'Large' when 1 then 'Small' when 2 then 'Very Small' else '' end as size
from {supplier}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts that may be sent to all tasks through the driver; of more, their files are small still but their rows are not.
SENT_PARTS = 200_000


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs a fixture text over the tables it names in braces."""
    names = [n for n in ("part", "lineitem", "supplier", "customer", "documents", "pages", "events", "orders")
             if "{" + n + "}" in text]
    given = {n: table(spark, sf_dir, n) for n in names}
    if {"part", "lineitem"} <= given.keys() and (parts := given["part"].count()) > SENT_PARTS:
        # The part table is joined inside a CTE, where a hint of its own would be lost; the other side's holds for the join.
        given["lineitem"] = given["lineitem"].hint("merge")
        given["part"] = spread(given["part"], parts)
    return spark.sql(text, **given)


def for_oracle(text: str) -> str:
    names = ("part", "lineitem", "supplier", "customer", "documents", "pages", "events", "orders")
    return text.format(**{n: n for n in names})
