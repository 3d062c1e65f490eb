"""Queries over source scans, normalisation, companies, exports, edits and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave import fixtures as X
from siteweave.functions import confidence as CF
from siteweave.functions import industry as I
from siteweave.functions import predicates as PR
from siteweave.functions import text as T
from siteweave.functions.company import (
    clean_company, extract_company, is_blocked, normalize_company, rules_from_table, title_case, with_company,
)
from siteweave.functions.geo import validate_coordinates
from siteweave.operators import companies as C
from siteweave.operators import paging
from siteweave.operators import quality as Q
from siteweave.operators import sinks as S
from siteweave.operators.filters import ExportFilter
from siteweave.plans import jobs
from siteweave.plans import oracle_text as O
from siteweave.plans.analytic_queries import COM, FAC, LIN, RAW, REVIEW, com, fac, lin, raw, review_candidates
from siteweave.plans.linkage_queries import FIELDS_SQL, RULES
from siteweave.session import shared_folder, spread
from siteweave.sources import curated as SC
from siteweave.sources import federal as SF
from siteweave.sources.common import read_csv
from siteweave.streaming import incremental as ST

# --- source layouts derived from the given tables --------------------------------------------

ECHO = """
select '1100' || cast(p_partkey as string) as REGISTRY_ID,
  case when p_partkey % 19 = 0 then cast(100 + p_partkey as string) || ' MAIN ST LLC' when p_partkey % 23 = 0 then ''
    else upper(p_name) || ' ' || p_brand end as FAC_NAME,
  cast(p_partkey % 900 as string) || ' ELM AVE' as FAC_STREET, 'Springfield' as FAC_CITY,
  substr('TXCAOHILMIPANYGAWANC', 1 + 2*cast(p_partkey % 10 as int), 2) as FAC_STATE, '' as FAC_ZIP, 'Kent' as FAC_COUNTY,
  '' as FAC_LAT, cast(p_size as string) as FAC_LONG,
  case cast(p_partkey % 5 as int) when 0 then '541330 332710' when 1 then '311615, 424470' when 2 then '541330' when 3 then '' else ' 5 336411' end as FAC_NAICS_CODES,
  case when p_partkey % 4 = 0 then '' else '3711 3714' end as FAC_SIC_CODES
from {part}"""

TRI = """
select case when l_orderkey % 31 = 0 then '' else 'TRI' || cast(l_partkey as string) end as tri_facility_id,
  case when l_partkey % 17 = 0 then cast(l_partkey as string) || ' TRUCKING' else 'SITE ' || cast(l_suppkey as string) end as facility_name,
  cast(l_linenumber as string) || ' OAK RD' as street_address, 'Springfield' as city_name, 'OH' as state_abbr, '45501' as zip_code,
  cast(null as string) as county_name, cast(l_partkey % 50 as double) as pref_latitude,
  cast(l_partkey % 120 as double) - 20 as pref_longitude, 'PARENT ' || cast(l_suppkey % 7 as string) as parent_co_name,
  cast(null as string) as parent_co_db_num, case when l_partkey % 2 = 0 then '1100' || cast(l_partkey as string) end as epa_registry_id,
  l_orderkey * 10 + l_linenumber as seq_a, l_partkey * 100000 + l_suppkey as seq_b, l_extendedprice as seq_c
from {lineitem}"""

OSHA = """
select cast(l_orderkey as string) || '.' || cast(l_linenumber as string) as ACTIVITY_NR,
  case when l_partkey % 13 = 0 then '  ' else 'Shop ' || cast(l_partkey % 300 as string) end as ESTAB_NAME, '1 Elm St' as SITE_ADDRESS,
  'Town ' || cast(l_suppkey % 5 as string) as SITE_CITY, case when l_suppkey % 6 = 0 then 'OHIO' else 'OH' end as SITE_STATE, '45501-1234-99' as SITE_ZIP,
  case when l_partkey % 3 = 0 then '' when l_partkey % 3 = 1 then '332710' else '541330' end as NAICS_CODE,
  case when l_partkey % 3 = 1 then '' else cast(1900 + l_partkey % 2200 as string) end as SIC_CODE,
  case when l_quantity > 40 then '0' when l_quantity > 35 then 'n/a' else cast(cast(l_quantity as int) as string) end as NR_IN_ESTAB,
  substr(cast(l_shipdate as string), 1, 10) as OPEN_DATE,
  l_orderkey * 10 + l_linenumber as seq_a, l_partkey * 100000 + l_suppkey as seq_b, l_extendedprice as seq_c
from {lineitem}"""

NHTSA = """
select s_suppkey - s_suppkey % 2 as Mfr_ID, case when s_suppkey % 7 = 0 then '' else upper(s_name) end as Mfr_Name,
  case when s_suppkey % 3 = 0 then s_name else '' end as Mfr_CommonName,
  case when s_nationkey % 4 = 0 then 'CANADA' when s_nationkey % 4 = 1 then 'United States (USA)' else '' end as Country,
  case when s_nationkey % 3 = 0 then 'Michigan' when s_nationkey % 3 = 1 then 'oh' else 'Ontario' end as StateProvince,
  'Detroit' as City, '48201' as PostalCode, cast(s_suppkey as string) || ' Motor Way' as Address,
  case when s_suppkey % 2 = 0 then 'Dock 4' else '' end as Address2, s_suppkey as seq, s_acctbal
from {supplier}"""

# Vehicle types by row, as a text so that both engines start from the same value.
NHTSA_TYPES = """case cast(seq % 6 as int) when 0 then 'Trailer' when 1 then 'Passenger Car|Motorcycle' when 2 then 'Truck'
  when 3 then 'Low Speed Vehicle (LSV)' when 4 then 'Off Road' else '' end"""

CENSUS_PAGES = """
select '[["NAICS2017","NAICS2017_LABEL","ESTAB","PAYANN","EMP","state","county"],["31-33","Manufacturing","'
  || case when c_custkey % 9 = 0 then '0' when c_custkey % 9 = 1 then 'D' else '1,' || lpad(cast(c_custkey % 1000 as string), 3, '0') end
  || '","' || cast(c_custkey * 10 as string) || '","' || case when c_custkey % 5 = 0 then 'S' else cast(c_custkey as string) end || '","'
  || lpad(cast(c_nationkey + 1 as string), 2, '0') || '","' || lpad(cast(c_custkey % 1000 as string), 3, '0')
  || '"],["3116","Slaughter","7","N","' || cast(c_nationkey as string) || '","48","' || lpad(cast(c_custkey % 1000 as string), 3, '0') || '"]]' as value,
  c_custkey, c_nationkey
from {customer}"""

SEED = """
select case when p_partkey % 29 = 0 then 'Company' when p_partkey % 31 = 0 then '' else p_brand || ' Inc' end as Company,
  case when p_partkey % 37 = 0 then '' else p_name || ' works' end as Description,
  case when p_partkey % 3 = 0 then '' else '40.1' end as LAT, '-90.2' as LONG, '1 Elm St' as Address, 'Springfield' as City,
  case cast(p_partkey % 4 as int) when 0 then 'Texas' when 1 then 'oh' when 2 then 'Guam' else 'Ontario' end as State,
  'US' as Country, p_partkey as k
from {part}"""


def tri_rows(s: SparkSession, d: str) -> DataFrame:
    return X.derive(s, d, TRI).withColumn("ingest_seq", F.struct("seq_a", "seq_b", "seq_c"))


def osha_source(s: SparkSession, d: str) -> DataFrame:
    return X.derive(s, d, OSHA).withColumn("ingest_seq", F.struct("seq_a", "seq_b", "seq_c"))


def nhtsa_rows(s: SparkSession, d: str) -> DataFrame:
    rows = X.derive(s, d, NHTSA)
    names = F.split(F.expr(NHTSA_TYPES), r"\|")
    kinds = F.transform(F.filter(names, lambda n: n != ""),
                        lambda n: F.struct(F.lit(False).alias("IsPrimary"), n.alias("Name")))
    return rows.withColumn("VehicleTypes", kinds).withColumnRenamed("seq", "ingest_seq")


def nhtsa_scan(s: SparkSession, d: str) -> DataFrame:
    """The list, with detail rows for the makers in good standing, in another city."""
    rows = nhtsa_rows(s, d)
    details = rows.filter("s_acctbal > 3000").withColumn("City", F.lit("Lansing"))
    out = SF.nhtsa_records(rows, details)
    return out.select(
        "source_record_id", "raw_name", "raw_address", "raw_city", "raw_state", "raw_zip", "raw_naics_code",
        F.array_join("nhtsa_vehicle_types", "|").alias("types"),
    )


def fsis_scan(s: SparkSession, d: str) -> DataFrame:
    rows = X.derive(s, d, X.FSIS_ROWS).withColumnsRenamed({"est_number": "EstNumber", "company": "Company"})
    return SF.fsis_records(rows).select(
        "source_record_id", "raw_name", "raw_state", "raw_naics_code", "fsis_activities", "fsis_size_category")


def _files(s: SparkSession, parts: list[DataFrame]) -> str:
    """The parts as CSV files of one folder tree, each with its own header."""
    folder = _stream_folder(s, "csv")
    for i, part in enumerate(parts):
        part.write.option("header", True).option("escape", '"').csv(f"{folder}/part={i}")
    return f"{folder}/part=*"


def osha_files(s: SparkSession, d: str) -> DataFrame:
    """Inspections written as files of two header spellings and orders, names with quotes and line breaks, and read back."""
    rows = X.table(s, d, "part").selectExpr(
        "cast(p_partkey as string) as activity_nr",
        "upper(p_name) || case when p_partkey % 5 = 0 then chr(10) else ' ' end || case when p_partkey % 7 = 0 then '\"M\", ' else '' end "
        "|| 'MILL ' || p_partkey as estab_name",
        "p_partkey || ' OAK ST, STE 1' as site_address", "'Springfield' as site_city", "'TX' as site_state", "'75001' as site_zip",
        "case when p_partkey % 3 = 0 then '445110' else '332710' end as naics_code", "cast(p_size as string) as nr_in_estab",
        "'2024-01-02' as open_date",
    )
    upper = rows.filter("activity_nr % 2 = 1").select(*[F.col(c).alias(c.upper()) for c in reversed(rows.columns)])
    plain = rows.filter("activity_nr % 4 = 0").select(*sorted(rows.columns))
    camel = rows.filter("activity_nr % 4 = 2").select(*[F.col(c).alias("".join(w.title() for w in c.split("_"))) for c in rows.columns])
    found = SF.read_osha(s, _files(s, [upper, plain, camel]))
    return found.select("source_record_id", "raw_name", "raw_address", "raw_state", "raw_naics_code", "osha_employee_count")


_OSHA_FILES = f"""with r as (select cast(p_partkey as varchar) as source_record_id,
    upper(p_name) || case when p_partkey % 5 = 0 then chr(10) else ' ' end || case when p_partkey % 7 = 0 then '"M", ' else '' end || 'MILL ' || p_partkey as raw_name,
    p_partkey || ' OAK ST, STE 1' as raw_address, 'TX' as raw_state, '332710' as raw_naics_code, cast(p_size as int) as osha_employee_count
  from part where p_partkey % 3 <> 0)
select * from r where not {O.stub('raw_name')}"""


def fsis_files(s: SparkSession, d: str) -> DataFrame:
    rows = X.derive(s, d, X.FSIS_ROWS).select(
        F.col("est_number").alias("EstNumber"), F.concat("company", F.lit("\n& Sons")).alias("Company"), F.col("state").alias("State"),
        F.col("size").alias("Size"), F.col("ingest_seq").cast("int").alias("n"),
    )
    renamed = {"EstNumber": "Est Number", "Company": "Establishment Name", "State": "STATE", "Size": "SIZE"}
    odd = rows.filter("n % 4 >= 2").drop("n").withColumnsRenamed(renamed)
    even = rows.filter("n % 4 < 2").drop("n")
    found = SF.read_fsis(s, _files(s, [even, odd.select(*reversed(odd.columns))]))
    return found.select("source_record_id", "raw_name", "raw_state")


def ticker_write(s: SparkSession, d: str) -> DataFrame:
    """Companies after the ticker list: variants merged with their types, the outside number filled where it was empty."""
    companies = com(s, d).withColumns({
        "name_variants": F.expr("case when facility_count % 2 = 0 then '{\"n\":1,\"ticker\":null}' end"),
        "duns_number": F.expr("case when facility_count % 3 = 0 then 'D1' end"),
    })
    return C.add_tickers(companies, C.match_tickers(companies, tickers(s, d))).select(
        "id", "duns_number", F.get_json_object("name_variants", "$.n").alias("n"), F.get_json_object("name_variants", "$.ticker").alias("ticker")
    )


def many_rules(s: SparkSession, d: str):
    """Some hundred overlapping rules over the words of the part table, as a table: brand and type, then brand, then type."""
    parts = X.table(s, d, "part").select(F.upper("p_brand").alias("b"), F.split(F.upper("p_name"), " ")[0].alias("w")).distinct()
    both = parts.select(F.lit(0).alias("level"), F.concat("w", F.lit(r"\b.*\b"), "b", F.lit(r"\b")).alias("pattern"), F.concat_ws(" ", "w", "b").alias("company"))
    brand = parts.select(F.lit(1).alias("level"), F.concat(F.lit(r"\b"), "b", F.lit(r"\b")).alias("pattern"), F.col("b").alias("company")).distinct()
    word = parts.select(F.lit(2).alias("level"), F.concat(F.lit(r"\b"), "w", F.lit(r"\b")).alias("pattern"), F.col("w").alias("company")).distinct()
    listed = both.unionByName(brand).unionByName(word)
    numbered = listed.select(F.concat_ws("|", "level", "pattern").alias("rule_no"), "pattern", F.concat(F.lit("Rule "), "company").alias("company"), F.lit(False).alias("exact_case"))
    return rules_from_table(numbered)


def company_rules_many(s: SparkSession, d: str) -> DataFrame:
    parts = X.table(s, d, "part")
    names = spread(parts, parts.count()).select("p_partkey", F.concat(F.upper("p_name"), F.lit(" "), F.upper("p_brand"), F.lit(" WORKS")).alias("name"))
    names = names.withColumn("name", F.when(F.col("p_partkey") % 3 == 0, F.split("name", " ")[0]).when(F.col("p_partkey") % 3 == 1, F.expr("'X ' || substring_index(name, ' ', -2)")).otherwise(F.col("name")))
    return names.select("p_partkey", normalize_company(F.col("name"), many_rules(s, d)).alias("company"))


def append_raw(s: SparkSession, d: str) -> DataFrame:
    """Raw records stored in two appends, by source."""
    folder = _stream_folder(s, "raw")
    rows = raw(s, d)
    for part in (0, 1):
        S.append_raw(rows.filter(F.pmod(F.crc32("id"), F.lit(2)) == part), folder)
    return s.read.parquet(folder).groupBy("source").agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"))


def run_counters(s: SparkSession, d: str) -> DataFrame:
    """The ledger row of a run that stores raw records, its counters taken while they are written."""
    rows, seen = S.counted(raw(s, d), named=F.col("raw_name").isNotNull(), placed=F.col("raw_latitude").isNotNull(), stateless=F.col("raw_state").isNull())
    S.append_raw(rows, _stream_folder(s, "run"))
    ledger = S.run_ledger(s, "r1", "all", "completed", seen.get, ["one", "two"])
    return ledger.select("id", "source", "status", "error_count", *[F.element_at("counts", F.lit(k)).alias(k) for k in ("rows", "named", "placed", "stateless")])


def sorted_export(s: SparkSession, d: str) -> DataFrame:
    """Golden rows exported in order and read back: rows of each file against the one before, and files against each other."""
    folder = _stream_folder(s, "export")
    S.write_sorted_csv(fac(s, d).select("id", "name", "state"), folder, ["name", "id"])
    rows = read_csv(s, folder)
    key = F.struct("name", "id")
    before = F.lag(key).over(Window.partitionBy(F.col("ingest_seq.file")).orderBy("ingest_seq.block", "ingest_seq.row"))
    files = rows.groupBy(F.col("ingest_seq.file").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    last = F.lag("high").over(Window.partitionBy(F.lit(1)).orderBy("file"))
    return rows.withColumn("bad", before > key).agg(F.count("*").alias("rows"), F.count_if("bad").alias("out_of_order")).join(
        files.withColumn("bad", last > F.col("low")).agg(F.count_if("bad").alias("files_out_of_order"))
    )


def tickers(s: SparkSession, d: str) -> DataFrame:
    """Listing pages of two hundred rows, in the array-of-arrays layout."""
    rows = X.table(s, d, "part").select(
        F.floor(F.col("p_partkey") / 200).alias("page"),
        F.array(
            F.col("p_partkey").cast("string"),
            F.concat(F.col("p_brand"), F.element_at(F.expr("array(' Inc', ', CORP.', ' Holdings', '')"), (F.col("p_partkey") % 4 + 1).cast("int"))),
            F.concat(F.lit("T"), F.col("p_partkey").cast("string")),
            F.lit("NYSE"),
        ).alias("cells"),
    )
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("cells")).alias("data"))
    return SC.ticker_rows(pages.select(F.expr("array('cik', 'name', 'ticker', 'exchange')").alias("fields"), "data")).withColumn(
        "seq", F.col("cik"))


def name_rows(s: SparkSession, d: str) -> DataFrame:
    # A small file of many names is read in few tasks; reading names costs far more than their bytes tell.
    return spread(X.derive(s, d, X.NAMES), X.table(s, d, "part").count())


def resolved_names(s: SparkSession, d: str) -> DataFrame:
    rows = with_company(name_rows(s, d), "resolved", RULES, name="name", parent="parent")
    rows = with_company(rows, "aggressive", RULES, name="name", parent="parent", aggressive=True)
    return extract_company(rows, "extracted", RULES, name="name").select("name_id", "resolved", "aggressive", "extracted")


def company_clean(s: SparkSession, d: str) -> DataFrame:
    name, parent = F.col("name"), F.col("parent")
    return name_rows(s, d).select(
        "name_id", is_blocked(name).alias("blocked"), clean_company(name).alias("cleaned"),
        normalize_company(name, RULES).alias("normalized"), normalize_company(parent, ()).alias("parent_clean"),
        title_case(name).alias("titled"),
    )


def slot_ctes(start: str) -> tuple[str, str, list[str]]:
    """Name extraction step by step: one CTE per stage, each candidate text in its own column.

    ``start`` selects an id, the name as ``f`` and the ``parent``.
    """
    def before(sep: str, least: int = 1) -> str:
        return f"case when strpos(f, {O.quote(sep)}) > {least} then {O.strip(f'left(f, strpos(f, {O.quote(sep)}) - 1)')} end"

    def after(sep: str) -> str:
        return O.strip(f"substr(f, strpos(f, {O.quote(sep)}) + {len(sep)})")

    def group(pattern: str, flags: str = "(?i)") -> str:
        p = O.quote(flags + pattern)
        return f"case when regexp_matches(f, {p}) then {O.strip(f'regexp_extract(f, {p}, 1)')} end"

    rest = f"regexp_replace(f, {O.quote('(?i)' + K.A_DIVISION_OF_PATTERN)}, '')"
    trimmed = O.strip(f"regexp_replace(f, {O.quote('(?i)' + K.TRAILER_PATTERN)}, '')")
    no_city = O.strip(f"regexp_replace({trimmed}, '\\s+[A-Z][A-Za-z]+$', '')")
    texts = {f"t_sep{i}": before(sep) for i, sep in enumerate((*K.DASH_SEPARATORS, *K.SOFT_SEPARATORS))}
    texts |= {
        "t_div": group(K.DIVISION_OF_PATTERN),
        "t_adiv": f"case when regexp_matches(f, {O.quote('(?i)' + K.A_DIVISION_OF_PATTERN)}) then nullif({O.strip(rest)}, '') end",
        "t_dba": group(K.DBA_PATTERN), "t_colon": before(":", 3), "t_hash": group(K.HASH_PATTERN),
        "t_nocity": f"case when {trimmed} <> f and length({no_city}) > 2 then {no_city} end",
        "t_strip": f"case when {trimmed} <> f then {trimmed} end", "t_hyph": group(K.HYPHEN_PATTERN, ""),
        "t_whole": "f", "t_wstrip": O.strip("f"), "t_upper": O.strip("upper(f)"),
        "t_part": O.strip(f"substr(f, 1, length(regexp_extract({O.strip('upper(f)')}, {O.quote('(?is)^.*?' + K.FIRST_SUFFIX_PATTERN)}, 0)))"),
        "t_paren": f"case when regexp_matches(f, '\\([^)]+\\)\\s*$') then regexp_extract(f, '\\(([^)]+)\\)\\s*$', 1) end",
        "t_parent": "parent",
    }
    keys = [k[2:] for k in texts]
    staged = ", ".join(f"{O.rule_company(f't_{k}', RULES)} as r_{k}, {O.clean_company(f't_{k}')} as c_{k}" for k in keys)
    normal = ", ".join(
        f"case when not {O.blocked(f't_{k}')} then coalesce(r_{k}, case when '{k}' = 'whole' then c_wstrip else c_{k} end) end as n_{k}"
        for k in keys)

    def corp(c: str) -> str:
        return O.matches(c, K.CORPORATE_PATTERN)

    steps = [(O.matches("f", K.NON_COMPANY_PATTERN), "cast(null as varchar)")]
    for i, sep in enumerate((*K.DASH_SEPARATORS, *K.SOFT_SEPARATORS)):
        eq = O.matches(after(sep), K.EQUIPMENT_PATTERN) if i < 3 else "false"
        value = f"case when n_sep{i} is not null and ({eq} or n_sep{i} <> t_sep{i}) then n_sep{i} else c_sep{i} end"
        steps.append((f"({value}) is not null", value))
    steps.append(("r_whole is not null", "r_whole"))
    for k, also in (("div", 1), ("adiv", 1), ("dba", 1), ("colon", 0), ("hash", 1), ("nocity", 0), ("strip", 0), ("hyph", 0)):
        steps.append((f"t_{k} is not null and n_{k} is distinct from c_{k}", f"n_{k}"))
        if also:
            steps.append((f"t_{k} is not null and {corp(f't_{k}')}", f"c_{k}"))
    words = "len(string_split_regex(f, '\\s+')) >= 2"
    steps.append((f"{corp('f')} or ({O.matches('f', K.INDUSTRY_TERM_PATTERN)} and {words})", "c_whole"))
    extracted = "case " + " ".join(f"when {c} then {v}" for c, v in steps) + " end"
    loose = ["r_upper", "case when length(t_part) >= 3 then n_part end"]
    for sep in K.EXTRA_SEPARATORS:
        left = before(sep, 3)
        loose.append(f"case when length({left}) >= 3 then {O.clean_company(left)} end")
    loose.append("case when length(t_paren) >= 3 then n_paren end")
    resolved = "coalesce(n_parent, extracted, case when n_whole is distinct from c_whole then n_whole end)"
    ctes = f"""s0 as ({start}), s1 as (select *, {', '.join(f'{v} as {k}' for k, v in texts.items())} from s0),
s2 as (select *, {staged} from s1), s3 as (select *, {normal} from s2), s4 as (select *, {extracted} as extracted from s3)"""
    return ctes, resolved, loose


def _slot_sql() -> str:
    ctes, resolved, loose = slot_ctes("select name_id, nullif(name, '') as f, parent from names")
    return f"""with {O.names_cte()}, {ctes}
select name_id, {resolved} as resolved, coalesce({resolved}, {', '.join(loose)}) as aggressive, extracted from s4"""


def _relink_sql() -> str:
    ctes, resolved, _ = slot_ctes("select id, nullif(name, '') as f, cast(null as varchar) as parent, company_id, company_name from equipment")
    named = f"case when company_id is null and company_name is null then {resolved} else company_name end"
    return f"""with {EQ}, {ctes}, n as (select {named} as company_name, company_id from s4)
select company_name, count(*) as facilities, count(coalesce(company_id, company_name)) as linked from n group by 1"""


# --- exports, edits, decisions ---------------------------------------------------------------


def edits(s: SparkSession, d: str) -> DataFrame:
    rows = X.table(s, d, "part")
    kept = F.map_from_arrays(
        F.expr("array('name', 'zip', 'employee_count', 'city')"),
        F.array(
            F.concat(F.upper("p_name"), F.expr("case when p_partkey % 2 = 0 then ' PLANT' else ' MILL' end")),
            F.lit(""), F.lit("12 people"), F.concat(F.lit("Springfield "), (F.col("p_partkey") % 50).cast("string")),
        ),
    )
    return rows.select(
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("edit_id"),
        F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("facility_id"),
        kept.alias("values"),
    )


_EDITED = f"""{FAC}, e as (select 'f' || lpad(cast(p_partkey as varchar), 8, '0') as id, 'e' || p_partkey as edit_id,
  upper(p_name) || case when p_partkey % 2 = 0 then ' PLANT' else ' MILL' end as new_name from part)"""


def decisions(s: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("event_type").isin("click", "purchase"), "confirm").when(F.col("event_type") == "error", "reject")
    return X.table(s, d, "events").filter("event_type in ('click', 'purchase', 'error')").select(
        F.concat(F.lit("m"), F.lpad((F.col("user_id") * 3).cast("string"), 9, "0")).alias("candidate_id"),
        decision.alias("decision"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )


_DECISIONS = """latest as (select 'm' || lpad(cast(user_id * 3 as varchar), 9, '0') as id,
  arg_max(case when event_type = 'error' then 'rejected' else 'confirmed' end, (ts, event_id)) as outcome
  from events where event_type in ('click', 'purchase', 'error') group by 1)"""


def _stream_folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    schema = X.table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)


def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    """Events as raw records, kept once per source and record id; every thirteenth has no record id."""
    folder = _stream_folder(s, "ingest")
    record = F.when(F.col("event_id") % 13 != 0, F.col("user_id").cast("string"))
    stream = _event_stream(s, d).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"), record.alias("source_record_id"), "value")
    ST.ingest(stream, f"{folder}/table", f"{folder}/progress").awaitTermination()
    return s.read.parquet(f"{folder}/table").select("id", "source", "source_record_id", "value")


def stream_decisions(s: SparkSession, d: str) -> DataFrame:
    folder = _stream_folder(s, "decisions")
    decision = F.when(F.col("event_type") == "error", "rejected").otherwise("confirmed")
    stream = _event_stream(s, d).filter("event_type in ('click', 'purchase', 'error')").select(
        F.concat(F.lit("m"), F.lpad((F.col("user_id") * 3).cast("string"), 9, "0")).alias("candidate_id"),
        decision.alias("decision"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    ST.decisions(stream, f"{folder}/table", f"{folder}/progress").awaitTermination()
    return ST.current_decisions(s, f"{folder}/table").select("candidate_id", "decision")


def clean_up_job(s: SparkSession, d: str) -> DataFrame:
    names = com(s, d).withColumn(
        "name", F.when(F.col("id") == "c-Brand#3", "Na").when(F.col("id") == "c-Brand#4", "GE").otherwise(F.col("name")))
    store = jobs.Store(raw(s, d), fac(s, d), names)
    return jobs.clean_up(store)[0].facilities.groupBy("company_id", "company_name").agg(F.count("*").alias("facilities"))


def page_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles with more entities than pages usually carry, to exercise decoding."""
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    marked = F.concat(title, F.expr("array(' &#65;&#66; &AMP;', ' &#8212; x,;.', ' &quot;q&Quot; &#38;lt;', '')[cast(page_id % 4 as int)]"))
    return X.table(s, d, "pages").select("page_id", T.normalize_facility_name(marked).alias("name"))


def page_titles_sql() -> str:
    marked = """regexp_extract(html, '(?is)<title>(.*?)</title>', 1) ||
      case page_id % 4 when 0 then ' &#65;&#66; &AMP;' when 1 then ' &#8212; x,;.' when 2 then ' &quot;q&Quot; &#38;lt;' else '' end"""
    text = marked
    for entity, char in (("AMP", "&"), ("LT", "<"), ("GT", ">"), ("QUOT", '"'), ("APOS", "'")):
        text = f"regexp_replace({text}, '(?i)&{entity};', {O.quote(char)}, 'g')"
    # zips the texts between the codes with the characters of the codes
    joined = """array_to_string(list_transform(list_zip(string_split_regex(t, '&#\\d+;'),
      list_transform(regexp_extract_all(t, '&#(\\d+);', 1), lambda n: chr(cast(n as int)))),
      lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"""
    space = "[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"
    def strip(c: str) -> str:
        return f"regexp_replace({c}, '^{space}|{space}$', '', 'g')"
    clean = f"regexp_replace({strip('d')}, '{space}', ' ', 'g')"
    return f"""with a as (select page_id, {text} as t from pages), b as (select page_id, {joined} as d from a)
    select page_id, nullif({strip(f"regexp_replace({clean}, '[,;.]+$', '')")}, '') as name from b"""


def _echo_kept() -> str:
    codes = "list_filter(string_split_regex(FAC_NAICS_CODES, '[\\s,]+'), lambda c: length(c) >= 2)"
    return f"""e as ({X.for_oracle(ECHO)}), k as (select *, {codes} as codes from e)
      select * from k where len(list_filter(codes, lambda c: left(c, 2) in ('31', '32', '33'))) > 0 and not {O.stub('FAC_NAME')}"""


_OSHA_SQL = f"""with o as ({X.for_oracle(OSHA)}), n as (select ACTIVITY_NR as activity, {O.strip('ESTAB_NAME')} as name, SITE_CITY as city,
  SITE_STATE as state, left(SITE_ZIP, 10) as zip, NAICS_CODE as naics, SIC_CODE as sic, OPEN_DATE as opened,
  try_cast(regexp_extract(NR_IN_ESTAB, '^\\s*([-+]?\\d+)', 1) as int) as staff, seq_a, seq_b, seq_c from o),
m as (select *, row_number() over (partition by upper(name), upper(city), upper(state) order by opened desc, seq_a, seq_b, seq_c) as rn from n
  where name <> '' and length(state) = 2 and (left(naics, 2) in ('31', '32', '33') or try_cast(sic as int) between 2000 and 3999))
select activity as source_record_id, name as raw_name, city as raw_city, state as raw_state, zip as raw_zip,
  coalesce(nullif(naics, ''), {O.lookup(K.SIC_GROUP_TO_NAICS, "left(sic, 2)")}) as raw_naics_code, nullif(sic, '') as raw_sic_code,
  cast(case when staff > 0 then staff end as varchar) as osha_employee_count, cast(opened as timestamp) as osha_inspection_date
from m where rn = 1 and not {O.stub('name')}"""

_TOP_PREFIX = """code_counts as (select company_id, left(primary_naics, 3) as prefix, count(*) as n,
  to_json(list_sort(list(distinct primary_naics)))::varchar as codes from facilities where company_id is not null and primary_naics is not null {more} group by 1, 2),
top as (select * from (select *, row_number() over (partition by company_id order by n desc, prefix) as rn from code_counts) where rn = 1)"""


def equipment_names(s: SparkSession, d: str) -> DataFrame:
    """Golden rows under the names that look like sites, companies or equipment."""
    rows = name_rows(s, d).select("name_id", "name")
    k = F.col("name_id")
    return rows.select(
        F.concat(F.lit("f"), F.lpad(k.cast("string"), 8, "0")).alias("id"), "name",
        F.when(k % 24 == 22, "Caterpillar").when(k % 3 == 0, F.concat(F.lit("Co "), (k % 6).cast("string"))).alias("company_name"),
        F.when(k % 3 == 0, F.lit("x")).alias("company_id"),
        F.when(k % 40 == 0, "PORTABLE SOURCE").when(k % 41 == 0, "Statewide unit").otherwise("Springfield").alias("city"),
    )


EQ = f"""{O.names_cte()}, equipment as (select 'f' || lpad(cast(name_id as varchar), 8, '0') as id, name,
  case when name_id % 24 = 22 then 'Caterpillar' when name_id % 3 = 0 then 'Co ' || (name_id % 6) end as company_name,
  case when name_id % 3 = 0 then 'x' end as company_id,
  case when name_id % 40 = 0 then 'PORTABLE SOURCE' when name_id % 41 = 0 then 'Statewide unit' else 'Springfield' end as city from names)"""

_NON_SITE = "(upper(city) like '%PORTABLE SOURCE%' or upper(city) like '%STATEWIDE%')"
_UNIT_REG = " or ".join(O.matches("name", p, "") for p in K.UNIT_REGISTRATION_PATTERNS)
_OIL = " or ".join(f"upper(name) like '%{p}%'" for p in K.OIL_GAS_PHRASES)
_MODEL = " or ".join(O.matches("name", p) for p in K.MISATTRIBUTED_MODEL_PATTERNS)
_OTHER = f"({O.matches('name', '^.+[[:space:]]*-[[:space:]]*.*CATERPILLAR')} and not {O.matches('name', '^CATERPILLAR')})"


def unlinked_sql(rows: str, more: str = "") -> str:
    """(id, more, company_name, company_id) of rows after misattributed ones are freed."""
    brands = "^[A-Z].+ - .*(" + "|".join(K.MISATTRIBUTED_BRANDS) + ")"
    return f"""select id, {more} case when not coalesce(hit, false) then company_name end as company_name,
      case when not coalesce(hit, false) then company_id end as company_id from (
        select *, ({O.matches('name', brands, '')} and company_name in {O.in_list(K.MISATTRIBUTED_COMPANIES)})
          or (company_name = 'Caterpillar' and ({_MODEL} or {_NON_SITE})) or ({_NON_SITE} and company_id is not null) as hit from ({rows}))"""


def scored_documents(s: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return X.table(s, d, "documents").select(
        "doc_id", PR.is_address_stub(text).alias("stub"), PR.matches(text, K.BROAD_EQUIPMENT_PATTERN).alias("equipment"),
        PR.unlinked_class(text).alias("class"),
    )


_CLASS = " ".join(f"when regexp_matches(text, {O.quote(p)}) then '{label}'" for label, p in K.UNLINKED_CLASSES)

QUERIES = {
    # source scans
    "echo_mfg_scan": (
        lambda s, d: SF.echo_records(X.derive(s, d, ECHO)).select(
            "source_record_id", "raw_name", "raw_address", "raw_zip", "raw_county", "raw_longitude", "raw_naics_code", "raw_sic_code"),
        f"""with kept as (with {_echo_kept()}) select REGISTRY_ID as source_record_id, nullif(FAC_NAME, '') as raw_name, FAC_STREET as raw_address,
        nullif(FAC_ZIP, '') as raw_zip, FAC_COUNTY as raw_county, FAC_LONG as raw_longitude, codes[1] as raw_naics_code,
        nullif(string_split_regex(FAC_SIC_CODES, '[\\s,]+')[1], '') as raw_sic_code from kept"""),
    "tri_dedup": (
        lambda s, d: SF.tri_records(tri_rows(s, d)).select(
            "source_record_id", "raw_name", "raw_address", F.col("raw_latitude").cast("double").alias("lat"),
            F.col("raw_longitude").cast("double").alias("lng"), "registry_id", "tri_parent_company_name"),
        f"""with t as ({X.for_oracle(TRI)}), f as (select *, row_number() over (partition by tri_facility_id order by seq_a, seq_b, seq_c) as rn
        from t where tri_facility_id <> '') select tri_facility_id as source_record_id, facility_name as raw_name, street_address as raw_address,
        pref_latitude as lat, case when pref_longitude > 60 then -pref_longitude else pref_longitude end as lng,
        epa_registry_id as registry_id, parent_co_name as tri_parent_company_name from f where rn = 1 and not {O.stub('facility_name')}"""),
    "osha_latest": (
        lambda s, d: SF.osha_records(osha_source(s, d)).select(
            "source_record_id", "raw_name", "raw_city", "raw_state", "raw_zip", "raw_naics_code", "raw_sic_code",
            F.col("osha_employee_count").cast("string").alias("osha_employee_count"), "osha_inspection_date"), _OSHA_SQL),
    "fsis_merge": (
        fsis_scan,
        f"""with r as ({X.for_oracle(X.FSIS_ROWS)}), f as (select est_number, arg_min(company, ingest_seq) as company, arg_min(state, ingest_seq) as state,
        arg_min(size, ingest_seq) as size, list(activities order by ingest_seq) as acts from r group by 1),
        m as (select *, case when acts[2] = '' or contains(acts[1], acts[2]) then acts[1] when acts[1] = '' then acts[2]
          else acts[1] || ', ' || acts[2] end as a from f)
        select 'FSIS-' || est_number as source_record_id, company as raw_name, state as raw_state,
        case when upper(a) like '%POULTRY%' then '311615' when upper(a) like '%SLAUGHTER%' then '311611'
          when upper(a) like '%PROCESSING%' then '311612' when upper(a) like '%RENDERING%' then '311613'
          when upper(a) like '%EGG%' then '311999' else '311611' end as raw_naics_code, nullif(a, '') as fsis_activities,
        case when size = '' then null else size end as fsis_size_category from m where not {O.stub('company')}"""),
    "nhtsa_scan": (
        nhtsa_scan,
        f"""with r as (select *, {NHTSA_TYPES} as types from ({X.for_oracle(NHTSA)})), k as (select * from r where upper(Country) <> 'CANADA'
        and (Mfr_Name <> '' or Mfr_CommonName <> '')), dt as (select * from (select *, row_number() over (partition by Mfr_ID order by seq) as rn
          from r where s_acctbal > 3000) where rn = 1),
        u as (select k.Mfr_ID, k.seq, coalesce(d.Mfr_Name, k.Mfr_Name) as mn, coalesce(d.Mfr_CommonName, k.Mfr_CommonName) as cn,
          coalesce(d.Country, k.Country) as ct, coalesce(d.StateProvince, k.StateProvince) as sp, case when d.Mfr_ID is null then k.City else 'Lansing' end as city,
          coalesce(d.PostalCode, k.PostalCode) as zip, coalesce(d.Address, k.Address) as a1, coalesce(d.Address2, k.Address2) as a2,
          coalesce(d.types, k.types) as types from k left join dt d using (Mfr_ID)),
        f as (select * from (select *, row_number() over (partition by Mfr_ID order by seq) as rn from u where upper(ct) <> 'CANADA' and (mn <> '' or cn <> '')) where rn = 1)
        select 'nhtsa_' || Mfr_ID as source_record_id, coalesce(nullif(cn, ''), mn) as raw_name, concat_ws(', ', nullif(a1, ''), nullif(a2, '')) as raw_address,
        city as raw_city, case sp when 'Michigan' then 'MI' when 'oh' then 'OH' end as raw_state, zip as raw_zip,
        case types when 'Trailer' then '336212' when 'Passenger Car|Motorcycle' then '336991' when 'Truck' then '336120'
          when 'Low Speed Vehicle (LSV)' then '336999' else '336110' end as raw_naics_code, nullif(types, '') as types
        from f where not {O.stub("coalesce(nullif(cn, ''), mn)")}"""),
    "census_scan": (
        lambda s, d: SF.census_records(X.derive(s, d, CENSUS_PAGES)).select(
            "source_record_id", "raw_state", "raw_naics_code", "raw_naics_description", "census_county_fips",
            "census_establishment_count", "census_annual_payroll", "census_employees"),
        f"""with c as (select lpad(cast(c_nationkey + 1 as varchar), 2, '0') as st, lpad(cast(c_custkey % 1000 as varchar), 3, '0') as co, * from customer),
        r as (select st, co, '31-33' as code, 'Manufacturing' as label, case when c_custkey % 9 < 2 then 0 else 1000 + c_custkey % 1000 end as e,
          c_custkey * 10 as p, case when c_custkey % 5 = 0 then 0 else c_custkey end as m from c
          union all select '48', co, '3116', 'Slaughter', 7, 0, c_nationkey from c)
        select 'cbp_' || st || co || '_' || replace(code, '-', '') as source_record_id, {O.lookup(K.FIPS_TO_STATE, 'st')} as raw_state,
        case when code = '31-33' then '31' else code end as raw_naics_code, label as raw_naics_description, st || co as census_county_fips,
        e as census_establishment_count, p as census_annual_payroll, m as census_employees
        from r where e <> 0 and {O.lookup(K.FIPS_TO_STATE, 'st')} is not null"""),
    "seed_golden": (
        lambda s, d: SC.seed_golden(X.derive(s, d, SEED))["facilities"].select(
            "name", "company_name", "address", "city", "state", "latitude", "longitude", "confidence"),
        f"""with r as ({X.for_oracle(SEED)}) select Description as name, regexp_replace(Company, ' Inc$', '') as company_name, Address as address,
        City as city, case State when 'Texas' then 'TX' when 'oh' then 'OH' when 'Guam' then 'GU' end as state, nullif(LAT, '') as latitude,
        LONG as longitude, case when LAT <> '' then 85 else 60 end as confidence
        from r where Company not in ('', 'Company') and Description <> ''"""),
    "seed_companies": (
        lambda s, d: SC.seed_golden(X.derive(s, d, SEED))["companies"].select("name", "sector", "facility_count"),
        f"""with r as ({X.for_oracle(SEED)}) select regexp_replace(Company, ' Inc$', '') as name, 'Manufacturing' as sector, count(*) as facility_count
        from r where Company not in ('', 'Company') and Description <> '' group by 1"""),
    "company_list": (
        lambda s, d: C.company_rows(
            X.derive(s, d, SEED).select(F.col("Company").alias("company_name"), F.col("Description").alias("industry"),
                                        F.lit("332710").alias("primary_naics"), F.col("k").cast("string").alias("tx_factory_count"),
                                        F.col("k").alias("ingest_seq")),
            com(s, d).filter("name < 'Brand#2'")).select("name", "sector", "naics_codes", "facility_count"),
        f"""with r as ({X.for_oracle(SEED)}), {COM}, n as (select regexp_replace(Company, ' Inc$', '') as name, arg_min(Description, k) as sector,
        '["332710"]' as naics_codes, min(k) as facility_count from r where Company <> '' group by 1)
        select name, nullif(sector, '') as sector, naics_codes, facility_count from n where name not in (select name from companies where name < 'Brand#2')"""),
    "curated_factories": (
        lambda s, d: SC.factory_records(
            X.table(s, d, "part").select(
                F.col("p_name").alias("factory_name"), F.concat(F.lit(" "), "p_type").alias("address"), F.lit("").alias("state"),
                F.expr("case when p_partkey % 3 = 0 then '' else '1100' || cast(p_partkey as string) end").alias("epa_registry_id")),
            raw(s, d).withColumns({"source": F.lit("manual"), "raw_state": F.lit("TX")})).select("raw_name", "raw_address", "raw_state", "registry_id"),
        f"""with {RAW}, r as (select p_name as raw_name, trim(p_type) as raw_address, 'TX' as raw_state,
        case when p_partkey % 3 = 0 then null else '1100' || p_partkey end as registry_id from part)
        select * from r where registry_id is null or registry_id not in (select registry_id from raw_records where registry_id is not null)"""),
    "ticker_match": (
        lambda s, d: C.match_tickers(com(s, d), tickers(s, d)),
        f"""with {COM}, t as (select p_partkey as seq, p_brand || ([' Inc', ', CORP.', ' Holdings', ''])[cast(p_partkey % 4 + 1 as int)] as name,
          'T' || p_partkey as ticker from part),
        f as (select seq, ticker, unnest([{O.normalize_company('name', ())}, {O.clean_company('name')},
          nullif({O.strip(f"regexp_replace(name, {O.quote('(?i)' + K.TICKER_STRIP_PATTERN)}, '', 'g')")}, '')]) as form, unnest([1, 2, 3]) as pos from t),
        k as (select form, arg_min(struct_pack(seq := seq, ticker := ticker), (seq, pos)) as e from f where form is not null group by 1),
        o as (select id, unnest([name, {O.normalize_company('name', ())}, {O.clean_company('name')},
          nullif({O.strip(f"regexp_replace(upper(name), {O.quote('(?i)' + K.COMPANY_STRIP_PATTERN)}, '', 'g')")}, '')]) as form, unnest([1, 2, 3, 4]) as pos from companies)
        select id, arg_min(e.ticker, pos) as ticker, lpad(cast(arg_min(e.seq, pos) as varchar), 10, '0') as cik, 'NYSE' as exchange
        from o join k using (form) group by id"""),
    "append_raw": (append_raw, f"with {RAW} select source, count(*) as records, count(distinct id) as ids from raw_records group by 1"),
    "run_counters": (
        run_counters,
        f"""with {RAW} select 'r1' as id, 'all' as source, 'completed' as status, 2 as error_count, count(*) as rows,
        count(raw_name) as named, count(raw_latitude) as placed, count(*) - count(raw_state) as stateless from raw_records"""),
    "sorted_export": (
        sorted_export, f"with {FAC} select count(*) as rows, 0 as out_of_order, 0 as files_out_of_order from facilities"),
    "ticker_write": (
        ticker_write,
        f"""with {COM}, t as (select p_partkey as seq, p_brand || ([' Inc', ', CORP.', ' Holdings', ''])[cast(p_partkey % 4 + 1 as int)] as name,
          'T' || p_partkey as ticker from part),
        f as (select seq, ticker, unnest([{O.normalize_company('name', ())}, {O.clean_company('name')},
          nullif({O.strip(f"regexp_replace(name, {O.quote('(?i)' + K.TICKER_STRIP_PATTERN)}, '', 'g')")}, '')]) as form, unnest([1, 2, 3]) as pos from t),
        k as (select form, arg_min(struct_pack(seq := seq, ticker := ticker), (seq, pos)) as e from f where form is not null group by 1),
        o as (select id, unnest([name, {O.normalize_company('name', ())}, {O.clean_company('name')},
          nullif({O.strip(f"regexp_replace(upper(name), {O.quote('(?i)' + K.COMPANY_STRIP_PATTERN)}, '', 'g')")}, '')]) as form, unnest([1, 2, 3, 4]) as pos from companies),
        h as (select id, arg_min(e.ticker, pos) as ticker, lpad(cast(arg_min(e.seq, pos) as varchar), 10, '0') as cik from o join k using (form) group by id)
        select id, coalesce(case when facility_count % 3 = 0 then 'D1' end, cik) as duns_number,
          case when facility_count % 2 = 0 then '1' end as n, ticker from companies left join h using (id)"""),
    "ticker_count": (
        lambda s, d: Q.ticker_count(C.add_tickers(com(s, d).withColumn("name_variants", F.lit(None).cast("string")), C.match_tickers(com(s, d).filter("name < 'Brand#3'"), tickers(s, d)))),
        f"with {COM} select count(*) filter (where name < 'Brand#3') as with_ticker from companies"),
    "osha_files": (osha_files, _OSHA_FILES),
    "fsis_files": (
        fsis_files,
        f"""with fsis as ({X.for_oracle(X.FSIS_ROWS)}),
        r as (select est_number as est, arg_min(company, ingest_seq) as company, arg_min(state, ingest_seq) as state from fsis group by 1)
        select 'FSIS-' || est as source_record_id, company || chr(10) || '& Sons' as raw_name, state as raw_state from r"""),
    "company_rules_many": (
        company_rules_many,
        """with p as (select p_partkey, split_part(upper(p_name), ' ', 1) as w, upper(p_brand) as b from part),
        words as (select distinct w from p), pairs as (select distinct w, b from p)
        select p.p_partkey, 'Rule ' || case when p_partkey % 3 = 0 then w when p_partkey % 3 = 1 then b else w || ' ' || b end as company from p"""),
    "crosswalk": (
        lambda s, d: SC.with_crosswalk_naics(
            X.table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 400).cast("string").alias("sic")).select(
                F.col("p_partkey").cast("string").alias("id"), F.lpad("sic", 4, "0").alias("raw_sic_code"), F.lit(None).cast("string").alias("raw_naics_code")),
            SC.crosswalk(X.table(s, d, "supplier").select(
                F.col("s_suppkey").cast("string").alias("sicCode"), F.col("s_name").alias("sicDesc"),
                F.expr("case when s_suppkey % 10 = 0 then 'x' else cast(311000 + s_suppkey as string) end").alias("naicsCode"),
                F.col("s_name").alias("naicsTitle")))).select("id", "raw_sic_code", "raw_naics_code"),
        """select cast(p_partkey as varchar) as id, lpad(cast(p_partkey % 400 as varchar), 4, '0') as raw_sic_code,
        cast(311000 + s_suppkey as varchar) as raw_naics_code from part left join (select * from supplier where s_suppkey % 10 <> 0) on s_suppkey = p_partkey % 400"""),
    "naics_hierarchy": (
        lambda s, d: fac(s, d).select(F.explode(F.array(*[T.starts(F.col("primary_naics"), n) for n in (2, 3, 4)])).alias("code")).groupBy(
            "code").agg(F.count("*").alias("facilities")).join(F.broadcast(SC.naics_codes(s)), "code"),
        f"""with {FAC}, c(code, title, level, parent_code) as (values {', '.join(
            [f"('{c}', 'Manufacturing ({c})', 2, null)" for c in K.SECTOR_CODES]
            + [f"('{c}', {O.quote(t)}, 3, '{c[:2]}')" for c, t in K.SUBSECTORS]
            + [f"('{c}', {O.quote(t)}, 4, '{c[:3]}')" for c, t in K.INDUSTRY_GROUPS])})
        select c.*, count(*) as facilities from c join facilities f on starts_with(f.primary_naics, c.code) group by all"""),
    # normalisation
    "address_norm": (
        lambda s, d: raw(s, d).select(
            "id", T.normalize_address(F.concat("raw_address", F.lit(" "), "raw_city", F.lit(" ST. LOUIS W. PKWY, FL 3"))).alias("address"),
            T.normalize_city(F.concat(F.lit("  "), "raw_city", F.lit("  x "))).alias("city"),
            T.normalize_zip(F.concat(F.lit(" "), "raw_zip", F.lit("-12"))).alias("zip"), T.zip_prefix(F.col("raw_zip")).alias("zip3")),
        f"""with {RAW} select id, {O.address("raw_address || ' ' || raw_city || ' ST. LOUIS W. PKWY, FL 3'")} as address,
        {O.city("'  ' || raw_city || '  x '")} as city, {O.zip5("' ' || raw_zip || '-12'")} as zip, left(raw_zip, 3) as zip3 from raw_records"""),
    "coord_quality": (
        lambda s, d: Q.coordinate_issues(raw(s, d).withColumn(
            "raw_latitude", F.expr("case when id like '%7' then '0' when id like '%3' then 'n/a' when id like '%9' then '95' else raw_latitude || 'N' end")).withColumn(
            "raw_longitude", F.expr("case when id like '%7' then '0' when id like '%1' then '10' else raw_longitude end"))),
        f"""with {RAW}, c as (select source, case when id like '%7' then '0' when id like '%3' then 'n/a' when id like '%9' then '95' else raw_latitude end as lat,
          case when id like '%7' then '0' when id like '%1' then '10' else raw_longitude end as lng from raw_records),
        n as (select source, lat as rl, lng as rg, try_cast(lat as double) as lat, try_cast(lng as double) as lng from c)
        select source, case when rl is null or rg is null then 'missing_coordinates' when lat is null or lng is null then 'non_numeric'
          when abs(lat) > 90 or abs(lng) > 180 then 'out_of_global_bounds' when lat = 0 and lng = 0 then 'zero_coordinates'
          when not ({' or '.join(f'(lat between {a} and {b} and lng between {c} and {e})' for _, a, b, c, e in K.US_BOXES)}) then 'outside_us'
          else 'valid' end as issue, count(*) as records from n group by 1, 2"""),
    "coordinates": (
        lambda s, d: raw(s, d).select("id", validate_coordinates(F.col("raw_latitude"), F.col("raw_longitude")).alias("c")).select("id", "c.*"),
        f"""with {RAW} select id, raw_latitude is not null as valid, try_cast(raw_latitude as double) as latitude, try_cast(raw_longitude as double) as longitude,
        case when raw_latitude is null then 'missing_coordinates' end as issue from raw_records"""),
    "codes": (
        lambda s, d: fac(s, d).select(
            "id", I.validate_naics(F.concat(F.lit(" "), "primary_naics", F.lit(" 99"))).alias("valid"), I.describe_naics(F.col("primary_naics")).alias("title"),
            I.category_key(F.col("primary_naics")).alias("category"), I.category_label(F.col("primary_naics")).alias("label"),
            I.sic_to_naics((F.col("employee_count") * 100).cast("string")).alias("from_sic"),
            I.is_manufacturing_naics(F.col("primary_naics")).alias("manufacturing")),
        f"""with {FAC} select id, case when left(primary_naics, 2) in ('31', '32', '33') then primary_naics end as valid,
        {O.lookup(K.SUBSECTORS, 'left(primary_naics, 3)')} as title, {O.category('primary_naics', 0)} as category,
        coalesce({O.category('primary_naics', 1)}, 'Manufacturing') as label, {O.lookup(K.SIC_GROUP_TO_NAICS, 'cast(employee_count as varchar)')} as from_sic,
        left(primary_naics, 2) in ('31', '32', '33') as manufacturing from facilities"""),
    "state_names": (
        lambda s, d: X.table(s, d, "part").select(
            "p_partkey", F.expr("array(' texas ', 'tx', 'District of Columbia', 'guam', 'X', 'Ontario', '', 'GU')[cast(p_partkey % 8 as int)]").alias("t")).select(
            "p_partkey", T.state_from_name(F.col("t")).alias("listed"), T.state_loose(F.col("t")).alias("loose"), T.state_seed(F.col("t")).alias("seed")),
        """select p_partkey, (['TX', 'TX', 'DC', null, null, null, null, null])[cast(p_partkey % 8 + 1 as int)] as listed,
        (['TX', 'TX', 'DC', null, 'X', null, null, 'GU'])[cast(p_partkey % 8 + 1 as int)] as loose,
        (['TX', 'TX', 'DC', 'GU', null, null, null, 'GU'])[cast(p_partkey % 8 + 1 as int)] as seed from part"""),
    "html_entity_names": (page_titles, page_titles_sql()),
    "fields_provided": (
        lambda s, d: raw(s, d).select("id", F.array_join(CF.fields_provided(raw(s, d).columns), ",").alias("fields")),
        f"with {RAW} select id, {FIELDS_SQL} as fields from raw_records"),
    "company_clean": (
        company_clean,
        f"""with {O.names_cte()} select name_id, {O.blocked('name')} as blocked, {O.clean_company('name')} as cleaned,
        {O.normalize_company('name', RULES)} as normalized, {O.normalize_company('parent', ())} as parent_clean, {O.title('name')} as titled from names"""),
    "company_rules": (resolved_names, _slot_sql()),
    "stub_filter": (
        lambda s, d: name_rows(s, d).select("name_id", PR.is_address_stub(F.col("name")).alias("stub")),
        f"with {O.names_cte()} select name_id, {O.stub('name')} as stub from names"),
    "document_predicates": (
        scored_documents,
        f"""select doc_id, {O.stub('text')} as stub, {O.matches('text', K.BROAD_EQUIPMENT_PATTERN)} as equipment,
        case {_CLASS} when length(text) < 10 then 'very_short' else 'other' end as class from documents"""),
    "unlinked_categories": (
        lambda s, d: Q.unlinked_classes(equipment_names(s, d)),
        f"""with {EQ} select case {_CLASS.replace('text', 'name')} when length(name) < 10 then 'very_short' else 'other' end as category,
        count(*) as facilities from equipment where company_id is null group by 1"""),
    "equipment_share": (
        lambda s, d: Q.equipment_share(equipment_names(s, d), minimum=3),
        f"""with {EQ} select company_name, count(*) as total, count(*) filter (where {O.matches('name', K.EQUIPMENT_SHARE_PATTERN)}) as equipment_like,
        cast(floor(count(*) filter (where {O.matches('name', K.EQUIPMENT_SHARE_PATTERN)})::double / count(*) * 100 + 0.5) as bigint) as percent
        from equipment where company_name is not null group by 1 having equipment_like > 3 order by 3 desc, 1 limit 20"""),
    "equipment_counts": (
        lambda s, d: Q.equipment_counts(equipment_names(s, d)),
        f"""with {EQ} select count(*) as total, count(*) filter (where {O.matches('name', K.PORTABLE_PATTERN)}) as portable,
        count(*) filter (where {O.matches('name', K.EQUIPMENT_WORDS_PATTERN)}) as equipment_words,
        count(*) filter (where {O.matches('name', K.BROAD_EQUIPMENT_PATTERN)}) as broad_equipment,
        count(*) filter (where {O.matches('name', K.INFRASTRUCTURE_PATTERN)}) as infrastructure, count(*) filter (where {_OIL}) as oil_gas,
        count(*) filter (where {_NON_SITE}) as non_site_city,
        count(*) filter (where {O.matches('name', '^[A-Z].+ - .*(' + '|'.join(K.CROSS_BRANDS) + ')', '')}) as cross_brand,
        count(*) filter (where {_NON_SITE} or {_UNIT_REG}) as unit_registrations from equipment"""),
    "raw_equipment_counts": (
        lambda s, d: Q.raw_equipment_counts(equipment_names(s, d), "name"),
        f"""with {EQ} select count(*) filter (where {O.matches('name', K.PORTABLE_PATTERN)}) as portable,
        count(*) filter (where {O.matches('name', K.RAW_EQUIPMENT_PATTERN)}) as equipment_words from equipment"""),
    "equipment_by_company": (
        lambda s, d: Q.equipment_by_company(equipment_names(s, d), ("Caterpillar", "Co 0", "Co 3")),
        f"""with {EQ}, e as (select company_name, {O.matches('name', K.MODEL_NUMBER_PATTERN)} or {_OTHER} or city in ('PORTABLE SOURCE', 'STATEWIDE') as q
        from equipment where company_name in ('Caterpillar', 'Co 0', 'Co 3')) select company_name, count(*) filter (where q) as equipment,
        count(*) filter (where not q) as sites, count(*) as total from e group by 1"""),
    "other_operator": (
        lambda s, d: equipment_names(s, d).filter(PR.is_other_operator(F.col("name"))).select("id", "name"),
        f"with {EQ} select id, name from equipment where {_OTHER}"),
    "unlink_misattributed": (
        lambda s, d: jobs.unlink_misattributed(equipment_names(s, d)).select("id", "company_name", "company_id"),
        f"with {EQ} {unlinked_sql('select * from equipment')}"),
    # companies
    "relink_companies": (
        lambda s, d: C.relink(equipment_names(s, d), com(s, d), RULES)[0].groupBy("company_name").agg(
            F.count("*").alias("facilities"), F.count("company_id").alias("linked")), _relink_sql()),
    "company_upsert": (
        lambda s, d: C.upsert_companies(com(s, d).filter("name > 'Brand#2'"), fac(s, d)).select("name", "status", "facility_count"),
        f"""with {COM}, {FAC}, c as (select * from companies where name > 'Brand#2') select name, status, facility_count from c union all
        select distinct company_name, 'unverified', 0 from facilities where company_name is not null and company_name not in (select name from c)"""),
    "company_links": (
        lambda s, d: C.link_by_name(fac(s, d).drop("company_id"), com(s, d)).select("id", "company_id"),
        f"with {FAC} select id, company_id from facilities"),
    "bad_companies": (
        lambda s, d: C.drop_bad_companies(fac(s, d), com(s, d), ("Brand#3", "Brand#7"))[1].select("id", "facility_count"),
        f"""with {COM}, {FAC}, n as (select company_id, count(*) as n from facilities where company_name not in ('Brand#3', 'Brand#7') group by 1)
        select c.id, coalesce(n.n, c.facility_count) as facility_count from companies c left join n on n.company_id = c.id
        where c.name not in ('Brand#3', 'Brand#7')"""),
    "name_sync": (
        lambda s, d: C.sync_names(fac(s, d), com(s, d).withColumn("name", F.upper("name"))).select("id", "company_name"),
        f"with {FAC} select id, upper(company_name) as company_name from facilities"),
    "clear_state": (
        lambda s, d: C.clear_state(fac(s, d), "GU").select("id", "state"),
        f"with {FAC} select id, nullif(state, 'GU') as state from facilities"),
    "sector_assign": (
        lambda s, d: C.assign_sectors(com(s, d), fac(s, d)).select("id", "sector", "naics_codes"),
        f"""with {COM}, {FAC}, {_TOP_PREFIX.format(more='')} select c.id, case when c.sector is null and t.prefix is not null
        then coalesce({O.lookup(K.SECTOR_LABELS_ASSIGN, 't.prefix')}, 'Manufacturing') else c.sector end as sector,
        case when c.sector is null and t.prefix is not null then t.codes end as naics_codes from companies c left join top t on t.company_id = c.id"""),
    "sector_refresh": (
        lambda s, d: C.refresh_sectors(com(s, d), fac(s, d)).select("id", "sector"),
        f"""with {COM}, {FAC}, {_TOP_PREFIX.format(more='and length(primary_naics) >= 3')} select c.id, case when t.prefix is not null
        then coalesce({O.lookup(K.SECTOR_LABELS_REFRESH, 't.prefix')}, 'Manufacturing') else c.sector end as sector
        from companies c left join top t on t.company_id = c.id"""),
    "sector_distribution": (
        lambda s, d: C.sector_distribution(C.refresh_sectors(com(s, d), fac(s, d))),
        f"""with {COM}, {FAC}, {_TOP_PREFIX.format(more='and length(primary_naics) >= 3')} select coalesce({O.lookup(K.SECTOR_LABELS_REFRESH, 't.prefix')}, 'Manufacturing') as sector,
        count(*) as companies from companies c join top t on t.company_id = c.id group by 1 order by 2 desc, 1 limit 25"""),
    "employee_propagation": (
        lambda s, d: C.propagate_employees(
            fac(s, d), raw(s, d).withColumn("facility_id", F.when(F.col("source") == "osha", F.concat(F.lit("f"), F.substring("id", 12, 8))))).select(
                "id", F.col("employee_count").cast("string").alias("employee_count")),
        f"""with {RAW}, {FAC}, l as (select * from (select 'f' || substr(id, 12, 8) as facility_id, osha_employee_count as n, row_number() over (
        partition by substr(id, 12, 8) order by osha_inspection_date desc nulls last, id) as rn from raw_records where source = 'osha' and osha_employee_count > 0) where rn = 1)
        select f.id, cast(case when coalesce(f.employee_count, 0) = 0 then coalesce(l.n, f.employee_count) else f.employee_count end as varchar) as employee_count
        from facilities f left join l on l.facility_id = f.id"""),
    "clean_up_job": (
        clean_up_job,
        f"""with {FAC} select case when company_id = 'c-Brand#3' then null else company_id end as company_id,
        case when company_id = 'c-Brand#3' then null when company_id = 'c-Brand#4' then 'GE' else company_name end as company_name,
        count(*) as facilities from facilities group by 1, 2"""),
    # sinks
    "export_factory": (
        lambda s, d: S.factory_export(fac(s, d), ExportFilter(naics_prefix="33", min_sources=2, has_company=True).for_export()),
        f"""with {FAC} select coalesce(company_name, '') as company_name, name as facility_name, coalesce(address, '') as address, city,
        coalesce(state, '') as state, coalesce(zip, '') as zip, coalesce(latitude, '') as latitude, coalesce(longitude, '') as longitude,
        primary_naics as naics_code, coalesce(primary_naics_description, '') as naics_description,
        coalesce(cast(employee_count as varchar), '') as employee_count, cast(source_count as varchar) as source_count,
        cast(confidence as varchar) as confidence, coalesce(epa_registry_id, '') as epa_registry_id
        from facilities where primary_naics like '33%' and source_count >= 2 and company_id is not null"""),
    "export_company": (
        lambda s, d: S.company_export(com(s, d), fac(s, d)),
        f"""with {COM}, {FAC} select c.name as company_name, coalesce(c.sector, '') as sector, c.facility_count,
        coalesce((select string_agg(distinct f.state, '; ' order by f.state) from facilities f where f.company_id = c.id), '') as states,
        '' as naics_codes, c.status from companies c where c.facility_count > 0 and c.status <> 'rejected'"""),
    "export_ledger": (
        lambda s, d: S.export_ledger(fac(s, d).filter("confidence >= 50"), F.lit("x1"), '{"minConfidence":50}'),
        f"""with {FAC} select 'x1' as export_id, 'completed' as status, count(*) as facility_count, count(distinct company_id) as company_count,
        '{{"minConfidence":50}}' as filters from facilities where confidence >= 50"""),
    "mark_exported": (
        lambda s, d: S.mark_exported(
            S.mark_exported(fac(s, d), F.col("confidence") >= 50, F.lit("2024-05-01").cast("timestamp")),
            F.col("state") == "TX", F.lit("2024-06-01").cast("timestamp")).select("id", "export_count", "last_exported_at"),
        f"""with {FAC} select id, (confidence >= 50)::int + coalesce((state = 'TX')::int, 0) as export_count,
        case when state = 'TX' then timestamp '2024-06-01' when confidence >= 50 then timestamp '2024-05-01' end as last_exported_at from facilities"""),
    "insert_new": (
        lambda s, d: S.insert_new(lin(s, d).filter("source <> 'osha'"), lin(s, d), ["facility_id", "source"]).select("facility_id", "source"),
        f"with {LIN} select distinct facility_id, source from lineage where source = 'osha'"),
    "bulk_update": (
        lambda s, d: S.update_from(
            fac(s, d), raw(s, d).filter("source = 'manual'").select(
                F.concat(F.lit("f"), F.substring("id", 2, 8)).alias("id"), F.col("raw_address").alias("address"), F.col("raw_state").alias("state")),
            "id", ["address", "state"]).select("id", "address", "state"),
        f"""with {FAC}, {RAW} select f.id, coalesce(r.raw_address, f.address) as address, coalesce(r.raw_state, f.state) as state
        from facilities f left join raw_records r on r.source = 'manual' and 'f' || substr(r.id, 2) = f.id"""),
    "delete_where": (
        lambda s, d: S.delete_unreferenced(S.delete_where(com(s, d), F.col("status") == "rejected"), fac(s, d).filter("confidence > 95"), "id", "company_id"),
        f"with {COM}, {FAC} select * from companies where status <> 'rejected' and id in (select company_id from facilities where confidence > 95)"),
    "manual_edits": (
        lambda s, d: S.apply_edits(fac(s, d), edits(s, d))["facilities"].select(
            "id", "name", "zip", "city", F.col("employee_count").cast("string").alias("employee_count"), "sources", "source_count"),
        f"""with {_EDITED} select f.id, case when e.id is null then f.name else e.new_name end as name, case when e.id is null then f.zip end as zip, f.city,
        cast(case when e.id is null then f.employee_count else 12 end as varchar) as employee_count,
        case when e.id is null then f.sources else replace(f.sources, ']', ',"manual"]') end as sources,
        f.source_count + case when e.id is null then 0 else 1 end - case when e.id is null then 0 else f.source_count - len(from_json(f.sources, '["VARCHAR"]')) end as source_count
        from facilities f left join e using (id)"""),
    "manual_edit_audit": (
        lambda s, d: S.apply_edits(fac(s, d), edits(s, d))["raw_records"].select(
            "source_record_id", "raw_name", "raw_zip", F.array_join("edited_fields", ",").alias("edited"), F.col("previous")["name"].alias("old_name")),
        f"""with {_EDITED} select 'manual_edit_' || f.id || '_' || e.edit_id as source_record_id, e.new_name as raw_name, f.zip as raw_zip,
        concat_ws(',', case when e.new_name <> f.name then 'name' end, case when f.zip is not null then 'zip' end,
          case when f.employee_count is distinct from 12 then 'employee_count' end) as edited, case when e.new_name <> f.name then f.name end as old_name
        from facilities f join e using (id) where e.new_name <> f.name or f.zip is not null or f.employee_count is distinct from 12"""),
    "company_edits": (
        lambda s, d: S.apply_company_edits(com(s, d), fac(s, d), com(s, d).filter("status = 'rejected'").select(
            "id", F.concat("name", F.lit(" Group")).alias("name"), F.lit(None).cast("string").alias("sector"), F.lit("verified").alias("status")))[1].select("id", "company_name"),
        f"""with {FAC}, {COM} select f.id, case when c.status = 'rejected' then c.name || ' Group' else f.company_name end as company_name
        from facilities f left join companies c on c.id = f.company_id"""),
    "review_decisions": (
        lambda s, d: S.apply_decisions(review_candidates(s, d), decisions(s, d)).select("id", "status"),
        f"""with {REVIEW}, {_DECISIONS} select c.id, case when c.status = 'pending' then coalesce(l.outcome, c.status) else c.status end as status
        from candidates c left join latest l using (id)"""),
    "json_types": (
        lambda s, d: X.table(s, d, "events").select("event_id", T.merge_json_objects(
            F.concat(F.lit('{"o":{"a":'), "event_id", F.lit('},"n":1,"x":null,"s":"1"}')),
            F.expr("case when event_id % 3 = 0 then null when event_id % 3 = 1 then '{\"n\":2.5,\"s\":null,\"l\":[1,\"2\"]}' else 'no object' end")).alias("m")).select(
            "event_id", *[F.schema_of_variant(F.try_variant_get(F.try_parse_json("m"), f"$.{k}", "variant")).alias(k) for k in "onxsl"],
            F.get_json_object("m", "$.o.a").alias("a"), F.get_json_object("m", "$.n").alias("value")),
        """select event_id, 'OBJECT<a: BIGINT>' as o, case when event_id % 3 = 1 then 'DECIMAL(2,1)' else 'BIGINT' end as n, 'VOID' as x,
        case when event_id % 3 = 1 then 'VOID' else 'STRING' end as s, case when event_id % 3 = 1 then 'ARRAY<VARIANT>' end as l,
        cast(event_id as varchar) as a, case when event_id % 3 = 1 then '2.5' else '1' end as value from events"""),
    "json_merge": (
        lambda s, d: X.table(s, d, "events").select("event_id", T.merge_json_objects(
            F.col("props"), F.to_json(F.struct(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, "0").alias("k")))).alias("merged")).select(
            "event_id", F.get_json_object("merged", "$.k").alias("k"), F.get_json_object("merged", "$.kind").alias("kind")),
        """select event_id, case when event_id % 2 = 0 then '0' else props ->> '$.k' end as k, event_type as kind from events"""),
    "random_sample": (
        lambda s, d: paging.random_sample(fac(s, d).filter("company_id is null"), 20, 7).select("id", "name"),
        f"with {FAC} select id, name from facilities where company_id is null order by md5('7:' || id), id limit 20"),
    # streams
    "stream_ingest": (
        stream_ingest,
        """with e as (select event_id as id, event_type as source, case when event_id % 13 <> 0 then cast(user_id as varchar) end as source_record_id, value from events)
        select * from e where source_record_id is null or id in (select min(id) from e where source_record_id is not null group by source, source_record_id)"""),
    "stream_decisions": (
        stream_decisions, f"with {_DECISIONS} select id as candidate_id, outcome as decision from latest"),
}
