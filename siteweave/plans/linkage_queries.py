"""Queries over matching, clustering and golden rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave import fixtures as X
from siteweave.functions.company import CompanyRule
from siteweave.functions.scoring import MatchConfig
from siteweave.operators import components, dedup, golden, linkage
from siteweave.plans import jobs
from siteweave.plans import oracle_text as O
from siteweave.session import cut_lineage, shared_folder
from siteweave.streaming.incremental import current_state, match_new, match_stream

# A rule list over the words of the given part table, as a user would supply one.
RULES = (
    CompanyRule(r"\bCATERPILLAR\b", "Caterpillar"),
    CompanyRule(r"\bBRAND#1\d\b", "Brand Teens"),
    CompanyRule(r"\bBRAND#2[0-4]\b", "Brand Twenties"),
    CompanyRule(r"\b(?:RED|BLUE)\s+WIDGET\b", "Colour Widget"),
    CompanyRule(r"\bACME1-", "Acme One"),
    CompanyRule(r"\bHOT GEAR\b", "HG", exact_case=True),
)

PAIR_COLUMNS = (
    "record_a", "record_b", "source_a", "source_b", "state", "name_score", "geo_score", "address_score",
    "naics_score", "confidence_score", "match_type", "status", "pair_count",
)


def linkable(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records with one inspection per establishment."""
    raw = X.derive(spark, sf, X.RAW_RECORDS)
    place = [F.upper("raw_name"), F.upper("raw_city"), F.upper("raw_state")]
    osha = raw.filter("source = 'osha'")
    latest = dedup.latest_per_key(osha, place, F.col("osha_inspection_date"), [F.col("id")])
    return raw.filter("source <> 'osha'").unionByName(latest)


def match_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.match(linkable(spark, sf)).pairs.select(*PAIR_COLUMNS)


def match_all_inspections(spark: SparkSession, sf: str) -> DataFrame:
    """All raw records, repeated inspections included: equal ones are folded and counted."""
    return linkage.match(X.derive(spark, sf, X.RAW_RECORDS)).pairs.select(*PAIR_COLUMNS)


def match_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    raw = linkable(spark, sf)
    return linkage.match_classes(linkage.match(raw).pairs, linkage.compared_pairs(linkage.prepared(raw)))


def match_by_sources(spark: SparkSession, sf: str) -> DataFrame:
    pairs = linkage.match(linkable(spark, sf)).pairs
    first, second = F.least("source_a", "source_b"), F.greatest("source_a", "source_b")
    return pairs.groupBy(first.alias("source_1"), second.alias("source_2"), "status").agg(
        F.sum("pair_count").alias("pairs"), F.max("confidence_score").alias("best")
    )


def block_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.block_sizes(linkage.prepared(linkable(spark, sf)))


def registry_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = linkage.prepared(linkable(spark, sf))
    return linkage.registry_pairs(rows).select("record_a", "record_b", "state", "confidence_score", "match_type")


def registry_pairs_any_state(spark: SparkSession, sf: str) -> DataFrame:
    config = MatchConfig(registry_cross_state=True)
    rows = linkage.prepared(linkable(spark, sf), config)
    return linkage.registry_pairs(rows, config).select("record_a", "record_b", "confidence_score")


def incremental_match(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the records first, the other half as a later batch: the pairs of one full run."""
    raw = linkable(spark, sf)
    later = F.substring("id", 2, 8).cast("bigint") % 2 == 1
    earlier, fresh = raw.filter(~later), raw.filter(later)
    both = linkage.match(earlier).pairs.unionByName(match_new(fresh, earlier).pairs)
    return both.select("record_a", "record_b", "confidence_score", "status")


def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    found = linkage.match(linkable(spark, sf))
    return components.connected_components(linkage.link_edges(found))


def hub_components(spark: SparkSession, sf: str) -> DataFrame:
    """A graph with heavy hubs: orders hang on their customer, customers on their nation."""
    customers = X.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    orders = X.table(spark, sf, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    return components.connected_components(customers.unionByName(orders))


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    raw = linkable(spark, sf)
    return raw, components.connected_components(linkage.link_edges(linkage.match(raw)))


GOLDEN_COLUMNS = (
    "unit", "name", "company_name", "address", "city", "state", "zip", "latitude", "longitude", "primary_naics",
    "primary_naics_description", "epa_registry_id", "parent_company_from_tri", "source_count", "confidence",
)


def field_survivorship(spark: SparkSession, sf: str) -> DataFrame:
    raw, clusters = _clusters(spark, sf)
    rows = golden.golden_rows(raw.join(clusters, "id"), "component")
    return rows.select(*GOLDEN_COLUMNS, F.array_join("sources", ",").alias("sources"))


def merged(spark: SparkSession, sf: str) -> golden.Merged:
    raw, clusters = _clusters(spark, sf)
    return golden.merge(raw, clusters)


def golden_facilities(spark: SparkSession, sf: str) -> DataFrame:
    rows = merged(spark, sf).facilities
    return rows.select(
        "name", "city", "state", "epa_registry_id", "source_count", "confidence",
        F.array_join("sources", ",").alias("sources"),
    )


def lineage_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records per golden row, told apart by the smallest record of the row."""
    edges = merged(spark, sf).lineage
    first = edges.groupBy("facility_id").agg(F.min("raw_record_id").alias("first_record"))
    return edges.join(first, "facility_id").select(
        "first_record", "raw_record_id", "source", "source_record_id",
        F.array_join("fields_provided", ",").alias("fields"),
    )


def candidate_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs by whether both records went into one golden row."""
    raw = linkable(spark, sf)
    found = linkage.match(raw)
    nodes = components.connected_components(linkage.link_edges(found))
    tagged = golden.tag_candidates(found.pairs, golden.merge(raw, nodes).lineage)
    return tagged.groupBy("status", F.col("facility_id").isNotNull().alias("tagged")).agg(F.count("*").alias("pairs"))


def merge_again(spark: SparkSession, sf: str) -> DataFrame:
    """A second merge into the golden table of the first: nothing new is created."""
    raw, clusters = _clusters(spark, sf)
    first = golden.merge(raw, clusters)
    second = golden.merge(raw, clusters, existing=first.facilities)
    return second.facilities.agg(
        F.count("*").alias("facilities"),
        second.created.agg(F.count("*").alias("n")).scalar().alias("created"),
        first.facilities.agg(F.count("*").alias("n")).scalar().alias("before"),
    )


def merge_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """A second run whose clusters each span two golden rows of the first, told apart by registry id."""
    raw = X.derive(spark, sf, X.RAW_RECORDS).filter("source = 'epa_echo' and registry_id is not null")
    first = golden.merge(raw, spark.createDataFrame([], "id string, component string"))
    number = F.col("source_record_id").cast("long")
    tied = raw.select("id", F.concat(F.lit("b"), (number - number % 4).cast("string")).alias("component"))
    second = golden.merge(raw, tied, first.facilities, (), first.lineage)
    owner = second.lineage.select(F.col("facility_id").alias("id")).distinct()
    return second.facilities.agg(
        F.count("*").alias("facilities"),
        first.facilities.agg(F.count("*").alias("n")).scalar().alias("before"),
        second.redirects.agg(F.count("*").alias("n")).scalar().alias("redirected"),
        second.facilities.join(owner, "id", "left_anti").agg(F.count("*").alias("n")).scalar().alias("without_lineage"),
        second.redirects.join(owner, F.col("new_id") == F.col("id"), "left_anti").agg(F.count("*").alias("n")).scalar().alias("dangling"),
    )


def candidate_records(spark: SparkSession, sf: str) -> DataFrame:
    """Record pairs behind the folded candidates of all inspections."""
    pairs = linkage.expand(linkage.match(X.derive(spark, sf, X.RAW_RECORDS)))
    return pairs.select(
        F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b"),
        "confidence_score", "match_type", "status",
    )


#: Rows of a file of the stream, about.
STREAM_FILE_ROWS = 100_000


def stream_match_merge(spark: SparkSession, sf: str) -> DataFrame:
    """All inspections in five micro-batches, so that copies fall into different ones: the record pairs behind the
    stored folds, and whether merged pairs ended in one golden row."""
    raw = cut_lineage(X.derive(spark, sf, X.RAW_RECORDS), "stream-raw")
    folder = f"{shared_folder(spark).rstrip('/')}/stream-match-{uuid.uuid4().hex}"
    # A micro-batch takes as many files as each of the five parts has; no part is written by one task alone.
    files = max(1, -(-raw.count() // (5 * STREAM_FILE_ROWS)))
    for i in range(5):
        raw.filter(F.pmod(F.crc32("id"), F.lit(5)) == i).repartition(files).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    match_stream(stream, f"{folder}/state", f"{folder}/progress", buckets=8).awaitTermination()
    pairs, members = (spark.read.parquet(f"{folder}/state/{name}") for name in ("pairs", "members"))
    edges = current_state(spark, f"{folder}/state", "lineage").select("raw_record_id", "facility_id")
    tagged = linkage.expand(linkage.Candidates(pairs, members), ("batch",)).select(
        F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b"), "confidence_score", "status"
    )
    for which in "ab":
        tagged = tagged.join(edges.select(F.col("raw_record_id").alias(f"record_{which}"), F.col("facility_id").alias(f"in_{which}")), f"record_{which}", "left")
    together = F.when(F.col("status") == "auto_matched", F.coalesce(F.col("in_a") == F.col("in_b"), F.lit(False)))
    return tagged.select("record_a", "record_b", "confidence_score", "status", together.alias("together"))


def full_run(spark: SparkSession, sf: str) -> DataFrame:
    """Sources to enriched golden rows: match, merge, companies, sectors, staff, confidence."""
    raw = X.derive(spark, sf, X.RAW_RECORDS)
    done = jobs.enrich(jobs.run_sources([linkable(spark, sf), raw.filter("source = 'manual'")]))
    return done.facilities.select(
        "name", "company_name", "city", "state", "epa_registry_id", "source_count",
        F.col("employee_count").cast("string").alias("employee_count"), "confidence",
    )


_CANDIDATES = O.candidates_cte()


def _components_sql(rows: str = "linkable") -> str:
    return f"""{O.candidates_cte(rows)}, edges as (
  select record_a as s, record_b as d from candidates where status = 'auto_matched'
  union select record_b, record_a from candidates where status = 'auto_matched'),
reach as (select s as id, s as other from edges union select r.id, e.d from reach r join edges e on e.s = r.other),
components as (select id, min(other) as component from reach group by id)"""


_COMPONENTS = _components_sql()


def _best(raw: str, field: str, out: str) -> str:
    rank = "case source " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(K.FIELD_PRIORITY[field])) + " else 999 end"
    return f"(array_agg({raw} order by {rank}, id) filter (where nullif({raw}, '') is not null))[1] as {out}"


def _golden_sql(unit_rows: str) -> str:
    parts = ",\n".join(
        _best(raw, field, out) for out, raw, field in golden.SURVIVING if raw != "raw_county"
    )
    tri = O.normalize_company("parent_company_from_tri", ())
    return f"""built as (select unit, {parts},
  (array_agg(registry_id order by id) filter (where registry_id is not null))[1] as epa_registry_id,
  (array_agg(tri_parent_company_name order by id) filter (where source = 'epa_tri'))[1] as parent_company_from_tri,
  array_to_string(list_sort(list(distinct source)), ',') as sources, count(distinct source) as source_count, count(*) as records
  from {unit_rows} group by unit),
golden as (select unit, coalesce(nullif({O.strip(O.collapse('best_name'))}, ''), 'Unknown Facility') as name,
  {tri} as company_name, address, city, state, zip, latitude, longitude, primary_naics,
  {O.lookup(K.SUBSECTORS, 'left(primary_naics, 3)')} as primary_naics_description, epa_registry_id, parent_company_from_tri,
  cast(source_count as int) as source_count, sources,
  cast(least(100, 30 + case when source_count >= 3 then 30 when source_count >= 2 then 20 else 0 end
    + case when latitude is not null then 20 else 0 end
    + case when records >= 3 then 20 when records >= 2 then 10 else 0 end) as int) as confidence
  from built)"""


_SURVIVORSHIP = f"""with recursive {_COMPONENTS}, unit_rows as (
  select component as unit, l.* from linkable l join components using (id)),
{_golden_sql('unit_rows')}"""

# Clusters first, one golden row per natural key; then single records, which join a golden row by
# registry id, else by name, city and state, or open one per natural key.
def _merge_sql(rows: str = "linkable") -> str:
    return f"""with recursive {_components_sql(rows)}, unit_rows as (
  select coalesce(component, id) as unit, component is not null as clustered, l.* from {rows} l left join components using (id)),
{_golden_sql('unit_rows')}, unit as (
  select g.*, u.clustered, coalesce('registry ' || epa_registry_id, 'name ' || name || '|' || coalesce(city, '') || '|' || coalesce(state, '')) as nk,
    name || '|' || coalesce(city, '') || '|' || coalesce(state, '') as nkey,
    sha256('facility' || chr(31) || g.unit) as fid
  from golden g join (select distinct unit, clustered from unit_rows) u on u.unit = g.unit),
c_links as (select unit, first_value(unit) over (partition by nk order by source_count desc, confidence desc, fid) as keeper
  from unit where clustered),
c_golden as (select k.keeper as unit, max(u.source_count) as n, max(u.confidence) as c
  from c_links k join unit u on u.unit = k.unit group by k.keeper),
c_rows as (select u.* exclude (source_count, confidence), g.n as source_count, g.c as confidence
  from c_golden g join unit u on u.unit = g.unit),
by_reg as (select epa_registry_id as r, arg_min(unit, (-source_count, -confidence, fid)) as keeper from c_rows
  where epa_registry_id is not null group by 1),
by_name as (select nkey as k, arg_min(unit, (-source_count, -confidence, fid)) as keeper from c_rows group by 1),
s_probe as (select u.unit, u.nk, u.source_count, u.confidence, u.fid, coalesce(r.keeper, n.keeper) as hit from unit u
  left join by_reg r on r.r = u.epa_registry_id left join by_name n on n.k = u.nkey where not u.clustered),
s_links as (select unit, hit as keeper from s_probe where hit is not null union all
  select unit, first_value(unit) over (partition by nk order by source_count desc, confidence desc, fid) from s_probe where hit is null),
links as (select * from c_links union all select * from s_links),
edges_out as (select k.keeper, r.id as raw_record_id, r.* exclude (id) from unit_rows r join links k using (unit)),
single_touched as (select distinct keeper from s_links),
recount as (select keeper, count(distinct source) as n, array_to_string(list_sort(list(distinct source)), ',') as srcs
  from edges_out where keeper in (select keeper from single_touched) group by keeper),
final as (select u.unit, u.name, u.city, u.state, u.epa_registry_id,
  cast(coalesce(rc.n, g.n) as int) as source_count, cast(g.c as int) as confidence, coalesce(rc.srcs, u.sources) as sources
  from (select keeper, max(source_count) as n, max(confidence) as c from links join unit using (unit) group by keeper) g
  join unit u on u.unit = g.keeper left join recount rc on rc.keeper = g.keeper)"""


_MERGE = _merge_sql()

FIELDS_SQL = "array_to_string(list_filter([" + ", ".join(
    f"case when {c} is not null and cast({c} as varchar) not in ('', '0') then '{label}' end"
    for c, label in (
        ("raw_name", "name"), ("raw_address", "address"), ("raw_city", "city"), ("raw_state", "state"),
        ("raw_zip", "zip"), ("raw_latitude", "latitude"), ("raw_longitude", "longitude"),
        ("raw_naics_code", "naics"), ("tri_parent_company_name", "company"), ("osha_employee_count", "employees"),
    )
) + "], lambda f: f is not null), ',')"

QUERIES = {
    "match_candidates": (
        match_candidates, f"with {_CANDIDATES} select {', '.join(PAIR_COLUMNS)} from candidates"),
    "match_all_inspections": (
        match_all_inspections,
        f"with {O.candidates_cte('raw_records')} select {', '.join(PAIR_COLUMNS)} from candidates"),
    "match_class_counts": (
        match_class_counts,
        f"""with {_CANDIDATES} select (select count(*) from scored) as compared,
        count(*) filter (where status = 'auto_matched') as auto, count(*) filter (where status = 'pending') as queued,
        (select count(*) from scored) - count(*) as no_match from candidates"""),
    "match_by_sources": (
        match_by_sources,
        f"""with {_CANDIDATES} select least(source_a, source_b) as source_1, greatest(source_a, source_b) as source_2,
        status, count(*) as pairs, max(confidence_score) as best from candidates group by 1, 2, 3"""),
    "block_sizes": (
        block_sizes,
        f"""with {O.prepared_cte()}, keys as (
        select id, source, state, upper(state) || '-' || area as block from prepared where state is not null union all
        select id, source, state, 'reg-' || registry_id from prepared where state is not null and registry_id is not null)
        select a.state, a.block, count(*) as records, (select count(*) from keys x join keys y on x.state = y.state
          and x.block = y.block and x.id < y.id and x.source <> y.source
          where x.state = a.state and x.block = a.block) as cross_source_pairs from keys a group by a.state, a.block"""),
    "registry_pairs": (
        registry_pairs,
        f"""with {O.linkable_cte()}, listed as materialized (
          select id, source, raw_state as state, registry_id from linkable where registry_id is not null and raw_state is not null)
        select a.id as record_a, b.id as record_b, a.state, 99 as confidence_score,
        'frs_id' as match_type from listed a join listed b on a.state = b.state and a.registry_id = b.registry_id
        and a.id < b.id and a.source <> b.source"""),
    "registry_pairs_any_state": (
        registry_pairs_any_state,
        f"""with {O.prepared_cte()} select a.id as record_a, b.id as record_b, 99 as confidence_score
        from prepared a join prepared b on a.registry_id = b.registry_id and a.id < b.id and a.source <> b.source"""),
    "incremental_match": (
        incremental_match, f"with {_CANDIDATES} select record_a, record_b, confidence_score, status from candidates"),
    "connected_components": (connected_components, f"with recursive {_COMPONENTS} select id, component from components"),
    "hub_components": (
        hub_components,
        """with c as (select 'c' || c_custkey as id, c_nationkey as n from customer), first as (select n, min(id) as component from c group by 1)
        select id, component from c join first using (n) union all select 'n' || n, component from first union all
        select 'o' || o_orderkey, component from orders join c on c.id = 'c' || o_custkey join first using (n)"""),
    "field_survivorship": (
        field_survivorship, f"{_SURVIVORSHIP} select {', '.join(GOLDEN_COLUMNS)}, sources from golden"),
    "golden_facilities": (
        golden_facilities,
        f"{_MERGE} select name, city, state, epa_registry_id, source_count, confidence, sources from final"),
    "lineage_edges": (
        lineage_edges,
        f"""{_MERGE} select min(raw_record_id) over (partition by keeper) as first_record, raw_record_id, source,
        source_record_id, {FIELDS_SQL} as fields from edges_out"""),
    "candidate_tags": (
        candidate_tags, f"with {_CANDIDATES} select status, true as tagged, count(*) as pairs from candidates group by 1"),
    "merge_again": (
        merge_again,
        f"{_MERGE} select count(*) as facilities, 0 as created, count(*) as before from final"),
    "merge_bridge": (
        merge_bridge,
        f"""with {O.raw_cte()}, r as (select cast(source_record_id as bigint) as k from raw_records where source = 'epa_echo' and registry_id is not null)
        select count(distinct k - k % 4) as facilities, count(*) as before, count(*) - count(distinct k - k % 4) as redirected,
        0 as without_lineage, 0 as dangling from r"""),
    "candidate_records": (
        candidate_records,
        f"""with {O.candidates_cte('raw_records')} select a_id as record_a, b_id as record_b,
        case when registered then 99 else composite end as confidence_score,
        case when registered then 'frs_id' else 'geo_name' end as match_type,
        case when registered or composite >= 90 then 'auto_matched' else 'pending' end as status
        from scored where registered or composite >= 60"""),
    "stream_match_merge": (
        stream_match_merge,
        f"""with {O.candidates_cte('raw_records')} select a_id as record_a, b_id as record_b,
        case when registered then 99 else composite end as confidence_score,
        case when registered or composite >= 90 then 'auto_matched' else 'pending' end as status,
        case when registered or composite >= 90 then true end as together
        from scored where registered or composite >= 60"""),
    "full_run": (
        full_run,
        f"""{_merge_sql('distinct_linkable')}, staff as (select keeper, arg_max(osha_employee_count, (osha_inspection_date, -row)) as n from (
          select *, row_number() over (order by raw_record_id) as row from edges_out where osha_employee_count > 0) group by keeper)
        select f.name, u.company_name, f.city, f.state, f.epa_registry_id, f.source_count, cast(s.n as varchar) as employee_count,
        cast(least(100, 30 + case when f.source_count >= 3 then 30 when f.source_count >= 2 then 20 else 0 end
          + case when u.latitude is not null then 20 else 0 end + case when u.company_name is not null then 10 else 0 end
          + case when s.n > 0 then 10 else 0 end) as int) as confidence
        from final f join unit u on u.unit = f.unit left join staff s on s.keeper = f.unit"""),
}
