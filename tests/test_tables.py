"""Golden rows, upserts, edits, exports, versions and streams."""

import csv
import glob
from itertools import combinations

from pyspark.sql import functions as F

from siteweave import fixtures as X
from siteweave.functions.scoring import MatchConfig
from siteweave.operators import breakdowns, components, dedup, golden, linkage, sinks
from siteweave.operators.filters import CompanyFilter, FacilityFilter, naics_prefixes
from siteweave.operators.paging import facility_page
from siteweave.plans import jobs
from siteweave.plans.linkage_queries import linkable
from siteweave.streaming import incremental

SF = "/root/testdata/sf0.001"


def clustered(spark):
    raw = linkable(spark, SF)
    return raw, components.connected_components(linkage.link_edges(linkage.match(raw)))


def test_merge_twice_creates_nothing(spark):
    raw, nodes = clustered(spark)
    first = golden.merge(raw, nodes)
    again = golden.merge(raw, nodes, existing=first.facilities)
    assert again.created.count() == 0
    assert again.facilities.count() == first.facilities.count()
    assert first.lineage.count() == raw.count()


def test_single_record_joins_by_registry_then_name(spark):
    schema = ("id string, source string, source_record_id string, raw_name string, raw_address string, raw_city string, raw_state string, "
              "raw_zip string, raw_latitude string, raw_longitude string, raw_naics_code string, registry_id string, tri_parent_company_name string, "
              "osha_employee_count int")
    def row(i, source, name, registry, city="Waco"):
        return (i, source, i, name, None, city, "TX", None, None, None, "332710", registry, None, None)
    raw = spark.createDataFrame([row("1", "epa_echo", "Acme", "R1"), row("2", "epa_tri", "Acme Two", "R1"),
                                 row("3", "osha", "Other", "R1"), row("4", "manual", "Acme", None), row("5", "manual", "Acme", None, "Ennis"),
                                 row("6", "osha", "acme", "R9"), row("7", "usda_fsis", None, None, None)], schema)
    nodes = spark.createDataFrame([("1", "1"), ("2", "1")], "id string, component string")
    merged = golden.merge(raw, nodes)
    owner = {r.raw_record_id: r.facility_id for r in merged.lineage.collect()}
    assert owner["1"] == owner["2"] == owner["3"] == owner["4"]
    assert len({owner[i] for i in "1567"}) == 4
    rows = {r.id: r for r in merged.facilities.collect()}
    assert (rows[owner["1"]].source_count, rows[owner["1"]].sources) == (4, ["epa_echo", "epa_tri", "manual", "osha"])
    assert rows[owner["7"]].name == "Unknown Facility"


def test_new_record_joins_the_row_of_its_match(spark):
    base = dict(raw_address="1 MAIN STREET", raw_city="WACO", raw_state="TX", raw_zip="77001", raw_latitude="30.0",
                raw_longitude="-97.0", raw_naics_code="332710", registry_id=None, tri_parent_company_name=None, osha_employee_count=None)
    schema = ("id string, source string, source_record_id string, raw_name string, raw_address string, raw_city string, raw_state string, "
              "raw_zip string, raw_latitude string, raw_longitude string, raw_naics_code string, registry_id string, tri_parent_company_name string, "
              "osha_employee_count int, osha_inspection_date timestamp")
    def frame(*rows):
        return spark.createDataFrame([{**base, "source_record_id": r["id"], "osha_inspection_date": None, **r} for r in rows], schema)
    old = frame(dict(id="1", source="epa_echo", raw_name="ACME BOLTS"), dict(id="2", source="osha", raw_name="FAR GEARS", raw_zip="99901"))
    first = jobs.match_and_merge(jobs.Store(old))
    assert first.facilities.count() == 2
    new = frame(dict(id="3", source="manual", raw_name="ACME BOLT"), dict(id="4", source="manual", raw_name="NEW SHOP", raw_zip="88801"))
    second = jobs.match_and_merge(jobs.Store(new, first.facilities, first.companies, first.facility_sources), earlier=old)
    owner = {r.raw_record_id: r.facility_id for r in second.facility_sources.collect()}
    assert owner["1"] == owner["3"] and len(set(owner.values())) == 3
    assert second.facilities.count() == 3


def test_confirmed_pairs_merge_on_request(spark):
    found = linkage.match(linkable(spark, SF))
    reviewed = linkage.Candidates(found.pairs.withColumn("status", F.regexp_replace("status", "pending", "confirmed")), found.members)
    plain = linkage.link_edges(reviewed).count()
    assert linkage.link_edges(reviewed, MatchConfig(merge_statuses=("auto_matched", "confirmed"))).count() > plain


def test_full_job(spark):
    raw = linkable(spark, SF)
    store = jobs.match_and_merge(jobs.Store(raw))
    enriched = jobs.enrich(store)
    linked = enriched.facilities.filter("company_id is not null")
    assert linked.count() > 0
    assert linked.join(enriched.companies, linked.company_id == enriched.companies.id, "left_anti").count() == 0
    assert enriched.companies.agg(F.sum("facility_count")).first()[0] == linked.count()
    rows = raw.filter("raw_state is not null").collect()
    area = lambda r: (r.raw_state, (r.raw_zip or "000")[:3])
    number = lambda r: r.registry_id is not None and (r.raw_state, r.registry_id)
    met = [a.source != b.source and (area(a) == area(b) or number(a) and number(a) == number(b)) for a, b in combinations(rows, 2)]
    assert store.counters["match"].first().compared == sum(map(bool, met))


def test_clean_up_dry_run(spark):
    store = jobs.Store(X.derive(spark, SF, X.RAW_RECORDS), X.derive(spark, SF, X.FACILITIES),
                       X.derive(spark, SF, X.COMPANIES).withColumn("name", F.when(F.col("name") == "Brand#3", "Na").otherwise(F.col("name"))))
    same, report = jobs.clean_up(store, dry_run=True)
    assert same is store and report.first().garbage_companies == 1


def test_dedup_drops_what_the_dry_run_counts(spark):
    facilities = X.derive(spark, SF, X.FACILITIES)
    drop = dedup.name_duplicates(facilities).first().duplicates
    kept = dedup.name_survivors(facilities).filter("id = survivor").count()
    assert kept == facilities.count() - drop


def test_filters_and_pages(spark):
    facilities = X.derive(spark, SF, X.FACILITIES)
    assert naics_prefixes("metals") == ("331", "332") and naics_prefixes("3327") == ("3327",)
    assert facilities.filter(FacilityFilter(search="metals").condition()).count() == facilities.filter("primary_naics like '33271%'").count()
    assert CompanyFilter(search="metals")
    seen, after = [], None
    while True:
        page = facility_page(facilities, F.lit(True), 60, after).collect()
        seen += [r.id for r in page]
        if not page or not page[0].has_more:
            break
        after = page[-1].cursor
    want = [r.id for r in facilities.orderBy(F.desc("confidence"), F.desc("id")).collect()]
    assert seen == want


def test_categories_of_bare_sector_codes(spark):
    rows = spark.createDataFrame([("31", "a"), ("32", "a"), ("33", "a"), ("336", "a"), ("3364", "a"), ("336411", "b")],
                                 "primary_naics string, company_id string")
    got = {r.key: (r.facility_count, r.company_count, r.distinct_companies) for r in breakdowns.categories(rows).collect()}
    assert got == {"organics": (1, 1, 1), "chemicals": (1, 1, 1), "automobiles": (1, 1, 1), "aerospace": (2, 2, 2)}


def test_sorted_csv(spark, tmp_path):
    facilities = X.derive(spark, SF, X.FACILITIES).withColumn("name", F.concat("name", F.lit(', "x"')))
    out = sinks.factory_export(facilities, F.lit(True))
    sinks.write_sorted_csv(out, str(tmp_path / "out"), sinks.EXPORT_ORDER)
    rows = []
    for path in sorted(glob.glob(str(tmp_path / "out/*.csv"))):
        with open(path, newline="") as handle:
            rows += list(csv.DictReader(handle))
    assert list(rows[0]) == [c for c, _ in sinks.FACTORY_COLUMNS]
    assert len(rows) == facilities.count() and rows[0]["facility_name"].endswith(', "x"')
    keys = [tuple(r[c] for c in sinks.EXPORT_ORDER) for r in rows]
    assert keys == sorted(keys)


def test_versions(spark, tmp_path):
    base = str(tmp_path / "table")
    assert sinks.latest_version(spark, base) is None
    sinks.write_version(spark.range(3), base, 1)
    sinks.write_version(spark.range(5), base, 2)
    (tmp_path / "table" / "version=000003").mkdir()  # an interrupted write
    assert sinks.latest_version(spark, base) == 2
    assert sinks.read_version(spark, base, 2).count() == 5


def test_append_and_ledger(spark, tmp_path):
    raw = X.derive(spark, SF, X.RAW_RECORDS)
    sinks.append_raw(raw, str(tmp_path / "raw"))
    sinks.append_raw(raw, str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    assert stored.count() == 2 * raw.count()
    assert dedup.dedup_raw(stored).count() == dedup.dedup_raw(raw).count()
    row = sinks.run_ledger(spark, "r1", "osha", "completed", {"parsed": 3}, [str(i) for i in range(150)], 1.5).first()
    assert (row.error_count, row.duration_ms, row.counts) == (150, 1500, {"parsed": 3})
    assert sinks.run_errors(spark, "r1", [str(i) for i in range(150)]).count() == 150


def test_counters_fill_during_the_write(spark, tmp_path):
    rows, seen = sinks.counted(X.derive(spark, SF, X.FACILITIES), linked=F.col("company_id").isNotNull())
    rows.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 200, "linked": 167}


def landing(spark, folder, parts=3):
    raw = linkable(spark, SF)
    for i in range(parts):
        raw.filter(F.crc32("id") % parts == i).coalesce(1).write.mode("append").parquet(folder)
    raw.limit(40).coalesce(1).write.mode("append").parquet(folder)  # a late repeat
    return raw


def test_stream_ingest_over_batches(spark, tmp_path):
    raw = landing(spark, str(tmp_path / "in"))
    def run():
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        incremental.ingest(stream, str(tmp_path / "table"), str(tmp_path / "progress")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "table"))
    first = run()
    assert first.select("batch").distinct().count() >= 3
    assert first.count() == raw.count() == first.select("source", "source_record_id").distinct().count()
    assert run().count() == raw.count()


def test_stream_match_and_merge(spark, tmp_path):
    """Batches give the record pairs of one run, copies in different batches included, and each golden row has lineage."""
    raw = X.derive(spark, SF, X.RAW_RECORDS)
    for i in range(2):
        raw.filter(F.crc32("id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    incremental.match_stream(stream, state, str(tmp_path / "progress")).awaitTermination()
    table = lambda name: spark.read.parquet(f"{state}/{name}")
    assert table("pairs").select("batch").distinct().count() == 2
    pairs = lambda *found: sorted(tuple(sorted((r.record_a, r.record_b))) for r in linkage.expand(*found).collect())
    assert pairs(linkage.Candidates(table("pairs"), table("members")), ("batch",)) == pairs(linkage.match(raw))
    lineage, facilities = (incremental.current_state(spark, state, name) for name in ("lineage", "facilities"))
    # The given table repeats a line, so two records share an id.
    assert lineage.count() == lineage.select("raw_record_id").distinct().count() == raw.select("id").distinct().count()
    assert {r.id for r in facilities.collect()} == {r.facility_id for r in lineage.collect()}
    assert [r.counts["records"] for r in table("ledger").orderBy("batch").collect()] == [r["count"] for r in table("records").groupBy("batch").count().orderBy("batch").collect()]
