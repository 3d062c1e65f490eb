"""Counts and roll-ups over golden rows, companies, raw records and census totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.operators.paging import looked_up
from siteweave.functions.industry import category_key, category_label
from siteweave.functions.text import blank_to_null, lookup, starts, text_array
from siteweave.operators.filters import ExportFilter, in_listed_states, same_city


def top_n(counts: DataFrame, by: str, n: int, *tie: str) -> DataFrame:
    return counts.orderBy(F.desc(by), *[F.asc_nulls_last(t) for t in tie]).limit(n)


def facility_count(facilities: DataFrame, condition: Column) -> DataFrame:
    return facilities.filter(condition).agg(F.count("*").alias("facility_count"))


def overview(facilities: DataFrame, companies: DataFrame, raw: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of totals; every table is reduced to its counts before they meet."""
    return facilities.agg(
        F.count("*").alias("total_facilities"),
        F.count_if(F.col("source_count") >= 2).alias("multi_source"),
        companies.agg(F.count("*").alias("n")).scalar().alias("total_companies"),
        raw.agg(F.count("*").alias("n")).scalar().alias("total_raw_records"),
        candidates.agg(F.count_if(F.col("status") == "pending").alias("n")).scalar().alias("pending_reviews"),
    )


def by_source(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source").agg(F.count("*").alias("records"))


def by_state(facilities: DataFrame) -> DataFrame:
    rows = facilities.filter(in_listed_states(F.col("state")))
    return rows.groupBy("state").agg(F.count("*").alias("facilities")).orderBy(F.desc("facilities"), "state")


def industries(facilities: DataFrame) -> DataFrame:
    rows = facilities.filter(blank_to_null(F.col("primary_naics")).isNotNull())
    return rows.groupBy(
        F.col("primary_naics").alias("code"), F.col("primary_naics_description").alias("description")
    ).agg(
        F.count("*").alias("facility_count"),
        F.countDistinct("company_id").alias("company_count"),
        starts(F.first("primary_naics"), 3).alias("subsector"),
    )


def manufacturing(facilities: DataFrame) -> DataFrame:
    return facilities.filter(starts(F.col("primary_naics"), 2).isin(*K.SECTOR_CODES))


def sectors_and_subsectors(facilities: DataFrame) -> DataFrame:
    """Two-digit and three-digit levels in one pass over grouping sets."""
    sector, subsector = starts(F.col("primary_naics"), 2), starts(F.col("primary_naics"), 3)
    rows = manufacturing(facilities).select(sector.alias("sector"), subsector.alias("subsector"), "company_id")
    level, two, three = F.grouping("subsector"), F.col("sector"), F.col("subsector")
    grouped = rows.groupingSets([[two], [three]], "sector", "subsector").agg(
        F.when(level == 1, 2).otherwise(3).alias("digits"),
        F.count("*").alias("facility_count"),
        F.countDistinct("company_id").alias("company_count"),
    )
    return grouped.select("digits", F.coalesce("subsector", "sector").alias("code"), "facility_count", "company_count")


def top_states_per_subsector(facilities: DataFrame, n: int = 5) -> DataFrame:
    counts = (
        facilities.filter("primary_naics is not null and state is not null")
        .groupBy(starts(F.col("primary_naics"), 3).alias("subsector"), "state")
        .agg(F.count("*").alias("facilities"))
    )
    # The window runs over counts: at most one row per subsector and state.
    order = Window.partitionBy("subsector").orderBy(F.desc("facilities"), "state")
    return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def _sector_categories() -> list[tuple[str, str]]:
    found = []
    for sector in K.SECTOR_CODES:
        key = next(key for key, _, prefixes in K.CATEGORIES if any(p.startswith(sector) for p in prefixes))
        if key not in ("aerospace", "automobiles"):
            found.append((sector, key))
    return found


def categories(facilities: DataFrame) -> DataFrame:
    """Roll-up to industry categories.

    ``company_count`` adds up the distinct companies of the codes below a category, so a
    company with two codes counts twice; ``distinct_companies`` counts it once. Code 336
    splits by its fourth digit, and all but 3364 of it is automobiles. A bare sector code
    goes to the first category below it, unless that is one of the two split ones.
    """
    code = F.col("primary_naics")
    transport = starts(code, 3) == "336"
    key = F.when(transport, F.when(starts(code, 4) == "3364", "aerospace").otherwise("automobiles")).otherwise(
        F.coalesce(category_key(starts(code, 3)), lookup(_sector_categories(), starts(code, 3)))
    )
    unit = F.when(transport, starts(code, 4)).otherwise(starts(code, 3))
    rows = manufacturing(facilities).select(key.alias("key"), unit.alias("unit"), "company_id").filter("key is not null")
    per_unit = rows.groupBy("key", "unit").agg(
        F.count("*").alias("n"), F.countDistinct("company_id").alias("companies")
    )
    added = per_unit.groupBy("key").agg(
        F.sum("n").alias("facility_count"), F.sum("companies").alias("company_count")
    )
    distinct = rows.groupBy("key").agg(F.countDistinct("company_id").alias("distinct_companies"))
    labels = F.create_map(*[F.lit(v) for key_, label, _ in K.CATEGORIES for v in (key_, label)])
    return added.join(distinct, "key").withColumn("label", F.try_element_at(labels, F.col("key")))


def coverage(facilities: DataFrame, census: DataFrame) -> DataFrame:
    """Census establishments against golden rows by state."""
    rows = census.filter("census_establishment_count is not null and raw_state is not null")
    totals = rows.groupBy(F.col("raw_state").alias("state")).agg(
        F.sum("census_establishment_count").cast("bigint").alias("census_establishments"),
        F.coalesce(F.sum("census_employees"), F.lit(0)).cast("bigint").alias("census_employees"),
        F.coalesce(F.sum("census_annual_payroll"), F.lit(0)).cast("bigint").alias("census_payroll"),
    )
    ours = facilities.filter("state is not null").groupBy("state").agg(F.count("*").alias("n"))
    theirs, own = F.col("census_establishments"), F.coalesce(F.col("n"), F.lit(0))
    ratio = F.when(theirs > 0, F.floor(own / theirs * 100 + F.lit(0.5))).otherwise(0)
    return totals.join(ours, "state", "left").select(
        "state",
        "census_establishments",
        "census_employees",
        "census_payroll",
        own.alias("our_facilities"),
        F.least(ratio, F.lit(999)).cast("bigint").alias("coverage_percent"),
        F.greatest(theirs - own, F.lit(0)).cast("bigint").alias("gap"),
    )


def coverage_summary(by_state_rows: DataFrame) -> DataFrame:
    theirs, ours = F.sum("census_establishments"), F.sum("our_facilities")
    return by_state_rows.agg(
        theirs.alias("census_establishments"),
        ours.alias("our_facilities"),
        F.when(theirs > 0, F.floor(ours / theirs * 100 + F.lit(0.5))).otherwise(0).cast("bigint").alias("overall_coverage"),
        F.sum("census_employees").alias("manufacturing_employees"),
    )


def coverage_bands(by_state_rows: DataFrame) -> DataFrame:
    percent = F.col("coverage_percent")
    band = F.when(percent >= 80, "good").when(percent >= 40, "partial").otherwise("low")
    return by_state_rows.groupBy(band.alias("band")).agg(F.count("*").alias("states"))


def company_status_counts(companies: DataFrame) -> DataFrame:
    statuses = ["unverified", "verified", "rejected"]
    return companies.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def review_status_counts(candidates: DataFrame) -> DataFrame:
    statuses = ["pending", "confirmed", "rejected"]
    return candidates.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def sources_of(facilities: DataFrame, *keys: str) -> DataFrame:
    """Golden rows per listed source; malformed lists are skipped."""
    rows = facilities.select(*keys, F.explode(text_array(F.col("sources"))).alias("source"))
    return rows.groupBy(*keys, "source").agg(F.count("*").alias("facilities"))


def company_states(facilities: DataFrame) -> DataFrame:
    rows = facilities.filter("company_id is not null and state is not null and state <> ''")
    return rows.groupBy("company_id", "state").agg(F.count("*").alias("facilities"))


def company_codes(facilities: DataFrame) -> DataFrame:
    rows = facilities.filter((F.col("company_id").isNotNull()) & blank_to_null(F.col("primary_naics")).isNotNull())
    return rows.groupBy("company_id", F.col("primary_naics").alias("code")).agg(
        F.min("primary_naics_description").alias("description"), F.count("*").alias("facilities")
    )


def company_categories(facilities: DataFrame) -> DataFrame:
    """Per company and category: golden rows and the codes behind them, largest first."""
    codes = company_codes(facilities).withColumn("category", category_label(F.col("code")))
    entry = F.struct((-F.col("facilities")).alias("order"), "code", "facilities")
    return codes.groupBy("company_id", "category").agg(
        F.sum("facilities").alias("facilities"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["code"]).alias("codes"),
    )


def with_shares(counts: DataFrame, by: str) -> DataFrame:
    """Share of the total and of the largest row."""
    total = counts.agg(F.sum(by).alias("n")).scalar()
    largest = counts.agg(F.max(by).alias("n")).scalar()
    return counts.withColumns({"share": F.col(by) / total, "share_of_largest": F.col(by) / largest})


# --- one state, one city ---------------------------------------------------------------------


def state_summary(facilities: DataFrame) -> DataFrame:
    """Totals of every listed state; filter by ``state`` for one."""
    rows = facilities.filter(in_listed_states(F.col("state")))
    names = F.create_map(*[F.lit(v) for pair in K.US_STATES for v in pair])
    return rows.groupBy("state").agg(
        F.count("*").alias("total_facilities"), F.countDistinct("company_id").alias("total_companies")
    ).withColumn("name", F.try_element_at(names, F.col("state")))


def top_codes(facilities: DataFrame, n: int = 15) -> DataFrame:
    rows = facilities.filter("primary_naics is not null")
    counts = rows.groupBy(
        F.col("primary_naics").alias("code"), F.col("primary_naics_description").alias("description")
    ).agg(F.count("*").alias("facilities"))
    return top_n(counts, "facilities", n, "code", "description")


def top_companies(facilities: DataFrame, companies: DataFrame, n: int = 20) -> DataFrame:
    """Counts per id first; names are joined to the few counted ids."""
    counts = facilities.filter("company_id is not null").groupBy(F.col("company_id").alias("id")).agg(
        F.count("*").alias("facilities")
    )
    return top_n(counts.join(companies.select("id", "name"), "id"), "facilities", n, "id")


def top_cities(facilities: DataFrame, n: int = 15) -> DataFrame:
    counts = facilities.filter("city is not null").groupBy("city").agg(
        F.count("*").alias("facilities"), F.countDistinct("company_id").alias("companies")
    )
    return top_n(counts, "facilities", n, "city")


def in_state(facilities: DataFrame, state: str) -> DataFrame:
    return facilities.filter(F.col("state") == state.upper())


def in_city(facilities: DataFrame, state: str, city: str) -> DataFrame:
    return in_state(facilities, state).filter(same_city(F.col("city"), city))


def city_summary(rows: DataFrame) -> DataFrame:
    """Totals of one city's rows; the smallest spelling stands for the city."""
    return rows.agg(
        F.min("city").alias("city"),
        F.min("state").alias("state"),
        F.count("*").alias("total_facilities"),
        F.countDistinct("company_id").alias("total_companies"),
    )


def city_sample(rows: DataFrame, companies: DataFrame, n: int = 20) -> DataFrame:
    shown = rows.select("id", "name", "company_id", "primary_naics", "primary_naics_description", "confidence")
    top = shown.orderBy(F.desc_nulls_last("confidence"), "id").limit(n)
    names = looked_up(top.select(F.col("company_id").alias("id")), companies.select("id", "name"), "id")
    return top.join(F.broadcast(names.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))), "company_id", "left")


#: Rows of a place's page by panel; None shows all.
PANELS = {"total": None, "codes": 15, "companies": 20, "sources": None, "cities": 15}


def place_panels(
    facilities: DataFrame, companies: DataFrame, by: Sequence[str] = ("state",), limits: dict[str, int | None] = PANELS
) -> DataFrame:
    """All panels of all places' pages from one scan: (*by, panel, rank, key, label, facilities, companies).

    Each golden row says what it adds to which panel. Counts per company are taken first, before the shuffle too, so
    that a place with a large part of all rows costs a row per task and entry, and distinct companies are a plain count.
    """
    null = F.lit(None).cast("string")

    def entry(panel: str, key: Column, label: Column, company: Column) -> Column:
        return F.struct(F.lit(panel).alias("panel"), key.alias("key"), label.alias("label"), company.alias("company"))

    company = F.col("company_id")
    source_list = F.from_json("sources", "array<string>") if dict(facilities.dtypes)["sources"] == "string" else F.col("sources")
    own = {
        "total": F.array(entry("total", null, null, company)),
        "codes": F.array(entry("codes", F.col("primary_naics"), F.col("primary_naics_description"), null)),
        "companies": F.array(entry("companies", company, null, null)),
        "sources": F.transform(F.coalesce(source_list, F.array().cast("array<string>")), lambda s: entry("sources", s, null, null)),
        "cities": F.array(entry("cities", F.col("city"), null, company)),
    }
    entries = F.flatten(F.array(*[own[panel] for panel in limits]))
    rows = facilities.select(*by, F.explode(entries).alias("e")).select(*by, "e.*").filter("key is not null or panel = 'total'")
    per_company = rows.groupBy(*by, "panel", "key", "label", "company").agg(F.count(F.lit(1)).alias("n"))
    counts = per_company.groupBy(*by, "panel", "key", "label").agg(F.sum("n").alias("facilities"), F.count("company").alias("companies"))
    names = companies.select(F.lit("companies").alias("panel"), F.col("id").alias("key"), "name")
    named = counts.join(names, ["panel", "key"], "left").filter("panel <> 'companies' or name is not null")
    order = Window.partitionBy(*by, "panel").orderBy(F.desc("facilities"), "key", F.col("label").asc_nulls_last())
    ranked = named.withColumn("rank", F.row_number().over(order))
    shown = F.lit(False)
    for panel, limit in limits.items():
        shown = shown | ((F.col("panel") == panel) & (F.lit(True) if limit is None else F.col("rank") <= limit))
    return ranked.filter(shown).select(*by, "panel", "rank", "key", F.coalesce("name", "label").alias("label"), "facilities", "companies")


# --- single rows, runs, exports --------------------------------------------------------------


def facility_detail(facilities: DataFrame, lineage: DataFrame, facility_id: str) -> DataFrame:
    """One golden row beside each of its lineage entries."""
    row = facilities.filter(F.col("id") == facility_id).withColumn("sources", text_array(F.col("sources")))
    links = lineage.filter(F.col("facility_id") == facility_id).select(
        F.col("facility_id").alias("id"), F.col("source").alias("link_source"), "raw_record_id", "source_record_id"
    )
    return row.join(links, "id", "left")


def source_summary(spark: SparkSession, raw: DataFrame, runs: DataFrame) -> DataFrame:
    """Every known source with its record count and latest run."""
    listed = spark.createDataFrame([(s,) for s in K.SOURCES], "source string")
    row = F.max_by(F.struct("id", "status", "started_at"), F.struct("started_at", "id"))
    latest = runs.groupBy("source").agg(row.alias("_run"))
    return (
        listed.join(by_source(raw), "source", "left")
        .join(latest, "source", "left")
        .select(
            "source",
            F.coalesce("records", F.lit(0)).alias("raw_record_count"),
            F.col("_run.id").alias("last_run_id"),
            F.col("_run.status").alias("last_run_status"),
            F.col("_run.started_at").alias("last_run_started_at"),
        )
    )


def export_preview(facilities: DataFrame, export: ExportFilter, min_facilities: int | None = None) -> DataFrame:
    """Rows, companies and states an export would hold; companies can need a minimum of rows."""
    rows = facilities.filter(export.for_preview())
    totals = [F.count("*").alias("facility_count"), F.countDistinct("state").alias("state_count")]
    if min_facilities and min_facilities > 1:
        sizes = rows.filter("company_id is not null").groupBy("company_id").agg(F.count("*").alias("n"))
        large = sizes.filter(F.col("n") >= min_facilities).agg(F.count("*").alias("n")).scalar()
        return rows.agg(*totals, large.alias("company_count"))
    return rows.agg(*totals, F.countDistinct("company_id").alias("company_count"))


def global_search(spark: SparkSession, facilities: DataFrame, companies: DataFrame, text: str) -> DataFrame:
    """Categories, then companies, then golden rows, in one shape with their rank."""
    from siteweave.operators.filters import CompanyFilter, FacilityFilter, category_search
    from siteweave.operators.paging import keyset_page

    def ranked(rows: DataFrame, *order: Column) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(*order)))

    found = category_search(spark, text).select(
        F.concat(F.lit("cat_"), "key").alias("id"),
        F.lit("categories").alias("type"),
        F.col("label").alias("name"),
        F.concat(F.lit("NAICS: "), F.size("prefixes")).alias("subtitle"),
        F.lit(None).cast("string").alias("meta"),
        "position",
    )
    first = ranked(found, F.col("position")).drop("position")
    page = keyset_page(companies, "facility_count", "id", 5, condition=CompanyFilter(search=text).condition())
    unit = F.when(F.col("facility_count") == 1, " factory").otherwise(" factories")
    second = ranked(
        page.select(
            "id",
            F.lit("companies").alias("type"),
            "name",
            F.coalesce(blank_to_null(F.col("sector")), F.lit("Manufacturing")).alias("subtitle"),
            F.concat(F.col("facility_count").cast("string"), unit).alias("meta"),
            "facility_count",
        ),
        F.desc("facility_count"), F.desc("id"),
    ).drop("facility_count")
    page = keyset_page(facilities, "confidence", "id", 8, condition=FacilityFilter(search=text).condition())
    place = F.concat_ws(", ", blank_to_null(F.col("city")), blank_to_null(F.col("state")))
    third = ranked(
        page.select(
            "id",
            F.lit("facilities").alias("type"),
            "name",
            F.col("company_name").alias("subtitle"),
            blank_to_null(place).alias("meta"),
            "confidence",
        ),
        F.desc("confidence"), F.desc("id"),
    ).drop("confidence")
    return first.unionByName(second).unionByName(third)
