"""Curated files and reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave import schemas as S
from siteweave.functions.company import Rules, normalize_company
from siteweave.functions.text import blank_to_null, starts, state_seed, strip
from siteweave.operators.companies import company_id, company_rows
from siteweave.operators.dedup import missing_from
from siteweave.sources.common import SEQ, any_of, finish, read_csv


def seed_rows(rows: DataFrame) -> DataFrame:
    company, text = blank_to_null(F.col("Company")), blank_to_null(F.col("Description"))
    return rows.filter(company.isNotNull() & (company != "Company") & text.isNotNull())


def seed_records(rows: DataFrame, run_id: str | None = None) -> DataFrame:
    kept = seed_rows(rows)
    return finish(
        kept.select(
            starts(F.concat_ws("_", F.lit("seed"), "Company", "Description"), 200).alias("source_record_id"),
            F.col("Description").alias("raw_name"),
            blank_to_null(F.col("Address")).alias("raw_address"),
            blank_to_null(F.col("City")).alias("raw_city"),
            state_seed(F.col("State")).alias("raw_state"),
            blank_to_null(F.col("LAT")).alias("raw_latitude"),
            blank_to_null(F.col("LONG")).alias("raw_longitude"),
            F.col("Company").alias("tri_parent_company_name"),
        ),
        "manual",
        run_id,
    )


def seed_golden(rows: DataFrame, rules: Rules = (), run_id: str | None = None) -> dict[str, DataFrame]:
    """Raw, golden, company and lineage rows of a seed file, which skips matching."""
    raw = seed_records(rows, run_id)
    company = normalize_company(F.col("tri_parent_company_name"), rules)
    named = raw.withColumn("_company", company)
    placed = F.col("raw_latitude").isNotNull() & F.col("raw_longitude").isNotNull()
    facility = F.sha2(F.concat(F.lit("facility\x1f"), F.col("id")), 256)
    golden = named.select(
        facility.alias("id"),
        F.col("raw_name").alias("name"),
        F.when(F.col("_company").isNotNull(), company_id(F.col("_company"))).alias("company_id"),
        F.coalesce("_company", "tri_parent_company_name").alias("company_name"),
        F.col("raw_address").alias("address"),
        F.col("raw_city").alias("city"),
        F.col("raw_state").alias("state"),
        F.col("raw_latitude").alias("latitude"),
        F.col("raw_longitude").alias("longitude"),
        F.lit(1).alias("source_count"),
        F.array(F.lit("manual")).alias("sources"),
        F.when(placed, 85).otherwise(60).alias("confidence"),
    )
    companies = named.filter("_company is not null").groupBy(F.col("_company").alias("name")).agg(
        F.count("*").alias("facility_count")
    ).select(company_id(F.col("name")).alias("id"), "name", F.lit("Manufacturing").alias("sector"), "facility_count")
    fields = ("name", "address", "city", "state", "latitude", "longitude", "companyName")
    lineage = raw.select(
        facility.alias("facility_id"),
        F.col("id").alias("raw_record_id"),
        "source",
        "source_record_id",
        F.array(*[F.lit(f) for f in fields]).alias("fields_provided"),
    )
    return {
        "raw_records": raw.withColumn("facility_id", facility),
        "facilities": golden,
        "companies": companies,
        "facility_sources": lineage,
    }


def read_seed(spark: SparkSession, path: str, rules: Rules = (), run_id: str | None = None) -> dict[str, DataFrame]:
    return seed_golden(read_csv(spark, path, S.SEED_CSV), rules, run_id)


def read_company_list(spark: SparkSession, path: str, companies: DataFrame, rules: Rules = ()) -> DataFrame:
    rows = read_csv(spark, path)
    listing = rows.select(
        *[any_of(rows, c).alias(c) for c in ("company_name", "industry", "primary_naics", "tx_factory_count")],
        F.col(SEQ).alias("ingest_seq"),
    )
    return company_rows(listing, companies, rules)


FACTORY_FIELDS = (
    ("factory_name", "raw_name"), ("address", "raw_address"), ("city", "raw_city"), ("state", "raw_state"),
    ("zip", "raw_zip"), ("county", "raw_county"), ("latitude", "raw_latitude"), ("longitude", "raw_longitude"),
    ("naics_code", "raw_naics_code"), ("sic_code", "raw_sic_code"), ("epa_registry_id", "registry_id"),
)


def factory_records(
    rows: DataFrame, known: DataFrame | None = None, state: str = "TX", run_id: str | None = None
) -> DataFrame:
    """Curated factories whose registry id is not among the state's curated records in ``known``."""
    read = rows.select(*[blank_to_null(strip(any_of(rows, f))).alias(raw) for f, raw in FACTORY_FIELDS])
    kept = read.filter("raw_name is not null").withColumn("raw_state", F.coalesce("raw_state", F.lit(state)))
    if known is not None:
        loaded = known.filter((F.col("source") == "manual") & (F.col("raw_state") == state))
        kept = missing_from(kept, loaded, "registry_id", "registry_id")
    return finish(kept.withColumn("source_record_id", F.col("registry_id")), "manual", run_id)


def read_factories(
    spark: SparkSession, path: str, known: DataFrame | None = None, state: str = "TX", run_id: str | None = None
) -> DataFrame:
    return factory_records(read_csv(spark, path), known, state, run_id)


def ticker_rows(pages: DataFrame) -> DataFrame:
    """Rows of a ticker list held as field names and an array of value arrays."""
    table = pages.select("fields", F.posexplode("data").alias("seq", "cells"))
    row = F.map_from_arrays("fields", "cells")
    return table.select(
        "seq",
        row["cik"].try_cast("bigint").alias("cik"),
        row["name"].alias("name"),
        row["ticker"].alias("ticker"),
        row["exchange"].alias("exchange"),
    )


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    return ticker_rows(spark.read.schema(S.TICKER_JSON).option("multiLine", True).json(path))


def crosswalk(rows: DataFrame) -> DataFrame:
    """Pairs of four-digit SIC and six-digit NAICS codes, all digits."""
    sic, naics = F.lpad(strip(F.col("sicCode")), 4, "0"), strip(F.col("naicsCode"))
    digits = sic.rlike(r"^\d+$") & naics.rlike(r"^\d+$")
    return rows.filter(digits).select(
        starts(sic, 4).alias("sic_code"), F.col("sicDesc").alias("sic_title"),
        starts(naics, 6).alias("naics_code"), F.col("naicsTitle").alias("naics_title"),
    )


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    return crosswalk(read_csv(spark, path))


def with_crosswalk_naics(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fills a missing industry code from the crosswalk, smallest code first."""
    one = pairs.groupBy(F.col("sic_code").alias("raw_sic_code")).agg(F.min("naics_code").alias("_naics"))
    return (
        raw.join(one, "raw_sic_code", "left")
        .withColumn("raw_naics_code", F.coalesce("raw_naics_code", "_naics"))
        .select(*raw.columns)
    )


def naics_codes(spark: SparkSession) -> DataFrame:
    """Code list with its hierarchy: sectors, subsectors, industry groups."""
    rows = [(c, f"Manufacturing ({c})", 2, None) for c in K.SECTOR_CODES]
    rows += [(c, title, 3, c[:2]) for c, title in K.SUBSECTORS]
    rows += [(c, title, 4, c[:3]) for c, title in K.INDUSTRY_GROUPS]
    return spark.createDataFrame(rows, "code string, title string, level int, parent_code string")
