"""Data-quality counts over golden rows, raw records and companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import predicates as P
from siteweave.functions.confidence import confidence_bucket
from siteweave.functions.geo import validate_coordinates
from siteweave.functions.text import blank_to_null
from siteweave.operators.filters import in_listed_states


def linked_counts(facilities: DataFrame) -> DataFrame:
    has_id, has_name = F.col("company_id").isNotNull(), F.col("company_name").isNotNull()
    return facilities.agg(
        F.count("*").alias("total"),
        F.count_if(has_id).alias("linked"),
        F.count_if(~has_id).alias("unlinked"),
        F.count_if(has_name).alias("named"),
        F.count_if(has_name & ~has_id).alias("orphaned"),
        F.count_if(~has_name & ~has_id).alias("no_company"),
    )


def sector_presence(companies: DataFrame) -> DataFrame:
    filled = blank_to_null(F.col("sector")).isNotNull()
    return companies.agg(F.count_if(filled).alias("with_sector"), F.count_if(~filled).alias("without_sector"))


def confidence_distribution(facilities: DataFrame) -> DataFrame:
    return facilities.groupBy(confidence_bucket(F.col("confidence")).alias("bucket")).agg(
        F.count("*").alias("facilities")
    )


def average_confidence(facilities: DataFrame) -> DataFrame:
    return facilities.agg(F.round(F.avg("confidence"), 1).alias("average_confidence"))


def store_stats(facilities: DataFrame, companies: DataFrame, raw: DataFrame) -> DataFrame:
    linked = F.count_if(F.col("company_id").isNotNull())
    return facilities.agg(
        F.count("*").alias("facilities"),
        companies.agg(F.count("*").alias("n")).scalar().alias("companies"),
        raw.agg(F.count("*").alias("n")).scalar().alias("raw_records"),
        linked.alias("with_company"),
        F.count_if(F.col("company_id").isNull()).alias("without_company"),
        F.floor(linked / F.count("*") * 100 + F.lit(0.5)).alias("percent_with_company"),
        F.count_if(F.col("source_count") >= 2).alias("multi_source"),
    )


def top_unlinked(facilities: DataFrame, n: int = 30) -> DataFrame:
    rows = facilities.filter("company_id is null").select("id", "name", "city", "state", "source_count")
    return rows.orderBy(F.desc("source_count"), "name", "id").limit(n)


def top_sectors(companies: DataFrame, n: int = 10) -> DataFrame:
    counts = companies.filter("sector is not null").groupBy("sector").agg(F.count("*").alias("companies"))
    return counts.orderBy(F.desc("companies"), "sector").limit(n)


def ticker_count(companies: DataFrame) -> DataFrame:
    return companies.agg(F.count_if(F.col("name_variants").contains("ticker")).alias("with_ticker"))


def quality_summary(facilities: DataFrame, companies: DataFrame) -> DataFrame:
    specific = companies.agg(F.count_if(F.col("sector") != "Manufacturing").alias("n")).scalar()
    return facilities.agg(
        F.count("*").alias("facilities"),
        companies.agg(F.count("*").alias("n")).scalar().alias("companies"),
        F.count_if(F.col("company_id").isNotNull()).alias("linked"),
        F.count_if(F.col("company_id").isNull()).alias("unlinked"),
        F.round(F.avg("confidence")).cast("bigint").alias("average_confidence"),
        specific.alias("companies_with_sector"),
    )


def equipment_share(facilities: DataFrame, minimum: int = 10, n: int = 20) -> DataFrame:
    """Companies with the most golden rows that look like equipment."""
    counts = facilities.filter("company_name is not null").groupBy("company_name").agg(
        F.count("*").alias("total"),
        F.count_if(P.matches(F.col("name"), K.EQUIPMENT_SHARE_PATTERN)).alias("equipment_like"),
    )
    percent = F.floor(F.col("equipment_like") / F.col("total") * 100 + F.lit(0.5))
    rows = counts.filter(F.col("equipment_like") > minimum).withColumn("percent", percent)
    return rows.orderBy(F.desc("equipment_like"), "company_name").limit(n)


def equipment_counts(facilities: DataFrame) -> DataFrame:
    """All golden-row tests for equipment and infrastructure in one pass."""
    name, city = F.col("name"), F.col("city")
    return facilities.agg(
        F.count("*").alias("total"),
        F.count_if(P.matches(name, K.PORTABLE_PATTERN)).alias("portable"),
        F.count_if(P.matches(name, K.EQUIPMENT_WORDS_PATTERN)).alias("equipment_words"),
        F.count_if(P.matches(name, K.BROAD_EQUIPMENT_PATTERN)).alias("broad_equipment"),
        F.count_if(P.matches(name, K.INFRASTRUCTURE_PATTERN)).alias("infrastructure"),
        F.count_if(P.contains_any(name, K.OIL_GAS_PHRASES)).alias("oil_gas"),
        F.count_if(P.is_non_site_city(city)).alias("non_site_city"),
        F.count_if(P.is_cross_brand(name)).alias("cross_brand"),
        F.count_if(P.is_unit_registration(name, city)).alias("unit_registrations"),
    )


def raw_equipment_counts(raw: DataFrame, name: str = "raw_name") -> DataFrame:
    return raw.agg(
        F.count_if(P.matches(F.col(name), K.PORTABLE_PATTERN)).alias("portable"),
        F.count_if(P.matches(F.col(name), K.RAW_EQUIPMENT_PATTERN)).alias("equipment_words"),
    )


def equipment_by_company(facilities: DataFrame, companies: tuple[str, ...]) -> DataFrame:
    rows = facilities.filter(F.col("company_name").isin(*companies))
    equipment = P.looks_like_equipment(F.col("name"), F.col("city"))
    return rows.groupBy("company_name").agg(
        F.count_if(equipment).alias("equipment"), F.count_if(~equipment).alias("sites"), F.count("*").alias("total")
    )


def raw_records_per_facility(facilities: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw records behind each golden row, counted before the join."""
    counts = raw.filter("facility_id is not null").groupBy(F.col("facility_id").alias("id")).agg(
        F.count("*").alias("_n")
    )
    return facilities.join(counts, "id", "left").select(
        "id", "name", "source_count", F.coalesce("_n", F.lit(0)).alias("raw_count")
    )


def unlinked_classes(facilities: DataFrame) -> DataFrame:
    rows = facilities.filter("company_id is null")
    return rows.groupBy(P.unlinked_class(F.col("name")).alias("category")).agg(F.count("*").alias("facilities"))


def state_audit(facilities: DataFrame) -> DataFrame:
    rows = facilities.filter("state is not null").groupBy("state").agg(F.count("*").alias("facilities"))
    return rows.withColumn("listed", in_listed_states(F.col("state")))


def state_code_count(facilities: DataFrame) -> DataFrame:
    return facilities.agg(F.countDistinct("state").alias("states"))


def top_company_names(facilities: DataFrame, n: int = 25) -> DataFrame:
    counts = facilities.filter("company_name is not null").groupBy("company_name").agg(
        F.count("*").alias("facilities")
    )
    return counts.orderBy(F.desc("facilities"), "company_name").limit(n)


def coordinate_issues(raw: DataFrame) -> DataFrame:
    checked = validate_coordinates(F.col("raw_latitude"), F.col("raw_longitude"))
    return raw.groupBy("source", F.coalesce(checked["issue"], F.lit("valid")).alias("issue")).agg(
        F.count("*").alias("records")
    )
