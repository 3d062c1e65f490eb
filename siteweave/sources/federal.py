"""Federal source extracts to raw records.

Every source has a ``*_records`` transform over rows in the source's own layout and
a ``read_*`` that applies it to landed files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave import schemas as S
from siteweave.functions import industry as I
from siteweave.functions.predicates import is_address_stub
from siteweave.functions.text import blank_to_null, leading_int, lookup, starts, state_loose, strip
from siteweave.operators.dedup import first_per_key, latest_per_key
from siteweave.sources.common import SEQ, any_of, finish, read_csv, read_json

# --- ECHO ------------------------------------------------------------------------------------


def echo_kept(rows: DataFrame) -> DataFrame:
    codes = I.code_tokens(F.col("FAC_NAICS_CODES"))
    kept = F.exists(codes, lambda code: I.is_manufacturing_naics(code))
    return rows.filter(F.coalesce(kept, F.lit(False))).filter(~is_address_stub(F.col("FAC_NAME")))


def echo_records(rows: DataFrame, run_id: str | None = None) -> DataFrame:
    def filled(c: str) -> Column:
        return blank_to_null(F.col(c))

    kept = echo_kept(rows).select(
        filled("REGISTRY_ID").alias("source_record_id"),
        filled("FAC_NAME").alias("raw_name"),
        filled("FAC_STREET").alias("raw_address"),
        filled("FAC_CITY").alias("raw_city"),
        filled("FAC_STATE").alias("raw_state"),
        filled("FAC_ZIP").alias("raw_zip"),
        filled("FAC_COUNTY").alias("raw_county"),
        filled("FAC_LAT").alias("raw_latitude"),
        filled("FAC_LONG").alias("raw_longitude"),
        F.try_element_at(I.code_tokens(F.col("FAC_NAICS_CODES")), F.lit(1)).alias("raw_naics_code"),
        blank_to_null(F.split("FAC_SIC_CODES", r"[\s,]+")[0]).alias("raw_sic_code"),
        filled("REGISTRY_ID").alias("registry_id"),
    )
    return finish(kept, "epa_echo", run_id)


def read_echo(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    return echo_records(read_csv(spark, path, S.ECHO_CSV), run_id)


# --- TRI -------------------------------------------------------------------------------------


def tri_records(rows: DataFrame, run_id: str | None = None) -> DataFrame:
    """First row per facility id; longitudes reported as positive are turned west."""
    keyed = rows.filter(blank_to_null(F.col("tri_facility_id")).isNotNull())
    first = first_per_key(keyed, ["tri_facility_id"], [F.col(SEQ)])
    kept = first.filter(~is_address_stub(F.col("facility_name")))
    lng = F.col("pref_longitude")

    def filled(c: str) -> Column:
        return blank_to_null(F.col(c).cast("string"))

    return finish(
        kept.select(
            filled("tri_facility_id").alias("source_record_id"),
            filled("facility_name").alias("raw_name"),
            filled("street_address").alias("raw_address"),
            filled("city_name").alias("raw_city"),
            filled("state_abbr").alias("raw_state"),
            filled("zip_code").alias("raw_zip"),
            filled("county_name").alias("raw_county"),
            F.col("pref_latitude").cast("string").alias("raw_latitude"),
            F.when(lng > 60, -lng).otherwise(lng).cast("string").alias("raw_longitude"),
            filled("epa_registry_id").alias("registry_id"),
            filled("parent_co_name").alias("tri_parent_company_name"),
            filled("parent_co_db_num").alias("tri_parent_duns"),
            filled("tri_facility_id").alias("tri_facility_id"),
        ),
        "epa_tri",
        run_id,
    )


def read_tri(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    return tri_records(read_json(spark, path, S.TRI_JSON), run_id)


# --- OSHA ------------------------------------------------------------------------------------


def osha_rows(rows: DataFrame) -> DataFrame:
    """Inspection rows under one set of names, limited to manufacturing."""

    def field(lower: str, camel: str) -> Column:
        return strip(F.coalesce(any_of(rows, lower, lower.upper(), camel), F.lit("")))

    staff = leading_int(field("nr_in_estab", "NrInEstab"))
    named = rows.select(
        field("activity_nr", "ActivityNr").alias("activity"),
        field("estab_name", "EstabName").alias("name"),
        field("site_address", "SiteAddress").alias("address"),
        field("site_city", "SiteCity").alias("city"),
        field("site_state", "SiteState").alias("state"),
        starts(field("site_zip", "SiteZip"), 10).alias("zip"),
        starts(field("naics_code", "NaicsCode"), 6).alias("naics"),
        starts(field("sic_code", "SicCode"), 4).alias("sic"),
        F.when(staff > 0, staff).cast("int").alias("staff"),
        field("open_date", "OpenDate").alias("opened"),
        SEQ,
    )
    wanted = I.is_manufacturing_naics(F.col("naics")) | I.is_manufacturing_sic(F.col("sic"))
    return named.filter((F.col("name") != "") & (F.length("state") == 2) & wanted)


def osha_latest(rows: DataFrame) -> DataFrame:
    """The latest inspection of each name, city and state; the first row wins a tie."""
    place = [F.upper("name"), F.upper("city"), F.upper("state")]
    return latest_per_key(rows, place, F.col("opened"), [F.col(SEQ)])


def osha_records(rows: DataFrame, run_id: str | None = None) -> DataFrame:
    kept = osha_latest(osha_rows(rows)).filter(~is_address_stub(F.col("name")))
    activity = blank_to_null(F.col("activity"))
    made_up = F.concat(F.lit("osha_"), "name", F.lit("_"), "state", F.lit("_"), "city")
    return finish(
        kept.select(
            F.coalesce(activity, made_up).alias("source_record_id"),
            F.col("name").alias("raw_name"),
            blank_to_null(F.col("address")).alias("raw_address"),
            blank_to_null(F.col("city")).alias("raw_city"),
            F.col("state").alias("raw_state"),
            blank_to_null(F.col("zip")).alias("raw_zip"),
            F.coalesce(blank_to_null(F.col("naics")), I.sic_to_naics(F.col("sic"))).alias("raw_naics_code"),
            blank_to_null(F.col("sic")).alias("raw_sic_code"),
            activity.alias("osha_activity_id"),
            F.col("staff").alias("osha_employee_count"),
            F.col("opened").try_cast("timestamp").alias("osha_inspection_date"),
        ),
        "osha",
        run_id,
    )


def read_osha(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    return osha_records(read_csv(spark, path), run_id)


# --- FSIS ------------------------------------------------------------------------------------

# Header spellings by field, in the order they are tried.
FSIS_HEADERS = {
    "est": ("EstNumber", "Est Number", "EST_NUMBER", "Establishment Number", "est_number", "EstablishmentNumber",
            "M&PI Number"),
    "company": ("Company", "COMPANY", "company", "Establishment Name", "EstName", "Operator"),
    "dba": ("DBAName", "DBA Name", "DBA", "dba_name"),
    "street": ("Street", "STREET", "Address", "street"),
    "city": ("City", "CITY", "city"),
    "state": ("State", "STATE", "state", "St"),
    "zip": ("Zip", "ZIP", "Zip Code", "zip"),
    "activities": ("Activities", "ACTIVITIES", "activities", "Activity"),
    "size": ("Size", "SIZE", "size", "Size Range"),
}


def fsis_rows(rows: DataFrame) -> DataFrame:
    fields = [strip(F.coalesce(any_of(rows, *names), F.lit(""))).alias(f) for f, names in FSIS_HEADERS.items()]
    named = rows.select(*fields, SEQ).withColumns({"state": F.upper("state"), "zip": starts(F.col("zip"), 10)})
    return named.filter((F.col("est") != "") & (F.length("state") == 2))


def fsis_merged(rows: DataFrame) -> DataFrame:
    """First row per establishment, with the activities of the others added where they are new.

    Repeated activity texts are dropped before they are collected, so a list holds
    distinct texts only.
    """
    texts = rows.groupBy("est", "activities").agg(F.min(SEQ).alias("seq"))
    listed = texts.filter("activities <> ''").groupBy("est").agg(
        F.array_sort(F.collect_list(F.struct("seq", "activities"))).alias("_list")
    )
    joined = F.aggregate(
        F.col("_list"),
        F.lit(""),
        lambda text, entry: F.when(F.contains(text, entry["activities"]), text)
        .when(text == "", entry["activities"])
        .otherwise(F.concat_ws(", ", text, entry["activities"])),
    )
    first = first_per_key(rows, ["est"], [F.col(SEQ)]).drop("activities")
    return first.join(listed, "est", "left").withColumn("activities", F.coalesce(joined, F.lit(""))).drop("_list")


def fsis_records(rows: DataFrame, run_id: str | None = None) -> DataFrame:
    merged = fsis_merged(fsis_rows(rows))
    name = F.coalesce(blank_to_null(F.col("company")), blank_to_null(F.col("dba")))
    kept = merged.filter(~is_address_stub(name))
    return finish(
        kept.select(
            F.concat(F.lit("FSIS-"), "est").alias("source_record_id"),
            F.coalesce(name, F.concat(F.lit("FSIS Est. "), "est")).alias("raw_name"),
            blank_to_null(F.col("street")).alias("raw_address"),
            blank_to_null(F.col("city")).alias("raw_city"),
            F.col("state").alias("raw_state"),
            blank_to_null(F.col("zip")).alias("raw_zip"),
            I.activity_to_naics(F.col("activities")).alias("raw_naics_code"),
            F.lit("Food Manufacturing").alias("raw_naics_description"),
            F.col("est").alias("fsis_est_number"),
            blank_to_null(F.col("activities")).alias("fsis_activities"),
            I.size_category(F.col("size")).alias("fsis_size_category"),
        ),
        "usda_fsis",
        run_id,
    )


def read_fsis(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    return fsis_records(read_csv(spark, path), run_id)


# --- NHTSA -----------------------------------------------------------------------------------

# Spellings of the country kept.
US_COUNTRY_NAMES = ("", "UNITED STATES (USA)", "USA", "US", "UNITED STATES")


def nhtsa_kept(rows: DataFrame) -> DataFrame:
    country = F.upper(F.coalesce("Country", F.lit("")))
    named = F.coalesce(blank_to_null(F.col("Mfr_Name")), blank_to_null(F.col("Mfr_CommonName"))).isNotNull()
    return rows.filter(country.isin(*US_COUNTRY_NAMES) & named)


def nhtsa_records(listing: DataFrame, details: DataFrame | None = None, run_id: str | None = None) -> DataFrame:
    """A detail row replaces the list row of its manufacturer as a whole."""
    rows = nhtsa_kept(listing)
    if details is not None:
        fields = [c for c in rows.columns if c not in ("Mfr_ID", SEQ)]
        one = details.groupBy("Mfr_ID").agg(F.min_by(F.struct(*fields), SEQ).alias("_detail"))
        plain = F.struct(*fields)
        rows = rows.join(one, "Mfr_ID", "left").select("Mfr_ID", SEQ, F.coalesce("_detail", plain).alias("_r"))
        rows = nhtsa_kept(rows.select("Mfr_ID", SEQ, "_r.*"))
    first = first_per_key(rows, ["Mfr_ID"], [F.col(SEQ)])
    name = F.coalesce(blank_to_null(F.col("Mfr_CommonName")), blank_to_null(F.col("Mfr_Name")))
    types = F.transform(F.coalesce("VehicleTypes", F.array().cast("array<struct<IsPrimary:boolean,Name:string>>")),
                        lambda t: t["Name"])
    kept = first.filter(~is_address_stub(name))
    return finish(
        kept.select(
            F.concat(F.lit("nhtsa_"), F.col("Mfr_ID").cast("string")).alias("source_record_id"),
            name.alias("raw_name"),
            blank_to_null(
                F.concat_ws(", ", blank_to_null(F.col("Address")), blank_to_null(F.col("Address2")))
            ).alias("raw_address"),
            blank_to_null(F.col("City")).alias("raw_city"),
            state_loose(F.col("StateProvince")).alias("raw_state"),
            blank_to_null(F.col("PostalCode")).alias("raw_zip"),
            I.vehicle_types_to_naics(types).alias("raw_naics_code"),
            F.lit("Motor Vehicle Manufacturing").alias("raw_naics_description"),
            F.col("Mfr_ID").cast("string").alias("nhtsa_mfr_id"),
            F.when(F.size(types) > 0, types).alias("nhtsa_vehicle_types"),
        ),
        "nhtsa",
        run_id,
    )


def read_nhtsa(spark: SparkSession, list_path: str, detail_path: str | None = None, run_id: str | None = None) -> DataFrame:
    details = read_json(spark, detail_path, S.NHTSA_JSON) if detail_path else None
    return nhtsa_records(read_json(spark, list_path, S.NHTSA_JSON), details, run_id)


# --- census ----------------------------------------------------------------------------------


def census_rows(pages: DataFrame, text: str = "value") -> DataFrame:
    """Rows of pages that hold an array of arrays with a header row, as name-to-value maps."""
    table = pages.select(F.from_json(F.col(text), "array<array<string>>").alias("t")).filter(F.size("t") >= 2)
    body = table.select(F.col("t")[0].alias("header"), F.explode(F.slice("t", 2, 1 << 30)).alias("cells"))
    return body.select(F.map_from_arrays("header", "cells").alias("row"))


def census_number(c: Column) -> Column:
    """Suppressed and non-numeric values count as zero."""
    return F.coalesce(leading_int(F.regexp_replace(c, ",", "")), F.lit(0))


def census_records(pages: DataFrame, text: str = "value", run_id: str | None = None) -> DataFrame:
    rows = census_rows(pages, text)

    def cell(name: str) -> Column:
        return F.try_element_at(F.col("row"), F.lit(name))

    usable = cell("NAICS2017").isNotNull() & cell("ESTAB").isNotNull() & cell("county").isNotNull()
    state = lookup(K.FIPS_TO_STATE, cell("state"))
    code = F.coalesce(cell("NAICS2017"), F.lit("31-33"))
    fips = F.concat(cell("state"), cell("county"))
    read = rows.filter(usable & state.isNotNull()).select(
        F.concat(F.lit("cbp_"), fips, F.lit("_"), F.regexp_replace(code, "^([^-]*)-", "$1")).alias("source_record_id"),
        F.lit(None).cast("string").alias("raw_name"),
        F.lit(None).cast("string").alias("raw_address"),
        F.lit(None).cast("string").alias("raw_city"),
        state.alias("raw_state"),
        F.when(code == "31-33", "31").otherwise(starts(code, 6)).alias("raw_naics_code"),
        F.coalesce(cell("NAICS2017_LABEL"), F.lit("Manufacturing")).alias("raw_naics_description"),
        fips.alias("census_county_fips"),
        census_number(cell("ESTAB")).alias("census_establishment_count"),
        census_number(cell("PAYANN")).alias("census_annual_payroll"),
        census_number(cell("EMP")).alias("census_employees"),
    )
    return finish(read.filter("census_establishment_count <> 0"), "census_cbp", run_id)


def read_census(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """One page per file: a page is one state's answer."""
    return census_records(spark.read.text(path, wholetext=True), "value", run_id)
