"""Explicit schemas. Codes and postal codes are text: inference would drop leading zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


RAW_RECORDS = T.StructType(
    [
        *_text("id", "source", "source_run_id", "source_record_id", "raw_name", "raw_address", "raw_city", "raw_state",
               "raw_zip", "raw_county", "raw_latitude", "raw_longitude", "raw_naics_code", "raw_naics_description",
               "raw_sic_code", "registry_id", "tri_parent_company_name", "tri_parent_duns", "tri_facility_id",
               "osha_activity_id"),
        T.StructField("osha_employee_count", T.IntegerType()),
        T.StructField("osha_inspection_date", T.TimestampType()),
        *_text("fsis_est_number", "fsis_activities", "fsis_size_category", "nhtsa_mfr_id"),
        T.StructField("nhtsa_vehicle_types", T.ArrayType(T.StringType())),
        *_text("census_county_fips"),
        T.StructField("census_establishment_count", T.LongType()),
        T.StructField("census_annual_payroll", T.LongType()),
        T.StructField("census_employees", T.LongType()),
        *_text("facility_id"),
    ]
)

ECHO_CSV = T.StructType(
    _text("REGISTRY_ID", "FAC_NAME", "FAC_STREET", "FAC_CITY", "FAC_STATE", "FAC_ZIP", "FAC_COUNTY", "FAC_LAT",
          "FAC_LONG", "FAC_NAICS_CODES", "FAC_SIC_CODES")
)

TRI_JSON = T.StructType(
    [
        *_text("tri_facility_id", "facility_name", "street_address", "city_name", "state_abbr", "zip_code",
               "county_name"),
        T.StructField("pref_latitude", T.DoubleType()),
        T.StructField("pref_longitude", T.DoubleType()),
        *_text("parent_co_name", "parent_co_db_num", "epa_registry_id"),
    ]
)

NHTSA_JSON = T.StructType(
    [
        T.StructField("Mfr_ID", T.LongType()),
        *_text("Mfr_Name", "Mfr_CommonName", "Country", "StateProvince", "City", "PostalCode", "Address", "Address2"),
        T.StructField(
            "VehicleTypes",
            T.ArrayType(T.StructType([T.StructField("IsPrimary", T.BooleanType()), *_text("Name")])),
        ),
    ]
)

SEED_CSV = T.StructType(_text("Company", "Description", "LAT", "LONG", "Address", "City", "State", "Country"))

TICKER_JSON = T.StructType(
    [
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("data", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)


def as_raw_records(rows: DataFrame) -> DataFrame:
    """Rows cast to the raw-record schema, absent columns null, id from source and record id."""
    present = set(rows.columns)
    out = []
    for field in RAW_RECORDS.fields:
        if field.name in present:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
    return rows.select(*out)
