"""Writing results: exports, ledgers, appends, versioned tables, edits and decisions.

A table is never overwritten while it is read: a change is a new version folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siteweave.functions.text import blank_to_null, leading_int, text_array

# --- exports ---------------------------------------------------------------------------------

# Export header and golden column.
FACTORY_COLUMNS = (
    ("company_name", "company_name"), ("facility_name", "name"), ("address", "address"), ("city", "city"),
    ("state", "state"), ("zip", "zip"), ("latitude", "latitude"), ("longitude", "longitude"),
    ("naics_code", "primary_naics"), ("naics_description", "primary_naics_description"),
    ("employee_count", "employee_count"), ("source_count", "source_count"), ("confidence", "confidence"),
    ("epa_registry_id", "epa_registry_id"),
)
EXPORT_ORDER = ("state", "city", "facility_name")


def factory_export(facilities: DataFrame, condition: Column) -> DataFrame:
    rows = facilities.filter(condition)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(out) for out, c in FACTORY_COLUMNS])


def company_export(companies: DataFrame, facilities: DataFrame) -> DataFrame:
    """Companies with golden rows, with their states joined into one text."""
    kept = companies.filter("facility_count > 0 and status <> 'rejected'")
    pairs = facilities.filter("company_id is not null and state is not null").select("company_id", "state").distinct()
    states = pairs.groupBy(F.col("company_id").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_list("state")), "; ").alias("states")
    )
    codes = F.col("naics_codes") if "naics_codes" in companies.columns else F.lit(None).cast("string")
    return kept.join(states, "id", "left").select(
        F.col("name").alias("company_name"),
        F.coalesce("sector", F.lit("")).alias("sector"),
        "facility_count",
        F.coalesce("states", F.lit("")).alias("states"),
        F.coalesce(codes, F.lit("")).alias("naics_codes"),
        "status",
    )


def write_sorted_csv(df: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """CSV files that follow each other in ``order``: ranges are sorted in parallel."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def export_ledger(rows: DataFrame, export_id: Column, filters: str) -> DataFrame:
    """One ledger row: what an export held."""
    return rows.agg(
        F.count("*").alias("facility_count"), F.countDistinct("company_id").alias("company_count")
    ).select(
        export_id.alias("export_id"), F.lit("completed").alias("status"), "facility_count", "company_count",
        F.lit(filters).alias("filters"),
    )


def mark_exported(facilities: DataFrame, condition: Column, at: Column) -> DataFrame:
    """Counts an export on every row it held and stamps its time."""
    hit = F.coalesce(condition, F.lit(False))
    has = "export_count" in facilities.columns
    count = F.coalesce("export_count", F.lit(0)) if has else F.lit(0)
    last = F.col("last_exported_at") if has else F.lit(None).cast("timestamp")
    return facilities.withColumns(
        {"export_count": F.when(hit, count + 1).otherwise(count), "last_exported_at": F.when(hit, at).otherwise(last)}
    )


# --- tables ----------------------------------------------------------------------------------


def append_raw(raw: DataFrame, path: str) -> None:
    raw.write.mode("append").partitionBy("source").parquet(path)


def insert_new(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the table yet, one per key."""
    fresh = rows.dropDuplicates(list(keys))
    return fresh.join(table.select(*keys).distinct(), list(keys), "left_anti")


def update_from(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Takes the non-null values of ``changes`` over, by key."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(new, key, "left")
    updated = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}
    return joined.withColumns(updated).select(*table.columns)


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.filter(~F.coalesce(condition, F.lit(False)))


def delete_unreferenced(table: DataFrame, references: DataFrame, key: str, column: str) -> DataFrame:
    """Keeps the rows that something refers to."""
    known = references.select(F.col(column).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return table.join(known, key, "left_semi")


def write_version(df: DataFrame, base: str, version: int) -> str:
    path = f"{base.rstrip('/')}/version={version:06d}"
    df.write.parquet(path)
    return path


def latest_version(spark: SparkSession, base: str) -> int | None:
    """Highest finished version; an interrupted write has no success marker and does not count."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    found = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(marker):
            found.append(int(name.removeprefix("version=")))
    return max(found, default=None)


def read_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/version={version:06d}")


def run_ledger(spark: SparkSession, run_id: str, source: str, status: str, counts: dict[str, int],
               errors: Sequence[str] = (), seconds: float = 0.0) -> DataFrame:
    """One ledger row of a run; its errors are rows of ``run_errors``."""
    row = (run_id, source, status, counts, len(errors), int(seconds * 1000))
    return spark.createDataFrame(
        [row], "id string, source string, status string, counts map<string,bigint>, error_count int, duration_ms bigint"
    ).withColumn("completed_at", F.current_timestamp())


def run_errors(spark: SparkSession, run_id: str, errors: Sequence[str]) -> DataFrame:
    """(run_id, seq, error): every error of a run."""
    return spark.createDataFrame([(run_id, i, e) for i, e in enumerate(errors)], "run_id string, seq int, error string")


def counted(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """The rows unchanged, and counters that fill while another action reads them."""
    seen = Observation()
    counters = [F.count_if(condition).alias(name) for name, condition in conditions.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counters), seen


# --- manual edits ----------------------------------------------------------------------------

# Editable golden column and the raw column that records it.
EDITABLE = (
    ("name", "raw_name"), ("address", "raw_address"), ("city", "raw_city"), ("state", "raw_state"),
    ("zip", "raw_zip"), ("primary_naics", "raw_naics_code"),
    ("primary_naics_description", "raw_naics_description"), ("latitude", "raw_latitude"),
    ("longitude", "raw_longitude"), ("company_name", "tri_parent_company_name"),
)


def edit_changes(facilities: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (edit_id, facility_id, values map) that change something, with the fields they change.

    A key present in ``values`` is an edit of that field; a blank value clears it.
    """
    entries = []
    for field, _ in EDITABLE:
        old = F.col(f"f.{field}").cast("string")
        new = F.try_element_at(F.col("e.values"), F.lit(field))
        changed = F.array_contains(F.map_keys("e.values"), field) & (
            F.coalesce(new, F.lit("")) != F.coalesce(old, F.lit(""))
        )
        entries.append(F.when(changed, F.struct(F.lit(field).alias("field"), old.alias("old"), blank_to_null(new).alias("new"))))
    staff = leading_int(F.try_element_at(F.col("e.values"), F.lit("employee_count"))).cast("string")
    old_staff = F.col("f.employee_count").cast("string")
    changed = F.array_contains(F.map_keys("e.values"), "employee_count") & ~staff.eqNullSafe(old_staff)
    entries.append(
        F.when(changed, F.struct(F.lit("employee_count").alias("field"), old_staff.alias("old"), staff.alias("new")))
    )
    joined = edits.alias("e").join(facilities.alias("f"), F.col("e.facility_id") == F.col("f.id"))
    return joined.select("e.edit_id", "e.facility_id", F.array_compact(F.array(*entries)).alias("changes")).filter(
        F.size("changes") > 0
    )


def apply_edits(facilities: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """Golden rows after the edits, with a raw record and a lineage edge per edit as audit trail.

    One edit per golden row and call; ``previous`` keeps the replaced values.
    """
    changes = edit_changes(facilities, edits)
    by_field = F.map_from_arrays(
        F.transform("changes", lambda c: c["field"]), F.transform("changes", lambda c: F.struct(c["new"].alias("v")))
    )
    keyed = changes.select("facility_id", "edit_id", "changes", by_field.alias("_new"))
    joined = facilities.join(keyed.withColumnRenamed("facility_id", "id"), "id", "left")

    def edited(field: str) -> Column:
        hit = F.try_element_at(F.col("_new"), F.lit(field))
        return F.when(hit.isNotNull(), hit["v"]).otherwise(F.col(field).cast("string"))

    kinds = dict(facilities.dtypes)
    touched = F.col("edit_id").isNotNull()
    listed = text_array(F.col("sources")) if kinds["sources"] == "string" else F.col("sources")
    grown = F.array_union(F.coalesce(listed, F.array().cast("array<string>")), F.array(F.lit("manual")))
    new_columns = {f: edited(f).cast(kinds[f]) for f in [*[f for f, _ in EDITABLE], "employee_count"] if f in kinds}
    new_columns["sources"] = F.when(touched, F.to_json(grown) if kinds["sources"] == "string" else grown).otherwise(F.col("sources"))
    is_new_source = touched & ~F.array_contains(F.coalesce(listed, F.array().cast("array<string>")), "manual")
    new_columns["source_count"] = F.when(is_new_source, F.size(grown)).otherwise(F.col("source_count"))
    golden = joined.select(*[new_columns[c].alias(c) if c in new_columns else F.col(c) for c in facilities.columns])

    record_id = F.concat(F.lit("manual_edit_"), "id", F.lit("_"), "edit_id")
    audit = joined.filter(touched).select(
        F.sha2(F.concat_ws("\x1f", F.lit("manual"), record_id), 256).alias("id"),
        F.lit("manual").alias("source"),
        record_id.alias("source_record_id"),
        *[F.coalesce(edited(f), F.col(f).cast("string")).alias(raw) for f, raw in EDITABLE if f in kinds],
        F.col("id").alias("facility_id"),
        F.transform("changes", lambda c: c["field"]).alias("edited_fields"),
        F.map_from_arrays(
            F.transform("changes", lambda c: c["field"]), F.transform("changes", lambda c: c["old"])
        ).alias("previous"),
    )
    lineage = audit.select(
        "facility_id", F.col("id").alias("raw_record_id"), "source", "source_record_id",
        F.col("edited_fields").alias("fields_provided"),
    )
    return {"facilities": golden, "raw_records": audit, "facility_sources": lineage}


def apply_company_edits(
    companies: DataFrame, facilities: DataFrame, edits: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Edits (id, name, sector, status; null leaves a value) on companies; a new name reaches their golden rows."""
    fields = ("name", "sector", "status")
    new = edits.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = companies.join(new, "id", "left")
    edited = joined.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).select(*companies.columns)
    renamed = joined.filter("_name is not null and _name <> name").select(
        F.col("id").alias("company_id"), F.col("_name").alias("_new_name")
    )
    moved = facilities.join(renamed, "company_id", "left").withColumn(
        "company_name", F.coalesce("_new_name", "company_name")
    )
    return edited, moved.select(*facilities.columns)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions (candidate_id, decision, at, seq) reduced to the latest per candidate."""
    row = F.max_by(F.struct("decision", "at"), F.struct("at", "seq"))
    return decisions.groupBy("candidate_id").agg(row.alias("_d")).select("candidate_id", "_d.decision", "_d.at")


def apply_decisions(candidates: DataFrame, decisions: DataFrame, pending_only: bool = True) -> DataFrame:
    """Review outcome per candidate; batch decisions only touch pending ones."""
    latest = latest_decisions(decisions).select(F.col("candidate_id").alias("id"), F.col("decision").alias("_decision"))
    status = F.when(F.col("_decision") == "confirm", "confirmed").when(F.col("_decision") == "reject", "rejected")
    may = (F.col("status") == "pending") if pending_only else F.lit(True)
    joined = candidates.join(latest, "id", "left")
    return joined.withColumn("status", F.when(may & status.isNotNull(), status).otherwise(F.col("status"))).select(
        *candidates.columns
    )


