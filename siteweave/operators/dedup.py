"""One row per key, survivors of duplicates, and re-linking to them.

Survivors are picked by rank with a limit that runs before the shuffle too: it
leaves one row per key and task, so a key with a third of all rows is no heavier
than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first in ``order`` (ascending; make it total).

    Spark turns the rank's limit into one that also runs before the shuffle, so a
    key costs one row per task. The keys' hash goes first: rows are sorted by a number, and texts only compared where it is the same.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    rank = F.row_number().over(Window.partitionBy(F.xxhash64(*named), *named).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").select(*df.columns)


def descending(c: Column) -> Column:
    """Order part for numbers: larger first, nulls last."""
    return F.coalesce(-c.cast("double"), F.lit(float("inf")))


def latest_per_key(
    df: DataFrame, keys: Sequence[str | Column], latest: Column, tie: Sequence[Column]
) -> DataFrame:
    """The row with the largest ``latest`` of each key; ties go to the first by ``tie``, nulls come last."""
    return first_per_key(df, keys, [latest.desc_nulls_last(), *tie])


def best_first() -> list[Column]:
    """Which golden row stays: more sources, more confidence, then the smaller id."""
    return [descending(F.col("source_count")), descending(F.col("confidence")), F.col("id")]


def registry_duplicates(facilities: DataFrame) -> DataFrame:
    """Number of rows beyond the best one of their registry id."""
    groups = facilities.filter("epa_registry_id is not null").groupBy("epa_registry_id").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def registry_survivors(facilities: DataFrame) -> DataFrame:
    newest = descending(F.unix_micros("created_at")) if "created_at" in facilities.columns else F.lit(0)
    order = [descending(F.col("source_count")), descending(F.col("confidence")), newest, F.col("id")]
    rows = facilities.filter("epa_registry_id is not null")
    slim = rows.select(*[c for c in ("id", "epa_registry_id", "source_count", "confidence", "created_at")
                         if c in rows.columns])
    return first_per_key(slim, ["epa_registry_id"], order).select("epa_registry_id", "id")


def name_key() -> list[Column]:
    return [F.col("name"), F.coalesce("city", F.lit("")), F.coalesce("state", F.lit(""))]


def name_duplicates(facilities: DataFrame) -> DataFrame:
    groups = facilities.groupBy(*name_key()).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def name_survivors(facilities: DataFrame) -> DataFrame:
    """(id, survivor): every golden row and the one that stays of its name, city and state."""
    key = [c.alias(f"k{i}") for i, c in enumerate(name_key())]
    slim = facilities.select("id", "source_count", "confidence", *key)
    best = slim.groupBy("k0", "k1", "k2").agg(
        F.min_by("id", F.struct(*best_first())).alias("survivor"), F.count("*").alias("n")
    )
    # Rows without duplicates need no second look: they survive as they are.
    return slim.join(best, ["k0", "k1", "k2"]).select("id", "survivor", "n")


def dedup_raw(raw: DataFrame) -> DataFrame:
    """Smallest id per (source, source_record_id); rows without a record id all stay."""
    keyed = raw.filter("source_record_id is not null")
    kept = first_per_key(keyed, ["source", "source_record_id"], [F.col("id")])
    return kept.unionByName(raw.filter("source_record_id is null"))


def relink(rows: DataFrame, survivors: DataFrame, column: str = "facility_id") -> DataFrame:
    """Moves references from dropped golden rows to their survivors."""
    moved = survivors.filter("id <> survivor").select(F.col("id").alias(column), "survivor")
    return (
        rows.join(moved, column, "left")
        .withColumn(column, F.coalesce("survivor", column))
        .select(*rows.columns)
    )


def source_counts(lineage: DataFrame) -> DataFrame:
    """Distinct sources of each golden row, counted and listed from its lineage."""
    return lineage.groupBy("facility_id").agg(
        F.countDistinct("source").cast("int").alias("source_count"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def dedup_facilities(
    facilities: DataFrame, raw: DataFrame, lineage: DataFrame, companies: DataFrame
) -> dict[str, DataFrame]:
    """Drops same-name golden rows, moves their records and lineage, recounts sources and companies.

    Companies left without a golden row are dropped.
    """
    survivors = name_survivors(facilities)
    kept = facilities.join(survivors.filter("id = survivor").select("id"), "id", "left_semi")
    moved = relink(lineage, survivors).dropDuplicates(["facility_id", "raw_record_id"])
    counted = recount_sources(kept, moved)
    return {
        "facilities": counted,
        "raw_records": relink(raw, survivors),
        "facility_sources": moved,
        "companies": recount_companies(companies, counted).filter("facility_count > 0"),
    }


def recount_sources(facilities: DataFrame, lineage: DataFrame) -> DataFrame:
    counts = source_counts(lineage).select(
        F.col("facility_id").alias("id"), F.col("source_count").alias("_n"), F.col("sources").alias("_sources")
    )
    listed = F.to_json("_sources") if dict(facilities.dtypes)["sources"] == "string" else F.col("_sources")
    return (
        facilities.join(counts, "id", "left")
        .withColumn("source_count", F.coalesce("_n", "source_count"))
        .withColumn("sources", F.coalesce(listed, F.col("sources")))
        .select(*facilities.columns)
    )


def recount_companies(
    companies: DataFrame, facilities: DataFrame, zero: bool = True, verify: bool = False
) -> DataFrame:
    """Golden rows per company. ``zero`` resets unlinked companies, ``verify`` marks linked ones."""
    counts = facilities.filter("company_id is not null").groupBy("company_id").agg(F.count("*").alias("_n"))
    joined = companies.join(counts, companies["id"] == counts["company_id"], "left").drop("company_id")
    fallback = F.lit(0) if zero else F.col("facility_count")
    out = joined.withColumn("facility_count", F.coalesce("_n", fallback))
    if verify:
        out = out.withColumn("status", F.when(F.col("_n") > 0, "verified").otherwise(F.col("status")))
    return out.select(*companies.columns)


def missing_from(rows: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose ``column`` is not among ``keys`` (nulls on either side never match)."""
    known = keys.select(F.col(key).alias(column)).filter(F.col(column).isNotNull()).distinct()
    return rows.join(known, column, "left_anti")


def present_in(rows: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    return rows.join(keys.select(F.col(key).alias(column)), column, "left_semi")

