"""Company table upkeep: upsert by name, linking, unlinking, sectors, tickers and staff counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions.company import Rules, clean_company, normalize_company, ticker_forms, with_company
from siteweave.functions.industry import sector_label
from siteweave.functions.predicates import is_garbage_company
from siteweave.functions.text import blank_to_null, merge_json_objects, starts
from siteweave.operators.dedup import latest_per_key, missing_from, recount_companies
from siteweave.session import cut_lineage


def company_id(name: Column) -> Column:
    return F.sha2(F.concat(F.lit("company\x1f"), name), 256)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, name string, sector string, status string, facility_count bigint")


def upsert_companies(companies: DataFrame, names: DataFrame, column: str = "company_name") -> DataFrame:
    """``companies`` plus a row for every new name."""
    wanted = names.select(F.col(column).alias("name")).filter("name is not null").distinct()
    fresh = missing_from(wanted, companies, "name", "name").select(
        company_id(F.col("name")).alias("id"),
        "name",
        F.lit(None).cast("string").alias("sector"),
        F.lit("unverified").alias("status"),
        F.lit(0).cast("bigint").alias("facility_count"),
    )
    return companies.unionByName(fresh, allowMissingColumns=True)


def link_by_name(facilities: DataFrame, companies: DataFrame) -> DataFrame:
    """Fills ``company_id`` of golden rows that carry a company name and no id yet."""
    ids = companies.groupBy(F.col("name").alias("company_name")).agg(F.min("id").alias("_cid"))
    current = F.col("company_id") if "company_id" in facilities.columns else F.lit(None).cast("string")
    columns = facilities.columns if "company_id" in facilities.columns else [*facilities.columns, "company_id"]
    return (
        facilities.join(ids, "company_name", "left")
        .withColumn("company_id", F.coalesce(current, "_cid"))
        .select(*columns)
    )


def relink(
    facilities: DataFrame, companies: DataFrame, rules: Rules = (), aggressive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Reads a company out of the names of unlinked golden rows and links it, creating companies as needed.

    Rows with a name but no id are linked too. One pass over all rows.
    """
    parent = "parent_company_from_tri" if aggressive and "parent_company_from_tri" in facilities.columns else None
    by = ["name", *([parent] if parent else [])]
    open_row = F.col("company_id").isNull() & F.col("company_name").isNull()
    # Names repeat; each is read once, and the reading is a table that both uses below share.
    names = facilities.filter(open_row).select(*by).distinct()
    found = cut_lineage(with_company(names, "_found", rules, name="name", parent=parent, aggressive=aggressive), "names")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by]
    read = facilities.alias("f").join(
        found.filter("_found is not null").alias("n"), reduce(and_, same), "left"
    ).select("f.*", "_found")
    named = read.withColumn("company_name", F.when(open_row, F.col("_found")).otherwise(F.col("company_name")))
    named = named.select(*facilities.columns)
    grown = upsert_companies(companies, named.filter("company_id is null"))
    return link_by_name(named, grown), grown


def unlink(facilities: DataFrame, condition: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return facilities.withColumns(
        {c: F.when(~hit, F.col(c)) for c in ("company_id", "company_name")}
    )


def drop_bad_companies(
    facilities: DataFrame, companies: DataFrame, names: tuple[str, ...] = K.UNLINK_NAMES
) -> tuple[DataFrame, DataFrame]:
    freed = unlink(facilities, F.col("company_name").isin(*names))
    kept = companies.filter(~F.col("name").isin(*names))
    return freed, recount_companies(kept, freed, zero=False)


def drop_garbage_companies(facilities: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unlinks and drops companies whose name says nothing; the list can be long, so it is joined."""
    garbage = companies.filter(is_garbage_company(F.col("name"))).select(F.col("id").alias("company_id"), F.lit(True).alias("_bad"))
    freed = unlink(facilities.join(garbage, "company_id", "left"), F.col("_bad")).select(*facilities.columns)
    return freed, companies.filter(~is_garbage_company(F.col("name")))


def sync_names(facilities: DataFrame, companies: DataFrame) -> DataFrame:
    """Copies the company's name to its golden rows."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("_name"))
    return (
        facilities.join(names, "company_id", "left")
        .withColumn("company_name", F.coalesce("_name", "company_name"))
        .select(*facilities.columns)
    )


def clear_state(facilities: DataFrame, code: str = "XF") -> DataFrame:
    return facilities.withColumn("state", F.when(~F.col("state").eqNullSafe(F.lit(code)), F.col("state")))


def top_prefix(facilities: DataFrame, min_length: int = 0) -> DataFrame:
    """(company_id, prefix, codes): the commonest three-digit prefix of each company and its codes."""
    coded = facilities.filter(F.col("company_id").isNotNull() & F.col("primary_naics").isNotNull()).filter(
        F.length("primary_naics") >= min_length
    )
    # One row per company and code first, so that collecting the few codes stays small.
    per_code = coded.groupBy("company_id", "primary_naics").agg(F.count("*").alias("n"))
    per_prefix = per_code.groupBy("company_id", starts(F.col("primary_naics"), 3).alias("prefix")).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_set("primary_naics")).alias("codes")
    )
    best = F.min_by(F.struct("prefix", "codes"), F.struct(-F.col("n"), F.col("prefix")))
    return per_prefix.groupBy("company_id").agg(best.alias("_top")).select("company_id", "_top.prefix", "_top.codes")


def assign_sectors(companies: DataFrame, facilities: DataFrame) -> DataFrame:
    """Gives companies without a sector the label of their commonest prefix, and its codes."""
    top = top_prefix(facilities).select(F.col("company_id").alias("id"), "prefix", "codes")
    joined = companies.join(top, "id", "left")
    fill = blank_to_null(F.col("sector")).isNull() & F.col("prefix").isNotNull()
    label = sector_label(F.col("prefix"), K.SECTOR_LABELS_ASSIGN)
    old_codes = F.col("naics_codes") if "naics_codes" in companies.columns else F.lit(None).cast("string")
    return joined.select(
        *[c for c in companies.columns if c not in ("sector", "naics_codes")],
        F.when(fill, label).otherwise(F.col("sector")).alias("sector"),
        F.when(fill, F.to_json("codes")).otherwise(old_codes).alias("naics_codes"),
    )


def refresh_sectors(companies: DataFrame, facilities: DataFrame) -> DataFrame:
    """Overwrites every linked company's sector with the label of its commonest prefix."""
    top = top_prefix(facilities, min_length=3).select(F.col("company_id").alias("id"), "prefix")
    label = F.when(F.col("prefix").isNotNull(), sector_label(F.col("prefix"), K.SECTOR_LABELS_REFRESH))
    return (
        companies.join(top, "id", "left").withColumn("sector", F.coalesce(label, "sector")).select(*companies.columns)
    )


def sector_distribution(companies: DataFrame, n: int = 25) -> DataFrame:
    counts = companies.filter("sector is not null").groupBy("sector").agg(F.count("*").alias("companies"))
    return counts.orderBy(F.desc("companies"), "sector").limit(n)


def propagate_employees(facilities: DataFrame, raw: DataFrame) -> DataFrame:
    """Staff count of the latest inspection, for golden rows that have none."""
    inspected = raw.filter(
        (F.col("source") == "osha") & (F.col("osha_employee_count") > 0) & F.col("facility_id").isNotNull()
    ).select("id", "facility_id", "osha_employee_count", "osha_inspection_date")
    latest = latest_per_key(inspected, ["facility_id"], F.col("osha_inspection_date"), [F.col("id")])
    found = latest.select(F.col("facility_id").alias("id"), F.col("osha_employee_count").alias("_staff"))
    empty = (F.coalesce(F.col("employee_count"), F.lit(0)) == 0) & F.col("_staff").isNotNull()
    return (
        facilities.join(found, "id", "left")
        .withColumn("employee_count", F.when(empty, F.col("_staff")).otherwise(F.col("employee_count")))
        .select(*facilities.columns)
    )


def match_tickers(companies: DataFrame, tickers: DataFrame, rules: Rules = ()) -> DataFrame:
    """(id, ticker, cik, exchange) of companies found in a ticker list.

    A listed name is known under three forms and the first listing keeps a form; a
    company tries four forms of its own name in turn.
    """
    listed = tickers.filter(
        blank_to_null(F.col("name")).isNotNull() & blank_to_null(F.col("ticker")).isNotNull()
    )
    listed_forms = _forms(
        listed,
        normalize_company(F.col("name"), rules),
        clean_company(F.col("name")),
        ticker_forms(F.col("name"), K.TICKER_STRIP_PATTERN),
    )
    entry = F.min_by(F.struct("ticker", "cik", "exchange"), F.struct("seq", "pos"))
    known = listed_forms.groupBy("form").agg(entry.alias("entry"))
    own_forms = _forms(
        companies.select("id", "name"),
        F.col("name"),
        normalize_company(F.col("name"), rules),
        clean_company(F.col("name")),
        ticker_forms(F.upper("name"), K.COMPANY_STRIP_PATTERN),
    )
    hits = own_forms.join(known, "form").groupBy("id").agg(F.min_by("entry", "pos").alias("entry"))
    return hits.select(
        "id", "entry.ticker", F.lpad(F.col("entry.cik").cast("string"), 10, "0").alias("cik"), "entry.exchange"
    )


def _forms(rows: DataFrame, *forms: Column) -> DataFrame:
    exploded = rows.select("*", F.posexplode(F.array(*forms)).alias("pos", "form"))
    return exploded.filter("form is not null and form <> ''")


def add_tickers(companies: DataFrame, found: DataFrame) -> DataFrame:
    """Merges the ticker into the JSON object of name variants; a company without an outside number takes its ``cik``."""
    extra = F.to_json(F.struct("ticker", "cik", "exchange"))
    hits = found.select("id", extra.alias("_extra"), F.col("cik").alias("_cik"))
    known = companies if "duns_number" in companies.columns else companies.withColumn("duns_number", F.lit(None).cast("string"))
    return (
        known.join(hits, "id", "left")
        .withColumn("duns_number", F.coalesce("duns_number", "_cik"))
        .withColumn(
            "name_variants",
            F.when(F.col("_extra").isNotNull(), merge_json_objects(F.col("name_variants"), F.col("_extra")))
            .otherwise(F.col("name_variants")),
        )
        .select(*known.columns)
    )


def company_rows(listing: DataFrame, companies: DataFrame, rules: Rules = ()) -> DataFrame:
    """New company rows from a list (company_name, industry, primary_naics, tx_factory_count, ingest_seq)."""
    named = listing.withColumn("name", normalize_company(F.col("company_name"), rules)).filter("name is not null")
    row = F.struct("industry", "primary_naics", "tx_factory_count")
    first = named.groupBy("name").agg(F.min_by(row, "ingest_seq").alias("r"))
    fresh = missing_from(first, companies, "name", "name")
    code = blank_to_null(F.col("r.primary_naics"))
    return fresh.select(
        company_id(F.col("name")).alias("id"),
        "name",
        blank_to_null(F.col("r.industry")).alias("sector"),
        F.when(code.isNotNull(), F.to_json(F.array(code))).alias("naics_codes"),
        F.coalesce(F.regexp_extract("r.tx_factory_count", r"^\s*(\d+)", 1).try_cast("bigint"), F.lit(0)).alias(
            "facility_count"
        ),
    )
