"""Keyset pages, recent lists and samples. A page is a top-n, never an offset scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.text import cursor, parse_cursor

MAX_PAGE = 100


def keyset_page(
    df: DataFrame, value: str, key: str, limit: int, after: str | None = None, condition: Column | None = None
) -> DataFrame:
    """One page by ``value`` then ``key``, both descending, after a ``value:key`` cursor.

    The row carries its own cursor and ``has_more`` tells whether another page follows.
    A page of more than ``MAX_PAGE`` rows is refused; read the table instead.
    """
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"a page holds 1 to {MAX_PAGE} rows, not {limit}")
    size = limit
    rows = df if condition is None else df.filter(condition)
    if after:
        last_value, last_key = parse_cursor(after)
        below = F.struct(F.col(value).cast("bigint").alias("v"), F.col(key).alias("k"))
        rows = rows.filter(below < F.struct(F.lit(last_value).cast("bigint").alias("v"), F.lit(last_key).alias("k")))
    # One row beyond the page answers has_more; both sorts see at most size + 1 rows.
    top = rows.orderBy(F.desc_nulls_last(value), F.desc(key)).limit(size + 1)
    marked = top.withColumn("has_more", (F.count("*").over(_whole()) > size))
    page = marked.orderBy(F.desc_nulls_last(value), F.desc(key)).limit(size)
    return page.withColumn("cursor", cursor(F.col(value), F.col(key)))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def facility_page(facilities: DataFrame, condition: Column, limit: int = 50, after: str | None = None) -> DataFrame:
    return keyset_page(facilities, "confidence", "id", limit, after, condition)


def company_page(companies: DataFrame, condition: Column, limit: int = 50, after: str | None = None) -> DataFrame:
    return keyset_page(companies, "facility_count", "id", limit, after, condition)


def review_page(
    candidates: DataFrame, raw: DataFrame, status: str | None = None, limit: int = 20, after: str | None = None
) -> DataFrame:
    """A page of candidate pairs by score with both records side by side."""
    condition = F.lit(True) if status is None else F.col("status") == status
    page = keyset_page(candidates, "confidence_score", "id", limit, after, condition)
    shown = ("source", "raw_name", "raw_address", "raw_city", "raw_state", "raw_zip", "raw_naics_code", "registry_id")

    # The page names at most two records a row, so its ids go to the records and those come back: neither join moves the table.
    records = looked_up(page.select(F.explode(F.array("record_a", "record_b")).alias("id")), raw.select("id", *shown), "id")

    def side(which: str) -> DataFrame:
        return F.broadcast(
            records.select(
                F.col("id").alias(f"record_{which}"),
                *[F.col(c).alias(f"{which}_{c.removeprefix('raw_')}") for c in shown],
            )
        )

    return page.join(side("a"), "record_a", "left").join(side("b"), "record_b", "left")


def looked_up(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose unique ``key`` a page asks for. ``wanted`` is bounded by the page."""
    return table.join(F.broadcast(wanted.filter(F.col(key).isNotNull()).distinct()), key)


def most_recent(df: DataFrame, column: str, key: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), key).limit(n)


def random_sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows in an order drawn from a hash of ``key`` and ``seed``: the same rows however the table is partitioned."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
