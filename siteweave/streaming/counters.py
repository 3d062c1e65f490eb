"""Breakdowns that are kept by what changes: counts, sums and exact distinct counts of groups.

A batch gives the rows that it takes away (as they were) and the rows that it adds (as they are). Only their groups
are looked up and written anew, so the work follows the batch. Distinct counts stay exact, as each
value of a group has a counter of its own: the group's number of values changes when one leaves or reaches zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.session import cut_lineage
from siteweave.streaming.shelf import SEPARATOR, Shelf

NUMBERS = T.MapType(T.StringType(), T.LongType())
COUNTERS = T.StructType([
    T.StructField("part", T.ArrayType(T.StringType())), T.StructField("n", T.LongType()),
    T.StructField("distinct", NUMBERS), T.StructField("total", NUMBERS),
])


@dataclass(frozen=True)
class Breakdown:
    """Rows by the columns ``by``, with the distinct values of some columns and the sums of whole numbers; nulls form a group, but count as no value."""

    name: str
    by: tuple[str, ...]
    distinct: tuple[str, ...] = ()
    total: tuple[str, ...] = ()


def _key(*parts: Column) -> Column:
    """One text for several values that may be null."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts])


def _mapped(names: Sequence[str], value) -> Column:
    pairs = [x for name in names for x in (F.lit(name), value(name))]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast(NUMBERS)


def _number(column: str, name: str) -> Column:
    return F.coalesce(F.try_element_at(column, F.lit(name)), F.lit(0).cast("bigint"))


def changed(shelf: Shelf, breakdowns: Sequence[Breakdown], taken: DataFrame | None, added: DataFrame | None, batch: int) -> None:
    """Writes the counters that change as the shelf's layer of the batch. Rows that did not change may be in both."""
    signed = [rows.withColumn("_by", F.lit(by).cast("bigint")) for rows, by in ((taken, -1), (added, 1)) if rows is not None]
    rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    columns = {c for b in breakdowns for c in (*b.by, *b.distinct, *b.total)}
    # Equal rows cancel out before anything is looked up.
    slim = rows.groupBy(*sorted(columns)).agg(F.sum("_by").alias("_by")).filter("_by <> 0")
    slim = cut_lineage(slim, "counter-changes")
    layer = None
    for b in breakdowns:
        for one in _of(shelf, b, slim, batch):
            layer = one if layer is None else layer.unionByName(one)
    shelf.write(layer, batch)


def _of(shelf: Shelf, b: Breakdown, rows: DataFrame, batch: int) -> list[DataFrame]:
    none = F.create_map().cast(NUMBERS)
    group = _key(*map(F.col, b.by))
    found, moves = [], None
    for column in b.distinct:
        kind = f"{b.name}:{column}"
        values = rows.filter(F.col(column).isNotNull()).groupBy(group.alias("of"), _key(*map(F.col, b.by), F.col(column)).alias("key"))
        values = values.agg(F.sum("_by").alias("by")).filter("by <> 0")
        old = shelf.find(kind, values.select("key"), batch, latest=True).select("key", F.col("n").alias("old"))
        both = values.join(old, "key", "left").withColumn("old", F.coalesce("old", F.lit(0))).withColumn("n", F.col("old") + F.col("by"))
        both = cut_lineage(both, "counter-values")
        found.append(both.select(F.lit(kind).alias("kind"), "key", F.array().cast("array<string>").alias("part"), "n", none.alias("distinct"), none.alias("total")))
        move = both.groupBy("of").agg(F.sum((F.col("n") > 0).cast("bigint") - (F.col("old") > 0).cast("bigint")).alias("move"))
        move = move.select(F.col("of").alias("key"), F.lit(column).alias("column"), "move")
        moves = move if moves is None else moves.unionByName(move)
    sums = [F.sum(F.col("_by") * F.coalesce(F.col(c).cast("bigint"), F.lit(0))).alias(f"_sum_{i}") for i, c in enumerate(b.total)]
    parts = F.first(F.array(*[F.col(c).cast("string") for c in b.by]).cast("array<string>")).alias("own")
    groups = rows.groupBy(group.alias("key")).agg(F.sum("_by").alias("by"), parts, *sums)
    if moves is not None:
        by_group = moves.groupBy("key").agg(*[F.sum(F.when(F.col("column") == c, F.col("move"))).alias(f"_move_{i}") for i, c in enumerate(b.distinct)])
        groups = groups.join(by_group, "key", "left")
    old = shelf.find(b.name, groups.select("key"), batch, latest=True)
    new = groups.join(old, "key", "left").select(
        F.lit(b.name).alias("kind"),
        "key",
        F.coalesce("part", "own").alias("part"),
        (F.coalesce("n", F.lit(0)) + F.col("by")).alias("n"),
        _mapped(b.distinct, lambda c: _number("distinct", c) + F.coalesce(f"_move_{b.distinct.index(c)}", F.lit(0))).alias("distinct"),
        _mapped(b.total, lambda c: _number("total", c) + F.col(f"_sum_{b.total.index(c)}")).alias("total"),
    )
    return [*found, new]


def current(shelf: Shelf, b: Breakdown) -> DataFrame:
    """The groups that have rows, as a recount of all rows would give them: (*by as text, n, distinct_<column>, total_<column>)."""
    rows = shelf.all(b.name, latest=True).filter("n > 0")
    return rows.select(
        *[F.element_at("part", i + 1).alias(c) for i, c in enumerate(b.by)],
        "n",
        *[_number("distinct", c).alias(f"distinct_{c}") for c in b.distinct],
        *[_number("total", c).alias(f"total_{c}") for c in b.total],
    )
