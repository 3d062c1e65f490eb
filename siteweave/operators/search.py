"""Substring search by a trigram index.

Every text is stored under its trigrams in a shelf. A search reads the postings of the rarest
trigrams of its term, and only rows that hold all of these are compared with the term. Postings may
be older than the rows: what they name is always verified, and changed rows add new ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.operators.filters import like_any_case
from siteweave.streaming.shelf import BUCKETS, Shelf

POSTINGS = T.StructType([T.StructField("value", T.StringType())])
#: Trigrams of a term whose postings are read: the rarest ones.
READ = 3
#: Texts whose postings one task makes.
TEXTS_PER_TASK = 20_000
#: Postings that one task of a search meets.
POSTINGS_PER_TASK = 200_000


def literals(text: str) -> list[str]:
    """The parts of a search text between its wildcards, ``%`` and ``_``; a backslash takes the next one as it is."""
    parts, escaped = [""], False
    for c in text:
        if escaped:
            parts[-1] += c
            escaped = False
        elif c == "\\":
            escaped = True
        elif c in "%_":
            parts.append("")
        else:
            parts[-1] += c
    return [p for p in parts if p]


def term_trigrams(text: str) -> list[str]:
    """Trigrams that every text with this term must hold, in lower case. Only ASCII ones: there all rules of case agree."""
    found = {p.lower()[i : i + 3] for p in literals(text) if p.isascii() for i in range(len(p) - 2)}
    return sorted(found)


def trigrams(value: Column) -> Column:
    low = F.lower(value)
    places = F.sequence(F.lit(1), F.length(low) - 2)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3)))))


@dataclass(frozen=True)
class TextIndex:
    """Postings of some text columns under ``path``, by the rows' id."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @property
    def shelf(self) -> Shelf:
        return Shelf(self.spark, self.path, POSTINGS, self.buckets)

    def add(self, rows: DataFrame, columns: Sequence[str], batch: int, key: str = "id") -> None:
        """Stores the postings of new or changed rows as a layer of their own."""
        layer = None
        # Dealt by number: a small file of many texts would be exploded in few tasks, whose tables of postings grow with the file.
        texts = rows.select(F.col(key).cast("string").alias("_id"), *columns)
        texts = texts.repartition(max(1, -(-rows.count() // TEXTS_PER_TASK)))
        for c in columns:
            own = texts.select(F.lit(c).alias("kind"), F.explode(trigrams(F.col(c))).alias("key"), F.col("_id").alias("value")).distinct()
            counts = own.groupBy("key").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(f"{c}#").alias("kind"), "key", "value")
            both = own.unionByName(counts)
            layer = both if layer is None else layer.unionByName(both)
        self.shelf.write(layer, batch)

    def candidates(self, text: str, columns: Sequence[str], batch: int = 1 << 62) -> DataFrame | None:
        """(id) of the rows that may hold the term in one of the columns, each once; None if the term has no trigram."""
        wanted = term_trigrams(text)
        if not wanted:
            return None
        found = None
        for c in columns:
            counted = self.shelf.under(f"{c}#", wanted, batch).groupBy("key").agg(F.sum(F.col("value").cast("bigint")).alias("n"))
            sizes = {r["key"]: r["n"] for r in counted.collect()}
            if len(sizes) < len(wanted):
                continue  # no row holds one of them
            rarest = sorted(wanted, key=lambda t: (sizes[t], t))[:READ]
            tasks = -(-sum(sizes[t] for t in rarest) // POSTINGS_PER_TASK)
            held = self.shelf.under(c, rarest, batch).repartition(tasks, "value")
            ids = held.groupBy("value").agg(F.countDistinct("key").alias("n")).filter(F.col("n") == len(rarest)).select(F.col("value").alias("id"))
            found = ids if found is None else found.unionByName(ids)
        return self.spark.createDataFrame([], "id string") if found is None else found.distinct()


def search(rows: DataFrame | Shelf, index: TextIndex, text: str, columns: Sequence[str], batch: int = 1 << 62) -> DataFrame:
    """The rows that hold the term in one of the columns, as a scan with ``like_any_case`` finds them.

    ``rows`` may be a shelf of rows by id, of which then only the candidates' folders are read. Terms without
    a trigram are looked for in all rows.
    """
    holds = reduce(or_, [like_any_case(F.col(c), text) for c in columns])
    ids = index.candidates(text, columns, batch)
    if isinstance(rows, Shelf):
        some = rows.all("row", batch, latest=True) if ids is None else rows.find("row", ids.select(F.col("id").alias("key")), batch, latest=True)
        return some.drop("key").filter(holds)
    return rows.filter(holds) if ids is None else rows.join(ids, rows["id"].cast("string") == ids["id"], "left_semi").filter(holds)
