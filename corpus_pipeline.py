"""The corpus pipeline: rejects poor documents, removes repeated lines, near-duplicates and benchmark leaks, and encodes the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm import bpe, leaks, lines, quality, similar, simhash
from siteweave.llm.common import hinted, table
from siteweave.operators.components import connected_components
from siteweave.session import cut_lineage

#: Keys that may be sent to all tasks (about 30 MB); more are joined by shuffling.
SENT_KEYS = 500_000


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts. Null and empty texts are scored like any others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand earlier; documents that lose all their words go, for others hold them.

    ``n_chars`` follows the text. Documents without words from the start stay as they are.
    """
    cleaned = lines.without_repeated_lines(docs)
    emptied = (F.col("lines_removed") > 0) & ~F.col("text").rlike(r"[^ \t\u000B\f\r\n]")
    kept = cleaned.filter(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group; null ids come first.

    Two documents are linked if their SimHash fingerprints differ in at most three bits, or if the exact join of five-word shingles, which
    follows, finds them alike. Groups are what both kinds of links connect. A document is known by its id and its text's hash; of rows equal in both, one stays.
    Texts are not shuffled to decide: only keys are, and the few that go are
    then taken out of the documents. Rows are kept whole in one column, so that
    other columns pass through whatever their names are.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    keyed = rows.select("row", F.struct("row.doc_id", F.xxhash64("row.text").alias("hash")).alias("key"), F.xxhash64("row").alias("mark"))
    texts = keyed.select("key", "row.text")
    hashed = simhash.near_duplicates(texts, id_col="key").select("key", "component_id")
    exact = similar.near_duplicates(texts, id_col="key").select("key", "component_id")
    links = hashed.unionByName(exact).filter("key <> component_id").select(F.col("key").alias("src"), F.col("component_id").alias("dst"))
    groups = connected_components(links).select(F.col("id").alias("key"), F.col("component").alias("component_id"))
    counted = keyed.groupBy("key").agg(F.min("mark").alias("least"), F.count(F.lit(1)).alias("n"))
    stays = F.col("key") == F.coalesce("component_id", "key")
    # Keys that are not simply kept: those of other group members, and those with several rows, of which the first returns.
    special = cut_lineage(
        counted.join(groups, "key", "left").filter(~(stays & (F.col("n") == 1))).select("key", F.when(stays, F.col("least")).alias("least")), "near-duplicates"
    )
    simple = keyed.join(hinted(special.select("key"), SENT_KEYS), "key", "left_anti")
    again = keyed.join(hinted(special.filter("least is not null"), SENT_KEYS), "key").filter(F.col("mark") == F.col("least"))
    return simple.select("row").unionByName(again.select("row").distinct()).select("row.*")


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document that is left."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", distinct_lines),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_leaks),
    ("bpe", encode),
]

#: Models, fingerprints and encodings are not expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
