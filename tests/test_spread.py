"""Costly work on a small file is dealt over tasks by the number of rows."""

import glob

import pytest
from pyspark.sql import functions as F

from siteweave.functions import company as C
from siteweave.operators import search
from siteweave.plans import linkage_queries, table_queries
from siteweave.session import SPREAD_ROWS
from siteweave.streaming.shelf import Shelf


def parts(spark, path, rows):
    name = F.concat(F.lit("Mill "), (F.col("id") % 7).cast("string"))
    made = spark.range(rows).select(
        F.col("id").alias("p_partkey"), name.alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), F.lit(1).alias("p_size"))
    made.coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_names_are_read_in_more_tasks_as_they_grow(spark, tmp_path):
    folder = parts(spark, tmp_path, 2 * SPREAD_ROWS + 1)
    names = table_queries.name_rows(spark, folder)
    assert names.rdd.getNumPartitions() == 3
    assert names.count() == 2 * SPREAD_ROWS + 1
    assert table_queries.resolved_names(spark, folder).rdd.getNumPartitions() == 3
    assert table_queries.company_rules_many(spark, folder).rdd.getNumPartitions() == 3


def test_names_with_blanks_around_read_as_before(spark):
    rules = (C.CompanyRule(r"^ACME", "Acme One"),)
    rows = spark.createDataFrame([("  ACME WIDGETS  ",), ("ACME WIDGETS",), ("   ",), (None,), ("plain",)], "name string")
    found = [r.c for r in C.with_company(rows, "c", rules, "name").collect()]
    # A rule that only the name without its blanks meets still decides.
    assert found == ["Acme One", "Acme One", None, None, None]


def test_postings_are_made_and_met_in_more_tasks_as_texts_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "TEXTS_PER_TASK", 10)
    monkeypatch.setattr(search, "POSTINGS_PER_TASK", 10)
    names = [(f"f{i}", "red mill" if i % 3 else "blue pit") for i in range(60)] + [("f1", "red mill"), (None, "red mill"), ("n", None)]
    rows = spark.createDataFrame(names, "id string, name string").coalesce(1)
    written = []
    write = Shelf.write
    monkeypatch.setattr(Shelf, "write", lambda self, layer, batch: (written.append(layer), write(self, layer, batch)))
    index = search.TextIndex(spark, f"{tmp_path}/t", 4)
    index.add(rows, ["name"], 0)
    assert "REPARTITION_BY_NUM" in written[0]._jdf.queryExecution().toString()
    # All postings of a trigram that most texts hold: dealt by the row's id.
    assert index.candidates("red", ["name"])._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") > 0
    found = [r.id for r in search.search(rows, index, "RED", ["name"]).select("id").collect()]
    assert sorted(found) == sorted([n[0] for n in names if n[0] and n[1] and "red" in n[1]])
    assert search.search(rows, index, "redx", ["name"]).count() == 0


def test_stream_parts_are_written_by_several_tasks_and_stay_one_batch_each(spark, tmp_path, monkeypatch):
    folder = parts(spark, tmp_path, 200)
    lines = spark.range(2000).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 200).alias("l_partkey"), F.lit(1).cast("bigint").alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), F.lit("2024-01-01").cast("timestamp").alias("l_shipdate"))
    lines.write.parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(linkage_queries, "STREAM_FILE_ROWS", 200)
    seen = {}

    class Stopped(Exception):
        pass

    def match_stream(stream, state, checkpoint, **_):
        place = state.removesuffix("/state")
        batches = seen["batches"] = []

        def take(batch, _id):
            batches.append({r[0]: r[1] for r in batch.groupBy(F.pmod(F.crc32("id"), F.lit(5))).count().collect()})

        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{place}/seen").trigger(availableNow=True).start().awaitTermination()
        seen["files"] = len(glob.glob(f"{place}/in/*.parquet"))
        raise Stopped

    monkeypatch.setattr(linkage_queries, "match_stream", match_stream)
    with pytest.raises(Stopped):
        linkage_queries.stream_match_merge(spark, folder)
    assert seen["files"] == 15
    assert [list(b) for b in seen["batches"]] == [[i] for i in range(5)]
    assert sum(sum(b.values()) for b in seen["batches"]) == 200 + 67 + 40 + 2000
