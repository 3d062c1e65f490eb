"""Tables that grow by batches: shelves, components, and the merging stream against one run over everything."""

import random
import time

import brute
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.operators import components, golden, linkage
from siteweave.plans.linkage_queries import linkable
from siteweave.streaming import incremental, shelf

SF = "/root/testdata/sf0.001"
VALUE = T.StructType([T.StructField("value", T.StringType())])


def test_lookups_read_the_buckets_of_their_keys(spark, tmp_path):
    kept = shelf.Shelf(spark, str(tmp_path / "s"), VALUE, 16)
    layer = lambda n, keys: spark.createDataFrame([("k", f"key{i}", f"{n}-{i}") for i in keys] + [("k", None, "no key"), ("other", "key0", "x")], "kind string, key string, value string")
    keys = spark.createDataFrame([("key3",), ("key77",), (None,), ("missing",)], "key string")
    assert kept.find("k", keys, 5).count() == 0
    for n in range(4):
        kept.write(layer(n, range(100) if n < 3 else range(50)), n)
    kept.write(layer("2b", range(100)), 2)  # a replay
    got = lambda rows: sorted(map(tuple, rows.collect()))
    assert got(kept.find("k", keys, 2)) == sorted((f"key{i}", f"{n}-{i}") for n in (0, 1) for i in (3, 77))
    assert got(kept.find("k", keys, 9, latest=True)) == [("key3", "3-3"), ("key77", "2b-77")]
    assert got(kept.all("other", latest=True)) == [("key0", "x")]
    scan = next(line for line in kept.find("k", keys, 9)._jdf.queryExecution().toString().split("\n") if "PartitionFilters" in line and "bucket" in line)
    filters = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "kind" in filters and "batch" in filters and "bucket" in filters
    one = shelf.compacted(kept, str(tmp_path / "c"), latest=("k",))
    assert got(one.find("k", keys, 9)) == got(kept.find("k", keys, 9, latest=True))
    assert one.all("k").count() == 100 and one.all("other").count() == 4


def test_filters_keep_new_keys_from_reading(spark, tmp_path):
    kept = shelf.Shelf(spark, str(tmp_path / "s"), VALUE, 8, filtered=True)
    rows = lambda keys, kind="k": spark.createDataFrame([(kind, k, "v") for k in keys], "kind string, key string, value string")
    keys = lambda names: spark.createDataFrame([(k,) for k in names], "key string")
    assert kept.folders("k", keys(["a"]), 3) == []
    for n in range(3):
        kept.write(rows([f"{n}-{i}" for i in range(400)]), n)
    kept.write(rows([], "k"), 3)
    # Every stored key is found in its own folder, and hardly any other key in one.
    for n in range(3):
        mine = [f"{n}-{i}" for i in range(0, 400, 7)]
        assert {b for b, _ in kept.folders("k", keys(mine), 9)} >= {n}
        assert {r.key for r in kept.find("k", keys(mine), 9).collect()} == set(mine)
        assert kept.find("k", keys(mine), n).isEmpty()
    assert len(kept.folders("k", keys([f"new-{i}" for i in range(400)]), 9)) <= 2
    assert kept.folders("other", keys(["0-1"]), 9) == [] and kept.find("k", keys(["new"]), 9).isEmpty()
    assert shelf.compacted(kept, str(tmp_path / "c")).find("k", keys(["1-7", "x"]), 9).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_components_grow_in_any_order(spark, seed):
    draw = random.Random(seed)
    edges = [(f"n{draw.randrange(60):02}", f"n{draw.randrange(60):02}") for _ in range(45)]
    edges += [("n00", "n00"), edges[0], (edges[1][1], edges[1][0])]
    draw.shuffle(edges)
    known = {}
    for start in range(0, len(edges), 12):
        batch = edges[start : start + 12]
        ends = {x for e in batch for x in e}
        table = spark.createDataFrame([(i, c) for i, c in known.items() if i in ends], "id string, component string")
        growth = components.grow(spark.createDataFrame(batch, "src string, dst string"), table)
        renamed = {r.component: r.into for r in growth.renamed.collect()}
        nodes = {r.id: r.component for r in growth.nodes.collect()}
        assert not nodes.keys() & known.keys() and not renamed.keys() - set(known.values())
        known = {i: renamed.get(c, c) for i, c in known.items()} | nodes
        so_far = brute.components([e for e in edges[: start + 12] if e[0] != e[1]])
        assert known == so_far


def test_a_batch_inside_one_component_changes_nothing(spark):
    known = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, component string")
    growth = components.grow(spark.createDataFrame([("b", "a")], "src string, dst string"), known)
    assert [tuple(r) for r in growth.contracted.collect()] == [("a", "a")]
    assert growth.nodes.isEmpty() and growth.renamed.isEmpty()


def feed(raw, folder, order):
    for i in order:
        raw.filter(F.crc32("id") % len(order) == i).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in the order of their times


def run(spark, raw, tmp_path, **options):
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.match_stream(stream, str(tmp_path / "state"), str(tmp_path / "progress"), buckets=4, **options).awaitTermination()
    return lambda name: incremental.current_state(spark, str(tmp_path / "state"), name)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_batches_in_any_order_give_the_components_of_one_run(spark, tmp_path, order):
    raw = linkable(spark, SF).cache()
    feed(raw, str(tmp_path / "in"), order)
    state = run(spark, raw, tmp_path)
    whole = components.connected_components(linkage.link_edges(linkage.match(raw)))
    expected = {r.id: r.component for r in whole.collect()}
    assert {r.id: r.component for r in state("components").collect()} == expected
    owner = {r.raw_record_id: r.facility_id for r in state("lineage").collect()}
    assert set(owner) == {r.id for r in raw.select("id").collect()}
    assert all(owner[i] == owner[c] for i, c in expected.items())
    golden = state("facilities").collect()
    assert {r.id for r in golden} == set(owner.values()) and len({r.id for r in golden}) == len(golden)
    # Kept counters equal a recount.
    linked = {}
    for r in golden:
        if r.company_id is not None:
            linked[r.company_id] = linked.get(r.company_id, 0) + 1
    counts = {r.id: r.facility_count for r in state("companies").collect()}
    assert all(counts[c] == n for c, n in linked.items())


def test_cost_follows_the_batch(spark, tmp_path):
    """A small batch after a large one reads the records of its areas only."""
    schema = linkable(spark, SF).schema
    base = {c: None for c in schema.names}
    row = lambda i, state, name: {**base, "id": f"r{i:05}", "source": "epa_echo" if i % 2 else "osha", "source_record_id": str(i), "raw_name": name, "raw_address": f"{i} MAIN ST", "raw_city": "TOWN", "raw_state": state, "raw_zip": f"{75000 + i % 40 * 100}"}
    large = [row(i, "TX", f"SITE {i} WORKS") for i in range(400)]
    small = [row(1000 + i, "TX", f"SITE {i} WORKS") | {"raw_zip": "75000", "source": "manual", "raw_address": f"{i} MAIN ST"} for i in (0, 40)]
    for rows in (large, small):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    run(spark, spark.createDataFrame(large, schema), tmp_path)
    counts = [r.counts for r in spark.read.parquet(str(tmp_path / "state/ledger")).orderBy("batch").collect()]
    assert counts[0]["records"] == 400 and counts[1]["records"] == 2
    assert counts[1]["compared_with"] == 10 and counts[1]["golden_met"] <= 4 and counts[1]["members"] <= 4


def test_refreshed_fields_follow_from_the_records_alone(spark, tmp_path):
    raw = linkable(spark, SF).filter("source <> 'osha' or id like '%1'").cache()
    feed(raw, str(tmp_path / "in"), (1, 0))
    state = run(spark, raw, tmp_path, refresh=True)
    owner = state("lineage").select(F.col("raw_record_id").alias("id"), "facility_id")
    whole = golden.golden_rows(raw.join(owner, "id"), "facility_id")
    fields = ["name", "company_name", "address", "city", "state", "zip", "latitude", "longitude", "primary_naics", "epa_registry_id",
              "parent_company_from_tri", "source_count", "sources", "confidence"]
    want = {r["unit"]: tuple(r[c] for c in fields) for r in whole.collect()}
    got = {r["id"]: tuple(r[c] for c in fields) for r in state("facilities").collect()}
    assert got == want
    ids = {r.name: r.id for r in state("companies").collect()}
    assert all(r.company_id == ids.get(r.company_name) for r in state("facilities").collect())


def test_lookups_list_the_folders_of_one_kind(spark, tmp_path):
    kept = shelf.Shelf(spark, str(tmp_path / "s"), VALUE, 4)
    for n in range(3):
        kinds = ("k", "other") if n < 2 else ("other",)
        kept.write(spark.createDataFrame([(kind, f"key{i}", f"{n}") for kind in kinds for i in range(20)], "kind string, key string, value string"), n)
    names = lambda batch, kind: ["/".join(path.split("/")[-2:]) for path in kept.layers(batch, kind)]
    assert names(9, "k") == ["batch=0/kind=k", "batch=1/kind=k"] and names(1, "k") == ["batch=0/kind=k"] and names(9, "none") == []
    assert all("/kind=k/" in path for path in kept.before(9, "k").inputFiles())
    kept.write(spark.createDataFrame([("a:b#", "x", "y")], "kind string, key string, value string"), 3)
    assert kept.all("a:b#").count() == 1 and kept.all("a:b").count() == 0
    assert kept.all("k").count() == 40 and kept.all("none").count() == 0 and kept.before(2).count() == 80
