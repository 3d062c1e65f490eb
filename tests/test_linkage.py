"""Matching against brute force: the key plan must lose no pair, whatever the shape of the blocks."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from siteweave.functions.scoring import MatchConfig
from siteweave.operators import components, linkage

SCHEMA = ("id string, source string, raw_name string, raw_address string, raw_city string, raw_state string, raw_zip string, "
          "raw_latitude string, raw_longitude string, raw_naics_code string, registry_id string")


def records(n, seed, hot=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = " ".join(rng.choice(["ACME", "ACMES", "BOLT", "BOLTS", "GEAR"]) for _ in range(rng.randint(1, 3)))
        lat, lng = (None, None) if rng.random() < 0.4 else (f"{30 + rng.random() * 0.08:.5f}", f"{-95 + rng.random() * 0.08:.5f}")
        out.append({
            "id": f"r{i:04d}", "source": rng.choice(["epa_echo", "epa_tri", "osha", "manual"]), "raw_name": rng.choice([name, name, None]),
            "raw_address": rng.choice([f"{rng.randint(1, 4)} MAIN STREET", f"{rng.randint(1, 4)} OAK ROAD", None]),
            "raw_city": rng.choice(["AUSTIN", "WACO", None]), "raw_state": "TX" if hot else rng.choice(["TX", "OK", None]),
            "raw_zip": rng.choice(["77001", "77002", "77101", None]), "raw_latitude": lat, "raw_longitude": lng,
            "raw_naics_code": rng.choice(["332710", "332710", "332999", "331110", "311615", None]),
            "registry_id": rng.choice([None, None, None, "11", "12"]),
        })
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def scored(spark, rows, config=MatchConfig(), earlier=None):
    found = linkage.match(frame(spark, rows), config, None if earlier is None else frame(spark, earlier))
    return {(r.record_a, r.record_b): r.confidence_score for r in linkage.expand(found).collect()}


@pytest.mark.parametrize("seed,max_block", [(1, 500), (2, 5)])
def test_equals_all_pairs(spark, seed, max_block):
    rows = records(220, seed, hot=seed == 2)
    want = brute.pairs(rows)
    assert len(want) > 300
    got = scored(spark, rows, MatchConfig(max_block=max_block))
    assert {tuple(sorted(k)): v for k, v in got.items()} == want


def test_equals_all_pairs_for_other_thresholds(spark):
    rows = records(120, 3)
    for review in (45, 80):
        got = scored(spark, rows, MatchConfig(review=review))
        assert {tuple(sorted(k)): v for k, v in got.items()} == brute.pairs(rows, review)


def test_copies_are_folded(spark):
    """A group of copies costs one row per pair of folds, and still ends up in one component."""
    base = dict(raw_name="ACME", raw_address="1 MAIN STREET", raw_city="AUSTIN", raw_state="TX", raw_zip="77001",
                raw_latitude="30.0", raw_longitude="-95.0", raw_naics_code="332710", registry_id=None)
    rows = [{**base, "id": f"a{i:03d}", "source": "epa_echo"} for i in range(300)]
    rows += [{**base, "id": f"b{i:03d}", "source": "manual"} for i in range(200)]
    found = linkage.match(frame(spark, rows))
    (pair,) = found.pairs.collect()
    assert (pair.record_a, pair.record_b, pair.pair_count, pair.confidence_score) == ("a000", "b000", 60000, 100)
    nodes = components.connected_components(linkage.link_edges(found)).collect()
    assert len(nodes) == 500 and {n.component for n in nodes} == {"a000"}


def test_hot_registry_id(spark):
    rows = [{**r, "registry_id": "same", "raw_state": "TX"} for r in records(150, 5)]
    found = linkage.match(frame(spark, rows))
    assert found.pairs.count() <= 6
    assert {tuple(sorted(k)): v for k, v in scored(spark, rows).items()} == brute.pairs(rows)
    assert components.connected_components(linkage.link_edges(found)).select("component").distinct().count() == 1


def test_new_records_meet_earlier_ones(spark):
    rows = records(160, 7)
    earlier, fresh = rows[:80], rows[80:]
    both = {**scored(spark, earlier), **scored(spark, fresh, earlier=earlier)}
    assert {tuple(sorted(k)): v for k, v in both.items()} == brute.pairs(rows)


def test_counts_and_order_freedom(spark):
    rows = records(150, 9)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert scored(spark, rows) == scored(spark, shuffled)
    table = linkage.prepared(frame(spark, rows))
    compared = linkage.compared_pairs(table).first().compared
    block = lambda r: (r["raw_state"], (r["raw_zip"] or "000")[:3])
    want = sum(
        1 for i, a in enumerate(rows) for b in rows[:i]
        if a["source"] != b["source"] and a["raw_state"] and a["raw_state"] == b["raw_state"]
        and (block(a) == block(b) or (a["registry_id"] and a["registry_id"] == b["registry_id"]))
    )
    assert compared == want


def test_reachability_without_coordinates_or_code(spark):
    """Without a point the score stays at 70, without a code at 85."""
    rows = records(200, 11)
    by_id = {r["id"]: r for r in rows}
    for (a, b), score in scored(spark, rows).items():
        if score == 99:
            continue
        a, b = by_id[a], by_id[b]
        if a["raw_latitude"] is None or b["raw_latitude"] is None:
            assert score <= 70
        if a["raw_naics_code"] is None or b["raw_naics_code"] is None:
            assert score <= 85


def test_grid_reaches_across_cells(spark):
    """Points within reach share a cell, near the date line and at high latitudes too."""
    rng = random.Random(4)
    points = []
    for i in range(400):
        lat = rng.choice([-71.3, 0.0, 45.0, 71.4, 89.7, 89.99])
        points.append((f"p{i}", lat + rng.random() * 0.06 - 0.03 if abs(lat) < 89.9 else lat, rng.choice([-180.0, 179.98, -95.0]) + rng.random() * 0.02))
    from siteweave.functions import geo

    left = spark.createDataFrame(points, "id string, lat double, lng double")
    own = left.select("id", geo.cell_name(geo.band(F.col("lat")), geo.band_cells(F.col("lat"), 0), F.col("lng"), F.lit(0)).alias("cell"))
    near = None
    for row in (-1, 0, 1):
        for shift in (-1, 0, 1):
            cell = geo.cell_name(geo.band(F.col("lat")) + row, geo.band_cells(F.col("lat"), row), F.col("lng"), F.lit(shift))
            part = left.select(F.col("id").alias("other"), cell.alias("cell"))
            near = part if near is None else near.unionByName(part)
    joined = own.join(near.filter("cell is not null"), "cell").groupBy("id", "other").count().collect()
    met = {(r.id, r.other) for r in joined}
    assert all(r["count"] == 1 for r in joined)
    for i, (a, *p) in enumerate(points):
        for b, *q in points[:i]:
            if brute.meters(p, q) < 5000:
                assert (a, b) in met and (b, a) in met


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    rng.shuffle(chain)
    star = [("s000", f"s{i:03d}") for i in range(1, 200)]
    loose = [(f"x{rng.randint(0, 80):02d}", f"x{rng.randint(0, 80):02d}") for _ in range(60)]
    edges = chain + star + [e for e in loose if e[0] != e[1]]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges + [("z", "z")], "src string, dst string")).collect()}
    assert got == brute.components(edges)


def test_rows_of_one_source_do_not_meet(spark):
    """A large key of one source costs no pairs, and few with one row of another source."""
    base = dict(raw_city="AUSTIN", raw_state="TX", raw_zip="77001", raw_latitude=None, raw_longitude=None, raw_naics_code="332710", registry_id=None)
    rows = [{"id": f"a{i:03d}", "source": "manual" if i == 7 else "osha", "raw_name": f"WORKS {i}", "raw_address": f"{i} OAK ROAD", **base} for i in range(200)]
    rows = [{c.split()[0]: r[c.split()[0]] for c in SCHEMA.split(", ")} for r in rows]
    folds = linkage.fold_by_fields(linkage.prepared(frame(spark, rows)))
    met = linkage.keyed_pairs(folds)
    assert met.filter("a_source = b_source").isEmpty()
    assert met.count() <= 3 * 199
    assert {tuple(sorted(k)): v for k, v in scored(spark, rows).items()} == brute.pairs(rows)


def test_more_sources_than_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(linkage, "NUMBERED_SOURCES", 2)
    rows = records(120, 13)
    assert {tuple(sorted(k)): v for k, v in scored(spark, rows).items()} == brute.pairs(rows)


def test_marks_never_exceed_edits(spark):
    """Half of the marks that differ bound the edits from below, whatever the letters are."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("AABC1 É😀-") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    rows = linkage._marked(spark.createDataFrame([(t,) for t in texts], "name string")).collect()
    for x in rows:
        for y in rows:
            changed = sum(bin((x[m] ^ y[m]) & (2**64 - 1)).count("1") for m in ("marks_1", "marks_2"))
            assert changed <= 2 * brute.edit_distance(x["name"], y["name"])


def test_many_parts_are_not_sent_through_the_driver(spark, monkeypatch):
    from siteweave import fixtures

    monkeypatch.setattr(fixtures, "SENT_PARTS", 10)
    plan = fixtures.derive(spark, "/root/testdata/sf0.001", fixtures.RAW_RECORDS)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_postal_keys_of_one_city_hold_no_pairs(spark):
    """Their pairs are found under the city; keys of several cities, or of missing ones, keep all rows."""
    base = dict(raw_name="ACME", raw_state="TX", raw_latitude=None, raw_longitude=None, raw_naics_code="332710", registry_id=None)
    rows = []
    for i, (postal, city) in enumerate([("77001", "AUSTIN")] * 6 + [("77002", "AUSTIN")] * 3 + [("77002", "WACO")] * 2 + [("77003", None)] * 4):
        rows.append({"id": f"r{i:02d}", "source": "osha" if i % 2 else "manual", "raw_address": f"{i} OAK ROAD", "raw_zip": postal, "raw_city": city, **base})
    rows = [{c.split()[0]: r[c.split()[0]] for c in SCHEMA.split(", ")} for r in rows]
    folds = linkage.fold_by_fields(linkage.prepared(frame(spark, rows)))
    met = {r.a_zip5 for r in linkage.keyed_pairs(folds).filter("kind = 'zip'").select("a_zip5").distinct().collect()}
    assert met == {"77002", "77003"}
    assert {tuple(sorted(k)): v for k, v in scored(spark, rows).items()} == brute.pairs(rows)


def test_numbers_tell_most_pairs_apart_and_lose_none(spark):
    """The bounds keep every pair that reaches the score, and ask for the distances of few others."""
    config = MatchConfig()
    least = config.review - 0.5 - linkage.EPSILON
    rows = records(220, 17, hot=True)
    folds = linkage.fold_by_fields(linkage.prepared(frame(spark, rows), config))
    pairs = linkage.keyed_pairs(folds, config)
    ends = lambda r: tuple(sorted((r.a_id, r.b_id)))
    kept = {ends(r) for r in pairs.filter(linkage._within_reach(config, least)).select("a_id", "b_id").collect()}
    want = {tuple(sorted((r.record_a, r.record_b))) for r in linkage.scored_pairs(folds, config).select("record_a", "record_b").collect()}
    assert want <= kept and len(kept) < 0.5 * pairs.count()
    assert {tuple(sorted(k)): v for k, v in scored(spark, rows).items()} == brute.pairs(rows)


def test_the_pairs_method_can_be_compiled(spark, capsys):
    """The JVM leaves methods above 8,000 bytes uncompiled, which makes pairs many times as dear."""
    import re

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        linkage.scored_pairs(linkage.fold_by_fields(linkage.prepared(frame(spark, records(60, 19))))).explain("codegen")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 6000
