"""Kept breakdowns against a recount after each batch of changes."""

import random

import pytest

from siteweave.streaming import counters
from siteweave.streaming.counters import Breakdown
from siteweave.streaming.shelf import Shelf

SCHEMA = "id int, state string, code string, company string, staff int"
ALL = (
    Breakdown("state", ("state",), ("company", "code"), ("staff",)),
    Breakdown("state and code", ("state", "code"), ("company",)),
    Breakdown("whole", (), (), ("staff",)),
)


def recount(rows, b):
    names = SCHEMA.replace(" int", "").replace(" string", "").split(", ")
    groups = {}
    for row in rows:
        values = dict(zip(names, row))
        groups.setdefault(tuple(values[c] for c in b.by), []).append(values)
    told = lambda own: [len({v[c] for v in own} - {None}) for c in b.distinct] + [sum(v[c] or 0 for v in own) for c in b.total]
    return sorted(((*key, len(own), *told(own)) for key, own in groups.items()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_recount_after_each_batch(spark, tmp_path, seed):
    draw = random.Random(seed)
    kept = Shelf(spark, str(tmp_path / "c"), counters.COUNTERS, 4)
    table = {}
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for batch in range(4):
        before = dict(table)
        for _ in range(25):
            i = draw.randrange(30)
            if draw.random() < 0.35:
                table.pop(i, None)
            else:
                table[i] = (i, draw.choice([None, "", "TX", "OH", "OH"]), draw.choice([None, "a", "b"]), draw.choice([None, "x", "y", "z"]), draw.choice([None, 1, 5]))
        touched = {i for i in range(30) if before.get(i) != table.get(i)} | {29}
        taken, added = ([rows[i] for i in touched if i in rows] for rows in (before, table))
        counters.changed(kept, ALL, frame(taken), frame(added), batch)
        if batch == 2:  # a replay changes nothing
            counters.changed(kept, ALL, frame(taken), frame(added), batch)
        for b in ALL:
            assert sorted(map(tuple, counters.current(kept, b).collect()), key=str) == recount(table.values(), b)


def test_only_touched_groups_are_written(spark, tmp_path):
    kept = Shelf(spark, str(tmp_path / "c"), counters.COUNTERS, 4)
    rows = spark.createDataFrame([(i, f"s{i % 50}", "a", f"c{i % 7}", 1) for i in range(500)], SCHEMA)
    counters.changed(kept, ALL[:1], None, rows, 0)
    one = rows.filter("id = 3")
    counters.changed(kept, ALL[:1], rows.filter("id in (3, 4)"), one.unionByName(rows.filter("id = 4")).withColumn("state", rows["state"]), 1)
    counters.changed(kept, ALL[:1], one, None, 2)
    written = kept.before(9).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in written}.get(1, 0) == 0 and {r["batch"]: r["count"] for r in written}[2] == 3
    assert counters.current(kept, ALL[0]).filter("state = 's3'").first().n == 9
