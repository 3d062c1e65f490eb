"""The contract's laws, and differencing against the best and a greedy partition."""

import itertools
import random
import zlib

import pytest

from siteweave.llm import shards

SCHEMA = "doc_id long, text string, size string"


def spread(sizes, placed, n):
    total = [0] * n
    for s, k in zip(sizes, placed):
        total[k] += s
    return max(total) - min(total)


def test_differencing_of_the_textbook():
    assert spread([8, 7, 6, 5, 4], shards.differenced([8, 7, 6, 5, 4], 2), 2) == 2


def test_differencing_against_greedy_and_best():
    draw = random.Random(1)
    worse = 0
    for _ in range(30):
        sizes = [draw.randrange(1, 1000) for _ in range(9)]
        best = min(spread(sizes, p, 3) for p in itertools.product(range(3), repeat=9) if p[0] == 0)
        assert best <= spread(sizes, shards.differenced(sizes, 3), 3) <= max(sizes)
        worse += spread(sizes, shards.differenced(sizes, 3), 3) > 4 * best + 100
    assert worse <= 6
    sizes = [draw.randrange(1, 10_000) for _ in range(3000)]
    assert spread(sizes, shards.differenced(sizes, 16), 16) <= 5
    assert shards.differenced([], 16) == []


def check(rows, got, n, most):
    assert sorted(map(str, ((r["doc_id"], r["text_crc32"], r["size"]) for r in got))) == sorted(map(str, ((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, _ in rows)))
    bytes_of, slots = [0] * n, [[] for _ in range(n)]
    for r in got:
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
        bytes_of[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for own in slots:
        assert sorted(own) == list(range(len(own)))
    assert max(bytes_of) - min(bytes_of) <= most
    # Equal texts have equal crc32 and size here, and stay together.
    groups = {}
    for r in got:
        if r["size"] > 1:
            groups.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(own) == 1 for own in groups.values())


@pytest.mark.parametrize("bucket_rows", [100_000, 7])
def test_laws(frame, bucket_rows):
    draw = random.Random(3)
    rows = [(i, "x" * draw.randrange(1, 3000) + str(i), None) for i in range(400)]
    rows += [(1000 + i, "copy", "c") for i in range(60)] + [(5, "same row", "c")] * 40 + [(None, "é", "c"), (7, None, None), (7, "", None)]
    got = shards.assign(frame(rows, SCHEMA), bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    check(rows, got, 16, 200)


def test_a_group_larger_than_a_shard(frame):
    rows = [(i, "y" * 1000, None) for i in range(50)] + [(100 + i, "z" * (i + 1), None) for i in range(300)]
    got = shards.assign(frame(rows, SCHEMA)).collect()
    hot = {r["shard"] for r in got if r["size"] == 1001}
    assert len(hot) == 1
    total = [0] * 16
    for r in got:
        total[r["shard"]] += r["size"]
    rest = [b for k, b in enumerate(total) if k not in hot]
    assert total[hot.pop()] == 50 * 1001
    assert max(rest) - min(rest) <= 20


def test_empty_table(frame):
    assert shards.assign(frame([], SCHEMA)).collect() == []
