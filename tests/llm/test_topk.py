"""Exact search against all scores, whatever the blocks, and how much the pivots save."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def plain(rows, k, every):
    taken = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            taken.setdefault((i, tuple(math.floor(256 * float(np.float32(x))) for x in v)), None)
    out = []
    for q, a in taken:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in taken if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def rows_of(seed, n, size):
    draw = np.random.default_rng(seed)
    centers = draw.normal(0, 0.3, (6, size))
    return [(i, (centers[i % 6] + draw.normal(0, 0.1, size)).tolist(), "x") for i in range(n)]


@pytest.mark.parametrize("blocks", [(20_000, 1000), (37, 3)])
def test_like_all_scores(frame, compare, blocks):
    rows = rows_of(1, 300, 16)
    rows += [(1000 + i, rows[7][1], "copy") for i in range(40)] + [rows[0], rows[10]]
    rows += [(2000, None, ""), (2010, [], ""), (2020, [1.0, None], ""), (2030, [float("nan")] * 16, ""), (2040, [float("inf")] * 16, ""), (None, rows[3][1], ""), (2050, [0.5, 0.5], ""), (2060, [0.5, -0.5], ""), (2070, [0.0] * 16, "")]
    got = topk.search(frame(rows, SCHEMA), F.col("id") % 10 == 0, row_block=blocks[0], query_block=blocks[1]).collect()
    compare(got, plain(rows, 5, 10))


def test_fewer_rows_than_k_and_empty(frame, compare):
    rows = rows_of(2, 3, 4)
    compare(topk.search(frame(rows, SCHEMA), F.col("id") % 2 == 0).collect(), plain(rows, 5, 2))
    assert topk.search(frame([], SCHEMA), F.col("id") % 2 == 0).collect() == []
    assert topk.search(frame(rows[:1], SCHEMA), F.col("id") == 0).collect() == []


def test_pivots_spare_most_rows():
    rows = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows_of(3, 4000, 8)], np.int64)
    # Rows of one length, as unit vectors have: there the bounds bite.
    rows = np.floor(4096 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int64)
    pivots = topk.far_apart(rows[:500].astype(float), topk.PIVOTS)
    table, ids = topk.distances(rows.astype(float), pivots), np.arange(len(rows))
    found, evaluated = topk.search_block(ids, rows, table, ids[:20], rows[:20], table[:20], 5)
    scores = rows[:20] @ rows.T
    for q in range(20):
        scores[q, q] = -(10**18)
        best = sorted(range(len(rows)), key=lambda i: (-scores[q, i], i))[:5]
        assert [(i, s) for k, i, s in found if k == q] == [(i, scores[q, i]) for i in best]
    assert evaluated < 20 * len(rows) / 2


def test_large_components_stay_exact():
    big = np.array([[2**30, 3], [2**30, 4]], np.int64)
    assert topk.exact_scores(big, np.array([2**30 + 1, 1], np.int64)).tolist() == [2**30 * (2**30 + 1) + 3, 2**30 * (2**30 + 1) + 4]
