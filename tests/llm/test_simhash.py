"""Fingerprints against a plain count, links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from siteweave.llm import simhash


def plain_fingerprint(text, width=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, budget):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[find(i)] = find(j)
    smallest = {}
    for i, k in enumerate(ids):
        smallest[find(i)] = min(smallest.get(find(i), k), k)
    return [smallest[find(i)] for i in range(len(prints))]


def near_texts(draw, count):
    words = [f"w{draw.randrange(400)}" for _ in range(60)]
    for _ in range(count):
        own = list(words)
        for _ in range(draw.randrange(3)):
            own[draw.randrange(60)] = f"W{draw.randrange(400)}"
        yield draw.choice([" ", "  ", "\n"]).join(own)


def test_spark_hash_is_the_contracts(spark):
    from pyspark.sql import functions as F

    for text in ("", "a b c", "über die brücke"):
        got = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
        assert got & (2**64 - 1) == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two", "A b  c\nd E f", "ÀB c\x0bd\xa0e f", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("hot", [4, 200_000])
def test_components_like_all_pairs(spark, frame, hot, monkeypatch):
    draw = random.Random(hot)
    rows = [t for _ in range(8) for t in near_texts(draw, 12)] + [None, "", "  ", "one", "one two"] * 2
    rows = [(3 * i + 1, t) for i, t in enumerate(rows)] + [(1, rows[0])]
    plain_links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, budget: plain_links(fps, budget, hot_rows=hot, rows_per_task=50))
    got = simhash.near_duplicates(frame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = components(prints, [i for i, _ in rows], 3)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted([(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, roots)], key=key)
    assert len(set(roots)) < len(rows) - 12


def test_trie_links_like_all_pairs():
    draw = np.random.default_rng(1)
    for _ in range(40):
        keys = draw.integers(0, 2**63, draw.integers(1, 6), dtype=np.uint64)[draw.integers(0, 1, 200)]
        for _ in range(draw.integers(0, 7)):
            keys = keys ^ np.where(draw.random(200) < 0.6, np.uint64(1) << draw.integers(0, 64, 200).astype(np.uint64), np.uint64(0))
        keys = np.unique(keys)
        at, root = simhash.trie_links(keys, np.zeros(len(keys), int), 3)
        mine = np.arange(len(keys))
        mine[at] = root
        assert mine.tolist() == components([int(k) for k in keys], list(range(len(keys))), 3)


def test_null_ids_and_empty_table(frame):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(frame([], schema)).collect() == []
    got = simhash.near_duplicates(frame([(None, "a"), (5, "a"), (None, "b c d e")], schema)).collect()
    assert sorted((str(r[0]), str(r[2])) for r in got) == [("5", "5"), ("None", "5"), ("None", "None")]
