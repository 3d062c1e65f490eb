"""The manifest against a plain tree, level by level."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from siteweave.llm import merkle

#: Extra columns whose names the operator uses inside.
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row string, top_lo long, leaf string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(digests, fanout=3):
    """The root and, for each digest, what stands to its left and right at each level."""
    paths = [[] for _ in digests]
    level = [(d, [i]) for i, d in enumerate(digests)]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), fanout):
            run = level[k : k + fanout]
            for j, (_, members) in enumerate(run):
                for i in members:
                    paths[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            above.append((h("".join(d for d, _ in run)), [i for _, m in run for i in m]))
        level = above
    return level[0][0], paths


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in sources}
    if not rows:
        return
    root, over = tree([trees[s][0] for s in sources])
    for s, rest in zip(sources, over):
        for r, path in zip(own[s], trees[s][1]):
            path = path + rest
            other = list(r)
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 and r[4] is not None:
                other[4] = r[4].replace("\n", "")
            node = leaf(other)
            for left, right in path:
                node = h(left + node + right)
            yield r[0], leaf(r), trees[s][0], root, h("".join(a + b for a, b in path)), node, node == root


def some_rows(count, seed=1):
    draw = random.Random(seed)
    texts = [None, "", "two\nlines", "é" * 30, "\n", "x" * 5000]
    for _ in range(count):
        doc_id = None if draw.random() < 0.02 else draw.randrange(-5, count)
        yield doc_id, draw.choice([None, "", "a", "hot", "hot", "hot", "é", "z"]), draw.choice([None, "en"]), draw.choice([None, 5]), draw.choice(texts), "r", 7, "l"


@pytest.mark.parametrize("count", [0, 1, 2, 5, 700])
def test_manifest_matches_a_plain_tree(frame, compare, count):
    rows = list(some_rows(count))
    rows += rows[:3]
    got = merkle.verified_manifest(frame(rows, SCHEMA))
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified")
    compare(got.collect(), plain(rows))


def test_other_fanouts_and_many_sources(frame):
    rows = [(str(i % 40), i, h(str(i)), None) for i in range(300)]
    leaves = frame(rows, "source string, key long, digest string, row string")
    got = merkle.manifest(leaves, fanout=2).collect()
    own = {s: tree([h(str(i)) for i in range(int(s), 300, 40)], 2) for s in {r[0] for r in rows}}
    root, over = tree([own[s][0] for s in sorted(own)], 2)
    rest = dict(zip(sorted(own), over))
    assert len(got) == 300 and {r["root"] for r in got} == {root}
    for r in got:
        assert [tuple(step) for step in r["path"]] == own[r["source"]][1][r["rank"]] + rest[r["source"]]
