"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most three of 64 bits agree on one of four
16-bit blocks. Every distinct fingerprint therefore goes, once for each block,
to the partition of that block's value; there the fingerprints, rotated so that
the block leads, are sorted, which lays out their binary trie: a node is a range
of rows that share their leading bits. The join walks down pairs of nodes
together, level by level, adds up the bits in which their paths differ, and
drops a pair as soon as that exceeds the budget. Pairs of ranges that already
hang together are dropped as well, with the budget raised step by step, so that
a thick cluster is tied by its close pairs and never listed pair by pair.

Each partition returns a star per cluster, at most one link for each row;
connected components over the links give the result. A block value that holds
more than ``hot_rows`` fingerprints is dealt out further: of the 48 bits left,
pairs agree on one of four 12-bit parts.

Defined results: null and empty texts have the fingerprint zero, which is linked
like any other; repeated rows get the same component; a null id gets its row's
component but is nobody's smallest id (a component of null ids alone is null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import ship, slices
from siteweave.operators.components import connected_components
from siteweave.session import cut_lineage

BLOCKS = 4
BITS = 64
#: The contract's seed, the one that Spark's own xxhash64 has.
SEED = 42
#: Node pairs that a task keeps open at once; beyond that it walks them in parts.
FRONTIER = 1 << 19


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word n-grams with repeats; the whole word sequence if it is shorter; none if there is no word."""
    words = text.encode().lower().split() if text else []
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width])).tolist()
    return [line[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprint(text: str | None, width: int = 3) -> int:
    parts = shingles(text, width)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in parts], np.uint64)
    total = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def compute(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return rows.mapInArrow(compute, f"id {kind}, fp bigint")


# The walk inside a task ------------------------------------------------------


def trie_links(keys: np.ndarray, group: np.ndarray, budget: int, start_bit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A star of row numbers per cluster of rows of one group at most ``budget`` bits apart.

    ``keys`` are unsigned longs, sorted within ``group``, whose rows are adjacent and
    agree on the first ``start_bit`` bits.
    """
    n = len(keys)
    root = np.arange(n)
    ones = [np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - bit)) & np.uint64(1), dtype=np.int64))) for bit in range(BITS)]
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if n else np.zeros(1, np.int64)
    for most in range(1, budget + 1):
        lo, hi = edges[:-1], edges[1:]
        big = hi - lo > 1
        lo, hi = lo[big], hi[big]
        stack = [(start_bit, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        spans = _Spans(root)
        while stack:
            bit, alo, ahi, blo, bhi, far = stack.pop()
            if len(alo) > FRONTIER:
                middle = len(alo) // 2
                for part in (slice(middle, None), slice(None, middle)):
                    stack.append((bit, alo[part], ahi[part], blo[part], bhi[part], far[part]))
                continue
            # Pairs of single rows are settled at once; others hang together already, or go on.
            single = (ahi - alo == 1) & (bhi - blo == 1)
            a, b = alo[single], blo[single]
            near = (a != b) & (np.bitwise_count(keys[a] ^ keys[b]) <= most)
            if near.any():
                found.append((a[near], b[near]))
            go = ~single
            alo, ahi, blo, bhi, far = alo[go], ahi[go], blo[go], bhi[go], far[go]
            go = ~spans.together(alo, ahi, blo, bhi)
            alo, ahi, blo, bhi, far = alo[go], ahi[go], blo[go], bhi[go], far[go]
            if not len(alo):
                continue
            one = ones[bit]
            amid, bmid = ahi - (one[ahi] - one[alo]), bhi - (one[bhi] - one[blo])
            same = (alo == blo) & (ahi == bhi)
            children = []
            for x0, x1, y0, y1, step, which in ((alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None), (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, ~same)):
                keep = (x1 > x0) & (y1 > y0) & (far + step <= most)
                if which is not None:
                    keep &= which
                # A node with itself needs two rows.
                keep &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 == 1))
                children.append((x0[keep], x1[keep], y0[keep], y1[keep], far[keep] + np.int8(step)))
            stack.append((bit + 1, *(np.concatenate(c) for c in zip(*children))))
        if found:
            root = _merged(root, np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
    row = np.flatnonzero(root != np.arange(n))
    return row, root[row]


class _Spans:
    """Tells whether all rows of two ranges have one root."""

    def __init__(self, root: np.ndarray):
        self.root = root
        change = np.concatenate(([0], (root[1:] != root[:-1]).astype(np.int64))) if len(root) else np.zeros(0, np.int64)
        self.changes = np.cumsum(change)

    def together(self, alo, ahi, blo, bhi):
        c = self.changes
        return (c[ahi - 1] == c[alo]) & (c[bhi - 1] == c[blo]) & (self.root[alo] == self.root[blo])


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number of each component, by pointing to the smaller neighbour and jumping."""
    root = root.copy()
    while True:
        ra, rb = root[a], root[b]
        small, large = np.minimum(ra, rb), np.maximum(ra, rb)
        if (small == large).all():
            return root
        np.minimum.at(root, large, small)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


# The join over the cluster ---------------------------------------------------


def rotated(fp: F.Column, bits: int) -> F.Column:
    """The 64 bits turned left."""
    if not bits:
        return fp
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, BITS - bits))


def links(fps: DataFrame, budget: int = 3, hot_rows: int = 200_000, rows_per_task: int = 200_000) -> DataFrame:
    """(src, dst) links that tie every cluster of distinct fingerprints ``fp`` at most ``budget`` (up to 3) bits apart."""
    if budget >= BLOCKS:
        raise ValueError(f"a budget of {budget} bits needs more than {BLOCKS} blocks")
    width = BITS // BLOCKS
    turned = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), rotated(F.col("fp"), k * width).alias("key")) for k in range(BLOCKS)])).alias("t"),
    ).select("t.turn", "t.key", F.shiftrightunsigned("t.key", BITS - width).alias("block"))
    sizes = turned.groupBy("turn", "block").count()
    rows, most = sizes.agg(F.sum("count"), F.max("count")).first()
    if not rows:
        return fps.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    parts = max(1, -(-rows // rows_per_task))
    plain = turned.withColumn("part", F.lit(-1)).withColumn("value", F.lit(0).cast("long"))
    if most > hot_rows:
        hot = sizes.filter(F.col("count") > hot_rows).select("turn", "block", F.lit(True).alias("hot"))
        dealt = turned.join(hot, ["turn", "block"], "left")
        size = (BITS - width) // BLOCKS
        places = [F.struct(F.lit(k).alias("part"), F.shiftrightunsigned("key", BITS - width - (k + 1) * size).bitwiseAND((1 << size) - 1).alias("value")) for k in range(BLOCKS)]
        whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("value")))
        plain = dealt.select("turn", "block", "key", F.explode(F.when(F.col("hot"), F.array(*places)).otherwise(whole)).alias("p")).select("turn", "block", "key", "p.part", "p.value")
    else:
        plain = plain.select("turn", "block", "key", "part", "value")
    spread = plain.select("key", "turn", F.xxhash64("turn", "block", "part", "value").alias("group"))

    def walk(batches):
        taken = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not taken:
            return
        key, turn, group = (np.concatenate(c) for c in zip(*taken))
        key = key.view(np.uint64)
        order = np.lexsort((key, group))
        key, turn, group = key[order], turn[order], group[order]
        a, b = trie_links(key, group, budget, width)
        back = [_turned_back(key[x], turn[x]) for x in (a, b)]
        for start in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[start : start + (1 << 16)]) for x in back], names=["src", "dst"])

    return spread.repartition(parts, "group").mapInArrow(walk, "src bigint, dst bigint")


def _turned_back(key: np.ndarray, turn: np.ndarray) -> np.ndarray:
    right = (turn * (BITS // BLOCKS)).astype(np.uint64)
    left = (np.uint64(BITS) - right) % np.uint64(BITS)
    return np.where(right == 0, key, (key >> right) | (key << left)).view(np.int64)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3
) -> DataFrame:
    """(id, fingerprint, component_id) of every row; the component is the smallest id that links reach."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, width), "simhash")
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"))
    clusters = connected_components(links(firsts.select("fp"), budget))
    smallest = (
        firsts.join(clusters.withColumnsRenamed({"id": "fp"}), "fp")
        .groupBy("component")
        .agg(F.min("first").alias("component_id"))
    )
    by_print = clusters.join(smallest, "component").select(F.col("id").alias("fp"), "component_id")
    # A table of its own, so that the last join reads two plain shuffles and Spark can split a hot fingerprint.
    known = cut_lineage(firsts.join(by_print, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-ids")
    return prints.join(known, "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
