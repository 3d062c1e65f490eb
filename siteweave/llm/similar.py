"""Groups of texts whose word shingles are alike, by an exact set-similarity join.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity
of four fifths or more; linked texts form a group. No pair at or above the bound is
missed (but for colliding 64-bit hashes):

1. Texts of equal sets fold into one set. Its shingles are hashed to 63 bits and put
   in one order for all sets: the hashes, those that are frequent in a sample last.
2. Two sets that are alike share a shingle among the first ``n - ceil(4n/5) + 1`` of
   each set (prefix filter), whatever the order is; so only these are shuffled, and
   only shingles that two sets share are kept. The order keeps common phrases out, and the
   sample grows with the documents, so that a phrase is common at the same number of copies
   whatever their number is.
3. Each set is compared with one set that shares a shingle with it, so that a
   group of copies costs a pair for each set. Sets that are tied by then
   need no more comparison with each other; those that share a shingle and are not tied are
   candidates if their sizes and the number of shingles that they share allow it.
4. A shingle that ``CROWD`` sets or more still share is not enough to make candidates: two sets that
   are alike share two of the first ``n - ceil(4n/5) + 2``, so these sets must share a second one.
5. Candidates are cut by a bound on their first shingles, which leaves few others than
   true pairs, and then verified on their whole sets. Connected components give the groups.

Defined results: null, empty and blank texts have the empty set and are alike; texts of
five words or fewer have one shingle, all their words; letter case is ignored for ASCII.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import hash_share, hinted, ship, slices
from siteweave.llm.simhash import SEED, shingles
from siteweave.operators.components import connected_components
from siteweave.session import cut_lineage

#: Words of a shingle, and the bound as a fraction.
WIDTH = 5
PART, WHOLE = 4, 5
#: Documents that the frequent shingles are counted on: one in so many, but a number at least; and how many of these must hold one.
SHARE, SAMPLE = 8, 2_000
FREQUENT = 2
#: Frequent shingles sent to the tasks (2 MB), the most frequent ones first; the choice has no bearing on the result.
SENT_SHINGLES = 250_000
#: Rows of slim tables up to which they are sent to all tasks.
BROADCAST_ROWS = 500_000
#: Sets from which on a shared shingle is a crowd.
CROWD = 64
#: Sets that a task remembers, so that a text that is repeated often is sent on once by each task.
REMEMBERED = 100_000
LOW = np.uint64((1 << 63) - 1)


def shingle_set(text: str | None, frequent: np.ndarray | None = None) -> np.ndarray:
    """The sorted hashes of a text's shingles; frequent ones have the first bit set, so that they come last."""
    digest = xxhash.xxh64_intdigest
    found = np.unique(np.array([digest(p, SEED) for p in set(shingles(text, WIDTH))], np.uint64) & LOW)
    if frequent is None or not len(frequent) or not len(found):
        return found
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    return np.sort(found | ((frequent[at] == found).astype(np.uint64) << np.uint64(63)))


def set_id(found: np.ndarray) -> int:
    """64 bits of a set, the same whichever shingles are frequent; zero for the empty one."""
    return xxhash.xxh64_intdigest(np.sort(found & LOW).tobytes(), SEED) if len(found) else 0


def leading(n: int) -> int:
    """How many of the first hashes of a set of ``n`` hold one that a set like it has among its own."""
    return min(n, n - -(-PART * n // WHOLE) + 1)


def prefix(found: np.ndarray) -> np.ndarray:
    """The first hashes, of which two sets that are alike share one without the last, and two with it."""
    return found[: leading(len(found)) + 1]


def frequent_shingles(rows: DataFrame) -> np.ndarray:
    """Sorted hashes that several documents of a sample hold."""

    def compute(batches):
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], names=["h"])

    total = rows.count()
    sample = rows.filter(hash_share(F.col("id"), max(SAMPLE, total // SHARE), total, 11)).select("text")
    common = sample.mapInArrow(compute, "h bigint").groupBy("h").count().filter(F.col("count") >= FREQUENT)
    found = common.orderBy(F.desc("count"), "h").limit(SENT_SHINGLES).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().astype(np.int64)).view(np.uint64)


def sets_of(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(id, s, n, prefix) of rows with id and text: the set's id, its size and its first hashes as bytes."""
    schema = rows.select("id", F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"), F.lit(b"").alias("prefix")).schema

    def compute(batches):
        for batch in slices(batches):
            found = [shingle_set(t, frequent) for t in batch.column("text").to_pylist()]
            ids = np.array([set_id(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids), pa.array([len(x) for x in found], pa.int32()), pa.array([prefix(x).tobytes() for x in found], pa.binary())],
                names=["id", "s", "n", "prefix"],
            )

    return rows.mapInArrow(compute, schema)


def shared_shingles(sets: DataFrame, rows_per_task: int = 1_000_000) -> DataFrame:
    """(h, s, n, p) of the first shingles that several sets have, each set once; ``p`` is the shingle's place in the set, from 0."""

    def spread(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            s, n, first = batch.column("s").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix").to_pylist()
            new = []
            for k, one in enumerate(s):
                if one not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(one)
                    new.append(k)
            sizes = [leading(n[k]) for k in new]
            h = np.frombuffer(b"".join(first[k][: 8 * size] for k, size in zip(new, sizes)), np.int64)
            own, size = (np.repeat(np.array([x[k] for k in new], t), sizes) for x, t in ((s, np.int64), (n, np.int32)))
            place = np.concatenate([np.arange(x, dtype=np.int32) for x in sizes]) if sizes else np.zeros(0, np.int32)
            for start in range(0, len(h), 1 << 16):
                end = start + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(x[start:end]) for x in (h, own, size, place)], names=["h", "s", "n", "p"])

    def walk(batches):
        taken = [[b.column(k).to_numpy() for k in range(4)] for b in batches if b.num_rows]
        if not taken:
            return
        h, s, n, p = (np.concatenate(c) for c in zip(*taken))
        del taken
        order = np.lexsort((s, h))
        h, s, n, p = h[order], s[order], n[order], p[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])))
        h, s, n, p = h[first], s[first], n[first], p[first]
        like = h[1:] == h[:-1]
        several = np.concatenate((like, [False])) | np.concatenate(([False], like))
        h, s, n, p = h[several], s[several], n[several], p[several]
        for start in range(0, len(h), 1 << 16):
            end = start + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(x[start:end]) for x in (h, s, n, p)], names=["h", "s", "n", "p"])

    total = sets.agg(F.sum(F.octet_length("prefix")) / 8).first()[0] or 0
    rows = sets.select("s", "n", "prefix").mapInArrow(spread, "h bigint, s bigint, n int, p int")
    return rows.repartition(max(1, -(-int(total) // rows_per_task)), "h").mapInArrow(walk, "h bigint, s bigint, n int, p int")


def starred(shared: DataFrame) -> DataFrame:
    """A pair (a, b) for each set: with the smallest of the sets that are the smallest of a shingle's."""
    centre = shared.groupBy("h").agg(F.min(F.struct("n", "s")).alias("first"))
    met = shared.join(centre, "h").filter((F.col("s") != F.col("first.s")) & (F.least("n", "first.n") * WHOLE >= F.greatest("n", "first.n") * PART))
    best = met.groupBy("s").agg(F.min("first").alias("first"))
    return best.select(F.least("s", "first.s").alias("a"), F.greatest("s", "first.s").alias("b")).distinct()


def untied(shared: DataFrame, tied: DataFrame) -> DataFrame:
    """(h, s, n, p, c, k) of the shingles whose sets are not all tied yet; ``c`` names what a set is tied to, ``k`` counts the sets."""
    by_set = shared.groupBy("s", "n").agg(F.collect_list(F.struct("h", "p")).alias("hs")).join(tied, "s", "left")
    marked = by_set.select(F.explode("hs").alias("x"), "s", "n", F.coalesce("c", "s").alias("c")).select("x.h", "s", "n", "x.p", "c")
    marked = cut_lineage(marked, "similar-marked")
    open_ones = marked.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("k")).filter("low <> high")
    return cut_lineage(marked.join(open_ones.select("h", "k"), "h"), "similar-untied")


def meeting(rows: DataFrame, *key: str) -> DataFrame:
    """Pairs of rows (*key, s, n, c, ...) of one key that are not tied and whose sizes allow the bound, as (a, na, b, nb, ...)."""
    names = [c for c in rows.columns if c not in key]
    one, two = (rows.withColumnsRenamed({c: x if c == "s" else f"{c}{x}" for c in names}) for x in "ab")
    fits = F.least("na", "nb") * WHOLE >= F.greatest("na", "nb") * PART
    return one.join(two, list(key)).filter(F.expr("a < b and ca <> cb") & fits)


def early(more: int) -> Column:
    """Whether a shared shingle's places (pa, pb) are among those of which two sets like these must share one more than ``more``.

    Two sets share ceil(4(na + nb)/9) shingles or more; the first of them has as many behind it in both.
    """
    need = F.ceil((F.col("na") + F.col("nb")) * PART / (PART + WHOLE))
    return (F.col("pa") <= F.col("na") - need + more) & (F.col("pb") <= F.col("nb") - need + more)


def listed(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """Candidates (a, b) of ``untied`` sets."""
    crowded = F.col("k") >= CROWD
    crowd_of = shared.groupBy("s").agg(F.count(F.when(crowded, 1)).alias("x"))
    calm = meeting(shared.filter(~crowded).join(crowd_of, "s").select("h", "s", "n", "p", "c", "x"), "h")
    # Whatever two sets share beyond the counted shingles is a crowd, or in the rest of one of the sets, of ceil(4n/5) - 1.
    rest = F.ceil(F.greatest("na", "nb") * PART / WHOLE) - 1 + F.least("xa", "xb")
    counted = calm.groupBy("a", "na", "b", "nb", "xa", "xb").agg(F.count(F.lit(1)).alias("common"), F.bool_or(early(0)).alias("early"))
    few = counted.filter(F.col("early") & ((F.col("common") + rest) * (WHOLE + PART) >= (F.col("na") + F.col("nb")) * PART)).select("a", "b")
    crowd = cut_lineage(shared.filter(crowded).select("h", "s", "n", "p", "c"), "similar-crowd")
    firsts = sets.join(hinted(crowd.select("s").distinct(), BROADCAST_ROWS), "s").select("s", "prefix").dropDuplicates(["s"])
    schema = "h bigint, s bigint, n int, c bigint, g bigint, p int"

    def with_second(batches):
        for batch in slices(batches):
            for h, s, n, p, c, first in zip(*(batch.column(k).to_pylist() for k in ("h", "s", "n", "p", "c", "prefix"))):
                second = np.frombuffer(first, np.int64)
                place = np.flatnonzero(second != h)
                same = ((h, np.int64), (s, np.int64), (n, np.int32), (c, np.int64))
                # The later one of both places counts.
                columns = [np.full(len(place), v, t) for v, t in same] + [second[place], np.maximum(place, p).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "s", "n", "c", "g", "p"])

    twice = crowd.join(firsts, "s").select("h", "s", "n", "p", "c", "prefix").mapInArrow(with_second, schema)
    both = meeting(twice, "h", "g").filter(early(1))
    return few.unionByName(both.select("a", "b")).distinct()


def may_be_alike(x: np.ndarray, na: int, y: np.ndarray, nb: int) -> bool:
    """False if the first hashes alone tell that two sets stay below the bound.

    Up to the smaller of the two last hashes both sets are known; after it no more
    can be common than the smaller rest.
    """
    last = min(x[-1], y[-1])
    ca, cb = np.searchsorted(x, last, "right"), np.searchsorted(y, last, "right")
    most = len(np.intersect1d(x[:ca], y[:cb], True)) + min(na - ca, nb - cb)
    return (WHOLE + PART) * most >= PART * (na + nb)


def possible(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that may reach the bound by their first hashes; few others are left."""
    pairs = cut_lineage(pairs, "similar-candidates")
    wanted = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()
    first = cut_lineage(sets.join(hinted(wanted, BROADCAST_ROWS), "s").select("s", "n", "prefix").dropDuplicates(["s"]), "similar-first")

    def compare(batches):
        for batch in slices(batches):
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("x", "y"))
            kept = [may_be_alike(*c) for c in zip(a, batch.column("na").to_pylist(), b, batch.column("nb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one, two = (first.withColumnsRenamed({"s": s, "n": f"n{s}", "prefix": x}) for s, x in ("ax", "by"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(compare, "a bigint, b bigint")


def verified(rows: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst) of the pairs (a, b) that reach the bound on their whole sets."""
    pairs = cut_lineage(possible(sets, pairs), "similar-pairs")
    wanted = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()
    firsts = cut_lineage(sets.select("id", "s").join(hinted(wanted, BROADCAST_ROWS), "s").groupBy("s").agg(F.min("id").alias("id")), "similar-wanted")
    texts = rows.join(hinted(firsts, BROADCAST_ROWS), "id").select("s", "text")

    def compute(batches):
        for batch in slices(batches):
            found = [shingle_set(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(found, pa.binary())], names=["s", "found"])

    whole = cut_lineage(texts.mapInArrow(compute, "s bigint, found binary").dropDuplicates(["s"]), "similar-sets")

    def compare(batches):
        for batch in slices(batches):
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("x", "y"))
            alike = [(WHOLE + PART) * len(np.intersect1d(x, y, True)) >= PART * (len(x) + len(y)) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["src", "dst"]).filter(pa.array(alike, pa.bool_()))

    both = pairs.join(whole.withColumnsRenamed({"s": "a", "found": "x"}), "a").join(whole.withColumnsRenamed({"s": "b", "found": "y"}), "b")
    return cut_lineage(both.mapInArrow(compare, "src bigint, dst bigint"), "similar-links")


def links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst) links between set ids that tie every group of rows with id and text."""
    shared = cut_lineage(shared_shingles(sets), "similar-shared")
    near = verified(rows, sets, starred(shared))
    tied = connected_components(near).withColumnsRenamed({"id": "s", "component": "c"})
    return near.unionByName(verified(rows, sets, listed(sets, untied(shared, tied))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row; the component is the smallest id that links reach. Equal ids must have equal texts."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = cut_lineage(sets_of(rows, frequent_shingles(rows)), "similar")
    firsts = sets.groupBy("s").agg(F.min("id").alias("first"))
    clusters = cut_lineage(connected_components(links(rows, sets)).withColumnRenamed("id", "s"), "similar-clusters")
    smallest = firsts.join(clusters, "s").groupBy("component").agg(F.min("first").alias("component_id"))
    by_set = clusters.join(smallest, "component").select("s", "component_id")
    # A table of its own, so that the last join reads two plain shuffles and Spark can split a hot set.
    known = cut_lineage(firsts.join(by_set, "s", "left").select("s", F.coalesce("component_id", "first").alias("component_id")), "similar-ids")
    return sets.select("id", "s").join(known, "s").select(F.col("id").alias(id_col), "component_id")
