"""Merkle manifest of a data set by nested-interval labels.

Rows become leaves; the leaves of a source, ordered by id, get ranks. Every node is
labelled with the interval ``[lo, hi)`` of leaf ranks that it covers, so that kinship
is arithmetic: an ancestor's interval contains a node's, and a parent's interval less
the node's own is covered by its siblings. Three consecutive nodes make a parent until
one is left, the source's subroot; the subroots make the root in the same way.

How it runs:

1. Ranks come from a range partitioning by source and id, numbered inside each
   partition, plus the counts of earlier partitions; no source is sorted in one task.
2. Nodes climb ``STRATUM`` levels for each shuffle: rows meet by the interval of the
   ancestor at the stratum's top (81 nodes), inside which windows over ever wider
   buckets collect a parent's children, at most ``FANOUT`` each.
3. From the top down, each stratum's rows are joined with the stratum above on
   (source, bucket of that level), where one interval contains the other, and take over
   the path found there. A key holds 81 rows at most, so a hot source is no hot key.

Defined results: null fields enter the hash as ``-``; rows of equal id are ordered by
their leaf, null ids come first; equal rows are leaves of their own with equal digests;
an only leaf of an only source is the root and has the proof of the empty text; an empty
table gives no rows. For tampering, a null id counts as empty text. Only the named
columns are read, so that others do no harm by their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.session import cut_lineage

FANOUT = 3
#: Levels that one shuffle climbs.
STRATUM = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it enters a leaf: its length in bytes and its text, so that no two rows read the same."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    return digest(F.concat(*map(field, fields)))


def source_key(source: Column) -> Column:
    """A source as text that is never null and sorts by bytes, null first."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def ranked(rows: DataFrame) -> DataFrame:
    """Rows of (source, key, digest, row) as leaves: (source, lo, hi, total, digest, row), ranked by key inside each source."""
    order = ["source", "key", "digest"]
    numbered = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "merkle-order"
    )
    # The id is the partition's number above 33 bits that count its rows.
    part = F.shiftright("at", 33).alias("part")
    runs = numbered.groupBy("source", part).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy("source")
    earlier = same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("source", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start")).alias("shift"), F.sum("n").over(same).alias("total"))
    placed = numbered.withColumn("part", part).join(starts, ["source", "part"])
    lo = F.col("at") + F.col("shift")
    return placed.select("source", lo.alias("lo"), (lo + 1).alias("hi"), "total", "digest", "row")


def depth(total: Column, fanout: int) -> Column:
    """Levels above the leaves until one node is left."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(F.lit(p).cast("bigint"))
        p *= fanout
    return F.size(F.filter(F.array(*powers), lambda x: x < total))


def bucket(column: str, level: int, fanout: int) -> Column:
    """The number of the interval of a level that a rank lies in."""
    return F.expr(f"{column} div {fanout**level}L")


def climbed(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """Nodes of ``level`` with the steps to their ancestor ``STRATUM`` levels above, and that ancestor as (top_lo, top_hi, top)."""
    levels = range(level, level + STRATUM)
    widest = level + STRATUM
    rows = nodes.withColumns({f"b{k + 1}": bucket("lo", k + 1, fanout) for k in levels})
    rows = rows.repartition("source", f"b{widest}").withColumns(
        {"height": depth(F.col("total"), fanout), "top_lo": F.col("lo"), "top_hi": F.col("hi"), "top": F.col("digest")}
    )
    for k in levels:
        # Widest bucket first: all windows share one shuffle and one sort.
        family = Window.partitionBy("source", *(f"b{j}" for j in range(widest, k, -1)))
        rows = rows.withColumn("kids", F.array_sort(F.collect_set(F.struct(F.col("top_lo").alias("lo"), F.col("top_hi").alias("hi"), F.col("top").alias("digest"))).over(family)))
        joined = lambda kids: F.array_join(F.transform(kids, lambda x: x["digest"]), "")
        # The parent's interval less the own one, on either side.
        step = F.struct(
            joined(F.filter("kids", lambda x: x["hi"] <= F.col("top_lo"))).alias("left"),
            joined(F.filter("kids", lambda x: x["lo"] >= F.col("top_hi"))).alias("right"),
        )
        below = F.lit(k) < F.col("height")
        # In a projection of its own: names inside a lambda also see aliases that stand beside it.
        rows = rows.withColumn(f"step{k}", F.when(below, step)).withColumns(
            {
                "top": F.when(below, digest(joined(F.col("kids")))).otherwise(F.col("top")),
                "top_lo": F.when(below, F.element_at("kids", 1)["lo"]).otherwise(F.col("top_lo")),
                "top_hi": F.when(below, F.element_at("kids", -1)["hi"]).otherwise(F.col("top_hi")),
            }
        )
    steps = F.filter(F.array(*(f"step{k}" for k in levels)), lambda x: x.isNotNull())
    return rows.select(*nodes.columns, "top_lo", "top_hi", "top", steps.alias("path"))


def strata(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The climbed nodes of each stratum, as written tables; the tops of the last are one for each source."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    found, level, nodes = [], 0, leaves
    while True:
        found.append(cut_lineage(climbed(nodes, level, fanout), f"merkle-{level}"))
        level += STRATUM
        if fanout**level >= most:
            return found
        nodes = found[-1].filter("lo = top_lo").select("source", "lo", F.col("top_hi").alias("hi"), "total", F.col("top").alias("digest"))


def descended(found: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """The leaves with their whole paths: each stratum takes over what the ancestor above it has.

    ``above`` has the columns (source, rest, subroot, root): what follows the path inside each source.
    """
    rows = found[-1].join(above, "source").withColumn("path", F.concat("path", "rest")).drop("rest")
    for n in range(len(found) - 2, -1, -1):
        level = (n + 1) * STRATUM
        upper = rows.select("source", F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("path").alias("rest"), "subroot", "root")
        upper = cut_lineage(upper, f"merkle-paths-{level}").withColumn("bucket", bucket("up_lo", level, fanout))
        rows = (
            found[n]
            .withColumn("bucket", bucket("lo", level, fanout))
            .join(upper, ["source", "bucket"])
            .filter("up_lo <= lo and hi <= up_hi")
            .withColumn("path", F.concat("path", "rest"))
            .drop("bucket", "up_lo", "up_hi", "rest")
        )
    return rows


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Rows of (source, key, digest, row) with their place in the tree.

    ``source`` must not be null (``source_key``); ``row`` passes through. Gives (source, rank,
    digest, row, path, subroot, root); ``path`` lists from the leaf to the root what stands to
    the ``left`` and to the ``right`` of the node at each level, as hex digests without a gap.
    """
    trees = strata(ranked(leaves), fanout)
    tops = trees[-1].filter("lo = top_lo").select("source", F.col("top").alias("subroot"))
    # The sources' tree: one leaf for each source.
    over = strata(ranked(tops.select(F.lit("").alias("source"), F.col("source").alias("key"), F.col("subroot").alias("digest"), F.struct(F.col("source").alias("of")).alias("row"))), fanout)
    root = over[-1].filter("lo = top_lo").select("source", F.array().cast("array<struct<left:string,right:string>>").alias("rest"), F.lit("").alias("subroot"), F.col("top").alias("root"))
    above = descended(over, root, fanout).select(F.col("row.of").alias("source"), F.col("path").alias("rest"), F.col("digest").alias("subroot"), "root")
    placed = descended(trees, cut_lineage(above, "merkle-sources"), fanout)
    return placed.select("source", F.col("lo").alias("rank"), "digest", "row", "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def without_line_ends(doc_id: Column, text: Column) -> Column:
    """Tampering: every second document, by a hash of its id, loses its line ends; null texts stay."""
    chosen = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return F.when(chosen, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verified_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, rank, path, subroot, root, folded_root, verified) of every row.

    ``folded_root`` is folded from the tampered row's leaf, ``verified`` tells whether it is the root.
    """
    tampered = without_line_ends(docs[id_col], docs[text_col])
    changed = F.contains(docs[text_col], F.lit("\n")) & (tampered != docs[text_col])
    other = leaf_of([tampered if c == text_col else docs[c] for c in fields])
    rows = docs.select(docs[id_col].alias("id"), source_key(docs[source_col]).alias("source"), leaf_of([docs[c] for c in fields]).alias("digest"), F.when(changed, other).alias("other"))
    leaves = cut_lineage(rows, "merkle-leaves").select("source", F.col("id").alias("key"), "digest", F.struct("id", "other").alias("row"))
    placed = manifest(leaves, fanout).withColumn("folded_root", folded(F.coalesce("row.other", "digest"), F.col("path")))
    return placed.select(
        F.col("row.id").alias(id_col),
        F.col("digest").alias("leaf"),
        "rank",
        "path",
        "subroot",
        "root",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
