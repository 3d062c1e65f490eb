"""Connected components of an edge table, by alternating star contractions.

Each round re-points every edge at the smallest neighbour seen (Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014). A round is an aggregation
with map-side combine and one join, so a hub with a large part of all edges costs
no more than its rows. Each round is written to the shared folder, which cuts its lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siteweave.session import cut_lineage

MAX_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    smallest = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("root"))
    return (
        both.filter("dst > src")
        .join(smallest, "src")
        .select(F.col("dst").alias("src"), F.col("root").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    smallest = down.groupBy("src").agg(F.min("dst").alias("root"))
    moved = down.join(smallest, "src").select(F.col("dst").alias("src"), F.col("root").alias("dst"))
    own = smallest.select("src", F.col("root").alias("dst"))
    return moved.unionByName(own).filter("src <> dst").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with an order-free digest taken during the write.

    Equal digests mean that a round changed nothing.
    """
    mixed = F.xxhash64("src", "dst")
    seen = Observation()
    marked = edges.observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.sum(mixed.cast("decimal(38,0)")).alias("total"),
        F.bit_xor(mixed).alias("mix"),
    )
    table = cut_lineage(marked, "edges")
    return table, tuple(sorted(seen.get.items()))


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, component) for every node with an edge; the component is its smallest id.

    ``edges`` has the columns ``src`` and ``dst``. Loops and repeats are allowed.
    """
    current, seen = _written(edges.select("src", "dst").filter("src <> dst").distinct())
    for _ in range(max_rounds):
        current, digest = _written(_small_star(_large_star(current)))
        if digest == seen:
            members = current.select(F.col("src").alias("id"), F.col("dst").alias("component"))
            roots = current.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
            return members.unionByName(roots)
        seen = digest
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


@dataclass(frozen=True)
class Growth:
    """What new edges change in a table of components.

    ``contracted`` (id, component): the components that the edges touch, by their old
    names and the nodes that are new. ``nodes`` (id, component): the new nodes.
    ``renamed`` (component, into): the old components that went into another.
    """

    contracted: DataFrame
    nodes: DataFrame
    renamed: DataFrame


def grow(edges: DataFrame, known: DataFrame) -> Growth:
    """Adds edges (src, dst) to components that are known.

    ``known`` (id, component) must hold the nodes of the edges that have a component, and need hold
    no others: ends of edges are replaced by their components, and the small graph
    between these and the new nodes is contracted. A component's name stays the smallest
    of all its ids, so that edges in any order give the components of one run.
    """
    edges = cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct(), "grow-edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    names = cut_lineage(ends.join(known.select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("name"), F.col("component").isNull().alias("new")), "grow-names")
    mapped = edges
    for end in ("src", "dst"):
        mapped = mapped.join(names.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")), end)
    between = connected_components(mapped.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst")))
    # A component all of whose new edges lie inside it is touched, but has no edge left.
    touched = names.select(F.col("name").alias("id")).distinct()
    contracted = cut_lineage(touched.join(between, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "grow-contracted")
    new = names.filter("new").select("id")
    nodes = contracted.join(new, "id")
    renamed = contracted.join(new, "id", "left_anti").filter("id <> component").select(F.col("id").alias("component"), F.col("component").alias("into"))
    return Growth(contracted, nodes, renamed)
