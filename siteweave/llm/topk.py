"""Exact top-k search by inner product, with a pivot table.

Components become whole numbers, floor(scale * x). A few rows far apart are
pivots; the table holds every row's distance to each of them. For a query q and
a row x the triangle inequality bounds their distance from below by the largest
difference of their distances to a pivot, and with the vectors' lengths that
bounds their inner product from above. Rows are evaluated in the order of their
bounds until no bound that is left reaches the k-th score found.

Queries and rows are dealt into blocks; each pair of a query block and a row
block is a task of bounded size that returns k rows for each query, and the
best k of all blocks are kept. Queries are a stated set, so this is no join of
all rows with all rows.

Defined results: vectors that are null, empty, or hold null or non-finite
components, and rows of null id, take no part; queries meet rows of their own
length only; rows equal in id and vector count once; rows that share an id with
the query are the query's own and no candidates; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.common import ship
from siteweave.session import cut_lineage

#: Rows among which the pivots are chosen, and the number of pivots; the table itself covers every row.
PIVOT_SAMPLE = 2000
PIVOTS = 24
#: Rows whose exact scores are computed in one step.
STEP = 64

FOUND = "query_id bigint, vec_id bigint, score bigint"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, size, v) of the rows that take part, each once."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.filter(F.coalesce(fit, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("size"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
        .distinct()
    )


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample chosen one by one as the farthest from those chosen before."""
    chosen = [int(np.argmax(((sample - sample.mean(0)) ** 2).sum(1)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; in floating point where that is exact, else in whole numbers."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * rows.shape[1]
    if bound < 2.0**53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return rows @ query


def search_block(ids: np.ndarray, rows: np.ndarray, table: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_table: np.ndarray, k: int):
    """The k best rows of a block for each query as (query, row, score), and how many rows were evaluated."""
    length = (rows.astype(np.float64) ** 2).sum(1)
    out, evaluated = [], 0
    for qid, query, own in zip(query_ids.tolist(), queries, query_table):
        low = np.abs(table - own).max(1)
        reach = (query.astype(np.float64) ** 2).sum() + length
        # The slack covers the rounding of the distances.
        bound = (reach - low * low) / 2 + 1e-9 * reach + 1
        bound[ids == qid] = -np.inf
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # The highest bounds first; they give the score that most other bounds do not reach.
        step = np.argpartition(-bound, STEP)[:STEP] if len(rows) > STEP else np.arange(len(rows))
        left, order = np.ones(len(rows), bool), None
        left[step] = False
        while len(step):
            step = step[bound[step] > -np.inf]
            evaluated += len(step)
            best_ids, best = np.concatenate((best_ids, ids[step])), np.concatenate((best, exact_scores(rows[step], query)))
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
            least = best[-1] if len(best) == k else -np.inf
            if order is None:
                order = np.flatnonzero(left & (bound >= least) & (bound > -np.inf))
                order = order[np.argsort(-bound[order], kind="stable")]
            step, order = order[: 8 * STEP], order[8 * STEP :]
            # Bounds fall from here on: one below the k-th score ends the search. Equal ones may tie.
            step = step[bound[step] >= least]
        out += [(qid, i, s) for i, s in zip(best_ids.tolist(), best.tolist())]
    return out, evaluated


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    row_block: int = 20_000,
    query_block: int = 1_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the highest inner products for each query.

    ``is_query`` is a condition over the id column, given as column ``id``.
    """
    spark = rows.sparkSession
    ship(spark)
    vectors = cut_lineage(whole_vectors(rows, id_col, vector_col, scale), "vectors")
    sizes = vectors.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).orderBy("size").collect()
    found = None
    for own in sizes:
        if own["q"]:
            part = _search_size(vectors.filter(F.col("size") == own["size"]), is_query, k, own["n"], own["q"], row_block, query_block)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_size(vectors: DataFrame, is_query: Column, k: int, n: int, q: int, row_block: int, query_block: int) -> DataFrame:
    """The search among the vectors of one length."""
    spark = vectors.sparkSession
    share = min(1.0, PIVOT_SAMPLE / n)
    sample = vectors.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * share)).select("id", "v").orderBy("id").limit(PIVOT_SAMPLE).collect()
    points = np.array([r["v"] for r in sample] or [vectors.select("v").first()["v"]], np.float64)
    sent = spark.sparkContext.broadcast(far_apart(points, PIVOTS))
    row_blocks, query_blocks = -(-n // row_block), -(-q // query_block)
    tabled = vectors.select("id", "v")

    def pivot_table(batches):
        for frame in batches:
            table = distances(np.array(frame["v"].tolist(), np.float64).reshape(len(frame), -1), sent.value)
            yield frame.assign(d=list(table))

    tabled = tabled.mapInPandas(pivot_table, "id bigint, v array<bigint>, d array<double>")
    block = lambda blocks, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = tabled.withColumn("rb", block(row_blocks, 1)).withColumn("qb", every(query_blocks))
    queries = tabled.filter(is_query).withColumn("qb", block(query_blocks, 2)).withColumn("rb", every(row_blocks))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        left = left.sort_values("id", kind="stable")
        matrix = lambda frame: (np.stack(frame["v"].to_numpy()).astype(np.int64), np.stack(frame["d"].to_numpy()))
        rows_v, rows_d = matrix(left)
        query_v, query_d = matrix(right)
        found, _ = search_block(left["id"].to_numpy(), rows_v, rows_d, right["id"].to_numpy(), query_v, query_d, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    return rows.groupBy("rb", "qb").cogroup(queries.groupBy("rb", "qb")).applyInPandas(both, FOUND)
