"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Rows of equal text form a group that stays whole. Differencing starts from one
partial partition for each item, in which that item stands alone; again and
again the two partial partitions of the widest spread are combined, the largest
part of the one with the smallest of the other, until one is left.

Groups above a fixed share of all bytes are items of their own; there are
fewer of them than that share allows. The others are gathered by hash
into at most ``bundles`` bundles, so that the items that are differenced are
bounded whatever the data, and many enough to leave a spread far below one
bundle. Only their sizes come to the driver.

Slots count the rows of a shard: each shard is cut by hash into buckets of
about ``bucket_rows`` rows, numbered on their own, and the buckets' counts are
summed up; rows equal in id and text are counted together, so that no group of
copies meets in one task.

Defined results: null text has size 1 and crc32 0 and is a group of its own,
apart from empty text; rows equal in id and text get slots one after the other;
null ids come first in a bucket; without rows there are no shards. Other columns
than id and text are not read.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.session import cut_lineage

#: Items that are differenced on the driver: bundles, and at most as many large groups.
BUNDLES = 16_384
#: Equal rows that are listed from one row.
CHUNK = 10_000


def differenced(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, by differencing."""
    order = count()
    # A partial partition: its parts' sizes in ascending order and, for each part, a tree of items.
    heap = [(-size, next(order), [0] * (shards - 1) + [size], [None] * (shards - 1) + [i]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, sums, trees = heapq.heappop(heap)
        _, _, other_sums, other_trees = heapq.heappop(heap)
        parts = [(a + b, k) for k, (a, b) in enumerate(zip(sums, reversed(other_sums)))]
        parts.sort()
        merged = [(trees[k], other_trees[shards - 1 - k]) for _, k in parts]
        sums = [s for s, _ in parts]
        heapq.heappush(heap, (sums[0] - sums[-1], next(order), sums, merged))
    found = [0] * len(sizes)
    if heap:
        for shard, tree in enumerate(heap[0][3]):
            stack = [tree]
            while stack:
                node = stack.pop()
                if type(node) is tuple:
                    stack.extend(node)
                elif node is not None:
                    found[node] = shard
    return found


def counted_most(rows: DataFrame) -> int:
    return rows.agg(F.max("copies")).first()[0] or 0


def assign(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    bundles: int = BUNDLES,
    bucket_rows: int = 100_000,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = docs.sparkSession
    text = F.col(text_col)
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("crc"),
            # 128 bits of the text; a null is not the empty text.
            F.xxhash64(F.lit(1), text.isNull(), raw).alias("h1"),
            F.xxhash64(F.lit(2), text.isNull(), raw).alias("h2"),
        )
        .groupBy("id", "size", "crc", "h1", "h2")
        .agg(F.count(F.lit(1)).alias("copies")),
        "sized",
    )
    groups = cut_lineage(
        rows.groupBy("h1", "h2").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows")), "text-groups"
    )
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    # Fewer than ``bundles`` groups can be above this size.
    large = F.col("bytes") > (total["bytes"] or 0) / bundles
    item = F.when(large, F.concat_ws(":", F.hex("h1"), F.hex("h2"))).otherwise(F.pmod(F.xxhash64("h1", "h2", F.lit(3)), F.lit(bundles)).cast("string"))
    items = [(r["item"], r["bytes"]) for r in groups.groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "item").collect()]
    placed = differenced([size for _, size in items], shards)
    # At most twice ``bundles`` rows, by the two bounds above.
    by_item = F.broadcast(spark.createDataFrame([(name, shard) for (name, _), shard in zip(items, placed)], "item string, shard int"))
    by_group = groups.select("h1", "h2", item.alias("item")).join(by_item, "item").select("h1", "h2", "shard")
    sharded = rows.join(by_group, ["h1", "h2"])

    buckets = max(1, -(-(total["rows"] or 0) // (shards * bucket_rows)))
    sharded = cut_lineage(sharded.withColumn("bucket", F.pmod(F.xxhash64("id", "h1", "h2", F.lit(4)), F.lit(buckets))), "sharded")
    counted = sharded.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    # One row for each bucket: a table as small as the data over ``bucket_rows``.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sharded.withColumn("own", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(starts, ["shard", "bucket"])
    # Copies of one row are listed in chunks, so that no row carries more than one chunk; many chunks are spread first.
    at = F.col("start") + F.col("own")
    last = at + F.col("copies") - 1
    chunks = numbered.withColumn("last", last).withColumn("at", F.explode(F.sequence(at, last, F.lit(CHUNK).cast("long"))))
    if (total["rows"] or 0) and counted_most(sharded) > bucket_rows:
        chunks = chunks.repartition("shard", "bucket", "at")
    slot = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + CHUNK - 1, F.col("last"))))
    return chunks.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
