"""URL rules by a cascade of Bloom filters.

A rule is a host and a path; it fits a url whose host is the rule's or below it
and whose path starts with the rule's. So the rules that can fit a url are known
from the url alone: its host's last labels with the beginnings of its path. Each
of these keys is looked up in a cascade that answers exactly for every key of
the corpus:

* level 1 is a Bloom filter of the listed keys,
* level 2 holds the corpus's unlisted keys that pass level 1,
* level 3 holds the listed keys that pass level 2, and so on until none is left.

A key is listed if the first level that it misses is an even one. Building
it compares keys with the list; judging urls takes only the levels' bits, so
no url is ever joined. The first level is sized so that about as many unlisted
keys pass as are listed, the others pass half, so all levels together grow with
the list and, by its logarithm, with the corpus. Their size is checked before
they are built: a list whose first level would take more than ``max_bytes`` is
joined with the corpus's distinct hosts and paths instead.

Keys that no rule lists mean ``allow``: it is a list of what is blocked.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; repeated rows get repeated results; of a rule
listed twice the first stands; the rule of the longest host wins, then the one
of the longest path. Other columns than id and url are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.session import cut_lineage

# The rules of the standing filter, as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels; each halves the keys that are left, so that this many mean a broken hash.
MAX_LEVELS = 64


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(verdict, rule, host, path); the path starts at the rule's first slash."""
    rows = [(k, v, r, r.split("/", 1)[0].translate(str.maketrans(UPPER, LOWER)), "/" + r.split("/", 1)[1] if "/" in r else "") for k, (v, r) in enumerate(rules)]
    return spark.createDataFrame(rows, "n long, verdict string, rule string, host string, path string")


def key_of(host: Column, path: Column) -> Column:
    """Host and path in one text; neither holds the blank line between them, for a host ends at the first slash."""
    return F.concat(host, F.lit("\n"), path)


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys of rules that fit, longest host first, then longest path."""
    hosts = [F.substring_index(host, ".", -n) for n in sorted(labels, reverse=True)]
    parts = sorted(lengths, reverse=True)
    keys = [F.when(F.length(path) >= n, key_of(h, F.substring(path, 1, n))) for h in hosts for n in parts]
    return F.array_distinct(F.array_compact(F.array(*keys)))


@dataclass
class Level:
    bits: bytes
    size: int
    probes: int
    seed: int


def probes(key: Column, level: int, size: int, count: int) -> list[Column]:
    """Bit places of a key: two hashes, stepped."""
    a = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(size))
    b = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(size))
    return [F.pmod(a + b * i, F.lit(size)) for i in range(count)]


def passes(key: Column, level: Level) -> Column:
    """True if all of the key's bits are set; the level's bits are one constant of the plan."""
    bits = F.lit(level.bits)

    def bit(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1

    out = F.lit(True)
    for at in probes(key, level.seed, level.size, level.probes):
        out &= bit(at)
    return out


def build_level(keys: DataFrame, count: int, pass_rate: float, seed: int) -> Level:
    """A Bloom filter of the column ``key``; its bytes are put together by aggregation."""
    count_probes = max(1, round(-math.log2(pass_rate)))
    size = max(64, 8 * math.ceil(count * count_probes / math.log(2) / 8))
    at = F.explode(F.array(*probes(F.col("key"), seed, size, count_probes)))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 3).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("at").bitwiseAND(7).cast("int"))).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in words:
        out[r["byte"]] = r["bits"]
    return Level(out.tobytes(), size, count_probes, seed)


def first_rate(listed: int, others: int) -> float:
    """The share of unlisted keys that level 1 lets pass."""
    return min(0.5, listed / max(others, 1) / math.sqrt(2))


def build_cascade(listed: DataFrame, universe: DataFrame, others: int) -> list[Level]:
    """Levels that answer exactly for every ``key`` of the universe of ``others`` keys. Both tables hold distinct keys."""
    n = listed.count()
    if not n:
        return []
    levels: list[Level] = []
    inside = listed
    outside = cut_lineage(universe.join(listed, "key", "left_anti"), "unlisted")
    while len(levels) < MAX_LEVELS:
        first = not levels
        rate = first_rate(n, others) if first else 0.5
        level = build_level(inside, n, rate, len(levels) + 1)
        levels.append(level)
        wrong = cut_lineage(outside.filter(passes(F.col("key"), level)), "passed")
        count = wrong.count()
        if not count:
            return levels
        inside, outside, n = wrong, inside, count
    raise RuntimeError(f"the cascade did not settle in {MAX_LEVELS} levels")


def listed_by(key: Column, levels: list[Level]) -> Column:
    """Exact membership for keys of the universe: the number of levels passed in a row is odd."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(passes(key, levels[k]), out).otherwise(F.lit(k % 2 == 1))
    return out


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", max_bytes: int = 32 << 20) -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    spark = pages.sparkSession
    listed = rule_table(spark, rules).withColumn("key", key_of(F.col("host"), F.col("path")))
    listed = listed.groupBy("key").agg(F.min_by(F.struct("verdict", "rule", "host", "path"), "n").alias("r")).select("key", "r.*")
    shapes = listed.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()
    judged = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not shapes["labels"]:
        return judged.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), shapes["labels"], shapes["lengths"])
    n = listed.count()
    universe = cut_lineage(judged.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    others = universe.count()
    if n * max(1.0, -math.log2(first_rate(n, others))) / math.log(2) / 8 > max_bytes:
        return _judged_by_join(judged, keys, listed).withColumnRenamed("id", id_col)
    judged = judged.withColumn("keys", keys)
    for verdict in ("block", "allow"):
        cascade = build_cascade(listed.filter(F.col("verdict") == verdict).select("key"), universe, others)
        judged = judged.withColumn(verdict, first_listed(F.col("keys"), cascade, len(shapes["labels"]) * len(shapes["lengths"])))
    at = {v: F.array_position("keys", F.col(v)) for v in ("block", "allow")}
    blocked = F.col("block").isNotNull() & (F.col("allow").isNull() | (at["block"] < at["allow"]))
    rule = F.replace(F.when(blocked, F.col("block")).otherwise(F.col("allow")), F.lit("\n"), F.lit(""))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict")
    )


def _judged_by_join(judged: DataFrame, keys: Column, listed: DataFrame) -> DataFrame:
    """The same by a join, for lists too long to send."""
    places = judged.select("host", "path").distinct().select("host", "path", F.posexplode(keys).alias("at", "key"))
    best = places.join(listed.select("key", "verdict", "rule"), "key").groupBy("host", "path").agg(F.min(F.struct("at", "rule", "verdict")).alias("r"))
    return judged.join(best, ["host", "path"], "left").select(
        "id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit("allow")).alias("verdict")
    )


def first_listed(keys: Column, cascade: list[Level], most: int) -> Column:
    """The first key of the array that the cascade lists."""
    out = F.lit(None).cast("string")
    for k in range(most, 0, -1):
        key = F.try_element_at(keys, F.lit(k))
        out = F.when(key.isNotNull() & listed_by(key, cascade), key).otherwise(out)
    return out
