"""Benchmark decontamination by spaced seeds.

A document holds a leak of a benchmark item if some window of ``WINDOW`` words of
the item (all of it, if it is shorter) stands in the document in a row, with up
to one word in six replaced. Spaced seeds are fixed masks over a few word
places: two texts that agree on a mask's places share its hash, whatever stands
on the places between. The masks below leave no window out: wherever the
replaced words stand, one of the masks fits between them. The hashes of all
windows of the documents meet those of the benchmark; around every hit the
document and the item are laid side by side and the windows verified word by
word.

Words are runs of letters, digits and underscores in lower case. Items of fewer
than ``MIN_WORDS`` words tell nothing about a leak and are left out.

The benchmark is dealt by hash into blocks of at most about ``block_words``
words; each block's table is sent to all tasks and the documents pass them one
after the other, so nothing that is sent grows with the data.

Defined results: null and empty texts hold no leaks; null benchmark texts are
left out; repeated rows get repeated results; repeated items are all named; a
null item id is not named but counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import ship, slices, unused

WINDOW = 13
MIN_WORDS = 5
#: Words whose numbers a task keeps; it starts anew when full.
CACHE_WORDS = 100_000

# Word places of the masks, by the smallest window that they leave
# no case out of. Found by search; tests/llm tries all cases.
MASKS = {
    5: ((0, 1, 2, 3, 4),),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    12: ((0, 1, 4, 7, 9), (0, 1, 3, 5, 6)),
    13: ((0, 2, 3, 7, 8, 10), (0, 1, 2, 3, 5, 6)),
}

WORD = re.compile(r"\w+")


def replaced(window: int) -> int:
    """Words of a window that may differ."""
    return window // 6


def masks(window: int) -> tuple[tuple[int, ...], ...]:
    return MASKS[max(k for k in MASKS if k <= window)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Benchmark:
    """Items as word numbers, and for each mask the sorted hashes of their windows."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.number[w] for w in ws], np.int64) for _, ws in items]
        draw = np.random.default_rng(17)
        self.values = draw.integers(1, 1 << 63, len(self.number) + 1, dtype=np.uint64)
        self.factors = draw.integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        places: dict[tuple[int, ...], list[int]] = {}
        for k, item in enumerate(self.items):
            for mask in masks(min(len(item), WINDOW)):
                places.setdefault(mask, []).append(k)
        self.tables = []
        for mask, members in places.items():
            hashes = [self.hashes(self.items[k], mask) for k in members]
            where = [np.stack([np.full(len(h), k), np.arange(len(h))], 1) for k, h in zip(members, hashes)]
            hashes, where = np.concatenate(hashes), np.concatenate(where)
            order = np.argsort(hashes, kind="stable")
            hashes, where = hashes[order], where[order]
            seen = np.zeros(1 << 22, bool)
            seen[hashes >> np.uint64(42)] = True
            self.tables.append((mask, hashes, where, seen))

    def hashes(self, numbers: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        """The mask's hash at each place where it fits."""
        n = len(numbers) - mask[-1]
        if n <= 0:
            return np.zeros(0, np.uint64)
        values = self.values[numbers]
        total = np.zeros(n, np.uint64)
        for k, p in enumerate(mask):
            total += values[p : p + n] * self.factors[k]
        return total

    def leaks(self, numbers: np.ndarray) -> list[tuple[int | None, int, int]]:
        """(item, first word, last word + 1) of each stretch of verified windows."""
        pairs: set[tuple[int, int]] = set()
        for mask, hashes, where, seen in self.tables:
            own = self.hashes(numbers, mask)
            at = np.flatnonzero(seen[own >> np.uint64(42)])
            if not len(at):
                continue
            low, high = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
            for i, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                for k, p in where[a:b].tolist():
                    pairs.add((k, i - p))
        return [leak for k, shift in sorted(pairs) for leak in self.verified(numbers, k, shift)]

    def verified(self, numbers: np.ndarray, k: int, shift: int) -> list[tuple[int | None, int, int]]:
        item = self.items[k]
        window = min(len(item), WINDOW)
        low, high = max(0, -shift), min(len(item), len(numbers) - shift)
        if high - low < window:
            return []
        same = np.concatenate(([0], np.cumsum(item[low:high] == numbers[low + shift : high + shift])))
        starts = np.flatnonzero(same[window:] - same[:-window] >= window - replaced(window))
        if not len(starts):
            return []
        parts = np.split(starts, np.flatnonzero(np.diff(starts) > window) + 1)
        return [(self.ids[k], int(s[0]) + low + shift, int(s[-1]) + low + shift + window) for s in parts]


class Reader:
    """Word numbers of texts, 0 for words outside the benchmark, with a cache of white-space words."""

    def __init__(self, benchmark: Benchmark):
        self.number = benchmark.number
        self.known: dict[str, list[int]] = {}

    def numbers(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, get, out = self.known, self.number.get, []
        for word in text.lower().split() if text else ():
            found = known.get(word)
            if found is None:
                found = [get(w, 0) for w in WORD.findall(word)]
                if len(word) < 64:
                    known[word] = found
            out += found
        return np.array(out, np.int64)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """The benchmark's items in blocks that fit into a task."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-size // (5 * block_words)))
    for k in range(count):
        own = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).collect()
        items = [(r["id"], words_of(r["text"])) for r in sorted(own, key=lambda r: (r["id"] is not None, r["id"] or 0, r["text"]))]
        items = [(i, ws) for i, ws in items if len(ws) >= MIN_WORDS]
        if items:
            yield Benchmark(items)


LEAKS = "array<struct<item:{kind},start:bigint,stop:bigint>>"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    into: str = "leaks",
    block_words: int = 2_000_000,
) -> DataFrame:
    """The documents with their columns and ``into``: an array of (item, start, stop) in words; it replaces a column of that name."""
    spark = docs.sparkSession
    ship(spark)
    kind = benchmark.schema[item_col].dataType.simpleString()
    found = docs.withColumn(into, F.array().cast(LEAKS.format(kind=kind)))
    for block in blocks(benchmark, item_col, item_text_col, block_words):
        found = _passed(found, spark.sparkContext.broadcast(block), text_col, into)
    return found


def _passed(docs: DataFrame, sent, text_col: str, into: str) -> DataFrame:
    text_at, into_at = docs.columns.index(text_col), docs.columns.index(into)

    def run(batches):
        benchmark = sent.value
        reader = Reader(benchmark)
        for batch in slices(batches):
            before = batch.column(into_at)
            leaks = [benchmark.leaks(reader.numbers(t)) for t in batch.column(text_at).to_pylist()]
            if any(leaks):
                rows = [[*old, *({"item": i, "start": a, "stop": b} for i, a, b in new)] for old, new in zip(before.to_pylist(), leaks)]
                batch = batch.set_column(into_at, batch.schema.field(into_at), pa.array(rows, before.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def item_list(leaks: str | Column) -> Column:
    """The items named in an array of leaks, each once, in order."""
    return F.array_sort(F.array_compact(F.array_distinct(F.transform(leaks, lambda x: x["item"]))))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with their columns whatever their names, that hold no leak."""
    into = unused("leaks", docs.columns)
    return find_leaks(docs, benchmark, into=into, **options).filter(F.size(into) == 0).drop(into)
