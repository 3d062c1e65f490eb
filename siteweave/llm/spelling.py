"""Spelling variants of a corpus's words, grouped by a dynamic program over sorted lists.

Two words are near if one inserted, deleted or replaced character makes them equal. The
sorted list of words is read as prefix ranges. For each word, the row of the edit matrix
that belongs to a prefix is computed once for all words that share it (neighbours in the
list share their longest common prefix), only the three cells of the band around the
diagonal are kept, and a range is skipped as soon as its prefix is more than one edit
away from the word's. The rows of all words of a list are kept as arrays and taken one
character further together, so the work follows the cells that stay within one edit.

The list is dealt to tasks without losing a pair:

1. One edit leaves the part before it and the part after it as they are. Words that agree
   in their first ``HEAD`` characters meet in a list sorted from the front; words that
   differ before that agree in their last ``TAIL`` ones, and meet in a list of the words
   read backwards, where all but the last few characters must then agree exactly.
2. A group of more than ``most`` words is divided by one more character, again and again.
   Pairs whose edit lies inside both a divided head and a divided tail are found by
   equality: the word with its edit's place cut out is the key (``cut_out``), which at
   most one word for each letter shares.

Each pair is found in exactly one of the three ways, so counts add up. What is left of a
pair outside its task is, for each word, the number of near words and the best of them.

Defined results: null texts have no words; a null id counts as empty text; equal rows
count as often as they occur; no words give no rows. A word's form is its near word of
the largest count, ties by code points, if that count is ``factor`` times its own. Other
columns are not read, so that names that clash do no harm.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siteweave.llm.common import hinted, ship, slices
from siteweave.session import cut_lineage

#: Code points of the shortest word.
SHORTEST = 7
#: First and last characters of which two near words share one kind.
HEAD, TAIL = 4, 3
#: Words of a group that one task takes as one list.
MOST = 100_000
#: Words that are scanned together, and of these the ones whose rows are kept at once.
TOGETHER, AT_ONCE = 50_000, 10_000
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Bytes of a text that are searched at once.
WINDOW = 1 << 20
#: Divided heads and tails that may be sent to all tasks.
SENT = 100_000
#: One in so many words loses a character (``misspelt``).
EVERY = 31

# The letters are the one-byte characters of Latin-1, so that a byte is a code point.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % SHORTEST)
OTHER = re.compile(rb"[^a-z\xc0-\xff]")
#: No character: stands behind the end of every word.
END = np.uint32(0xFFFFFFFF)


# Words ---------------------------------------------------------------------


def misspelt(words: list[bytes], start: int) -> None:
    """Takes a character out of the words whose checksum, continued from ``start``, ``EVERY`` divides."""
    crc = zlib.crc32
    for k, word in enumerate(words):
        h = crc(word if word.isascii() else word.decode("latin-1").encode(), start)
        if not h % EVERY:
            at = h % len(word)
            words[k] = word[:at] + word[at + 1 :]


def runs(text: str) -> Iterator[list[bytes]]:
    """The text's long runs of letters, in lower case, some at a time."""
    raw = text.encode("latin-1", "replace").translate(LOWER)
    start = 0
    while start < len(raw):
        stop = OTHER.search(raw, min(len(raw), start + WINDOW))
        end = stop.end() if stop else len(raw)
        yield RUN.findall(raw, start, end)
        start = end


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """(word, n) of the words that occur ``least`` times or more in all texts."""
    ship(docs.sparkSession)

    def rows(counted: Counter) -> Iterator[pa.RecordBatch]:
        kept = [(w.decode("latin-1"), n) for w, n in counted.items() if len(w) >= SHORTEST]
        for k in range(0, len(kept), 1 << 16):
            words, n = zip(*kept[k : k + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    def count(batches):
        counted: Counter = Counter()
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{doc}:".encode())
                for words in runs(text):
                    misspelt(words, start)
                    counted.update(words)
                    if len(counted) > COUNTED:
                        yield from rows(counted)
                        counted.clear()
        yield from rows(counted)

    texts = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# The scan of one sorted list -------------------------------------------------


class SortedList:
    """Sorted words in groups, each of which agrees in its first ``depth`` characters."""

    def __init__(self, words: list[str], depths: list[int], starts: list[int]):
        """``starts`` are the groups' first words, ``depths`` what each group shares."""
        self.size = len(words)
        self.length = np.fromiter(map(len, words), np.int64, self.size)
        # Three ends behind each word, so that the band may look past it.
        flat = "".join(w + "\0\0\0" for w in words).encode("utf-32-le")
        self.codes = np.frombuffer(flat, np.uint32).copy()
        self.offset = np.concatenate(([0], np.cumsum(self.length + 3)[:-1])).astype(np.int64)
        for k in range(3):
            self.codes[self.offset + self.length + k] = END
        self.starts = np.array(starts, np.int64)
        self.ends = np.append(self.starts[1:], self.size)
        self.depths = np.array(depths, np.int64)
        self.shared = self._shared()

    def _shared(self) -> np.ndarray:
        """Longest common prefix of each word with the one before it; -1 where a group starts."""
        found = np.zeros(self.size, np.int64)
        going = np.setdiff1d(np.arange(self.size), self.starts)
        depth = 0
        while len(going):
            same = self.codes[self.offset[going] + depth] == self.codes[self.offset[going - 1] + depth]
            going = going[same & (depth < self.length[going])]
            depth += 1
            found[going] = depth
        found[self.starts] = -1
        return found

    def near(self, exact: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of near words (a, b), a before b, some at a time; ``exact`` characters of each word must agree as they are."""
        for first in range(0, self.size, AT_ONCE):
            yield from self._near(first, min(self.size, first + AT_ONCE), exact)

    def _near(self, first: int, last: int, exact: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        length, offset, codes, shared = self.length, self.offset, self.codes, self.shared
        group = np.searchsorted(self.starts, np.arange(first, last), "right") - 1
        live = np.arange(self.starts[group[0]], self.ends[group[-1]])
        none = np.zeros(0, np.int64)
        # A word, a range of the list that shares a prefix of ``depth``, and the band of that prefix's row.
        word, lo, hi = none, none, none
        cells = [np.zeros(0, np.int8)] * 3
        depth = int(self.depths[group].min())
        deepest = int(self.depths[group].max())
        while True:
            new = np.flatnonzero(self.depths[group] == depth)
            if len(new):
                own = group[new]
                word, lo, hi = (np.concatenate(x) for x in ((word, new + first), (lo, self.starts[own]), (hi, self.ends[own])))
                cells = [np.concatenate((x, np.full(len(new), v, np.int8))) for x, v in zip(cells, (1, 0, 1))]
            # Only words behind the own one are of interest.
            ahead = hi > word + 1
            word, lo, hi, cells = word[ahead], lo[ahead], hi[ahead], [x[ahead] for x in cells]
            if len(word):
                # The first of a range may end here.
                over = length[word] - depth
                done = np.flatnonzero((length[lo] == depth) & (lo > word) & (np.abs(over) <= 1))
                if len(done):
                    value = np.choose(over[done] + 1, [x[done] for x in cells])
                    done = done[value == 1]
                    if len(done):
                        yield word[done], lo[done]
            elif depth >= deepest:
                return
            # Ranges of the next character.
            live = live[length[live] > depth]
            at = np.flatnonzero(shared[live] <= depth)
            heads, sizes = live[at], np.diff(np.append(at, len(live)))
            left, right = np.searchsorted(heads, lo), np.searchsorted(heads, hi)
            count = right - left
            pair = np.repeat(np.arange(len(word)), count)
            child = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + left[pair]
            word, head = word[pair], heads[child]
            letter, place = codes[offset[head] + depth], offset[word] + depth
            a, b, c = (x[pair] for x in cells)
            n0 = np.minimum(a + (codes[place - 1] != letter), b + 1)
            n1 = np.minimum(np.minimum(b + (codes[place] != letter), c + 1), n0 + 1)
            n2 = np.minimum(c + (codes[place + 1] != letter), n1 + 1)
            depth += 1
            within = np.minimum(np.minimum(n0, n1), n2) <= 1
            if exact is not None:
                within &= (n1 == 0) | (depth > exact[word])
            kept = np.flatnonzero(within)
            word, lo, cells = word[kept], head[kept], [x[kept].astype(np.int8) for x in (n0, n1, n2)]
            hi = lo + sizes[child[kept]]


def best_of(a: np.ndarray, b: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, number of near words, best near word) by pairs: the largest n, then the smallest in order."""
    one, two = np.concatenate((a, b)), np.concatenate((b, a))
    by = np.lexsort((order[two], -n[two], one))
    one, two = one[by], two[by]
    first = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1]))) if len(one) else np.zeros(0, np.int64)
    return one[first], np.diff(np.append(first, len(one))), two[first]


# Dealing the list out --------------------------------------------------------


def divided(words: DataFrame, text: Column, depth: int, most: int) -> DataFrame:
    """The words with ``d``, the characters of ``text`` that are shared by ``most`` words at most; one more than it has if there are more."""
    words = words.withColumn("d", F.lit(depth))
    while True:
        key = F.when(F.length(text) >= F.col("d"), F.substring(text, F.lit(1), F.col("d")))
        # Only what was divided in the last round can be too large now.
        large = words.filter(F.col("d") == depth).groupBy(key.alias("k")).count().filter((F.col("count") > most) & F.col("k").isNotNull()).select("k")
        large = cut_lineage(large, "spelling-large")
        if large.isEmpty():
            return words
        hit = (F.col("d") == depth) & (key == F.col("k"))
        words = cut_lineage(words.join(hinted(large, SENT), hit, "left").withColumn("d", F.when(F.col("k").isNotNull(), depth + 1).otherwise(F.col("d"))).drop("k"), "spelling-divided")
        depth += 1


FOUND = "word string, n bigint, near bigint, best_n bigint, best string"


def in_lists(words: DataFrame, text: Column, depth: str, other: str | None) -> DataFrame:
    """``FOUND`` of the words that meet in sorted lists of ``text``; of pairs that agree in the first ``other`` of ``word`` none."""
    rows = words.select("word", "n", text.alias("text"), F.col(depth).alias("depth"), F.col(other or depth).alias("other"))
    # A word that is shorter than its depth is alone in its group.
    key = F.when(F.length("text") >= F.col("depth"), F.substring("text", F.lit(1), F.col("depth"))).otherwise(F.concat(F.col("text"), F.lit("\0")))
    dealt = rows.withColumn("key", key).repartition("key").sortWithinPartitions("key", "text")

    def scanned(own: pa.Table) -> Iterator[pa.RecordBatch]:
        words, texts, keys = (own.column(c).to_pylist() for c in ("word", "text", "key"))
        n = own.column("n").to_numpy()
        starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
        scan = SortedList(texts, [len(keys[k]) for k in starts], starts)
        order = np.empty(len(words), np.int64)
        order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        bound = own.column("other").to_numpy().astype(np.int64)
        pairs = list(scan.near(None if other is None else scan.length - bound))
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        if other is not None and len(a):
            # Those that agree in their heads meet in the other lists.
            same, d = np.ones(len(a), bool), 0
            ends = scan.offset + scan.length - 1
            while (going := np.flatnonzero(same & (d < bound[a]))).size:
                fits = (d < scan.length[a[going]]) & (d < scan.length[b[going]])
                same[going] = fits & (scan.codes[ends[a[going]] - d * fits] == scan.codes[ends[b[going]] - d * fits])
                d += 1
            a, b = a[~same], b[~same]
        at, near, best = best_of(a, b, n, order)
        if other is None:
            # Every word once, with or without near ones.
            all_near, all_best = np.zeros(len(words), np.int64), np.full(len(words), -1)
            all_near[at], all_best[at] = near, best
            at, near, best = np.arange(len(words)), all_near, all_best
        taken = own.column("word").take(pa.array(at))
        best_word = own.column("word").take(pa.array(best, mask=best < 0))
        best_n = own.column("n").take(pa.array(best, mask=best < 0))
        yield from pa.table([taken, pa.array(n[at]), pa.array(near), best_n, best_word], names=["word", "n", "near", "best_n", "best"]).to_batches(1 << 16)

    def scan(batches):
        """Whole groups, as many as make up ``TOGETHER`` words."""
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_pylist()
            cut = next((k for k in range(len(keys) - 1, 0, -1) if keys[k] != keys[k - 1]), 0)
            if cut:
                yield from scanned(table.slice(0, cut).combine_chunks())
                held, size = table.slice(cut).combine_chunks().to_batches(), len(keys) - cut
        if size:
            yield from scanned(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(scan, FOUND)


def cut_out(words: DataFrame) -> DataFrame:
    """``FOUND`` of the pairs whose edit lies inside both a divided head and a divided tail.

    ``words`` has (word, n, head, tail). Words that differ in one place share the rest
    and the place; a word with one character more shares what is left without it.
    """
    size = F.length("word")
    wide = words.filter((F.col("head") > HEAD) | (F.col("tail") > TAIL))
    places = wide.withColumn("i", F.explode(F.sequence(F.lit(1), size)))
    before, after = F.expr("substring(word, 1, i - 1)"), F.expr("substring(word, i + 1)")
    replaced = places.filter((F.col("i") - 1 < F.col("head")) & (size - F.col("i") < F.col("tail")))
    replaced = replaced.select("word", "n", F.concat(before, F.lit("\0"), after).alias("key"))
    group = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word")))
    groups = replaced.groupBy("key").agg(group.alias("members")).filter(F.size("members") > 1)
    each = groups.select("members", F.explode("members").alias("own"))
    rest = F.filter("members", lambda x: x["word"] != F.col("own.word"))[0]
    by_place = each.select(F.col("own.word").alias("word"), (-F.col("own.less")).alias("n"), (F.size("members") - 1).cast("bigint").alias("near"), (-rest["less"]).alias("best_n"), rest["word"].alias("best"))
    # Of equal neighbours the last is taken out; the shorter word's tail then starts at the first of them.
    letter = F.expr("substring(word, i, 1)")
    run = F.length(before) - F.length(F.expr("rtrim(substring(word, i, 1), substring(word, 1, i - 1))"))
    shorter = (
        places.filter(letter != F.expr("substring(word, i + 1, 1)"))
        .filter((F.col("i") - 1 < F.col("head")) & (size - F.col("i") + run < F.col("tail")))
        .select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.concat(before, after).alias("word"))
    )
    both = wide.select("word", "n").join(shorter, "word")
    small = both.select("word", "n", F.lit(1).cast("bigint").alias("near"), F.col("long_n").alias("best_n"), F.col("long").alias("best"))
    large = both.select(F.col("long").alias("word"), F.col("long_n").alias("n"), F.lit(1).cast("bigint").alias("near"), F.col("n").alias("best_n"), F.col("word").alias("best"))
    return by_place.unionByName(small).unionByName(large)


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, n_near, best, best_n) of every row of (word, n), whose words are distinct and have 7 code points or more."""
    ship(words.sparkSession)
    from_behind = F.reverse("word")
    plain = cut_lineage(words.select("word", "n"), "spelling-words")
    heads = divided(plain, F.col("word"), HEAD, most).withColumnRenamed("d", "head")
    both = divided(heads, from_behind, TAIL, most).withColumnRenamed("d", "tail")
    found = in_lists(both, F.col("word"), "head", None).unionByName(in_lists(both, from_behind, "tail", "head")).unionByName(cut_out(both))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    totals = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("top"))
    return totals.select("word", "n", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


# Forms and roots ---------------------------------------------------------------


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where each word's chain of forms ends. Rounds double the steps; counts grow along a chain, so it ends."""
    while True:
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = Observation()
        forms = forms.join(on, "root", "left").observe(moved, F.count("next").alias("n")).select("word", F.coalesce("next", "root").alias("root"))
        forms = cut_lineage(forms, "spelling-roots")
        if not moved.get["n"]:
            return forms


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = 10, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs at least twice."""
    found = near_words(vocabulary(docs, id_col, text_col), most)
    large = F.col("best_n") >= factor * F.col("n")
    found = cut_lineage(found.select("word", F.when(large, F.col("best")).alias("form"), "n", "n_near", F.when(large, F.col("best_n")).alias("form_n")), "spelling")
    roots = last_forms(found.filter("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
