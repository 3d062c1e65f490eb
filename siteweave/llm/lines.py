"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join.

An occurrence of a line goes if the same line, or one whose words are at most
one word away (a word replaced, added or missing, or other white space only),
stands earlier, in order of document id and line number; the earliest stays. One
word is the bound for lines of ``min_words`` words or more, which keeps them at
least four fifths alike; shorter lines go for exact repeats only. Blank lines stay.

How near lines are found:

1. Equal lines fold into one row with its first place, by map-side aggregation.
2. Two lines one word apart share their first or their last half, so a line
   whose halves no other line has cannot have a partner. This exact test leaves
   few lines.
3. Each of those emits the hash of itself and of every variant with one word
   left out. Hashes are differences of running sums, so a line of n words costs
   n steps and not n squared. Equal variants meet: with the same place left out,
   the lines differ by one replaced word; a variant that equals a whole line
   tells of one added word. For each key only the earliest place is kept, by
   map-side aggregation: the work grows with the rows of a key and not with its
   pairs.
4. The earliest partner of each line is verified word by word. (Only colliding
   64-bit keys can fail here; such a line stays.)

Only DataFrame functions are used.

Defined results: null texts stay null and have no lines; empty texts have one
blank line, which stays; rows equal in id and text count as one place, so
neither removes the other's lines, and the same holds for lines at the same
number of rows that share an id; null ids come first. Other columns pass
through; the ids are whole numbers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.common import hinted, unused
from siteweave.session import cut_lineage

MIN_WORDS = 5
#: Rows of slim tables up to which they are sent to all tasks (about 24 MB each).
BROADCAST_ROWS = 500_000
#: Bits of a word's hash in a running sum; 2^22 words stay below a long's bound.
MASK = (1 << 40) - 1
#: Two independent sums stand for a sequence of words.
SEEDS = (("a", 3), ("b", 5))


def words_of(line: Column) -> Column:
    """Words between white space; lines that have no other than blanks take the way without a pattern."""
    odd = F.lit(False)
    for c in "\t\v\f\r":
        odd |= F.contains(line, F.lit(c))
    return F.array_remove(F.when(odd, F.split(line, r"[ \t\u000B\f\r]")).otherwise(F.split(line, " ")), "")


def place(id_col: Column, line_no: Column) -> Column:
    """Order of the ids, then of the lines, in one number that aggregates well; null ids come first."""
    wide = F.coalesce(id_col.cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)).cast("decimal(20,0)"))
    return (wide * F.lit(1 << 32).cast("decimal(11,0)") + line_no.cast("decimal(11,0)")).cast("decimal(34,0)")


def occurrences(rows: DataFrame) -> DataFrame:
    """(id, mark, n, line) of each line that is not blank, of rows with id, mark and text."""
    return rows.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter(F.col("line").rlike(r"[^ \t\u000B\f\r]"))


def line_key() -> list[Column]:
    """128 bits of a line."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")]


#: Columns of ``half_keys``.
HALVES = ["k1", "k2", "k3", "k4"]


def half_keys(words: Column, size: Column) -> list[Column]:
    """Hashes of the halves that a partner of the same length, or one word longer or shorter, must share one of."""
    first = lambda n: F.xxhash64(F.lit(1), F.slice(words, 1, n))
    last = lambda n: F.xxhash64(F.lit(2), F.slice(words, size - n + 1, n))
    half, less = (size / 2).cast("int"), ((size - 1) / 2).cast("int")
    return [first(half), first(less), last(size - half), last(size - 1 - less)]


def word_sum(seed: int, moved: int) -> Column:
    """The sum over the words of a hash of the word together with its place, less ``moved``."""
    placed = F.transform("words", lambda w, j: word_hash(seed, w, j - moved))
    return F.aggregate(placed, F.lit(0).cast("long"), lambda s, x: s + x)


def word_hash(seed: int, word: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(seed), word, at).bitwiseAND(MASK)


def variants(lines: DataFrame) -> DataFrame:
    """(h1, h2, first, key, whole): the keys of each line of (h1, h2, first, size, words).

    Key kinds: the line itself (``whole`` is true), a variant that may equal a whole
    line (false), and a variant together with its place, which only meets its like
    (null). A variant's sum is the sum of the words before the place that is left
    out, plus that of the words after it, each moved up by one.
    """
    sums = {f"{name}{moved}": word_sum(seed, moved) for name, seed in SEEDS for moved in (0, 1)}
    lines = lines.select("h1", "h2", "first", "size", "words", *[c.alias(k) for k, c in sums.items()]).repartition("h1", "h2")
    whole = lines.select("h1", "h2", "first", F.xxhash64("size", "a0", "b0").alias("key"), F.lit(True).alias("whole"))
    line = Window.partitionBy("h1", "h2")
    before = line.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    each = lines.select("h1", "h2", "first", "size", "a1", "b1", F.posexplode("words").alias("at", "word"))
    for name, seed in SEEDS:
        each = each.withColumn(f"{name}h", word_hash(seed, F.col("word"), F.col("at"))).withColumn(f"{name}m", word_hash(seed, F.col("word"), F.col("at") - 1))
    left_out = [
        F.col(f"{name}1") - F.col(f"{name}m") + F.coalesce(F.sum(F.col(f"{name}h") - F.col(f"{name}m")).over(before), F.lit(0))
        for name, _ in SEEDS
    ]
    each = each.select("h1", "h2", "first", "at", F.xxhash64(F.col("size") - 1, *left_out).alias("key"))
    kinds = F.array(
        F.struct(F.col("key").alias("key"), F.lit(False).alias("whole")),
        F.struct(F.xxhash64("key", "at").alias("key"), F.lit(None).cast("boolean").alias("whole")),
    )
    parts = each.select("h1", "h2", "first", F.explode(kinds).alias("k")).select("h1", "h2", "first", "k.key", "k.whole")
    return whole.unionByName(parts)


def within_one(a: Column, b: Column) -> Column:
    """True if two word arrays are equal, or become so by one word replaced, added or left out."""
    short = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
    rest = lambda x, start: F.slice(x, start, F.greatest(F.size(x) - start + 1, F.lit(0)))
    skip_a = F.when(F.size(a) >= F.size(b), at + 1).otherwise(at)
    skip_b = F.when(F.size(b) >= F.size(a), at + 1).otherwise(at)
    return (at == 0) | ((F.abs(F.size(a) - F.size(b)) <= 1) & (short >= 0) & (rest(a, skip_a) == rest(b, skip_b)))


def near_lines(rows: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2) of the lines that have a partner, one word away, whose first place is before theirs."""
    keyed = lines.filter(F.col("size") >= min_words).select("h1", "h2", "first", F.explode(F.array_distinct(F.array(*HALVES))).alias("half"))
    shared = cut_lineage(
        keyed.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("half"), "halves"
    )
    some = cut_lineage(keyed.join(hinted(shared, BROADCAST_ROWS), "half").select("h1", "h2", "first").distinct(), "candidates")

    # The words of the candidates, read where they first stand.
    at = hinted(some.withColumnsRenamed({"h1": "c1", "h2": "c2"}), BROADCAST_ROWS)
    texts = cut_lineage(
        occurrences(rows)
        .withColumn("first", place(F.col("id"), F.col("n")))
        .join(at, "first")
        .select("first", "line", "c1", "c2", *line_key())
        .filter("h1 = c1 and h2 = c2")
        .groupBy("h1", "h2")
        .agg(F.min("first").alias("first"), F.first("line").alias("line"))
        .select("h1", "h2", "first", words_of(F.col("line")).alias("words"))
        .withColumn("size", F.size("words")),
        "candidate-words",
    )

    keys = variants(texts)
    earliest = keys.groupBy("key").agg(
        F.min(F.when(F.col("whole"), F.col("first"))).alias("whole_first"),
        F.min(F.when(~F.col("whole"), F.col("first"))).alias("part_first"),
        F.min(F.when(F.col("whole").isNull(), F.col("first"))).alias("like_first"),
        F.max("first").alias("last_first"),
    )
    # A key matters if it holds two lines that match: a whole and a variant, two of one place, or two wholes of other white space.
    earliest = cut_lineage(
        earliest.filter(
            "(whole_first is not null and part_first is not null) or like_first < last_first or (part_first is null and whole_first < last_first)"
        ).drop("last_first"),
        "variants",
    )
    partner = F.when(F.col("whole"), F.least("part_first", "whole_first")).when(~F.col("whole"), F.col("whole_first")).otherwise(F.col("like_first"))
    paired = (
        keys.join(hinted(earliest, BROADCAST_ROWS), "key")
        .withColumn("partner", partner)
        .filter("partner < first")
        .groupBy("h1", "h2")
        .agg(F.min("partner").alias("partner"))
    )
    other = texts.select(F.col("first").alias("partner"), F.col("words").alias("partner_words"))
    return (
        paired.join(texts.select("h1", "h2", "words"), ["h1", "h2"])
        .join(other, "partner")
        .filter(within_one(F.col("words"), F.col("partner_words")))
        .select("h1", "h2")
        .distinct()
    )


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, mark, gone) for each document that loses lines: their numbers, from 0, in order. ``mark`` is a hash of its text."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    spots = occurrences(rows)
    wordy = spots.select(place(F.col("id"), F.col("n")).alias("first"), *line_key(), words_of(F.col("line")).alias("words"))
    size = F.size("words")
    spread = wordy.select("first", "h1", "h2", size.alias("size"), *[F.when(size >= min_words, k).alias(c) for k, c in zip(half_keys(F.col("words"), size), HALVES)])
    lines = cut_lineage(
        spread.groupBy("h1", "h2").agg(
            F.min("first").alias("first"), F.max("first").alias("last"), *[F.max(c).alias(c) for c in ("size", *HALVES)]
        ),
        "lines",
    )
    near = near_lines(rows, lines, min_words).withColumn("near", F.lit(True))
    bad = cut_lineage(
        lines.join(near, ["h1", "h2"], "left")
        .filter("near or first < last")
        .select("h1", "h2", F.when(F.col("near"), F.lit(None)).otherwise(F.col("first")).alias("keep")),
        "repeated-lines",
    )
    return (
        spots.select("id", "mark", "n", *line_key())
        .join(hinted(bad, BROADCAST_ROWS), ["h1", "h2"])
        .filter(F.col("keep").isNull() | (place(F.col("id"), F.col("n")) > F.col("keep")))
        .groupBy("id", "mark")
        .agg(F.sort_array(F.collect_set("n")).alias("gone"))
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, the text without its removed lines, and a column ``lines_removed`` set last.

    A column of that name in ``docs`` is replaced; others pass through whatever their names are.
    """
    own_id, own_mark, own = (unused(c, [*docs.columns, "id", "mark", "gone"]) for c in ("gone_id", "gone_mark", "gone_lines"))
    mark = unused("mark", docs.columns)
    gone = removed_lines(docs, id_col, text_col, min_words).withColumnsRenamed({"id": own_id, "mark": own_mark, "gone": own})
    # The lines are cut before the join, so that no later expression cuts them again for every line.
    cut = docs.withColumns({mark: F.xxhash64(text_col), text_col: F.split(text_col, "\n")})
    joined = cut.join(gone, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_mark)), "left")
    lines = F.col(text_col)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own))
    kept = F.transform(numbers, lambda n: F.element_at(lines, n + 1))
    text = F.array_join(F.when(F.col(own).isNull(), lines).otherwise(kept), "\n")
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "lines_removed"],
        F.coalesce(F.size(own), F.lit(0)).alias("lines_removed"),
    )
