"""Token counts of every prefix of a text, by a dynamic program over prefixes.

A sequence of BPE tokens is the encoding of its text if and only if every two
neighbours are the encoding of theirs. So the encoding of a prefix is that of a
shorter prefix and one token that may stand behind the shorter one's last token, and
there is exactly one such token. The program keeps the last token and the number of tokens
of each prefix of a unit, and finds those of the next prefix by trying the tokens
that end there; no text is merged. Whether two tokens may stand side by side is read
off the merges: the pair is taken apart in the order in which it was made, and must never
show two neighbours that an earlier merge would have joined (``Prefixes.stable``).

A prefix of a text ends inside a unit, which then is a unit of its own with an end mark on its
last byte. So each place has two answers: of the open prefix, which longer ones build
on, and of the closed one, which is counted. Words of one batch are sorted, and
take over the program's rows of what they share with the word before.

The counts of all prefixes are stored as a table, in parts of a text, from which questions are
answered later without its text: the tokens of a prefix (``prefix_tokens``), the longest prefix
within a limit (``truncated``), or just the total.

Texts above ``long_chars`` are cut at white space and their pieces counted by several
tasks; a piece without white space stays one, and is worked through in windows.

Defined results: null text counts as empty and has 0 tokens, and one part without
counts; repeated rows give repeated rows; special tokens inside texts count as one,
a prefix that ends inside their string as the text that it is. Prefixes are counted in code
points of the text as it stands, normalisation included. Other columns are not read, so that names
that clash with the output do no harm.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.llm.bpe import Bpe, loaded, plain, read_vocabulary
from siteweave.llm.common import ship, tokenizer_file

#: Words and clusters that a task remembers; it starts anew when full.
REMEMBERED = 300_000
#: Bytes of words that are remembered.
SHORT = 64
#: Units whose rows are computed together, and the slots for pairs of tokens, as a power of 2.
TOGETHER, PAIR_BITS = 50_000, 20
#: Bytes of text that a task works on at once.
AT_ONCE = 4 << 20
#: Bytes of a unit that are worked through at once.
WINDOW = 1 << 16
#: Code points of a part of a long text.
PART = 1 << 20

#: White space among the characters of plain texts.
SPACE = np.array([chr(c).isspace() for c in range(0x178)])
#: A place where every tokenizer of this kind ends a unit.
CUT = re.compile("[ \n](?=[\x21-\x7e])")


class Prefixes:
    """The tokens and merges of a tokenizer file, read for counting."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.rank, self.never = bpe.ranks, len(bpe.made)
        size = len(bpe.pieces)
        # What each token was made of, and when; bytes were never made.
        self.left, self.right, self.when = [-1] * size, [-1] * size, [-1] * size
        for (a, b), rank in bpe.ranks.items():
            made = bpe.made[rank]
            if self.when[made] < 0:
                self.left[made], self.right[made], self.when[made] = a, b, rank
        closing = set(bpe.last)
        if bpe.suffix:
            closing |= {i for i, p in enumerate(bpe.pieces) if p.endswith(bpe.suffix)}
        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {} if bpe.suffix else self.open
        own = [False] * size
        basic = {*bpe.first, *bpe.last}
        for i in [*basic, *bpe.made]:
            own[i] = i in basic or (own[self.left[i]] and own[self.right[i]] and self.stable(self.left[i], self.right[i], self.when[i]))
            # A token that its own text is not encoded as never occurs.
            if own[i]:
                (self.closed if i in closing else self.open)[bpe.raw[i]] = i
        self.longest = max(map(len, [*self.open, *self.closed]))
        # The ends of tokens too, without an id: where none fits, no longer token does.
        for known in (self.open,) if self.closed is self.open else (self.open, self.closed):
            for raw in list(known):
                for k in range(1, len(raw)):
                    known.setdefault(raw[k:], -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self._read_backwards()
        self.words: dict[str, bytes | np.ndarray] = {}
        self.clusters: dict[str, str] = {}

    def stable(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether no merge before ``limit`` ever joins the two tokens' texts across the place where they meet."""
        rank, when, never = self.rank, self.when, self.never
        limit = never if limit is None else limit
        while rank.get((a, b), never) >= limit:
            if when[a] > when[b]:
                # Made later than b: before that its right part stood here.
                limit, a = when[a], self.right[a]
            elif when[b] >= 0:
                # Merges of one rank go from the left, so an equal one would have come first.
                limit, b = when[b] + 1, self.left[b]
            else:
                return True
        return False

    def _read_backwards(self) -> None:
        """Tables for many units at once: the ends of tokens as a tree that is walked from a token's last byte to its first."""
        ends = sorted({*self.open, *self.closed}, key=len)
        node = {raw: k + 1 for k, raw in enumerate(ends)}
        node[b""] = 0
        self.step = np.zeros((len(ends) + 1, 256), np.int32)
        self.step[[node[raw[1:]] for raw in ends], [raw[0] for raw in ends]] = np.arange(1, len(ends) + 1)
        self.open_at, self.closed_at = (np.array([-1, *(known.get(raw, -1) for raw in ends)], np.int32) for known in (self.open, self.closed))
        # Pairs that were asked for, by a hash of both ids; a later pair takes an earlier one's place.
        self.asked = np.full(1 << PAIR_BITS, -1, np.int64)
        self.answer = np.zeros(1 << PAIR_BITS, bool)

    # The program ---------------------------------------------------------------

    def rows(self, raw: bytes, last: list[int], count: list[int], closed: list[int]) -> None:
        """Takes the program's rows on to the end of ``raw``; they stand at the prefix that is known already."""
        for end in range(len(last), len(raw) + 1):
            start, token = self.final(self.open, raw, end, last)
            last.append(token)
            count.append(count[start] + 1)
            if self.closed is self.open:
                closed.append(count[end])
            elif end < len(raw) and raw[end] & 0xC0 == 0x80:
                # Inside a character no prefix ends.
                closed.append(0)
            else:
                closed.append(count[self.final(self.closed, raw, end, last)[0]] + 1)

    def final(self, known: dict[bytes, int], raw: bytes, end: int, last: list[int]) -> tuple[int, int]:
        """Where the last token of a prefix starts, and which it is: exactly one of those that end there fits."""
        get, ending = known.get, []
        for start in range(end - 1, -1, -1):
            token = get(raw[start:end])
            if token is None:
                break
            if token >= 0:
                ending.append((start, token))
        pairs = self.pairs
        for start, token in reversed(ending):
            if not start:
                return 0, token
            pair = last[start], token
            fits = pairs.get(pair)
            if fits is None:
                if len(pairs) > REMEMBERED:
                    pairs.clear()
                fits = pairs[pair] = self.stable(*pair)
            if fits:
                return start, token
        raise ValueError("the tokenizer has no token for a byte")

    def windows(self, raw: bytes) -> Iterator[list[int]]:
        """The closed counts of a long unit's prefixes, window by window; only the last rows are kept."""
        last, count, closed, base = [-1], [0], [0], 0
        while True:
            end = min(len(raw), base + len(last) - 1 + WINDOW)
            # Two bytes more than wanted would be enough to see where a character goes on.
            piece = raw[base:end]
            known = len(closed)
            self.rows(piece if end == len(raw) else whole_characters(piece), last, count, closed)
            yield closed[known:]
            if base + len(last) - 1 == len(raw):
                return
            drop = max(0, len(last) - 1 - self.longest)
            base += drop
            last, count, closed = last[drop:], count[drop:], closed[drop:]

    def unit(self, unit: str) -> np.ndarray:
        """Closed counts of the prefixes of 1, 2, ... characters of one unit."""
        raw = unit.encode()
        found = np.fromiter((n for w in self.windows(raw) for n in w), np.int64, len(raw))[character_ends(raw)]
        return self.contraction(unit, found)

    def contraction(self, unit: str, found: np.ndarray) -> np.ndarray:
        """Prefixes of units such as 's or 're are not units: the mark stands alone before letters that do not complete it."""
        if unit[0] == "'" and len(unit) == 3 and unit[1].isalpha():
            found = found.copy()
            found[1] = self.total("'") + self.total(unit[1])
        return found

    def total(self, text: str) -> int:
        """Tokens of a normalised text without special tokens."""
        return sum(int(self.unit(bytes(map(self.bpe.bytes_of.__getitem__, u)).decode())[-1]) for u, _ in self.bpe.split(text))

    def many(self, units: list[bytes]) -> list[np.ndarray]:
        """Closed counts behind each byte of sorted, different units of up to ``SHORT`` bytes, all units together.

        The program's rows of a prefix that units share are those of the first unit that has it.
        """
        size = np.fromiter(map(len, units), np.int64, len(units))
        most = int(size.max())
        raw = np.frombuffer(b"".join(u.ljust(most, b"\0") for u in units), np.uint8).reshape(len(units), most)
        differs = np.ones((len(units), most), bool)
        # The end of the unit before counts as a difference, whatever byte follows it here.
        differs[1:] = (raw[1:] != raw[:-1]) | (np.arange(most) >= size[:-1, None])
        last, count, closed = (np.zeros((len(units), most + 1), t) for t in (np.int32, np.uint8, np.uint8))
        fresh = np.zeros(len(units), bool)
        every = np.arange(len(units))
        for end in range(1, most + 1):
            # Rows of units whose prefix is not the one of the unit before.
            fresh |= differs[:, end - 1]
            own = np.flatnonzero(fresh & (size >= end))
            if len(own):
                self._ending(raw, end, own, last, count, closed)
            first = np.maximum.accumulate(np.where(fresh, every, 0))
            for x in (last, count, closed):
                x[:, end] = x[first, end]
        return [closed[k, 1 : n + 1] for k, n in enumerate(size.tolist())]

    def _ending(self, raw: np.ndarray, end: int, row: np.ndarray, last: np.ndarray, count: np.ndarray, closed: np.ndarray) -> None:
        """Fills the rows of one prefix length: walks back from its end, and takes the tokens that fit where they start."""
        node = np.zeros(len(row), np.int32)
        for start in range(end - 1, -1, -1):
            node = self.step[node, raw[row, start]]
            on = np.flatnonzero(node)
            if not len(on):
                return
            row, node = row[on], node[on]
            before = last[row, start]
            for at, out in ((self.open_at, last), (self.closed_at, closed)):
                token = at[node]
                fits = np.flatnonzero(token >= 0)
                if start and len(fits):
                    fits = fits[self.fit(before[fits], token[fits])]
                if len(fits):
                    done = row[fits]
                    found = count[done, start] + 1
                    if out is last:
                        last[done, end], count[done, end] = token[fits], found
                    if out is closed or self.closed is self.open:
                        closed[done, end] = found

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of tokens may stand side by side."""
        key = (a.astype(np.int64) << 32) | b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero(self.asked[slot] != key)
        found = self.answer[slot]
        if len(new):
            pairs, which = np.unique(key[new], return_inverse=True)
            told = np.fromiter((self.stable(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()), bool, len(pairs))
            found[new] = told[which]
            self.asked[slot[new]], self.answer[slot[new]] = key[new], told[which]
        return found

    # Words ---------------------------------------------------------------------

    def learn(self, words: set[str]) -> None:
        """Counts the prefixes of plain words that are not known; sorted, so that rows are shared."""
        if len(self.words) + len(words) > REMEMBERED:
            self.words.clear()
        new = {w for w in words if w not in self.words and len(w) <= SHORT}
        units = {w: self.bpe.unit.findall(w) for w in new if not w.isalpha()}
        alone = new.difference(units).union(u for own in units.values() for u in own if u not in self.words and u not in units)
        # Marks before letters are not what their bytes are on their own; see ``contraction``.
        by_bytes = {w.encode(): w for w in alone if len(w) <= SHORT and not (w[0] == "'" and w[-1].isalpha())}
        known = self.words
        order = sorted(x for x in by_bytes if len(x) <= SHORT)
        for start in range(0, len(order), TOGETHER):
            some = order[start : start + TOGETHER]
            for raw, found in zip(some, self.many(some)):
                w = by_bytes[raw]
                known[w] = (found if len(raw) == len(w) else found[character_ends(raw)]).tobytes()
        for w, own in units.items():
            if own != [w] or w not in known:
                known[w] = self.of_units(own)

    def of_units(self, units: list[str]) -> bytes:
        """Counts of the prefixes of a short word of several units."""
        get, found, before = self.words.get, b"", 0
        for u in units:
            own = get(u)
            if own is None:
                own = self.words[u] = self.unit(u).astype(np.uint8).tobytes()
            found += bytes([n + before for n in own]) if before else own
            before = found[-1]
        return found

    def long_word(self, word: str) -> np.ndarray:
        found, before = [], 0
        for u in self.bpe.unit.findall(word):
            found.append(self.unit(u) + before)
            before = int(found[-1][-1])
        return np.concatenate(found)

    def plain_counts(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a plain text whose words ``learn`` has seen."""
        codes = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        space = SPACE[codes]
        words = text.lower().split()
        if not words:
            return np.zeros(len(codes), np.int64)
        known = [self.words.get(w) for w in words]
        if None in known:
            known = [self.long_word(w) if x is None else np.frombuffer(x, np.uint8) for w, x in zip(words, known)]
            inside = np.concatenate(known)
        else:
            inside = np.frombuffer(b"".join(known), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1
        before = np.concatenate(([0], np.cumsum(inside[ends], dtype=np.int64)))
        # The word that a character belongs to; for white space, the number of words so far.
        starts = ~space & np.concatenate(([True], space[:-1]))
        word = np.cumsum(starts)
        found = before[word]
        letters = np.flatnonzero(~space)
        found[letters] = before[word[letters] - 1] + inside
        return found

    # Any text --------------------------------------------------------------------

    def normal(self, cluster: str) -> str:
        found = self.clusters.get(cluster)
        if found is None:
            if len(self.clusters) > REMEMBERED:
                self.clusters.clear()
            found = self.clusters[cluster] = self.bpe.normalise(cluster)
        return found

    def other_counts(self, text: str) -> tuple[np.ndarray, str]:
        """Counts of the prefixes of any text without special tokens, and its last unit if the text ends in it."""
        whole = self.bpe.normalise(text)
        counts = np.zeros(len(whole) + 1, np.int64)
        start_of = np.arange(len(whole) + 1)
        before = end = 0
        for letters, (a, b) in self.bpe.split(whole):
            own = self.unit(bytes(map(self.bpe.bytes_of.__getitem__, letters)).decode())
            counts[end : a + 1] = before
            counts[a + 1 : b + 1] = before + own
            start_of[a + 1 : b + 1] = a
            before, end = before + int(own[-1]), b
        counts[end:] = before
        found = np.empty(len(text), np.int64)
        place, at = 0, 0
        for cluster in clusters(text):
            done = self.normal(cluster)
            joins = place and whole[place - 1] == " " and done.startswith(" ")
            for k in range(1, len(cluster)):
                found[at + k - 1] = self.behind(whole, counts, start_of, place, self.normal(cluster[:k]))
            place += len(done) - bool(joins)
            found[at + len(cluster) - 1] = counts[place]
            at += len(cluster)
        if place != len(whole):
            raise ValueError("the tokenizer's normaliser does not work character by character")
        return found, whole[start_of[-1] :]

    def behind(self, whole: str, counts: np.ndarray, start_of: np.ndarray, place: int, more: str) -> int:
        """The count of a normalised text up to ``place`` with more characters, which may go on with its last unit."""
        start = start_of[place]
        if start and whole[start - 1] == "'" and start_of[start] == start - 1:
            # A mark that stands alone may begin a unit with what follows.
            start -= 1
        return int(counts[start]) + self.total(whole[start:place] + more)

    def counts(self, text: str) -> np.ndarray:
        """Tokens of the text's prefixes of 1, 2, ... code points."""
        found: list[np.ndarray] = []
        before, tail = 0, ""
        for part in self.bpe.special_parts(text):
            if not part:
                continue
            if part in self.bpe.special:
                rest = before - (self.total(tail) if tail else 0)
                found.append(np.array([rest + self.total(tail + part[:k].lower()) for k in range(1, len(part))] + [before + 1], np.int64))
                before, tail = before + 1, ""
                continue
            if plain(part):
                own = self.plain_counts(part)
                word = part.rsplit(None, 1)[-1:] if not part[-1].isspace() else []
                tail = self.bpe.unit.findall(word[0].lower())[-1] if word else ""
            else:
                own, tail = self.other_counts(part)
            found.append(own + before)
            before += int(own[-1])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def counts_of(self, texts: list[str]) -> list[np.ndarray]:
        new: set[str] = set()
        for text in texts:
            for part in self.bpe.special_parts(text):
                if part not in self.bpe.special and plain(part):
                    new.update(part.lower().split())
        self.learn(new)
        return [self.counts(t) for t in texts]


def character_ends(raw: bytes) -> np.ndarray:
    """The places of the last bytes of characters."""
    return np.flatnonzero((np.frombuffer(raw + b" ", np.uint8) & 0xC0) != 0x80)[1:] - 1


def whole_characters(raw: bytes) -> bytes:
    """Without a character that is cut at the end."""
    end = len(raw) - 1
    while raw[end] & 0xC0 == 0x80:
        end -= 1
    return raw[:end]


def clusters(text: str) -> Iterator[str]:
    """The text in pieces that are normalised on their own: a character and what may join with it."""
    start = 0
    for k in range(1, len(text)):
        c = text[k]
        if ord(c) >= 0x300:
            held = text[start:k]
            if unicodedata.combining(c) or unicodedata.normalize("NFC", held + c) != unicodedata.normalize("NFC", held) + unicodedata.normalize("NFC", c):
                continue
        yield text[start:k]
        start = k
    if text:
        yield text[start:]


_READ: dict[int, Prefixes] = {}


def reader(raw: str) -> Prefixes:
    """One for each worker process and tokenizer file."""
    key = hash(raw)
    if key not in _READ:
        _READ[key] = Prefixes(loaded(raw))
    return _READ[key]


def packed(counts: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, the highest byte first, so that SQL functions can read one of them."""
    return counts.astype(">u4").tobytes()


def unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, ">u4").astype(np.int64)


def some_text(batches, column: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``AT_ONCE`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + AT_ONCE)))
            yield batch.slice(start, end - start)
            start = end


def pieces(text: str, size: int) -> Iterator[str]:
    """The text cut at white space, into pieces of about ``size`` code points or more if there is none."""
    start = 0
    while start < len(text):
        found = CUT.search(text, min(len(text), start + size))
        end = found.end() if found else len(text)
        yield text[start:end]
        start = end


def prefix_table(docs: DataFrame, vocabulary: str = tokenizer_file("word_bpe_49k.json"), id_col: str = "doc_id", text_col: str = "text", long_chars: int = PART) -> DataFrame:
    """(id, digest, n_bytes, n_tokens, part, start, before, counts): a row for each part of each document.

    ``counts`` has an entry for each code point of the part (``unpacked``): the tokens from the part's
    start up to it, which with ``before`` make those of the text up to it. ``start`` is the number of
    code points before the part; ``digest`` tells apart texts under one id; totals are the document's.
    """
    spark = docs.sparkSession
    ship(spark)
    shared_file = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"digest": F.xxhash64("text"), "n_bytes": F.octet_length("text").cast("bigint")})
    key = f"id {rows.schema['id'].dataType.simpleString()}, digest bigint, n_bytes bigint"
    result = f"{key}, n_tokens bigint, part int, start bigint, before bigint, counts binary"

    def whole(batches):
        read = reader(shared_file.value)
        for batch in some_text(batches, 3):
            found = read.counts_of(batch.column(3).to_pylist())
            zero = pa.array([0] * len(found), pa.int64())
            total = pa.array([int(x[-1]) if len(x) else 0 for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], total, zero.cast(pa.int32()), zero, zero, pa.array(map(packed, found), pa.binary())],
                names=["id", "digest", "n_bytes", "n_tokens", "part", "start", "before", "counts"],
            )

    def cut(batches):
        for batch in some_text(batches, 3):
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                for part, piece in enumerate(pieces(one.column(3)[0].as_py(), long_chars)):
                    yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([part], pa.int32()), pa.array([piece])], names=["id", "digest", "n_bytes", "part", "piece"])

    def count_pieces(batches):
        read = reader(shared_file.value)
        for batch in some_text(batches, 4):
            found = read.counts_of(batch.column(4).to_pylist())
            own = pa.array([int(x[-1]) for x in found], pa.int64())
            size = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], own, size, pa.array(map(packed, found), pa.binary())], names=["id", "digest", "n_bytes", "part", "own", "size", "counts"])

    columns = ["id", "digest", "n_bytes", "text"]
    short = rows.filter(F.length("text") <= long_chars).select(*columns).mapInArrow(whole, result)
    # Equal long rows are counted once and then repeated.
    long = rows.filter(F.length("text") > long_chars).groupBy("id", "digest", "n_bytes", "text").agg(F.count(F.lit(1)).alias("copies"))
    copies = long.select("id", "digest", "n_bytes", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    counted = (
        long.select(*columns)
        .mapInArrow(cut, f"{key}, part int, piece string")
        .repartition("id", "digest", "part")
        .mapInArrow(count_pieces, f"{key}, part int, own bigint, size bigint, counts binary")
    )
    same = Window.partitionBy("id", "digest", "n_bytes")
    earlier = same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select(
        "id",
        "digest",
        "n_bytes",
        F.sum("own").over(same).alias("n_tokens"),
        "part",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"),
        F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"),
        "counts",
    )
    repeated = placed.alias("p").join(copies.alias("c"), F.expr("p.id <=> c.id and p.digest = c.digest and p.n_bytes = c.n_bytes")).select("p.*")
    return short.unionByName(repeated).withColumnRenamed("id", id_col)


def token_counts(table: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document of a prefix table."""
    return table.filter("part = 0").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def prefix_tokens(table: DataFrame, asked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, digest, chars, n_tokens): the tokens of the first ``chars`` code points, for every row of ``asked`` (id, chars).

    A prefix of 0 code points has 0 tokens; one that is longer than the text gives no row.
    """
    wanted = asked.select(F.col(id_col).alias("_id"), F.col("chars").cast("bigint").alias("chars"))
    size = F.octet_length("counts") / 4
    inside = (F.col("chars") > F.col("start")) & (F.col("chars") <= F.col("start") + size)
    empty = (F.col("chars") == 0) & (F.col("part") == 0)
    entry = F.expr("cast(conv(hex(substring(counts, cast(4 * (chars - start) - 3 as int), 4)), 16, 10) as bigint)")
    found = table.join(wanted, F.col(id_col).eqNullSafe(F.col("_id")) & (inside | empty))
    return found.select(id_col, "digest", "chars", F.when(empty, F.lit(0).cast("bigint")).otherwise(F.col("before") + entry).alias("n_tokens")).distinct()


def truncated(table: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """(id, digest, chars): the longest prefix of each text that has ``limit`` tokens at most."""
    kind = table.schema[id_col].dataType.simpleString()

    def longest(batches):
        for batch in batches:
            chars = []
            for start, before, counts in zip(*(batch.column(c).to_pylist() for c in ("start", "before", "counts"))):
                fits = np.flatnonzero(unpacked(counts) + before <= limit)
                chars.append(start + int(fits[-1]) + 1 if len(fits) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chars, pa.int64())], names=["id", "digest", "chars"])

    found = table.select(F.col(id_col).alias("id"), "digest", "start", "before", "counts").mapInArrow(longest, f"id {kind}, digest bigint, chars bigint")
    return found.groupBy("id", "digest").agg(F.max("chars").alias("chars")).withColumnRenamed("id", id_col)
