"""BPE encoding and decoding by tree concatenation.

A text is normalised and split into units as the tokenizer file says; short
units are merged directly. A long unsplit unit is halved down to leaves, the
leaves are encoded on their own, and neighbours are joined pair by pair up the
tree: at each join a window of tokens around it is encoded anew and grown until
its first and its last token are those that the two sides already hold. A token
sequence is the BPE encoding of its text if every two neighbours are the
encoding of theirs, so an agreeing window settles the whole join.

Texts above ``long_chars`` are cut between units and, inside a long unit, into
leaf rows that other tasks encode in parallel; the rows of one text then meet
again in one small group, where only the joins are left to do.

Defined results: null text counts as empty; empty text gives no ids and an
empty decoded text; repeated rows give repeated results. The input's other
columns are not read, so names that clash with the output do no harm.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import ship, slices, tokenizer_file

#: Bytes of a tokenizer file that may be sent to every task.
MAX_VOCABULARY_BYTES = 64 << 20
#: Entries of a task's cache of words; it starts anew when full.
CACHE_WORDS = 400_000
#: Bytes of a unit up to which units of one length are merged together.
MANY = 64
#: Bytes of a leaf.
LEAF = 256

# The byte alphabet of byte-level BPE. Printable bytes stand for
# themselves, the others for the characters from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Texts of these characters alone split at the same places in this library and in the tokenizer's own code.
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u0177]*")


def plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None


def halves(raw: bytes, size: int) -> list[bytes]:
    """Halves of halves, down to ``size`` bytes."""
    if len(raw) <= size:
        return [raw]
    middle = len(raw) // 2
    return halves(raw[:middle], size) + halves(raw[middle:], size)


def byte_alphabet() -> list[str]:
    rest = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(rest)) for b in range(256)]


class Bpe:
    """A tokenizer file's normaliser, units, merges and pieces."""

    def __init__(self, raw: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        model, self.leaf = spec["model"], leaf
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.made.append(vocab[a + b])
        alphabet = byte_alphabet()
        self.first = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = text
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.unit = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        own = Tokenizer.from_str(raw)
        self.normalise = own.normalizer.normalize_str
        self.split = own.pre_tokenizer.pre_tokenize_str
        self.bytes_of = {c: b for b, c in enumerate(alphabet)}
        # A unit's bytes by piece, without the end mark, to encode windows from ids.
        self.raw = [bytes(self.bytes_of.get(c, 0) for c in (p.removesuffix(self.suffix) if self.suffix else p)) for p in self.pieces]
        # Merge ranks by pair as sorted arrays, to merge many units at once.
        keys = np.array([(a << 32) | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.ranks.values(), np.int32, len(keys))[order]
        self.made_array, self.first_array, self.last_array = (np.array(x, np.int32) for x in (self.made, self.first, self.last))
        self.known: dict[str, list[int]] = {}

    # Units -----------------------------------------------------------------

    def special_parts(self, text: str) -> list[str]:
        return self.special_split.split(text) if "<|" in text else [text]

    def units_of(self, text: str) -> Iterator[str]:
        """The units of any text without special tokens."""
        if plain(text):
            for word in text.lower().split():
                yield from self.unit.findall(word)
        else:
            for letters, _ in self.split(self.normalise(text)):
                yield bytes(map(self.bytes_of.__getitem__, letters)).decode()

    # Merging ---------------------------------------------------------------

    def merged(self, ids: list[int]) -> list[int]:
        """Applies the merges to one unit's symbols, lowest rank first, leftmost first."""
        if len(ids) > 2 * LEAF:
            return self._merged_heap(ids)
        rank, made, last = self.ranks.get, self.made, len(self.made)
        ids = list(ids)
        ranks = [rank(pair, last) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == last:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), last)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), last)
        return ids

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.made)).astype(np.int32)

    def merged_many(self, units: list[bytes]) -> list[list[int]]:
        """``merged`` for whole units of one length: each round merges the best pair of every unit that has one."""
        size, last, made = len(units[0]), len(self.made), self.made_array
        raw = np.frombuffer(b"".join(units), np.uint8).reshape(len(units), size)
        ids = self.first_array[raw]
        ids[:, -1] = self.last_array[raw[:, -1]]
        ranks = self.lookup(ids[:, :-1], ids[:, 1:])
        found: list[list[int]] = [[]] * len(units)
        left = np.arange(len(units))
        while True:
            if size > 1:
                best = ranks.argmin(1)
                rank = ranks[np.arange(len(left)), best]
                going = rank < last
            else:
                going = np.zeros(len(left), bool)
            for k, row in zip(left[~going].tolist(), ids[~going].tolist()):
                found[k] = row
            if not going.any():
                return found
            left, ids, ranks, best, rank = left[going], ids[going], ranks[going], best[going], rank[going]
            size -= 1
            row, at = np.arange(len(left)), np.arange(size)
            ids = np.take_along_axis(ids, at + (at > best[:, None]), 1)
            ids[row, best] = made[rank]
            at = at[:-1]
            ranks = np.take_along_axis(ranks, at + (at >= best[:, None]), 1)
            some = row[best > 0]
            ranks[some, best[some] - 1] = self.lookup(ids[some, best[some] - 1], ids[some, best[some]])
            some = row[best < size - 1]
            ranks[some, best[some]] = self.lookup(ids[some, best[some]], ids[some, best[some] + 1])

    def learn(self, words: set[str]) -> None:
        """Encodes all units of plain words that are not known yet."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in words if w not in known]
        split = {w: self.unit.findall(w) for w in new if not w.isalpha()}
        units = {w for w in new if w not in split}
        units.update(u for parts in split.values() for u in parts)
        by_size: dict[int, list[tuple[bytes, str]]] = {}
        for u in units:
            if u in known:
                continue
            raw = u.encode()
            by_size.setdefault(len(raw), []).append((raw, u))
        for size, group in by_size.items():
            if size <= MANY:
                self.known.update(zip([u for _, u in group], self.merged_many([raw for raw, _ in group])))
        for w, parts in split.items():
            if len(w) <= MANY:
                self.known[w] = [i for u in parts for i in self.encode_unit(u)]

    def _merged_heap(self, ids: list[int]) -> list[int]:
        rank, made, ids, n = self.ranks.get, self.made, list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := rank((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            best, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made[best], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (m := rank((ids[i], ids[after[j]]))) is not None:
                    heappush(heap, (m, i, ids[i], ids[after[j]]))
            if before[i] >= 0 and (m := rank((ids[before[i]], ids[i]))) is not None:
                heappush(heap, (m, before[i], ids[before[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def symbols(self, raw: bytes, ends: bool) -> list[int]:
        ids = [self.first[b] for b in raw]
        if ends and raw:
            ids[-1] = self.last[raw[-1]]
        return ids

    # Tree concatenation ----------------------------------------------------

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The encoding of both sides' text; ``ends`` if the right side closes the unit."""
        if not left or not right:
            return left or right
        size = 4
        while True:
            l, r = min(size, len(left)), min(size, len(right))
            whole = r == len(right)
            window = left[len(left) - l :] + right[:r]
            new = self.merged(self.symbols(b"".join(map(self.raw.__getitem__, window)), ends and whole))
            if (l == len(left) or new[0] == left[-l]) and (whole or new[-1] == right[r - 1]):
                return left[: len(left) - l] + new + right[r:]
            size *= 2

    def tree(self, leaves: list[list[int]], ends: bool = True) -> list[int]:
        """Joins encoded leaves pair by pair; ``ends`` if the last of them closes the unit."""
        while len(leaves) > 1:
            paired = [self.join(leaves[i], leaves[i + 1], ends and i + 2 >= len(leaves)) for i in range(0, len(leaves) - 1, 2)]
            leaves = paired + leaves[len(leaves) - len(leaves) % 2 :]
        return leaves[0] if leaves else []

    def encode_leaf(self, raw: bytes, ends: bool) -> list[int]:
        return self.merged(self.symbols(raw, ends))

    def encode_unit(self, unit: str) -> list[int]:
        found = self.known.get(unit)
        if found is None:
            raw = unit.encode()
            found = self.encode_leaf(raw, True) if len(raw) <= self.leaf else self.encode_long(raw, True)
        return found

    def encode_long(self, raw: bytes, ends: bool) -> list[int]:
        leaves = halves(raw, self.leaf)
        return self.tree([self.encode_leaf(x, ends and k == len(leaves) - 1) for k, x in enumerate(leaves)], ends)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Each text's ids. Words that no earlier text had are encoded together first."""
        parted = []
        new: set[str] = set()
        for text in texts:
            parts: list[int | list[str]] = []
            for part in self.special_parts(text):
                if part in self.special:
                    parts.append(self.special[part])
                elif plain(part):
                    words = part.lower().split()
                    new.update(words)
                    parts.append(words)
                else:
                    parts.append(list(self.units_of(part)))
            parted.append(parts)
        self.learn(new)
        out = []
        get = self.known.get
        for parts in parted:
            ids: list[int] = []
            for part in parts:
                if type(part) is int:
                    ids.append(part)
                    continue
                for word in part:
                    found = get(word)
                    if found is None:
                        # Units of other texts, and words too long to keep.
                        for unit in self.unit.findall(word) if plain(word) else [word]:
                            ids += self.encode_unit(unit)
                    else:
                        ids += found
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The pieces with a blank between them, as a tokenizer file without a decoder joins them; none is skipped."""
        return " ".join(map(self.pieces.__getitem__, ids))


_LOADED: dict[tuple[int, int], Bpe] = {}


def loaded(raw: str, leaf: int = LEAF) -> Bpe:
    """One tokenizer for each worker process."""
    key = (hash(raw), leaf)
    if key not in _LOADED:
        _LOADED[key] = Bpe(raw, leaf)
    return _LOADED[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        raw = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return raw


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u4")


def pack_ids(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def encode_decode(
    docs: DataFrame,
    vocabulary: str = tokenizer_file("word_bpe_49k.json"),
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf: int = LEAF,
    long_chars: int = 1 << 20,
) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers
    (``unpack_ids``), ``decoded`` the text that they decode to. Texts above
    ``long_chars`` characters are encoded by several tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    result = f"id {kind}, n_tokens bigint, ids binary, decoded string"

    def whole(batches):
        bpe = loaded(shared.value, leaf)
        for batch in slices(batches):
            found = bpe.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([pack_ids(x) for x in found], pa.binary()),
                    pa.array([bpe.decode(x) for x in found], pa.string()),
                ],
                names=["id", "n_tokens", "ids", "decoded"],
            )

    def cut(batches):
        """A row for each run of units and for each leaf of a long unit."""
        bpe = loaded(shared.value, leaf)
        for batch in slices(batches, 1):
            key = batch.column(0)[0].as_py()
            for seq, (part, ends, text) in enumerate(pieces_of(bpe, batch.column(2)[0].as_py(), long_chars)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int64()), batch.column(1), pa.array([seq], pa.int64()), pa.array([part], pa.int32()), pa.array([ends]), pa.array([text], pa.binary())],
                    names=["row", "id", "seq", "part", "ends", "piece"],
                )

    def encode_pieces(batches):
        bpe = loaded(shared.value, leaf)
        for batch in slices(batches, 16):
            found = []
            for part, ends, piece in zip(*(batch.column(c).to_pylist() for c in ("part", "ends", "piece"))):
                found.append(bpe.encode(piece.decode()) if part == 0 else bpe.encode_long(piece, ends))
            kept = [batch.column(c) for c in ("row", "id", "seq", "part", "ends")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([pack_ids(x) for x in found], pa.binary())], names=["row", "id", "seq", "part", "ends", "ids"])

    def meet(group: pa.Table) -> pa.Table:
        """One text's pieces: leaves of a unit are joined up their tree, the rest is set side by side."""
        bpe = loaded(shared.value, leaf)
        group = group.sort_by("seq")
        ids: list[int] = []
        open_unit: list[list[int]] = []
        for part, ends, packed in zip(*(group.column(c).to_pylist() for c in ("part", "ends", "ids"))):
            found = unpack_ids(packed).tolist()
            if part == 0:
                ids += found
                continue
            open_unit.append(found)
            if ends:
                ids += bpe.tree(open_unit)
                open_unit = []
        return pa.table({"id": group.column("id")[:1], "n_tokens": pa.array([len(ids)], pa.int64()), "ids": pa.array([pack_ids(ids)], pa.binary()), "decoded": pa.array([bpe.decode(ids)])})

    short = rows.filter(F.length("text") <= long_chars).mapInArrow(whole, result)
    long = (
        rows.filter(F.length("text") > long_chars)
        .select(F.monotonically_increasing_id().alias("row"), "id", "text")
        .mapInArrow(cut, f"row bigint, id {kind}, seq bigint, part int, ends boolean, piece binary")
        .repartition("row", "seq")
        .mapInArrow(encode_pieces, f"row bigint, id {kind}, seq bigint, part int, ends boolean, ids binary")
        .groupBy("row")
        .applyInArrow(meet, result)
    )
    return short.unionByName(long).withColumnRenamed("id", id_col)


def pieces_of(bpe: Bpe, text: str, size: int) -> Iterator[tuple[int, bool, bytes]]:
    """(part, ends, bytes) of a long text, in order.

    Part 0 is a run of whole words, cut where white space stands; parts from 1
    are the halves of halves of one long unit, of at most ``size`` bytes each.
    """
    for piece in bpe.special_parts(text):
        if piece in bpe.special:
            yield 0, True, piece.encode()
            continue
        start = 0
        while start < len(piece):
            end = min(len(piece), start + size)
            if end < len(piece):
                space = max(piece.rfind(" ", start, end), piece.rfind("\n", start, end))
                if space <= start:
                    blank = WHITE.search(piece, end)
                    yield from long_word(bpe, piece[start : (end := blank.start() if blank else len(piece))], size)
                    start = end
                    continue
                end = space
            yield 0, True, piece[start:end].encode()
            start = end


#: White space that ends a unit whatever stands beside it.
WHITE = re.compile("[ \n]")


def long_word(bpe: Bpe, word: str, size: int) -> Iterator[tuple[int, bool, bytes]]:
    for unit in bpe.units_of(word):
        raw = unit.encode()
        if len(raw) <= size:
            yield 0, True, raw
            continue
        parts = halves(raw, size)
        for k, part in enumerate(parts):
            yield k + 1, k == len(parts) - 1, part
