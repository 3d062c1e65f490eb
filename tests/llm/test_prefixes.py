"""Token counts of prefixes against the tokenizers library, prefix by prefix."""

import random

import pytest
from tokenizers import Tokenizer

from siteweave.llm import prefixes
from siteweave.llm.common import tokenizer_file

FILE = tokenizer_file("word_bpe_49k.json")
#: Extra columns whose names the operator uses inside.
SCHEMA = "doc_id long, text string, part int, counts string, n_tokens long, id long"
LETTERS = [*"aAbeéÉ 's'dre'll\n\t. ,!?123中文हिन्दी한ᄒ\0", "́", "̧", "<|endoftext|>", "<|start", "  ", "ᅡ", "ᆨ", "İ", "\x85", "　", "\x1c", "ŉ", "ß", "😀", "‍", "\xa0", "the", "ing", "'re", "'ve", "ation"]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(FILE)
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def read():
    return prefixes.reader(open(FILE, encoding="utf-8").read())


def some_text(draw, parts):
    return "".join(draw.choice(LETTERS) for _ in range(draw.randint(0, parts)))


def test_every_prefix_as_the_library_counts_it(read, library):
    draw = random.Random(4)
    texts = [some_text(draw, 16) for _ in range(600)]
    texts += ["".join(draw.choice("aeinrst") for _ in range(n)) + " end" for n in (63, 64, 65, 300)]
    texts += ["é" * 70, "!" * 90, "-<|endoftext|>", "x'<|startoftext|>re"]
    for text, found in zip(texts, read.counts_of(texts)):
        assert found.tolist() == [library(text[:k]) for k in range(1, len(text) + 1)], ascii(text)


def test_units_one_by_one_and_together(monkeypatch, read):
    monkeypatch.setattr(prefixes, "WINDOW", 50)
    draw = random.Random(5)
    units = sorted({"".join(draw.choice("abcinéo\0") for _ in range(draw.randint(1, 30))).encode() for _ in range(300)})
    for raw, found in zip(units, read.many(units)):
        last, count, closed = [-1], [0], [0]
        read.rows(raw, last, count, closed)
        ends = prefixes.character_ends(raw)
        assert found[ends].tolist() == [closed[k + 1] for k in ends]
        assert read.unit(raw.decode()).tolist() == found[ends].tolist()
    long = "".join(draw.choice("abcdeé") for _ in range(500))
    last, count, closed = [-1], [0], [0]
    read.rows(long.encode(), last, count, closed)
    assert read.unit(long).tolist() == [closed[k + 1] for k in prefixes.character_ends(long.encode())]


def test_only_one_token_fits(read):
    """Of the tokens that end at a place exactly one may stand behind the prefix that it leaves."""
    draw = random.Random(6)
    for _ in range(200):
        raw = "".join(draw.choice("aeinrsth") for _ in range(12)).encode()
        last, count, closed = [-1], [0], [0]
        read.rows(raw, last, count, closed)
        for end in range(1, len(raw) + 1):
            fits = [s for s in range(end) if (t := read.open.get(raw[s:end], -1)) >= 0 and (not s or read.stable(last[s], t))]
            assert len(fits) == 1


def rows_of(library):
    draw = random.Random(7)
    rows = [(k, " ".join("".join(draw.choice("aeinrst") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(0, 60))), k, "c", k, 5) for k in range(40)]
    rows += [(50, None, 1, None, None, None), (51, "", 1, "", 0, 0), (None, "no id\n" * 30, 0, "", 0, 0), (52, some_text(draw, 200) + " x", 0, "", 0, 0), (53, "y" * 700, 0, "", 0, 0)]
    return rows + rows[:2] + rows[-4:] + [(3, "another text under this id", 0, "", 0, 0)]


@pytest.mark.parametrize("long_chars", [1 << 20, 40, 1])
def test_documents(frame, compare, library, long_chars):
    rows = rows_of(library)
    table = prefixes.prefix_table(frame(rows, SCHEMA), long_chars=long_chars)
    got = prefixes.token_counts(table, 30)
    expected = [(i, len((t or "").encode()), library(t or ""), library(t or "") > 30) for i, t, *_ in rows]
    compare(got.collect(), expected)
    held = {}
    for r in table.collect():
        held.setdefault((r["doc_id"], r["digest"]), {})[r["start"]] = [n + r["before"] for n in prefixes.unpacked(r["counts"])]
    found = sorted([n for s in sorted(parts) for n in parts[s]] for parts in held.values())
    texts = {(i, t or "") for i, t, *_ in rows}
    assert found == sorted([library(t[:k]) for k in range(1, len(t) + 1)] for _, t in texts)


def test_questions_need_no_texts(frame, library):
    rows = rows_of(library)
    texts = {(i, t or "") for i, t, *_ in rows}
    table = prefixes.prefix_table(frame(rows, SCHEMA), long_chars=50).cache()
    for limit in (0, 7, 10_000):
        got = sorted((str(r["doc_id"]), r["chars"]) for r in prefixes.truncated(table, limit).collect())
        assert got == sorted((str(i), max(k for k in range(len(t) + 1) if library(t[:k]) <= limit)) for i, t in texts)
    asked = [(i, k) for i, _ in texts for k in (0, 1, 17, 60, 10_000)]
    got = [(r["doc_id"], r["chars"], r["n_tokens"]) for r in prefixes.prefix_tokens(table, frame(asked, "doc_id long, chars long")).collect()]
    assert set(got) == {(i, k, library(t[:k])) for i, t in texts for j, k in asked if i == j and k <= len(t)}


def test_empty(frame):
    assert prefixes.prefix_table(frame([], SCHEMA)).collect() == []
