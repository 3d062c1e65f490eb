"""Ids and texts against the tokenizers library, and long texts cut over tasks against whole ones."""

import itertools
import random

import pytest
from tokenizers import Tokenizer

from siteweave.llm import bpe
from siteweave.llm.common import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, count, sizes):
    draw = random.Random(seed)
    alphabets = ["ab", "etaoinshrdlu", "the and of ing er", "aaab", "!?.'", "é ü'sà\t\n", "ÀÉΣσ中文한́İ", "<|endoftext|> a", "\x1c\x85\xa0 x1²"]
    for _ in range(count):
        letters = draw.choice(alphabets)
        text = "".join(draw.choice(letters) for _ in range(draw.choice(sizes)))
        yield text if draw.random() < 0.8 else text + "<|startoftext|>" + text


def test_every_sign_like_the_library(library):
    own = bpe.Bpe(bpe.read_vocabulary(PATH))
    for point in [*range(0x0, 0x500), *range(0x2000, 0x2100), 0x1F600, 0x4E2D, 0xAC00]:
        for text in (chr(point), f"a{chr(point)}b", f"1{chr(point)}!'s"):
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(point)


@pytest.mark.parametrize("leaf", [2, 16, 256])
def test_trees_like_the_library(library, leaf):
    own = bpe.Bpe(bpe.read_vocabulary(PATH), leaf)
    for text in texts(leaf, 300, [0, 1, 5, 40, 300, 2000]):
        ids = own.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_rows_are_cut_over_tasks(frame, library):
    word = "".join(random.Random(4).choice("etaoinshrdlu") for _ in range(5000))
    rows = [(i, t) for i, t in enumerate(texts(9, 60, [0, 10, 200, 3000]))]
    rows += [(100, word + " and " + word), (101, None), (102, ""), (None, "some text"), (0, rows[0][1]), (103, "a " * 3000), (104, "<|endoftext|>" + word)]
    docs = frame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    for size in (100, 1 << 20):
        got = bpe.encode_decode(docs, leaf=32, long_chars=size).collect()
        expected = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
        key = lambda r: (str(r[0]), r[1])
        assert sorted([(r["doc_id"], bpe.unpack_ids(r["ids"]).tolist()) for r in got], key=key) == sorted(expected, key=key)
        for r in got:
            assert r["n_tokens"] == len(r["ids"]) // 4
            assert r["decoded"] == library.decode(bpe.unpack_ids(r["ids"]).tolist(), skip_special_tokens=False)


def test_empty_table(frame):
    assert bpe.encode_decode(frame([], "doc_id long, text string")).collect() == []


def test_many_units_at_once_equal_one_by_one():
    own = bpe.Bpe(bpe.read_vocabulary(PATH))
    for size in (1, 2, 5):
        units = ["".join(p).encode() for p in itertools.islice(itertools.product("theran", repeat=size), 300)]
        assert own.merged_many(units) == [own.merged(own.symbols(u, True)) for u in units]
        assert [own._merged_heap(own.symbols(u, True)) for u in units] == own.merged_many(units)
