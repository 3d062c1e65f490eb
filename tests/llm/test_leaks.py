"""Spaced seeds: the masks leave no case out, and leaks equal those of a plain scan."""

import itertools
import random

import pytest

from siteweave.llm import leaks


@pytest.mark.parametrize("window", range(5, 14))
def test_masks_leave_no_case_out(window):
    for wrong in itertools.combinations(range(window), leaks.replaced(window)):
        assert any(not any(o + p in wrong for p in mask) for mask in leaks.masks(window) for o in range(window - mask[-1])), wrong


def plain(text, items):
    words = leaks.words_of(text)
    found = set()
    for key, item_text in items:
        item = leaks.words_of(item_text)
        window = min(13, len(item))
        if window < 5:
            continue
        for s in range(len(item) - window + 1):
            for i in range(len(words) - window + 1):
                if sum(a != b for a, b in zip(item[s : s + window], words[i : i + window])) <= window // 6:
                    found.add(key)
    return found


def cases():
    draw = random.Random(2)
    word = lambda: draw.choice(["the", "of", f"w{draw.randrange(60)}"])
    items = [(i, " ".join(word() for _ in range(draw.choice([3, 5, 6, 8, 12, 13, 14, 20, 40])))) for i in range(40)]
    items += [(7, items[8][1]), (50, None), (51, ""), (None, " ".join(f"q{i}" for i in range(15)))]
    docs = []
    for i in range(150):
        text = [word() for _ in range(draw.randrange(60))]
        if draw.random() < 0.7:
            passage = leaks.words_of(draw.choice(items)[1])
            for _ in range(draw.randrange(6)):
                if passage:
                    passage[draw.randrange(len(passage))] = "zz"
            at = draw.randrange(len(text) + 1)
            text[at:at] = passage[draw.randrange(4) :]
        docs.append((i, draw.choice([" ", ", ", "\n"]).join(text).upper() if i % 2 else " ".join(text)))
    return items, [*docs, (900, None), (901, ""), (3, docs[3][1]), (None, items[39][1])]


@pytest.mark.parametrize("block_words", [2_000_000, 100])
def test_like_a_plain_scan(frame, block_words):
    items, docs = cases()
    table = frame([(t, i, t) for i, t in docs], "leaks string, doc_id long, text string")
    got = leaks.find_leaks(table, frame(items, "item_id long, text string"), block_words=block_words).collect()
    expected = sorted((str(i), str(sorted(map(str, plain(t, items))))) for i, t in docs)
    assert sorted((str(r["doc_id"]), str(sorted({str(x["item"]) for x in r["leaks"]}))) for r in got) == expected
    assert sum(e != "[]" for _, e in expected) > 20


def test_spans_hold_the_passage(frame):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = frame([(1, "one two " + passage.replace("p9 ", "x ") + " three")], "doc_id long, text string")
    (row,) = leaks.find_leaks(docs, frame([(5, passage)], "item_id long, text string")).collect()
    assert [tuple(x) for x in row["leaks"]] == [(5, 2, 32)]


def test_filter_and_empty_tables(frame):
    docs, items = "doc_id long, text string, lang string", "item_id long, text string"
    passage = "a b c d e f g h i j k l m n"
    kept = leaks.without_leaks(frame([(1, passage, "x"), (2, "other words", "y"), (3, None, None)], docs), frame([(1, passage)], items))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert leaks.without_leaks(frame([], docs), frame([(1, passage)], items)).collect() == []
    assert leaks.without_leaks(frame([(1, passage, "x")], docs), frame([], items)).count() == 1
