"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siteweave.llm import spelling

#: Extra columns whose names the operator uses inside.
SCHEMA = "doc_id long, text string, word string, n long, root string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    counted = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counted[run] += 1
    return {w: n for w, n in counted.items() if n >= 2}


def plain(counted):
    others = {w: [v for v in counted if near(w, v)] for w in counted}
    form = {}
    for w, own in others.items():
        best = min(own, key=lambda v: (-counted[v], v), default=None)
        form[w] = best if best is not None and counted[best] >= 10 * counted[w] else None
    for w in counted:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, counted[w], len(others[w]), counted.get(form[w])


def some_words(seed, count, letters="abé", shortest=7):
    draw = random.Random(seed)
    found = set()
    for _ in range(count):
        word = "".join(draw.choice(letters) for _ in range(draw.choice([shortest, shortest + 1, 10])))
        found.add(word)
        at = draw.randrange(len(word))
        found.add(word[:at] + draw.choice(letters) + word[at:])
        found.add(word[:at] + draw.choice(letters) + word[at + 1 :])
    return sorted(w for w in found if len(w) >= shortest)


def some_rows(seed):
    draw = random.Random(seed)
    words = some_words(seed, 25)
    for i in range(120):
        kinds = [w.upper() if draw.random() < 0.1 else w for w in draw.choices(words, [1 / (k + 1) ** 2 for k in range(len(words))], k=40)]
        yield draw.choice([i, i, None]), "".join(w + draw.choice([" ", "\n", "-", "中", "1", "ā"]) for w in kinds), "x", 3, "y"


@pytest.mark.parametrize("most", [100_000, 3])
def test_variants_match_brute_force(spark, frame, compare, most):
    rows = [*some_rows(1), (1, None, None, None, None), (2, "", "", 1, ""), (None, "short words only", "", 1, "")]
    rows += rows[:5]
    counted = plain_words(rows)
    expected = list(plain(counted))
    assert any(r[1] for r in expected) and any(r[2] != r[1] and r[1] for r in expected)
    got = spelling.variants(frame(rows, SCHEMA), most=most)
    compare(got.select("word", "form", "root", "n", "n_near", "form_n").collect(), expected)


@pytest.mark.parametrize("most", [2, 20, 100_000])
def test_near_words_of_hot_heads_and_tails(frame, compare, most):
    middle = some_words(3, 40, "ab", 1)
    words = sorted({"abcd" + m + "xyz" for m in middle} | {"abcdaaaaaaxyz"[:k] + "a" * j + "xyz" for k in (4, 7) for j in range(9)} | set(some_words(5, 30)))
    words = [w for w in words if len(w) >= 7]
    rows = [(w, zlib.crc32(w.encode()) % 5) for w in words]
    counted = dict(rows)
    expected = []
    for w, n in rows:
        own = [v for v in words if near(w, v)]
        best = min(own, key=lambda v: (-counted[v], v), default=None)
        expected.append((w, n, len(own), best, counted.get(best)))
    compare(spelling.near_words(frame(rows, "word string, n long"), most).collect(), expected)


@pytest.mark.parametrize("letters, at_once", [("ab", 10_000), ("abcdefgh", 7), ("a中\U0001f600", 3)])
def test_sorted_list(monkeypatch, letters, at_once):
    monkeypatch.setattr(spelling, "AT_ONCE", at_once)
    words = some_words(9, 120, letters)
    groups = [w[:2] for w in words]
    starts = [k for k in range(len(words)) if not k or groups[k] != groups[k - 1]]
    scan = spelling.SortedList(words, [2] * len(starts), starts)
    got = sorted((int(x), int(y)) for a, b in scan.near() for x, y in zip(a, b))
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if groups[i] == groups[j] and near(words[i], words[j])]
    some = sorted((int(x), int(y)) for a, b in scan.near(scan.length - 3) for x, y in zip(a, b))
    assert set(some) <= set(got) and {p for p in got if words[p[0]][: len(words[p[0]]) - 3] == words[p[1]][: len(words[p[0]]) - 3]} <= set(some)


def test_ranges_beyond_one_edit_are_skipped(monkeypatch):
    """The cells that are computed follow the near prefixes, not the square of the list."""
    words = some_words(11, 4_000, "abcdefghijklmnop", 9)
    cells = 0
    choose = np.repeat

    def counted(a, *rest):
        nonlocal cells
        found = choose(a, *rest)
        cells += len(found)
        return found

    monkeypatch.setattr(spelling.np, "repeat", counted)
    scan = spelling.SortedList(words, [0 + 1] * 16, [next(k for k, w in enumerate(words) if w[0] == c) for c in "abcdefghijklmnop"])
    assert sum(len(a) for a, _ in scan.near()) > 4_000
    assert cells < 0.1 * len(words) ** 2 / 16 * 9


def test_windows_and_long_runs():
    text = ("word" * 5 + " ") * 200_000 + "x" * 3_000_000 + " lastword"
    found = [w for part in spelling.runs(text) for w in part]
    assert len(found) == 200_002 and len(found[-2]) == 3_000_000 and found[-1] == b"lastword"


def test_empty(frame):
    assert spelling.variants(frame([], SCHEMA)).collect() == []
