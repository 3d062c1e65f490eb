"""Line dedup against a comparison of all lines, and the sums behind its keys."""

import random

import pytest

from siteweave.llm import lines

WORDS = "a b c d e f g".split()
SCHEMA = "doc_id long, text string, note string, lines_removed string"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    cut = [(k, -(10**30) if row[0] is None else row[0], row[1].split("\n") if row[1] is not None else []) for k, row in enumerate(rows)]
    occurrences = [(k, (i, n), line) for k, i, own in cut for n, line in enumerate(own) if line.strip(" \t\x0b\f\r")]
    first = {}
    for _, at, line in occurrences:
        first[line] = min(first.get(line, at), at)
    words = {line: line.split() for line in first}
    near = {a for a in first if len(words[a]) >= 5 and any(len(words[b]) >= 5 and first[b] < first[a] and one_apart(words[a], words[b]) for b in first if a != b)}
    gone = {(k, at[1]) for k, at, line in occurrences if at > first[line] or line in near}
    out = []
    for (k, _, own), row in zip(cut, rows):
        left = [line for n, line in enumerate(own) if (k, n) not in gone]
        out.append((row[0], None if row[1] is None else "\n".join(left), row[2], len(own) - len(left)))
    return out


def some_rows(seed, count):
    draw = random.Random(seed)
    for i in range(count):
        own = []
        for _ in range(draw.randint(0, 5)):
            blank = draw.choice([" "] * 9 + ["  ", "\t"])
            own.append(blank.join(draw.choice(WORDS[: draw.choice([2, 3, 7])]) for _ in range(draw.choice([0, 1, 2, 4, 5, 6, 7, 9]))))
        yield draw.choice([i, i, i, i - 1]), "\n".join(own) if draw.random() > 0.03 else None, draw.choice(["x", None]), "clash"


@pytest.mark.parametrize("broadcast_rows", [0, lines.BROADCAST_ROWS])
def test_like_all_lines_compared(frame, compare, monkeypatch, broadcast_rows):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", broadcast_rows)
    rows = list(some_rows(broadcast_rows, 250))
    rows += [(None, "a b c d e f\nq", None, ""), (None, "q", "n", ""), (999, "", "e", ""), *rows[:4]]
    got = lines.without_repeated_lines(frame(rows, SCHEMA)).collect()
    compare(got, plain(rows))


def test_one_hot_line_and_template(frame, compare):
    rows = [(i, f"the same line in every text\nitem number {i} of the long list", "x", "") for i in range(300)]
    rows += [(1000 + i, f"own words {i} {i * 7} stand {i * 13} here {i * 17}", "x", "") for i in range(100)]
    compare(lines.without_repeated_lines(frame(rows, SCHEMA)).collect(), plain(rows))


def test_very_long_lines(frame):
    words = [f"w{i}" for i in range(20_000)]
    changed = [*words[:9000], "other", *words[9001:]]
    longer = [*words[:15_000], "more", *words[15_000:]]
    rows = [(1, " ".join(words), "", ""), (2, " ".join(changed), "", ""), (3, " ".join(longer), "", ""), (4, " ".join(reversed(words)), "", "")]
    got = {r["doc_id"]: r["lines_removed"] for r in lines.without_repeated_lines(frame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_empty_table(frame):
    assert lines.without_repeated_lines(frame([], SCHEMA)).collect() == []


def test_no_python_in_the_plan(frame):
    docs = frame(list(some_rows(3, 20)), SCHEMA)
    plan = lines.without_repeated_lines(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
