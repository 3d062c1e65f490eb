"""Groups of alike texts against a comparison of all pairs, also where the fingerprints of op7 miss most links."""

import random

import pytest

import corpus_pipeline
from siteweave.llm import similar

from .test_simhash import components, plain_fingerprint


def plain_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def plain_groups(texts):
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def texts_of(seed):
    """Bases with copies of some replaced words, from near equality to below the bound, and a phrase that many hold."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(3000)}"
    phrase = " ".join(word() for _ in range(12))
    out = [None, "", "  ", "one two", "One  two", "one two three"]
    for base in range(40):
        words = [word() for _ in range(draw.choice([4, 12, 40, 100, 300]))]
        out.append(" ".join(words))
        for _ in range(draw.choice([0, 1, 3])):
            own = list(words)
            for _ in range(draw.randint(0, 1 + len(own) // 30)):
                own[draw.randrange(len(own))] = word()
            out.append(" ".join(own))
        out.append(phrase + " " + " ".join(word() for _ in range(draw.choice([3, 30]))))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("crowd, share", [(2, 8), (4, 1), (similar.CROWD, similar.SHARE)])
def test_like_all_pairs_compared(frame, monkeypatch, crowd, share):
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "SHARE", share)
    texts = texts_of(crowd)
    got = similar.near_duplicates(frame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == plain_groups(texts)


def test_stage_finds_what_three_bits_miss(spark, frame):
    texts = texts_of(7)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    groups = plain_groups(texts)
    assert sorted(r["doc_id"] for r in got) == sorted(set(groups))
    old = components([plain_fingerprint(t) for t in texts], list(range(len(texts))), 3)
    assert len(set(old)) > len(set(groups))


def test_hot_text_and_empty_table(frame):
    rows = [(i, "the same text in one row of two " * 5 if i % 2 else f"own words of row {i} and {i * 7} then {i * 13}") for i in range(400)]
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(frame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 1 if i % 2 else i for i in range(400)}
    assert similar.near_duplicates(frame([], "doc_id long, text string")).collect() == []


def test_crowds_of_sets_that_are_not_alike(frame, monkeypatch):
    """Many texts hold one phrase; only a few of them are alike, and the phrase makes no pair of the others a candidate."""
    monkeypatch.setattr(similar, "CROWD", 8)
    monkeypatch.setattr(similar, "FREQUENT", 10**6)
    draw = random.Random(3)
    own = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(30)) for _ in range(60)]
    texts = [f"{t} one phrase of seven words in all" for t in own] + [f"{t} one phrase of seven words in all or so" for t in own[:5]]
    seen = []
    listed = similar.listed
    monkeypatch.setattr(similar, "listed", lambda *rows: seen.append(listed(*rows)) or seen[-1])
    got = similar.near_duplicates(frame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == plain_groups(texts) == [*range(60), *range(5)]


def test_null_ids_and_clashing_names(spark, frame):
    schema = "doc_id long, text string, lang string, source string, n_chars long, first string, _key string, _row long, key int, row int, mark int, least int"
    texts = ["some words that stand in this text " * 3, "SOME words that stand in this text " * 3, "words of their own here", None, ""]
    rows = [(None if i == 2 else i, t, "en", "s", 1, "f", "k", 7, 1, 2, 3, 4) for i, t in enumerate(texts)]
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame([*rows, rows[2]], schema), "")
    assert got.schema == frame(rows, schema).schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
