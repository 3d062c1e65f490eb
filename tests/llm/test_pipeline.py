"""The stages against plain versions of their rules, on rows with planted cases."""

import random

import corpus_pipeline
from siteweave.llm import leaks, simhash

from .test_lines import plain as plain_lines
from .test_leaks import plain as plain_leaks
from .test_similar import plain_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def sentence(draw, n=60):
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(n))


def test_stages_are_the_five():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]


def test_line_stage(spark, frame, compare):
    draw = random.Random(1)
    shared = sentence(draw)
    texts = [f"{sentence(draw)}\n{shared}\n{sentence(draw)}" for _ in range(20)] + [None, "", "  "]
    texts += [texts[0], texts[1].replace("w", "v", 1)]
    rows = [(i, t, "en", "s", -1) for i, t in enumerate(texts)]
    got = stage("line_dedup")(spark, frame(rows, SCHEMA), "").collect()
    expected = []
    for (i, text, *_), row in zip(plain_lines([(r[0], r[1], "", "") for r in rows]), rows):
        if text == row[1]:
            expected.append(row)
        elif text.strip():
            expected.append((i, text, "en", "s", len(text)))
    compare(got, expected)
    assert 23 not in {r["doc_id"] for r in got} and 24 not in {r["doc_id"] for r in got}


def test_near_stage_keeps_one_of_each_group(spark, frame):
    draw = random.Random(2)
    base = sentence(draw, 200).split()
    texts = [" ".join(base)] + [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (3, 90, 180)]
    texts += [sentence(draw, 80) for _ in range(10)] + [None, "", texts[0]]
    rows = [(i + 10, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (rows[5][0], rows[5][1], "de", "s", 1), (None, sentence(draw), "en", "s", 1), (20, "other text under the same id now", "en", "s", 1)]
    got = stage("near_dedup")(spark, frame(rows, SCHEMA), "").collect()
    unique = sorted({(i, t) for i, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))
    roots = plain_groups([t for _, t in unique])
    # One document of each group, of the smallest id.
    groups = {}
    for (i, t), root in zip(unique, roots):
        groups.setdefault(root, []).append((i, t))
    kept = [(r["doc_id"], r["text"]) for r in got]
    assert len(kept) == len(groups) == len(set(kept))
    for members in groups.values():
        own = [m for m in members if m in kept]
        assert len(own) == 1 and own[0][0] == members[0][0]


def test_near_stage_links_by_simhash(spark, frame):
    """Long texts whose fingerprints are three bits apart at most go together, though their shingles are not alike enough for the exact join."""
    draw = random.Random(4)
    common, rows = sentence(draw, 3), []
    for i in range(2):
        # Most shingles repeat, so they decide the bits; the set of different shingles holds little in common.
        rows.append((i, " ".join([common] * 200 + [sentence(draw, 40)]), "en", "s", 1))
    rows.append((2, sentence(draw, 60), "en", "s", 1))
    assert bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).count("1") <= 3
    assert len(set(plain_groups([r[1] for r in rows]))) == 3
    assert {r["doc_id"] for r in stage("near_dedup")(spark, frame(rows, SCHEMA), "").collect()} == {0, 2}


def test_leak_stage(spark, frame):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    clean = {r[0] for r in rows if not plain_leaks(" ".join(leaks.words_of(r[1])[:300]), items)}
    planted = [(10_000 + i, f"{sentence(random.Random(i))} {t} {sentence(random.Random(i + 1))}", "en", "s", 1) for i, (_, t) in enumerate(items[:10])]
    got = {r["doc_id"] for r in stage("decontaminate")(spark, frame([*rows, *planted], SCHEMA), folder).collect()}
    assert not got & {r[0] for r in planted}
    assert got <= {r[0] for r in rows} and len(got & clean) >= 0.98 * len(clean)


def test_run_is_the_stages_in_order(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, run in corpus_pipeline.STAGES:
        docs = run(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in docs.collect())
    assert got.count() > 50


def test_empty_documents(spark, frame):
    folder = "/root/testdata/sf0.001"
    docs = frame([], SCHEMA)
    for _, run in corpus_pipeline.STAGES:
        docs = run(spark, docs, folder)
    assert docs.collect() == []


def test_clashing_names_pass_through(spark, frame, compare):
    folder = "/root/testdata/sf0.001"
    schema = SCHEMA + ", _mark string, mark string, gone string, _gone string, _leaks string, leaks string, lines_gone int"
    draw = random.Random(8)
    shared = sentence(draw)
    rows = [(i, f"{sentence(draw)}\n{shared}", "en", "s", 1, "m", "n", "g", "h", "l", "k", i) for i in range(5)]
    for name in ("line_dedup", "decontaminate"):
        got = stage(name)(spark, frame(rows, schema), folder)
        assert got.schema == frame(rows, schema).schema
        compare([r[5:] for r in got.collect()], [r[5:] for r in rows])
