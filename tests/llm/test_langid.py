"""Forward and backward passes against all segmentations, held-out accuracy, and odd rows."""

import itertools
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.llm import langid
from siteweave.llm.common import tokenizer_file
from siteweave.llm.queries import op1_language_id


@pytest.fixture(scope="module")
def pieces():
    return langid.read_pieces(tokenizer_file("piece_bpe_32k.model"))


def vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    return {model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i)}


def segmentations(run, known):
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        parts, start = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                parts.append(run[start : i + 1])
                start = i + 1
        if all(p in known or len(p) == 1 for p in parts):
            yield parts


def test_forward_sums_all_segmentations(pieces):
    known = vocabulary()
    draw = np.random.default_rng(1)
    model = np.zeros((pieces.count + 2, 2))
    model[1:-1] = draw.random((pieces.count, 2))
    model[-1] = langid.UNKNOWN
    for run in ("▁the", "▁und", "▁xqzé", "ing", "▁日本a"):
        places = langid.lattice(pieces, langid.code_points([run]))
        row = {(s, e): int(r[0]) for s, e, r in places}
        usable = lambda p, s: row.get((s, s + len(p)), 0) != 0
        total = np.zeros(2)
        uses = np.zeros_like(model)
        for parts in segmentations(run, known):
            starts = np.cumsum([0, *map(len, parts)])[:-1]
            if all(usable(p, s) for p, s in zip(parts, starts)):
                rows = [row[(s, s + len(p))] for p, s in zip(parts, starts)]
                value = reduce(lambda a, b: a * b, [model[r] for r in rows])
                total += value
                for r in rows:
                    uses[r] += value
        assert np.allclose(langid.score_runs(pieces, model, [run])[0], np.log(total))
        found = langid.expected_counts(pieces, model, [run], np.ones((1, 2)))
        assert np.allclose(found[1:-1], (uses / total)[1:-1])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = op1_language_id(spark, folder).join(truth, "doc_id").toPandas()
    assert len(got) == 1000
    assert got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98


def test_odd_rows(spark, frame):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r[0], r[1], r[2], 1) for r in base] + [(None, None, None, 1), (9001, "", "en", 1), (9002, "12 !!", None, 1), (9003, "x" * 100_000, None, 1), (9003, "x" * 100_000, None, 1)]
    got = langid.identify(frame(rows, "doc_id long, text string, lang string, score int")).collect()
    assert len(got) == len(rows)
    odd = {r["doc_id"]: r for r in got if r["doc_id"] is None or r["doc_id"] > 9000}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0.0 for k in (None, 9001, 9002))
    assert odd[9003]["lang_pred"] in {"en", "de", "fr", "es"}


def test_nothing_to_learn(frame):
    schema = "doc_id long, text string, lang string"
    assert langid.identify(frame([], schema)).collect() == []
    assert [r["lang_pred"] for r in langid.identify(frame([(1, "abc", None)], schema)).collect()] == ["und"]


def test_fold_is_crc32(frame):
    import zlib

    got = langid.identify(frame([(i, None, None) for i in range(40)], "doc_id long, text string, lang string")).select("doc_id", F.col("held_out")).collect()
    assert {r[0]: r[1] for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(40)}
