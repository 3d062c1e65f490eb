"""Held-out accuracy, calibration, folds and odd rows."""

import zlib

import numpy as np

from siteweave.llm import quality
from siteweave.llm.common import table
from siteweave.llm.queries import op5_quality

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    got = op5_quality(spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").toPandas()
    assert op5_quality(spark, FOLDER).count() == 1000
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == got.held_out.tolist()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.98
    assert ((got.score >= 0.7).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    # Calibration: the mean score is the share of label 1, up to a few hundredths.
    assert abs(held.score.mean() - held.quality.mean()) < 0.04


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    turned = labels.withColumn("quality", F.when(quality.id_fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (quality.classify(docs, x).orderBy("doc_id").toPandas().score for x in (labels, turned))
    assert np.allclose(first, second)


def test_odd_rows(spark, frame):
    docs = [(r["doc_id"], r["text"], "x") for r in table(spark, FOLDER, "documents").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in table(spark, FOLDER, "labels").collect()]
    docs += [(None, None, None), (90_001, "", "x"), (90_002, "word " * 50_000, "x"), docs[0], (90_003, None, "x")]
    labels += [(None, 1, 0), (90_001, None, 0), labels[0], (5, 1, 0), (5, 0, 0), (99_999, 1, 1)]
    got = quality.classify(frame(docs, DOCS), frame(labels, LABELS)).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)


def test_without_labels_of_both_kinds(frame):
    docs = frame([(1, "a b", "x"), (2, None, "x")], DOCS)
    assert [r["score"] for r in quality.classify(docs, frame([], LABELS)).collect()] == [1.0, 1.0]
    assert [r["score"] for r in quality.classify(docs, frame([(1, 0, 0)], LABELS)).collect()] == [0.0, 0.0]
    assert quality.classify(frame([], DOCS), frame([(1, 0, 0), (3, 1, 0)], LABELS)).collect() == []


def test_index_vectors_are_sparse_and_fixed():
    vector = quality.index_vector("word")
    assert np.count_nonzero(vector) == quality.PLACES
    assert (vector == quality.index_vector("word")).all()


def test_filter_keeps_columns(spark, frame):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["predicted"] == 1}
    assert {r["doc_id"] for r in kept.collect()} == good
