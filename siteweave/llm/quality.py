"""Document quality by random-indexing word vectors and a small network.

Every word of a bounded vocabulary has a sparse random index vector, drawn from
a hash of the word; its context vector adds up the index vectors of its
neighbours in the learning texts. A document is the mean of its words' vectors,
fed to a network of two layers whose logit is divided by a temperature that was
fitted on learning rows that the network had not seen.

A word that repeats the one before it counts as the one word ``AGAIN``, so that
stuttering texts are told from prose by their words' contexts like any others.
Words outside the vocabulary share the vector of their shape (capital, upper
case, digits, signs), which takes part in learning like a word.

Learning uses at most about ``per_class`` labelled documents of each label,
chosen by a hash of the id among the rows that may be learned from, weighted
back to the labels' shares; scoring reads every document whole.

Defined results: null and empty texts have the mean vector zero and get a score
like any other; a document with several labels counts with the mean of its
labels; null labels and ids are not learned from; without labels of both kinds
every score is the share of label 1 (1 if there is none). Only the id and text
of the documents and the id and label of the labels are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import hash_share, id_fold, ship, slices

#: Length of the word vectors.
SIZE = 48
#: Non-zero places of an index vector.
PLACES = 6
#: Neighbours on each side.
WINDOW = 2
#: Words whose place a task keeps; it starts anew when full.
CACHE_WORDS = 100_000

#: Stands for a word that repeats the one before it, and for no word.
AGAIN, NONE = "<again>", "<none>"
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    if token.isalpha():
        kind = "upper" if token.isupper() and len(token) > 1 else "capital" if token[0].isupper() else "lower"
        return f"<{kind}{min(len(token) // 6, 3)}>"
    if token.isdigit():
        return "<digits>"
    return f"<sign{min(len(token), 4)}>"


def index_vector(word: str) -> np.ndarray:
    """Ones and minus ones at places drawn from the word's hash."""
    draw = np.random.default_rng(xxhash.xxh64_intdigest(word, 11))
    out = np.zeros(SIZE)
    out[draw.choice(SIZE, PLACES, replace=False)] = draw.choice([-1.0, 1.0], PLACES)
    return out


class Words:
    """Places of tokens in the vocabulary, by white-space word, with a cache."""

    def __init__(self, vocabulary: list[str]):
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.known: dict[str, list[int]] = {}

    def places(self, text: str | None) -> list[int]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, out, again, before = self.known, [], self.place.get(AGAIN, 0), None
        for word in text.split() if text else ():
            if word == before:
                out.append(again)
                continue
            before = word
            found = known.get(word)
            if found is None:
                found = [self._place(t) for t in TOKEN.findall(word)]
                if len(word) < 64:
                    known[word] = found
            out += found
        return out

    def _place(self, token: str) -> int:
        place = self.place
        return place[token] if token in place else place.get(shape(token), 0)


@dataclass
class QualityModel:
    vocabulary: list[str]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    first: tuple[np.ndarray, np.ndarray]
    second: tuple[np.ndarray, float]
    temperature: float
    constant: float | None = None

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(logits(self, pooled) / self.temperature, -30, 30)))


def logits(m: QualityModel, pooled: np.ndarray) -> np.ndarray:
    hidden = np.tanh((pooled - m.mean) / m.spread @ m.first[0] + m.first[1])
    return hidden @ m.second[0] + m.second[1]


def pool(words: Words, vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), vectors.shape[1]))
    for i, text in enumerate(texts):
        places = words.places(text)
        total = np.zeros(vectors.shape[1])
        for start in range(0, len(places), 1 << 14):
            total += vectors[places[start : start + (1 << 14)]].sum(0)
        out[i] = total / max(len(places), 1)
    return out


def learning_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame | None, float]:
    """(text, label, weight) of the chosen documents, and the share of label 1.

    ``docs`` has id and text, ``labels`` id and label. The chosen ids are bounded by
    ``per_class``, so they go to the documents and no text is shuffled.
    """
    labels = labels.filter("id is not null and label is not null").groupBy("id").agg(F.avg(F.col("label").cast("double")).alias("mean"))
    labels = labels.select("id", (F.col("mean") >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return None, (sizes.get(1, 0) / total if total else 1.0)
    chosen, weight = F.lit(False), F.lit(1.0)
    for label, n in sizes.items():
        chosen |= (F.col("label") == label) & hash_share(F.col("id"), per_class, n, 2)
        weight = F.when(F.col("label") == label, n / total / min(1.0, per_class / n)).otherwise(weight)
    picked = labels.filter(chosen).select("id", "label", weight.alias("weight"))
    return docs.join(F.broadcast(picked), "id").select("id", "text", "label", "weight"), sizes[1] / total


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, vocabulary_size: int = 8192, min_count: int = 3) -> QualityModel:
    spark = docs.sparkSession
    ship(spark)
    rows, share = learning_rows(docs, labels, per_class)
    empty = QualityModel([], np.zeros((1, SIZE)), np.zeros(SIZE), np.ones(SIZE), (np.zeros((SIZE, 1)), np.zeros(1)), (np.zeros(1), 0.0), 1.0, share)
    if rows is None:
        return empty
    rows = rows.repartition(16, F.xxhash64("id")).persist()
    try:
        return _fit(rows, vocabulary_size, min_count) or empty
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, vocabulary_size: int, min_count: int) -> QualityModel | None:
    spark = rows.sparkSession
    texts = rows.select("text")

    def tokens(batches):
        from collections import Counter

        found: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                own = TOKEN.findall(text or "")
                found.update(own)
                found.update(map(shape, own))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counted = texts.mapInArrow(tokens, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    common = counted.filter(F.col("n") >= min_count).orderBy(F.desc("n"), "word").limit(vocabulary_size).select("word")
    vocabulary = [NONE, AGAIN, *(r["word"] for r in common.collect())]
    sent = spark.sparkContext.broadcast(vocabulary)

    def contexts(batches):
        """The sums of neighbours' index vectors, by word."""
        words, index = Words(sent.value), np.array([index_vector(w) for w in sent.value])
        total = np.zeros_like(index)
        seen = False
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                places = np.array(words.places(text), np.int64)
                seen |= len(places) > 0
                for step in range(1, WINDOW + 1):
                    left, right = places[:-step], places[step:]
                    np.add.at(total, left, index[right])
                    np.add.at(total, right, index[left])
        if seen:
            row, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(place, pa.int32()), pa.array(total[row, place])], names=["row", "place", "x"])

    summed = texts.mapInArrow(contexts, "row int, place int, x double").groupBy("row", "place").agg(F.sum("x").alias("x")).toPandas()
    context = np.zeros((len(vocabulary), SIZE))
    context[summed["row"], summed["place"]] = summed["x"]
    own = np.array([index_vector(w) for w in vocabulary])
    # The word's own index vector takes part, so that words in like contexts stay apart.
    vectors = (unit(context - context.mean(0)) + unit(own)).astype(np.float32)
    vectors[0] = 0.0
    model = spark.sparkContext.broadcast((vocabulary, vectors))

    def pooled(batches):
        names, values = model.value
        words = Words(names)
        for batch in slices(batches):
            found = pool(words, values, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(list(found), pa.list_(pa.float64()))], names=["id", "label", "weight", "x"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    table = rows.select("id", "text", "label", "weight").mapInArrow(pooled, f"id {kind}, label int, weight double, x array<double>").orderBy("id").toPandas()
    if table.empty or table["label"].nunique() < 2:
        return None
    x, y, weight = np.array(table["x"].tolist()), table["label"].to_numpy(float), table["weight"].to_numpy(float)
    return train(vocabulary, vectors, x, y, weight / weight.mean())


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def train(vocabulary, vectors, x, y, weight, hidden: int = 24, rounds: int = 400, decay: float = 1e-3) -> QualityModel:
    """Two layers by Adam over all learning rows but every fifth; these fit the temperature."""
    draw = np.random.default_rng(5)
    # Labels may be wrong: targets keep a little away from certainty.
    y = 0.01 + 0.98 * y
    aside = np.arange(len(y)) % 5 == 4
    mean, spread = x[~aside].mean(0), x[~aside].std(0) + 1e-3
    z, t, w = (x[~aside] - mean) / spread, y[~aside], weight[~aside] / weight[~aside].sum()
    params = [draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        h = np.tanh(z @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        d = (p - t) * w
        dh = np.outer(d, params[2]) * (1 - h * h)
        grads = [z.T @ dh + decay * params[0], dh.sum(0), h.T @ d + decay * params[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - 0.03 * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.999**k)) + 1e-8)
    m = QualityModel(vocabulary, vectors, mean, spread, (params[0], params[1]), (params[2], float(params[3][0])), 1.0)
    if aside.any():
        z, t, w = logits(m, x[aside]), y[aside], weight[aside]
        tried = np.exp(np.linspace(np.log(0.25), np.log(8.0), 141))
        m.temperature = float(tried[np.argmin([(w * (np.logaddexp(0, z / k) - t * z / k)).sum() for k in tried])])
    return m


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(id, score) for the columns id and text."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("id", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        own = sent.value
        words = Words(own.vocabulary)
        for batch in slices(batches):
            found = own.scores(pool(words, own.vectors, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double")


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, **options) -> QualityModel:
    """Learns from the rows that ``learn``, over the label's ``id``, lets; by default those whose id's crc32 modulo 4 is not 2."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    known = known.filter(id_fold(F.col("id"), 4) != 2 if learn is None else learn)
    return fit(rows_of(docs, id_col, text_col), known, **options)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = fitted(docs, labels, id_col=id_col, text_col=text_col, **options)
    return score(rows_of(docs, id_col, text_col), model).select(
        F.col("id").alias(id_col), (id_fold(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with their columns, whose score reaches the threshold."""
    model = fitted(docs, labels, id_col=id_col, text_col=text_col, **options)
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        own = sent.value
        words = Words(own.vocabulary)
        for batch in slices(batches):
            found = own.scores(pool(words, own.vectors, batch.column(place).to_pylist()))
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)
