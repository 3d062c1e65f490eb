"""Language identification by unigram piece models, marginalised over segmentations.

Every language has its own probability for each piece of one public vocabulary.
A word's probability in a language is the sum over all its segmentations into
pieces, which a forward pass over the word's characters computes; a text's
probability is the product over its words. The probabilities are learned by EM:
the expected piece counts of a forward-backward pass, summed over the cluster.

Words are runs of letters, in lower case. A word is scored in runs of ``RUN``
characters, so a text without blanks costs no more per character than prose.

Learning uses at most about ``per_language`` texts of each language, chosen by a
hash of the id among the rows that may be learned from; scoring reads every text.

Defined results: ``und`` and score 0 if the text is null or has no letter, or if
nothing could be learned; rows of null language are not learned from; repeated
rows get repeated results. Only the id, the text and, for learning, the language
are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import hash_share, id_fold, ship, slices, tokenizer_file
from siteweave.session import cut_lineage

#: Characters that are scored as one lattice.
RUN = 32
#: The mark that the vocabulary sets before the first character of a word.
WORD_START = "▁"
#: Probability of a character that no piece covers, the same in each language.
UNKNOWN = 1e-8
#: Runs that a task keeps with their scores; it starts anew when full.
CACHE_RUNS = 300_000
#: Languages that one model may hold; it bounds what is sent to the tasks.
MAX_LANGUAGES = 1000

LETTERS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x100000001B3)


def runs_of(text: str) -> list[str]:
    """The lattices of a text: words, marked at their start, in runs of ``RUN`` characters."""
    return [run for word in LETTERS.findall(text.lower()) for run in cut(word)]


def cut(word: str) -> list[str]:
    if len(word) < RUN:
        return [WORD_START + word]
    word = WORD_START + word
    return [word[i : i + RUN] for i in range(0, len(word), RUN)]


@dataclass
class Pieces:
    """The vocabulary: sorted hashes of its pieces; the row of piece ``i`` in a model is ``i + 1``."""

    keys: np.ndarray
    rows: np.ndarray
    longest: int
    count: int

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], 0)


def read_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = sorted({model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
    texts = [t for t in texts if t == t.lower() and LETTERS.fullmatch(t.removeprefix(WORD_START) or "a")]
    by_size: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        by_size.setdefault(len(t), []).append(i)
    keys = np.zeros(len(texts), np.uint64)
    for own in by_size.values():
        points = code_points([texts[i] for i in own])
        key = np.zeros(len(own), np.uint64)
        for column in points.T:
            key = extended(key, column)
        keys[own] = key
    order = np.argsort(keys)
    return Pieces(keys[order], (order + 1).astype(np.int32), max(by_size), len(texts))


def code_points(runs: list[str]) -> np.ndarray:
    """Runs of one length as a matrix of code points."""
    return np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(runs), -1)


def extended(key: np.ndarray, column: np.ndarray) -> np.ndarray:
    return (key ^ (column.astype(np.uint64) + np.uint64(0x9E3779B9))) * BASE + np.uint64(0x632BE5AB)


def lattice(pieces: Pieces, points: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, model rows) of each place; row 0 has no piece, the last row is the unknown character."""
    size, out = points.shape[1], []
    for start in range(size):
        key = np.zeros(len(points), np.uint64)
        for end in range(start + 1, min(size, start + pieces.longest) + 1):
            key = extended(key, points[:, end - 1])
            rows = pieces.rows_of(key)
            if end == start + 1:
                rows = np.where(rows == 0, pieces.count + 1, rows)
            elif not rows.any():
                continue
            out.append((start, end, rows))
    return out


def forward(model: np.ndarray, places, size: int, n: int) -> np.ndarray:
    """alpha[position, run, language]: the summed probability of all segmentations up to a position."""
    alpha = np.zeros((size + 1, n, model.shape[1]))
    alpha[0] = 1.0
    for start, end, rows in places:
        alpha[end] += alpha[start] * model[rows]
    return alpha


def score_runs(pieces: Pieces, model: np.ndarray, runs: list[str]) -> np.ndarray:
    """Log probability of each run in each language."""
    out = np.zeros((len(runs), model.shape[1]))
    for own, points in by_length(runs):
        out[own] = np.log(forward(model, lattice(pieces, points), points.shape[1], len(points))[-1])
    return out


def by_length(runs: list[str], most: int = 20_000):
    groups: dict[int, list[int]] = {}
    for i, run in enumerate(runs):
        groups.setdefault(len(run), []).append(i)
    for own in groups.values():
        for k in range(0, len(own), most):
            part = own[k : k + most]
            yield part, code_points([runs[i] for i in part])


def expected_counts(pieces: Pieces, model: np.ndarray, runs: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, by forward and backward passes; counts[run, language]."""
    total = np.zeros_like(model)
    for own, points in by_length(runs):
        places, size = lattice(pieces, points), points.shape[1]
        alpha = forward(model, places, size, len(points))
        beta = np.zeros_like(alpha)
        beta[size] = 1.0
        for start, end, rows in reversed(places):
            beta[start] += model[rows] * beta[end]
        weight = counts[own] / alpha[size]
        for start, end, rows in places:
            used = alpha[start] * model[rows] * beta[end] * weight
            for language in range(model.shape[1]):
                total[:, language] += np.bincount(rows, used[:, language], len(model))
    total[0] = total[-1] = 0.0
    return total


def probabilities(counts: np.ndarray, shared: float = 200.0) -> np.ndarray:
    """Piece probabilities, drawn towards those of all languages together by ``shared`` counts."""
    inner = counts[1:-1]
    pooled = inner.sum(1, keepdims=True) + 0.01
    pooled /= pooled.sum()
    model = np.zeros_like(counts)
    model[1:-1] = (inner + shared * pooled) / (inner.sum(0, keepdims=True) + shared)
    model[-1] = UNKNOWN
    return model


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    pieces: Pieces
    model: np.ndarray


def fit(
    rows: DataFrame,
    vocabulary: str = tokenizer_file("piece_bpe_32k.model"),
    per_language: int = 500,
    rounds: int = 3,
) -> LanguageModel:
    """Learns from the columns id, text and lang of ``rows``; rows of null language or text are left out."""
    spark = rows.sparkSession
    ship(spark)
    rows = rows.filter("lang is not null and text is not null")
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(share) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(share)
    pieces = read_pieces(vocabulary)
    sizes = np.array([share[x] for x in languages], float)
    model = np.zeros((pieces.count + 2, len(languages)))
    result = LanguageModel(languages, np.log(sizes / sizes.sum()), pieces, model)
    if not languages:
        return result

    chosen = F.lit(False)
    for language, n in share.items():
        chosen |= (F.col("lang") == language) & hash_share(F.col("id"), per_language, n, 1)
    place = {x: i for i, x in enumerate(languages)}

    def count(batches):
        found: Counter = Counter()
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((run, place[lang]) for run in runs_of(text))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in found]), pa.array([k for _, k in found], pa.int32()), pa.array(list(found.values()), pa.int64())],
                names=["run", "language", "n"],
            )

    runs = cut_lineage(
        rows.filter(chosen).select("text", "lang").mapInArrow(count, "run string, language int, n bigint")
        .groupBy("run", "language").agg(F.sum("n").alias("n")).repartition(16, "run"),
        "langid",
    )

    model[1:-1] = 1.0 / pieces.count
    model[-1] = UNKNOWN
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, model))

        def expect(batches):
            own, current = sent.value
            for batch in slices(batches, 50_000):
                texts = batch.column(0).dictionary_encode()
                names = texts.dictionary.to_pylist()
                counts = np.zeros((len(names), current.shape[1]))
                counts[texts.indices.to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
                total = expected_counts(own, current, names, counts)
                row, language = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(language, pa.int32()), pa.array(total[row, language])], names=["row", "language", "n"])

        summed = runs.mapInArrow(expect, "row int, language int, n double").groupBy("row", "language").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(model)
        counts[summed["row"], summed["language"]] = summed["n"]
        model = probabilities(counts)
    result.model = model
    return result


class Scorer:
    """Scores texts with a cache of words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known: dict[str, list[int]] = {}
        self.runs: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.runs) > CACHE_RUNS or len(self.known) > CACHE_RUNS:
            self.known, self.runs, self.scores = {}, {}, self.scores[:0]
        words = [t.lower().split() if t else [] for t in texts]
        known, runs = self.known, self.runs
        new: dict[str, int] = {}
        for own in words:
            for w in own:
                if w not in known:
                    known[w] = [runs[r] if r in runs else new.setdefault(r, len(runs) + len(new)) for r in runs_of(w)]
        if new:
            runs.update(new)
            self.scores = np.concatenate((self.scores, score_runs(self.model.pieces, self.model.model, list(new))))
        langs, scores = [], []
        for own in words:
            ids = [i for w in own for i in known[w]]
            if not ids or not self.model.languages:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.scores[ids].sum(0) + self.model.log_prior
            best = int(total.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores


def predict(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(id, lang_pred, score) for the columns id and text; the score is the language's posterior probability."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.select("id", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            langs, scores = scorer.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learned from the rows whose id's crc32 modulo 5 is not 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held_out = id_fold(F.col("id"), 5) == 0
    model = fit(rows.filter(~held_out if learn is None else learn), **options)
    return predict(rows, model).select(F.col("id").alias(id_col), held_out.alias("held_out"), "lang_pred", "score")
