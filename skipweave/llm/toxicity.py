"""Toxic passages as maximum-scoring segments (operator 1).

A token's score is its log-odds between toxic and other documents under an informative Dirichlet prior. A linear scan
finds every maximal segment of a text, the extreme-value law of such segments turns scores into significance, and the
sum over significant segments is calibrated to a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import Logistic
from .common import Memo, held_out, let_go, shared_dir, slices, texts_of, training_texts

#: Labelled rows that the model is fitted on, at most; the first two thirds give the log-odds, the rest the calibration.
TRAINING_ROWS = 12_000
#: Tokens and stems of the model, at most: those with the largest z.
MODEL_TOKENS = 50_000
#: Weight of the Dirichlet prior, as a share of the training documents: each label's documents are joined by this share of
#: as many more, in which tokens are as frequent as in all documents.
PRIOR = 0.05
#: Least log-odds that is kept, and least z; weaker tokens are left to chance.
LEAST_ODDS = 3.0
LEAST_Z = 2.5
#: What a token without a log-odds of its own takes from a segment.
DRIFT = 0.1
#: Lengths of the word beginnings that stand in for words too rare to have a log-odds.
STEMS = (6, 5, 4)

_marks = re.compile(r"[\W_]+")
_words = re.compile(r"[^\x20\x09-\x0d]+").findall


def normal(word: str) -> str:
    """A word without case and marks."""
    return _marks.sub("", word.lower())


def keys(token: str) -> list[str]:
    """The token, then its beginnings with a final "*"."""
    return [token, *(token[:n] + "*" for n in STEMS if len(token) > n)]


def segments(scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in linear time; scores: positive, or 0 for -drift.

    Candidates are kept on a stack with the total before them (low) and after them (high); a new one swallows those
    below it whose low is smaller and whose high is not larger.
    """
    at = np.flatnonzero(scores > 0)
    stack: list[list[float]] = []  # begin, end, low, high, position on the stack of the nearest candidate with a smaller low
    total, before = 0.0, 0
    for i in at.tolist():
        total -= drift * (i - before)
        low, total = total, total + float(scores[i])
        item, before = [i, i + 1, low, total], i + 1
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= item[2]:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= item[3]:
                stack.append([*item, k])
                break
            item = [stack[k][0], item[1], stack[k][2], item[3]]
            del stack[k:]
    return [(int(b), int(e), high - low) for b, e, low, high, _ in stack]


@dataclass
class Model:
    odds: dict[str, float]
    rate: float  # lambda of the extreme-value law
    log_k: float  # and the logarithm of its K
    calibrate: Logistic | None = None

    def memo(self) -> Memo:
        def score(word: str) -> float:
            return next((self.odds[k] for k in keys(normal(word)) if k in self.odds), 0.0)

        return Memo(score, 100_000)

    def passages(self, text: str, memo: Memo) -> tuple[list[str], list[tuple[int, int, float, float]]]:
        """The words, and of each significant segment its words' span, score and -log E: at under one such segment
        expected by chance in a text of this length."""
        words, scores = token_scores(text, memo)
        if not scores.any():
            return words, []
        chance = self.log_k + np.log(len(words))
        return words, [(b, e, s, z) for b, e, s in segments(scores, DRIFT) if (z := self.rate * s - chance) > 0]

    def features(self, text: str, memo: Memo) -> tuple[float, float, float]:
        found = [z for *_, z in self.passages(text, memo)[1]]
        return (min(sum(found), 60.0), min(max(found, default=0.0), 40.0), float(bool(found)))

    def scores(self, texts: list[str], memo: Memo) -> np.ndarray:
        return self.calibrate(np.array([self.features(s, memo) for s in texts], float).reshape(-1, 3))


def token_scores(text: str, memo: Memo) -> tuple[list[str], np.ndarray]:
    """The words and their log-odds; a word that follows itself counts once."""
    words = _words(text)
    scores = np.fromiter(map(memo.__getitem__, words), float, len(words))
    for i in np.flatnonzero((scores[1:] > 0) & (scores[1:] == scores[:-1])).tolist():
        if words[i] == words[i + 1]:
            scores[i + 1] = 0.0
    return words, scores


def _token_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many toxic and other documents each token and stem stands."""
    counts = (Counter(), Counter())
    for batch in slices(batches):
        for text, y in zip(texts_of(batch), batch.column("y").to_pylist()):
            counts[bool(y)].update({k for w in set(_words(text)) if (t := normal(w)) for k in keys(t)})
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"token": part, "clean": pa.array([counts[0][k] for k in part], pa.int64()), "toxic": pa.array([counts[1][k] for k in part], pa.int64())})


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model from at most `rows` labelled rows outside the held-out fifth; equal texts count once.

    Without labelled rows, or with rows of one label only, every score is the smoothed share of that label.
    """
    shared_dir(docs.sparkSession)
    seen = training_texts(docs, labels, "toxic", rows).select("text", "y").groupBy("text").agg(F.max("y").alias("y"))
    seen = seen.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(3))).checkpoint()
    counts = seen.where("fold < 2").select("text", "y").mapInArrow(_token_documents, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    documents = {bool(y): n for y, n in seen.where("fold < 2").groupBy((F.col("y") > 0).alias("y")).count().collect()}
    n_clean, n_toxic = documents.get(False, 0) + 1.0, documents.get(True, 0) + 1.0
    both, n = F.col("toxic") + F.col("clean"), n_clean + n_toxic
    toxic, clean = F.col("toxic") + both * (PRIOR * n_toxic / n), F.col("clean") + both * (PRIOR * n_clean / n)
    counts = counts.withColumn("odds", F.log(toxic / (n_toxic * (1 + PRIOR))) - F.log(clean / (n_clean * (1 + PRIOR))))
    counts = counts.withColumn("z", F.col("odds") / F.sqrt(1 / toxic + 1 / clean))
    kept = counts.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "token").limit(MODEL_TOKENS).select("token", "odds", "clean", "toxic").collect()
    model = Model({r.token: r.odds for r in kept}, 1.0, 0.0)

    rest = seen.where("fold = 2").select("text", "y")
    model.rate, model.log_k = extreme_value_law(*_segment_totals(rest.where("y = 0"), model))
    found = _features(rest, model)
    model.calibrate = Logistic(np.array([r[1:] for r in found], float).reshape(-1, 3), np.array([r[0] > 0 for r in found], float))
    return model


def _segment_totals(rows: DataFrame, model: Model) -> tuple[int, float, float, int]:
    """Of all segments of the texts: number, sum and least of the scores; and the words of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in slices(batches):
            out = []
            for text in texts_of(batch):
                words, scores = token_scores(text, memo)
                found = [s for *_, s in segments(scores, DRIFT)]
                out.append((len(found), sum(found), min(found, default=None), len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.float64(), pa.int64()))], ["n", "total", "least", "n_words"])

    r = rows.select("text").mapInArrow(run, "n long, total double, least double, n_words long").agg(F.sum("n"), F.sum("total"), F.min("least"), F.sum("n_words")).first()
    return r[0] or 0, r[1] or 0.0, 1.0 if r[2] is None else r[2], r[3] or 0


def _features(rows: DataFrame, model: Model) -> list[tuple]:
    """Of each calibration row: y, then the features by which texts are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in slices(batches):
            x = np.array([model.features(s, memo) for s in texts_of(batch)], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(x[:, k]) for k in range(3))], ["y", "a", "b", "c"])

    return [tuple(r) for r in rows.select("y", "text").mapInArrow(run, "y int, a double, b double, c double").collect()]


def extreme_value_law(n: int, total: float, least: float, n_words: int) -> tuple[float, float]:
    """lambda and log K of E(segments of at least s) = K n exp(-lambda s), from the n segments of clean texts: the sum and
    the least of their scores, and the texts' words.

    Scores above the least one fall off exponentially; the maximum-likelihood lambda is one over their mean excess, here
    with one pseudo-segment of excess 1, so that few or no segments still give a law.
    """
    excess = total - n * least + 1.0
    rate = float(np.clip((n + 1) / excess, 0.3, 3.0))
    return rate, float(np.log((n + 0.5) / (n_words + 1.0)) + rate * least)


def toxicity(docs: DataFrame, model: Model, with_passages: bool = False) -> DataFrame:
    """(doc_id, score) of each row's whole text, and with_passages its significant passages; docs: doc_id and text, other
    columns are left out.

    A null text counts as an empty one: no words, no segment, the score of a text without toxic passages. Rows with equal
    or null ids each give a row; an empty table gives none. Rows never leave their partition.
    """
    kind = "doc_id long, score double" + ", passages array<struct<begin:int,end:int,score:double,log_e:double,text:string>>" * with_passages
    passage = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log_e", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in slices(batches):
            texts = texts_of(batch)
            columns = {"doc_id": batch.column("doc_id"), "score": pa.array(model.scores(texts, memo), pa.float64())}
            if with_passages:
                found = (model.passages(s, memo) for s in texts)
                columns["passages"] = pa.array([[{"begin": b, "end": e, "score": s, "log_e": -z, "text": " ".join(words[b:e])} for b, e, s, z in spans] for words, spans in found], passage)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def is_toxic(text: Column, model: Model, threshold: float = 0.5) -> Column:
    """Whether a text's score is at least the threshold; false for a null text's score below it."""

    @F.arrow_udf("boolean")
    def verdict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        memo = model.memo()
        for part in parts:
            yield pa.array([bool(p >= threshold) for at in range(0, len(part), 512) for p in model.scores([s or "" for s in part.slice(at, 512).to_pylist()], memo)], pa.bool_())

    return verdict(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxicity() by a model fitted on the labels, with held_out and predicted."""
    rows = toxicity(docs, fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
