"""Quality rules over document statistics, decided by gradient-boosted trees (operator 3)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, train
from .common import let_go, slices, texts_of, training_texts

#: Labelled rows that the trees are fitted on, at most.
TRAINING_ROWS = 10_000
#: Base rules; fixed by the operator's contract.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Least probability of good quality at which a document is kept.
KEEP = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The trees' features and how the verdict may change with each: more symbols, repeats or capitals never help.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "mark_share": -1, "digit_share": 0, "distinct_share": 1, "words_per_line": 0, "same_as_last_share": -1,
}


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts and the features of a text. Words are runs of anything but space and \\t to \\r."""
    data = text.encode("utf-8", "replace")
    words = data.split()  # bytes split at exactly those six characters
    n, n_chars = len(words), len(text)
    word_chars = n_chars - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
        repeats = int((np.r_[again, False, False] | np.r_[False, again, False] | np.r_[False, False, again]).sum())
    upper = digits = marks = 0
    if n_chars:
        codes = np.frombuffer(data, np.uint8)
        table = np.bincount(codes, minlength=128)
        upper, digits = int(table[65:91].sum()), int(table[48:58].sum())
        marks = int(table[33:48].sum() + table[58:65].sum() + table[91:97].sum() + table[123:127].sum())
    same = sum(map(bytes.__eq__, words, words[1:]))
    per_char, per_word = max(1, word_chars), max(1, n)
    features = (
        float(np.log1p(n)), word_chars / per_word, symbols / per_word, dup_lines / max(1, len(lines)), repeats / per_word, upper / per_char,
        marks / per_char, digits / per_char, len(set(words)) / per_word, n / max(1, len(lines)), same / per_word,
    )
    return (n, word_chars, symbols, dup_lines, repeats), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Trees:
    """Trees from at most `rows` labelled rows outside the held-out fifth; only their features go to the driver.

    Without labelled rows, or with rows of one label only, the trees are a constant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "x": pa.array([list(statistics(s)[1]) for s in texts_of(batch)], pa.list_(pa.float64()))})

    seen = training_texts(docs, labels, "quality", rows).select("text", "y").mapInArrow(run, "y int, x array<double>").collect()
    seen = sorted((tuple(r.x), r.y) for r in seen)  # the order of rows decides nothing
    return train(np.array([x for x, _ in seen]).reshape(-1, len(FEATURES)), np.array([y > 0 for _, y in seen]), tuple(FEATURES.values()))


def quality_rules(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and probability of each row's whole text; docs: doc_id and text, other
    columns are left out.

    A null text has no words: all counts are 0 and it fails the base rules, as an empty one does. Rows with equal or null
    ids each give a row; an empty table gives none. Rows never leave their partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [statistics(s) for s in texts_of(batch)]
            p = trees.probability(np.array([x for _, x in found]).reshape(-1, len(FEATURES)))
            failed = np.array([base_failed(c[0], c[4]) for c, _ in found], bool)
            counts = {name: pa.array([c[k] for c, _ in found], pa.int64()) for k, name in enumerate(BASE)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **counts, "base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= KEEP)), "probability": pa.array(p)})

    kind = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), "base_failed boolean, kept boolean, probability double"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def is_kept(text: Column, trees: Trees) -> Column:
    """The verdict `kept` on a text; false for a null one."""

    @F.arrow_udf("boolean")
    def verdict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for part in parts:
            found = [statistics(s or "") for at in range(0, len(part), 512) for s in part.slice(at, 512).to_pylist()]
            p = trees.probability(np.array([x for _, x in found]).reshape(-1, len(FEATURES)))
            yield pa.array([not base_failed(c[0], c[4]) and bool(q >= KEEP) for (c, _), q in zip(found, p)], pa.bool_())

    return verdict(text)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality_rules() by trees fitted on the labels."""
    return quality_rules(docs, fit(docs, labels))
