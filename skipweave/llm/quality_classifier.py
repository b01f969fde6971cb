"""A quality score from compressed sizes (operator 5).

Two zstandard dictionaries are built from good and from bad labelled texts. A text that compresses better with the good
one resembles good texts; the difference of the compressed sizes, normalised by the size without a dictionary, is
calibrated together with the plain compression ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import Logistic
from .common import held_out, shared_dir, slices, texts_of, training_texts

#: Labelled rows that the model is fitted on, at most: half of them (by a hash) for the dictionaries, half to calibrate.
TRAINING_ROWS = 8_000
#: Blocks of training texts that each of the two dictionaries is built from, at most: drawn by a hash from all of them.
SAMPLES = 4_000
#: Texts are compressed in blocks of so many bytes, so that the dictionary counts to the end of a long one.
BLOCK = 2048
DICTIONARY = 112 << 10
LEVEL = 3


def blocks(data: bytes) -> list[bytes]:
    return [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    calibrate: Logistic | None = None

    def compressors(self) -> tuple:
        slim = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0)
        return tuple(zstandard.ZstdCompressor(compression_params=slim, dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdCompressor(compression_params=slim) for d in (self.good, self.bad, b""))

    @staticmethod
    def features(text: str, compressors: tuple) -> tuple[float, float, float]:
        """Normalised size difference (positive: nearer to good texts), and how far the text shrinks alone, in blocks and as a whole."""
        data = text.encode("utf-8", "replace")
        if not data:
            return (0.0, 0.0, 0.0)
        good, bad, plain = (sum(len(c.compress(b)) for b in blocks(data)) for c in compressors)
        whole = len(compressors[2].compress(data))
        return ((bad - good) / plain, float(np.log(plain / len(data))), float(np.log(whole / len(data))))

    def scores(self, texts: list[str], compressors: tuple) -> np.ndarray:
        return self.calibrate(expand([self.features(s, compressors) for s in texts]))


def expand(features: list[tuple[float, ...]]) -> np.ndarray:
    """With squares and products."""
    x = np.array(features, float).reshape(-1, 3)
    return np.c_[x, x * x, x[:, :1] * x[:, 1:]]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY bytes; where there is too little to train one, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ys, out = [], []
        for text, y in zip(texts_of(batch), batch.column("y").to_pylist()):
            for part in blocks(text.encode("utf-8", "replace")):
                ys.append(y)
                out.append(part)
        yield pa.RecordBatch.from_pydict({"y": pa.array(ys, pa.int32()), "sample": pa.array(out, pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, samples: int = SAMPLES) -> Model:
    """A model from at most `rows` labelled rows outside the held-out fifth.

    Each dictionary is built from at most `samples` blocks of the texts of half of these rows; no other blocks are sent to
    the driver. The other half calibrates. Without labelled rows, or with
    rows of one label only, every score is the smoothed share of that label.
    """
    shared_dir(docs.sparkSession)
    seen = training_texts(docs, labels, "quality", rows).select("doc_id", "text", "y").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2))).checkpoint()
    found = seen.where("fold = 0").select("text", "y").mapInArrow(_samples, "y int, sample binary")
    drawn = lambda y: found.where(F.col("y") == y).orderBy(F.xxhash64("sample"), "sample").limit(samples).collect()
    model = Model(*(dictionary([bytes(r.sample) for r in drawn(y)]) for y in (1, 0)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.compressors()
        for batch in slices(batches):
            x = np.array([model.features(s, own) for s in texts_of(batch)], float).reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), **{c: pa.array(x[:, k]) for k, c in enumerate("abc")}})

    rest = seen.where("fold = 1").select("text", "y").mapInArrow(features, "y int, a double, b double, c double").collect()
    model.calibrate = Logistic(expand([(r.a, r.b, r.c) for r in rest]), np.array([r.y > 0 for r in rest], float))
    return model


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, difference) of each row's whole text; docs: doc_id and text, other columns are left out.

    A null text counts as an empty one, whose features are 0. Rows with equal or null ids each give a row; an empty table
    gives none. Rows never leave their partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.compressors()
        for batch in slices(batches):
            found = [model.features(s, own) for s in texts_of(batch)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(model.calibrate(expand(found))), "difference": pa.array([f[0] for f in found], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, difference double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality() by a model fitted on the labels, with held_out and predicted."""
    rows = quality(docs, fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference")
