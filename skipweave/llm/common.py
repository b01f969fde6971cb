"""Shared helpers of the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import file_system, fresh_dir, shared_dir  # noqa: F401

#: Bytes of output gathered before a batch is sent to the JVM.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of finished rounds, which it does when their objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5) == 0


def labelled(labels: DataFrame, column: str, limit: int) -> DataFrame:
    """At most `limit` training rows (doc_id, y), spread by a hash of doc_id; a doc_id labelled twice counts once, as its largest label."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def training_texts(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of labelled(); the broadcast side has `limit` rows of two numbers at most."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labelled(labels, column, limit)), "doc_id")


class Memo(dict):
    """A dict that computes missing values and keeps about the last `cap` to 2 * cap of them; longer keys than LONGEST are
    computed each time, so that its bytes are bounded too."""

    LONGEST = 128

    def __init__(self, compute: Callable, cap: int = 150_000):
        super().__init__()
        self.compute, self.cap, self.old = compute, cap, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.compute(key)
        value = self.old.get(key, self)
        if value is self:
            value = self.compute(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_kept: dict[tuple, object] = {}


def kept(make: Callable) -> Callable:
    """make(path), whose last result a process keeps until another factory's is asked for; so a worker that serves several
    operators in turn holds the tables of one of them at a time."""

    def get(path: str):
        key = (make.__module__, make.__qualname__, path)
        if key not in _kept:
            let_go()
            _kept[key] = make(path)
        return _kept[key]

    return get


def let_go() -> None:
    """Drops what kept() holds; for operators that keep nothing between tasks."""
    _kept.clear()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [s or "" for s in batch.column(name).to_pylist()]


def joined_lists(parts: list[bytes], width: int, value_type: pa.DataType) -> pa.Array:
    """A list column from the raw little-endian values of each row."""
    import numpy as np

    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // width for p in parts], out=offsets[1:])
    values = pa.Array.from_buffers(value_type, int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
