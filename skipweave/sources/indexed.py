"""Saved indexes, and a data source that reads a saved column through its signatures."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..column import Column
from ..functions import bits
from ..functions.binning import Bins
from ..operators.scan import Range
from ..operators.signature import Signatures
from ..types import resolve
from .files import file_system

FORMAT = "signatures"
#: Rows that one task reads, about.
ROWS_PER_TASK = 1 << 22


def _blocks_per_task(values_per_block: int) -> int:
    return max(1, ROWS_PER_TASK // values_per_block)


def save(index: Signatures, folder: str) -> None:
    """Writes the column (sorted by position), its blocks, the union of the blocks of each task (a row for ROWS_PER_TASK
    rows, from which reads are planned) and its bounds below folder."""
    spark = index.blocks.sparkSession
    index.column.rows.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(f"{folder}/column")
    index.blocks.repartitionByRange("block_id").sortWithinPartitions("block_id").write.mode("overwrite").parquet(f"{folder}/blocks")
    index.coarser(_blocks_per_task(index.values_per_block)).blocks.coalesce(1).write.mode("overwrite").parquet(f"{folder}/tasks")
    meta = {"name": index.column.name, "type": index.column.type.name, "values_per_block": index.values_per_block, "bounds": [b if isinstance(b, (int, float)) else int(b) for b in index.bins.bounds]}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def load(spark: SparkSession, folder: str) -> Signatures:
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    kind = resolve(meta["type"])
    column = Column(spark.read.parquet(f"{folder}/column"), kind, meta["name"])
    return Signatures(column, Bins(tuple(meta["bounds"]), kind), meta["values_per_block"], spark.read.parquet(f"{folder}/blocks"))


class Share(InputPartition):
    """The number of the ROWS_PER_TASK rows that one task reads; -1 for none."""

    def __init__(self, number: int):
        self.number = number


def _dataset(path: str) -> ds.Dataset:
    where, name = file_system(path)
    return ds.dataset(name, filesystem=where, format="parquet")


class SignatureReader(DataSourceReader):
    """Takes comparisons of v from Spark's filter, and reads only candidate blocks. Spark applies
    the filter again to the rows, so a candidate without hits does no harm."""

    def __init__(self, folder: str):
        where, name = file_system(f"{folder}/meta")
        part = next(f for f in where.get_file_info(FileSelector(name)) if f.base_name.startswith("part-") and f.size)
        with where.open_input_stream(part.path) as stream:
            self.meta = json.loads(stream.read())
        self.folder, self.low, self.high = folder, None, None
        self.bins = Bins(tuple(self.meta["bounds"]), resolve(self.meta["type"]))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("v",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = f.value if self.low is None else max(self.low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def _hit(self) -> pc.Expression:
        """Whether a row of blocks has a bin that the range touches."""
        first = 0 if self.low is None else self.bins.find(self.low)
        last = len(self.bins) - 1 if self.high is None else self.bins.find(self.high)
        words = bits.words_of((1 << last + 1) - (1 << first) if first <= last else 0, len(self.bins))
        hit = None
        for name, word in zip(bits.word_names(len(self.bins)), words):
            one = pc.bit_wise_and(pc.field(name), pa.scalar(word, pa.int64())) != 0
            hit = one if hit is None else hit | one
        return hit

    def partitions(self) -> list[Share]:
        """The tasks that have a candidate block, from their unions alone."""
        found = _dataset(f"{self.folder}/tasks").to_table(columns=["block_id"], filter=self._hit())["block_id"]
        return [Share(k) for k in sorted(found.to_pylist())] or [Share(-1)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        """The rows of the task's candidate blocks, by one scan from the first to the last of them."""
        if partition.number < 0:
            return
        per = self.meta["values_per_block"]
        many, block = _blocks_per_task(per), pc.field("block_id")
        own = (block >= partition.number * many) & (block < (partition.number + 1) * many)
        blocks = np.sort(_dataset(f"{self.folder}/blocks").to_table(columns=["block_id"], filter=own & self._hit())["block_id"].to_numpy())
        if not len(blocks):
            return
        inside = (pc.field("pos") >= int(blocks[0]) * per) & (pc.field("pos") < (int(blocks[-1]) + 1) * per)
        for batch in _dataset(f"{self.folder}/column").to_batches(columns=["pos", "v"], filter=inside):
            of = batch.column("pos").to_numpy() // per
            at = np.minimum(np.searchsorted(blocks, of), len(blocks) - 1)
            yield batch.filter(pa.array(blocks[at] == of))


class SignatureSource(DataSource):
    """Option path: a folder that save() wrote. Filters on v reach the index (spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType | str:
        return f"pos bigint, v {SignatureReader(self.options['path']).bins.type.spark}"

    def reader(self, schema: StructType) -> SignatureReader:
        return SignatureReader(self.options["path"])


def read_indexed(spark: SparkSession, folder: str, wanted: Range) -> DataFrame:
    """The qualifying rows (pos, v) of a saved column, from candidate blocks only.

    Each call loads anew: Spark keeps what a filter planned with a loaded frame, so one frame must serve one filter.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SignatureSource)
    return spark.read.format(FORMAT).option("path", folder).load().where(wanted.holds(F.col("v")))
