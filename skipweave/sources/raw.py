"""Raw column files: values of one fixed width in a row, host-endian, without a header."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..column import Column
from ..types import ColumnType, resolve
from .files import file_system

FORMAT = "rawcolumn"
#: Values that one task reads, and that it hands on at a time.
VALUES_PER_TASK = 1 << 24
VALUES_PER_BATCH = 1 << 16

_NUMPY = {"tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64, "decimal(20,0)": np.uint64}


class Slice(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class RawReader(DataSourceReader):
    def __init__(self, path: str, kind: ColumnType, count: int | None, per_task: int):
        self.path, self.kind, self.per_task = path, kind, per_task
        where, name = file_system(path)
        size = where.get_file_info(name).size
        if not size:
            raise ValueError(f"{path} is missing or empty")
        if size % kind.width:
            raise ValueError(f"{path} holds no whole number of {kind.name} values")
        self.n = size // kind.width
        if count is not None and count != self.n:
            raise ValueError(f"{path} holds {self.n} values, not {count}")

    def partitions(self) -> list[Slice]:
        return [Slice(at, min(at + self.per_task, self.n)) for at in range(0, self.n, self.per_task)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        where, name = file_system(self.path)
        with where.open_input_file(name) as file:
            for at in range(partition.start, partition.end, VALUES_PER_BATCH):
                end = min(at + VALUES_PER_BATCH, partition.end)
                file.seek(at * self.kind.width)
                values = np.frombuffer(file.read((end - at) * self.kind.width), _NUMPY[self.kind.spark])
                v = pa.array(values)
                yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(at, end)), "v": v.cast(pa.decimal128(20, 0)) if self.kind.spark.startswith("decimal") else v})


class RawColumnSource(DataSource):
    """Options: path (a URI or absolute path that executors can open), type, and count to check or leave out."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"pos bigint, v {resolve(self.options['type']).spark}"

    def reader(self, schema: StructType) -> RawReader:
        count = self.options.get("count")
        return RawReader(self.options["path"], resolve(self.options["type"]), int(count) if count else None, int(self.options.get("valuespertask", VALUES_PER_TASK)))


def read_raw(spark: SparkSession, path: str, type_name: str, count: int | None = None) -> Column:
    spark.dataSource.register(RawColumnSource)
    reader = spark.read.format(FORMAT).option("path", path).option("type", type_name)
    rows = (reader.option("count", str(count)) if count is not None else reader).load()
    return Column(rows, resolve(type_name), path.rsplit("/", 1)[-1])


def write_raw(column: Column, folder: str) -> DataFrame:
    """Writes the values in order to raw files below folder, one a task, and returns their (path, first_pos, n_values),
    which must be kept before use: a task that is run again writes a file of another name."""
    kind = column.type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(folder)
        where.create_dir(base, recursive=True)
        context = TaskContext.get()
        name, first, n = f"{context.partitionId():05d}-{context.taskAttemptId()}.raw", None, 0
        with where.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                if batch.num_rows:
                    first = batch.column(0)[0].as_py() if first is None else first
                    values = batch.column(1)
                    if values.null_count:
                        raise ValueError("raw files hold no nulls")
                    values = np.array(values.to_pylist(), np.uint64) if kind.spark.startswith("decimal") else values.to_numpy(zero_copy_only=False)
                    out.write(values.astype(_NUMPY[kind.spark]).tobytes())
                    n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "first_pos": pa.array([first], pa.int64()), "n_values": pa.array([n], pa.int64())})

    ordered = column.rows.repartitionByRange("pos").sortWithinPartitions("pos")
    return ordered.mapInArrow(run, "path string, first_pos bigint, n_values bigint")
