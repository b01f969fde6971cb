"""An index that grows with a stream of appended rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.binning import Bins
from ..functions import bits
from ..operators.signature import block_signatures


def append_stream(stream: DataFrame, bins: Bins, values_per_block: int, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the partial signatures of each micro-batch of rows (pos, v) below folder/batch=N.

    A batch that is run again overwrites its own folder, so each row counts once. Blocks that span batches are put
    together by read_blocks().
    """

    def write(rows: DataFrame, batch: int) -> None:
        block_signatures(rows, bins, values_per_block).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_blocks(spark, folder: str, bins: Bins) -> DataFrame:
    """The blocks of all batches so far."""
    parts = spark.read.parquet(folder)
    return parts.groupBy("block_id").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), *(F.bit_or(w).alias(w) for w in bits.word_names(len(bins))))
