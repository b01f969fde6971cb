"""A corpus through four stages: toxicity filter, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs; all
but the last return the columns of docs. sf_dir is where labels are, which the first two learn from; they learn from the
documents that reach them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skipweave.llm import near_dedup, packing, quality_rules, toxicity
from skipweave.llm.common import fresh_dir, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity; null texts count as empty ones and stay."""
    shared_dir(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.is_toxic(docs["text"], model))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; null texts, which have no words, go."""
    trees = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_rules.is_kept(docs["text"], trees))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id."""
    shared_dir(spark)
    return near_dedup.without_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a packed sequence."""
    return packing.pieces(packing.pack(docs))


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_quality), ("near_dedup", drop_near_duplicates), ("packing", pack_sequences)]

#: SQL cannot express the trained models, the alignment and the packing; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage on the documents of sf_dir; what stages hand on is kept in the shared folder."""
    folder = fresh_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
