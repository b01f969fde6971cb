"""Canonical exact digests of documents, with DataFrame functions only (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: 64-bit words of a fingerprint.
WORDS = 4
#: Ranges of ids for each shuffle partition that with_next() sorts apart.
RANGES = 4


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again; runs of white space become one space, none at the ends. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(ascii_only, F.lower(text)).otherwise(folded), r"[\s\p{Z}\x85]+", " "))


def wide_hash(text: Column) -> Column:
    """256 bits of xxhash64 under four seeds, as an array of four numbers."""
    return F.array(*(F.xxhash64(F.lit(k), text) for k in range(WORDS)))


def as_hex(words: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(words[k])), 16, "0") for k in range(WORDS)))


def groups(docs: DataFrame) -> DataFrame:
    """(hash, canonical, group_id, group_size): a row for each canonical text.

    The rows of a bucket (equal hashes) are grouped by their canonical bytes too, so two texts share a group exactly if
    those bytes are equal. Copies meet in the partial aggregation of each task, so a large group sends a row per task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text").cast("string")).alias("canonical"))
    return rows.select("doc_id", "canonical", wide_hash(F.col("canonical")).alias("hash")).groupBy("hash", "canonical").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(hash, group_id, group_size, n_texts) by hash, from groups(); small rows without texts, checkpointed."""
    by_hash = groups(docs).groupBy("hash").agg(F.min("group_id").alias("group_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("n_texts"))
    shared_dir(docs.sparkSession)
    return by_hash.checkpoint()


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*(F.lit(b) for b in bounds[width - 1 :: width]))
    parts = F.array(*(F.array(*(F.lit(b) for b in bounds[at : at + width])) for at in range(0, len(bounds), width)))
    upto = lambda a: F.size(F.filter(a, lambda b: b <= key))
    full = upto(coarse)
    return full * width + F.coalesce(F.when(full < F.size(parts), upto(F.get(parts, full))), F.lit(0))


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """docs with next_text, and next_NAME of each carried column, of the row that follows by ascending doc_id (ties by
    text, null ids first; after the last row the first).

    Rows are dealt to ranges of ids of about equal size; the first rows of each range are sent to the range before it as
    well, as its last neighbours. So there is one shuffle of the texts and no sort of all rows in one task. The driver
    sees RANGES numbers for each shuffle partition.
    """
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(docs.select(F.percentile_approx(key, steps, 20 * ranges)).first()[0] or []))
    heads = {r.r: r.head for r in docs.groupBy(_range_of(key, bounds).alias("r")).agg(F.min(key).alias("head")).collect()}
    full = sorted(heads)
    before = {r: full[k - 1] for k, r in enumerate(full)}
    numbers = lambda of, kind: F.array(*(F.lit(of.get(r)).cast(kind) for r in range(len(bounds) + 1)))
    at = F.col("at")
    placed = docs.withColumn("at", _range_of(key, bounds))
    own, copy = F.struct(at.alias("range"), F.lit(False).alias("copy")), F.struct(F.get(numbers(before, "int"), at).alias("range"), F.lit(True).alias("copy"))
    placed = placed.withColumn("to", F.explode(F.when(key == F.get(numbers(heads, "long"), at), F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("to.range").orderBy("to.copy", key, "text")
    following = [F.lead("text").over(order).alias("next_text"), *(F.lead(c).over(order).alias(f"next_{c}") for c in carried)]
    return placed.select("*", *following).where("not to.copy").drop("at", "to")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint and edited_fingerprint of each whole text and of its edited text, and their likeness.

    docs: doc_id and text, other columns are left out. The edited text ends, for its last floor(n_chars / 2) code points,
    with the first as many of the next document. A fingerprint is exact: likeness is 1 for equal ones, else 0. Null texts
    count as empty ones: they share a fingerprint. Rows with equal ids each give a row, in the order of their texts; an
    empty table gives none. group_id is the smallest doc_id with the same canonical bytes and group_size their number;
    should different canonical texts ever share a hash, all but the first carry their number within it at the end.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = fingerprint_table(rows)
    rows = rows.withColumn("hash", wide_hash(canonical(F.col("text"))))
    clash = not table.where("n_texts > 1").isEmpty()
    found = with_next(rows, "hash").withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    found = found.withColumn("edited", edited)
    found = found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "hash", wide_hash(canonical(F.col("edited"))).alias("edited_hash"), "next_hash",
        *([canonical(F.col("text")).alias("canonical")] if clash else []),
    )
    if clash:
        numbered = groups(rows.select("doc_id", "text")).withColumn("text_no", F.row_number().over(Window.partitionBy("hash").orderBy("group_id", "canonical")) - 1)
        found = found.join(numbered, ["hash", "canonical"])
        mark = F.when(F.col("text_no") > 0, F.concat(F.lit("-"), F.col("text_no").cast("string"))).otherwise("")
    else:
        found = found.join(table, "hash")
        mark = F.lit("")
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.concat(as_hex(F.col("hash")), mark).alias("fingerprint"), as_hex(F.col("edited_hash")).alias("edited_fingerprint"),
        like("hash", "edited_hash").alias("near_edited"), like("hash", "next_hash").alias("near_next"), "group_id", "group_size",
    )
