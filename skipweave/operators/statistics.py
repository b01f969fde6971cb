"""Properties of columns and of their indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..column import Column
from ..functions import bits
from .runs import Runs
from .scan import Range
from .signature import Signatures
from .zonemap import FULL, PARTIAL, SKIP, Zonemap


def properties(column: Column, segment: int = 1 << 22) -> DataFrame:
    """name, type, width, n, least, most and sorted (never falling or never rising, nulls left out).

    Order is checked within segments of positions and between the ends of neighbouring ones, so no task sees all rows.
    """
    rows = column.rows.where("v is not null").withColumn("segment", F.expr(f"pos div {segment}"))
    inside = Window.partitionBy("segment").orderBy("pos")
    steps = rows.withColumn("before", F.lag("v").over(inside))
    by_segment = steps.groupBy("segment").agg(F.max((F.col("v") < F.col("before")).cast("int")).alias("falls"), F.max((F.col("v") > F.col("before")).cast("int")).alias("rises"), F.min_by("v", "pos").alias("first"), F.max_by("v", "pos").alias("last"), F.min("v").alias("least"), F.max("v").alias("most"))
    between = Window.orderBy("segment")  # a row per segment
    ends = by_segment.withColumn("before", F.lag("last").over(between))
    falls = F.max(F.greatest(F.coalesce("falls", F.lit(0)), F.coalesce((F.col("first") < F.col("before")).cast("int"), F.lit(0))))
    rises = F.max(F.greatest(F.coalesce("rises", F.lit(0)), F.coalesce((F.col("first") > F.col("before")).cast("int"), F.lit(0))))
    found = ends.agg(F.min("least").alias("least"), F.max("most").alias("most"), (F.coalesce(falls, F.lit(0)) + F.coalesce(rises, F.lit(0)) < 2).alias("sorted"))
    counted = column.rows.agg(F.count(F.lit(1)).alias("n"))
    return counted.join(found).select(F.lit(column.name).alias("name"), F.lit(column.type.name).alias("type"), F.lit(column.type.width).alias("width"), "n", "least", "most", "sorted")


def entropy(runs: Runs) -> DataFrame:
    """Bits that differ between neighbouring stored vectors, over twice the bits set; null without vectors."""
    in_order = Window.partitionBy("segment").orderBy("vector_id")
    changed = bits.popcount(F.coalesce(F.col(w).bitwiseXOR(F.lag(w).over(in_order)), F.lit(0).cast("bigint")) for w in runs.words)
    each = runs.vectors.select(changed.alias("changed"), bits.popcount(F.col(w) for w in runs.words).alias("set"))
    return each.agg(F.count(F.lit(1)).alias("n_vectors"), F.sum("changed").alias("bits_changed"), F.sum("set").alias("bits_set")).withColumn("entropy", F.col("bits_changed") / (2 * F.col("bits_set")))


def spread_and_density(runs: Runs) -> DataFrame:
    """Mean and population deviation of last bin - first bin + 1, and of the number of bins, over the stored vectors."""
    columns = [F.col(w) for w in runs.words]
    each = runs.vectors.select((bits.last_bit(columns) - bits.first_bit(columns) + 1).alias("spread"), bits.popcount(columns).alias("density"))
    return each.agg(F.avg("spread").alias("mean_spread"), F.stddev_pop("spread").alias("dev_spread"), F.avg("density").alias("mean_density"), F.stddev_pop("density").alias("dev_density"))


def bin_histogram(runs: Runs, bins: int) -> DataFrame:
    """(bin, n_vectors): in how many stored vectors each bin is set; bins that none has are left out."""
    return runs.vectors.select(F.explode(bits.bins_set([F.col(w) for w in runs.words], bins)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n_vectors"))


def bins_covered(runs: Runs, bins: int) -> DataFrame:
    """How many bins any stored vector has."""
    return bin_histogram(runs, bins).agg(F.count(F.lit(1)).alias("covered"))


def popcount_vectors(runs: Runs) -> DataFrame:
    """(n_bits, n_vectors): how many stored vectors have so many bins."""
    return runs.vectors.groupBy(bits.popcount(F.col(w) for w in runs.words).alias("n_bits")).agg(F.count(F.lit(1)).alias("n_vectors"))


def global_vector(runs: Runs) -> DataFrame:
    return runs.vectors.agg(*(F.bit_or(w).alias(w) for w in runs.words))


def distinct_vectors(runs: Runs) -> DataFrame:
    return runs.vectors.select(*runs.words).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))


def printed(index: Signatures) -> DataFrame:
    """(block_id, bins): each block's bins as x and ."""
    return index.blocks.select("block_id", bits.as_text([F.col(w) for w in index.words], len(index.bins)).alias("bins"))


def printed_entries(runs: Runs, bins: int) -> DataFrame:
    """(segment, entry_id, vector_id, bins, note): the stored vectors under their entries, " repeat [n]" for runs."""
    note = F.when(F.col("repeated"), F.concat(F.lit(" repeat ["), F.col("blocks").cast("string"), F.lit("]"))).otherwise("")
    spans = runs.entries.withColumn("vector_id", F.explode(F.sequence(F.col("vector_lo"), F.col("vector_lo") + F.when(F.col("repeated"), 0).otherwise(F.col("blocks") - 1))))
    return spans.join(runs.vectors.select("segment", "vector_id", *runs.words), ["segment", "vector_id"]).select("segment", "entry_id", "vector_id", bits.as_text([F.col(w) for w in runs.words], bins).alias("bins"), note.alias("note"))


def bounds_table(index: Signatures) -> DataFrame:
    """(bin, bound)."""
    spark = index.blocks.sparkSession
    return spark.createDataFrame([(k, b) for k, b in enumerate(index.bins.bounds)], f"bin int, bound {index.bins.type.spark}")


def runs_with_zones(index: Signatures, runs: Runs, zones: Zonemap) -> DataFrame:
    """(block_lo, block_hi, zmin, zmax, bins) of each stored vector's run; zones and blocks must be of one size.

    Blocks are matched to their run by a running maximum over both, not by a range join.
    """
    if zones.values_per_zone != index.values_per_block:
        raise ValueError("zones and blocks differ in size")
    blocks = runs.expand().select("block_id")
    starts = runs.vectors.select(F.col("block_lo").alias("block_id"), F.col("block_lo").alias("start"))
    segment = F.expr(f"block_id div {1 << 22}")
    lookup = blocks.join(starts, "block_id", "left").withColumn("run", F.max("start").over(Window.partitionBy(segment).orderBy("block_id")))
    ends = lookup.join(zones.zones.select(F.col("zone_id").alias("block_id"), "zmin", "zmax"), "block_id").groupBy("run").agg(F.max("block_id").alias("block_hi"), F.min("zmin").alias("zmin"), F.max("zmax").alias("zmax"))
    vectors = runs.vectors.select(F.col("block_lo").alias("run"), bits.as_text([F.col(w) for w in runs.words], len(index.bins)).alias("bins"))
    return ends.join(vectors, "run").select(F.col("run").alias("block_lo"), "block_hi", "zmin", "zmax", "bins")


def probe_counters(index: Signatures, zones: Zonemap, wanted: Range) -> DataFrame:
    """Per path: index rows probed, blocks of each verdict, values compared. The plain scan compares all values."""

    def of(path: str, classified: DataFrame) -> DataFrame:
        count = lambda kind: F.count_if(F.col("verdict") == kind)
        return classified.agg(F.count(F.lit(1)).alias("probes"), count(SKIP).alias("skipped"), count(PARTIAL).alias("partial"), count(FULL).alias("full"), F.coalesce(F.sum(F.when(F.col("verdict") == PARTIAL, F.col("n_values"))), F.lit(0)).alias("compared")).select(F.lit(path).alias("path"), "*")

    zero = [F.lit(0).cast("bigint").alias(c) for c in ("probes", "skipped", "partial", "full")]
    scan = index.column.rows.agg(F.count("v").alias("compared")).select(F.lit("scan").alias("path"), *zero, "compared")
    return scan.union(of("zonemap", zones.classify(wanted))).union(of("signature", index.classify(wanted)))


def storage(index: Signatures, runs: Runs, zones: Zonemap, bitmap_words: DataFrame) -> DataFrame:
    """(path, bytes, percent): sizes of the three indexes; bitmap_words has a row per 4-byte code word."""
    width, bins = index.column.type.width, len(index.bins)
    total = index.column.rows.agg((F.count(F.lit(1)) * width).alias("total"))
    sizes = [
        zones.zones.agg((F.count(F.lit(1)) * 2 * width).alias("bytes")).select(F.lit("zonemap").alias("path"), "bytes"),
        runs.vectors.agg((F.count(F.lit(1)) * bins / 8).cast("bigint").alias("v")).join(runs.entries.agg((F.count(F.lit(1)) * 4).alias("e"))).select(F.lit("signature").alias("path"), (F.col("v") + F.col("e")).alias("bytes")),
        bitmap_words.agg((F.count(F.lit(1)) * 4).alias("bytes")).select(F.lit("bitmap").alias("path"), "bytes"),
    ]
    out = sizes[0].union(sizes[1]).union(sizes[2]).join(total)
    return out.select("path", "bytes", F.expr("bytes * 100 div total").alias("percent"))


def bars(histogram: DataFrame, bins: int, height: int = 10) -> DataFrame:
    """(row, bar): bin_histogram() as `height` rows of H marks, the highest first; a bin of n vectors out of at most m gets
    ceil(height * n / m) marks."""
    most = histogram.agg(F.max("n_vectors").alias("most"))
    scaled = histogram.join(most).select("bin", F.ceil(F.col("n_vectors") * height / F.col("most")).alias("marks"))
    marks = F.map_from_entries(F.collect_list(F.struct("bin", "marks")))  # a pair per bin, 256 at most
    rows = scaled.agg(marks.alias("marks")).select("marks", F.explode(F.sequence(F.lit(height), F.lit(1))).alias("level"))
    mark = lambda b: F.when(F.coalesce(F.element_at("marks", b), F.lit(0)) >= F.col("level"), "H").otherwise(" ")
    return rows.select((height - F.col("level") + 1).alias("row"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), mark), "").alias("bar"))
