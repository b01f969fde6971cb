"""Queries of every operator over the driver's tables, with DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .column import Column, coded_column, column
from .functions import bits
from .functions.binning import bins_for, bins_of, equi_depth_bins, sample
from .operators import bitmap, conjunction, runs, scan, signature, statistics, updates, zonemap
from .operators.scan import Range
from .plans import access, analysis, workload
from .sources import indexed, metrics_log, raw
from .sources.files import fresh_dir

#: Column -> table, position key, SQL of the value, largest value of its type.
COLUMNS = {
    "value": ("events", "event_id", "value", "1.7976931348623157e308::DOUBLE"),
    "ts": ("events", "event_id", "epoch_us(ts)", "9223372036854775807::BIGINT"),
    "o_totalprice": ("orders", "o_orderkey", "o_totalprice", "1.7976931348623157e308::DOUBLE"),
    "o_orderkey": ("orders", "o_orderkey", "o_orderkey", "9223372036854775807::BIGINT"),
    "p_size": ("part", "p_partkey", "p_size", "2147483647::INTEGER"),
    "p_retailprice": ("part", "p_partkey", "p_retailprice", "1.7976931348623157e308::DOUBLE"),
    "c_acctbal": ("customer", "c_custkey", "c_acctbal", "1.7976931348623157e308::DOUBLE"),
    "n_chars": ("documents", "doc_id", "n_chars", "9223372036854775807::BIGINT"),
    "label": ("embeddings", "vec_id", "label", "2147483647::INTEGER"),
}
VALUES = Range(10.0, 50.0)
#: A range of a clustered column.
KEYS = Range(1000, 4000)
PRICES = Range(920.0, 960.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> Column:
    source, pos, _, _ = COLUMNS[name]
    return column(spark.read.parquet(f"{sf_dir}/{source}.parquet"), name, pos)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# SQL of the oracles


def col(name: str) -> str:
    source, pos, value, _ = COLUMNS[name]
    return f"WITH col AS (SELECT {pos}::BIGINT AS pos, {value} AS v FROM {source}), n AS (SELECT count(*) AS n FROM col)"


def sampled(name: str) -> str:
    i = "((pos * 2048 + n - 1) // n)"
    return col(name) + f""",
picked AS (SELECT pos, v FROM col, n WHERE v IS NOT NULL AND {i} < 2048 AND ({i} * n) // 2048 = pos),
srt AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT v FROM picked))"""


def bounded(name: str, most: int = 64) -> str:
    largest = COLUMNS[name][3]
    return sampled(name) + f""",
shape AS (SELECT s, CASE WHEN s < {most - 1} THEN (SELECT min(b) FROM (VALUES (8), (16), (32), (64), (128), (256)) t(b) WHERE b > greatest(s, 1)) ELSE {most} END AS bins FROM (SELECT count(*) AS s FROM srt)),
idx AS (SELECT i AS bin, CASE WHEN s < {most - 1} THEN CASE WHEN i < s THEN i END WHEN i = 0 THEN 1 WHEN i < {most - 2} THEN (i * s) // {most - 2} WHEN i = {most - 2} THEN s - 1 END AS k FROM shape, range(256) r(i) WHERE i < bins),
bounds AS (SELECT idx.bin, coalesce(srt.v, {largest}) AS bound FROM idx LEFT JOIN srt ON idx.k = srt.k),
lim AS (SELECT list(bound) AS b FROM bounds, shape WHERE bin <= bins - 2)"""


def find(value: str) -> str:
    return f"len(list_filter(b, lambda x: {value} > x))"


def binned(name: str, most: int = 64) -> str:
    return bounded(name, most) + f""",
binned AS (SELECT pos, v, CASE WHEN v IS NOT NULL THEN {find("v")} END AS bin FROM col, lim)"""


def word(k: int) -> str:
    one = "CASE WHEN bin % 64 = 63 THEN (-9223372036854775807 - 1)::BIGINT ELSE 1::BIGINT << (bin % 64)::INTEGER END"
    return f"coalesce(bit_or(CASE WHEN bin // 64 = {k} THEN {one} ELSE 0::BIGINT END), 0)::BIGINT AS w{k}"


def signed_blocks(name: str, per_block: int, most: int = 64) -> str:
    words = ", ".join(word(k) for k in range(bits.n_words(most)))
    return binned(name, most) + f""",
blocks AS (SELECT pos // {per_block} AS block_id, count(*) AS n_rows, count(v) AS n_values, {words} FROM binned GROUP BY ALL)"""


def classified(name: str, per_block: int, wanted: Range, most: int = 64) -> str:
    return binned(name, most) + f""",
ends AS (SELECT {find(repr(wanted.low))} AS lo, {find(repr(wanted.high))} AS hi FROM lim),
verdicts AS (SELECT pos // {per_block} AS block_id, count(*) AS n_rows, count(v) AS n_values,
  CASE WHEN NOT coalesce(bool_or(bin BETWEEN lo AND hi), false) THEN 'skip' WHEN bool_and(bin > lo AND bin < hi) THEN 'full' ELSE 'partial' END AS verdict
  FROM binned, ends GROUP BY ALL)"""


def zones(name: str, per_zone: int) -> str:
    return col(name) + f", zones AS (SELECT pos // {per_zone} AS zone_id, min(v) AS zmin, max(v) AS zmax, count(*) AS n_rows, count(v) AS n_values FROM col GROUP BY ALL)"


def run_form(name: str, per_block: int) -> str:
    return signed_blocks(name, per_block) + """,
marked AS (SELECT *, CASE WHEN w0 = lag(w0) OVER (ORDER BY block_id) THEN 0 ELSE 1 END AS starts FROM blocks),
numbered AS (SELECT *, sum(starts) OVER (ORDER BY block_id) AS run FROM marked),
vectors AS (SELECT run, w0, min(block_id) AS block_lo, count(*) AS length FROM numbered GROUP BY ALL),
stored AS (SELECT w0, block_lo, length, row_number() OVER (ORDER BY block_lo) - 1 AS vector_id, length > 1 AS repeated FROM vectors),
opened AS (SELECT *, CASE WHEN repeated OR coalesce(lag(repeated) OVER (ORDER BY vector_id), true) THEN 1 ELSE 0 END AS opens FROM stored),
grouped AS (SELECT *, sum(opens) OVER (ORDER BY vector_id) - 1 AS entry_id FROM opened),
entries AS (SELECT entry_id::BIGINT AS entry_id, repeated, sum(length)::BIGINT AS blocks, min(block_lo) AS block_lo, min(vector_id) AS vector_lo FROM grouped GROUP BY ALL)"""


def in_range(wanted: Range, v: str = "v") -> str:
    return f"{v} > {wanted.low!r} AND {v} <= {wanted.high!r}"


# scans and predicates


@query(f"{col('value')} SELECT count(*) AS n FROM col WHERE {in_range(VALUES)}")
def range_scan_count(spark, sf_dir):
    return scan.scan_count(read(spark, sf_dir, "value"), VALUES)


@query(f"{col('value')} SELECT pos FROM col WHERE {in_range(VALUES)}")
def range_scan_positions(spark, sf_dir):
    return scan.scan_positions(read(spark, sf_dir, "value"), VALUES)


@query(f"{col('value')} SELECT round(sum(v), 2) AS total FROM col WHERE {in_range(VALUES)}")
def range_scan_sum(spark, sf_dir):
    return scan.scan_sum(read(spark, sf_dir, "value"), VALUES).select(F.round("total", 2).alias("total"))


@query(f"{col('p_size')} SELECT '[)' AS ends, count(*) AS n FROM col WHERE v >= 10 AND v < 20 UNION ALL SELECT '(]', count(*) FROM col WHERE v > 10 AND v <= 20 UNION ALL SELECT '[]', count(*) FROM col WHERE v >= 10 AND v <= 20 UNION ALL SELECT '()', count(*) FROM col WHERE v > 10 AND v < 20")
def range_scan_ends(spark, sf_dir):
    c = read(spark, sf_dir, "p_size")
    parts = [scan.scan_count(c, Range(10, 20, ends)).select(F.lit(ends).alias("ends"), "n") for ends in ("[)", "(]", "[]", "()")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"{col('p_size')} SELECT pos FROM col WHERE v = 7")
def point_scan(spark, sf_dir):
    index = signature.build_signatures(read(spark, sf_dir, "p_size"))
    return index.positions(scan.point(7))


@query("SELECT event_id AS pos FROM events WHERE event_type = (SELECT max(event_type) FROM events)")
def dictionary_string_point(spark, sf_dir):
    c, codes = coded_column(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "event_id")
    code = codes.agg(F.max_by("code", "text")).first()[0]
    return signature.build_signatures(c).positions(scan.point(code))


@query("".join(f"{' UNION ALL ' if i else ''}SELECT '{n}' AS name, * FROM ({col(n)}, steps AS (SELECT v, lag(v) OVER (ORDER BY pos) AS p FROM col) SELECT count(*) AS n, min(v)::DOUBLE AS least, max(v)::DOUBLE AS most, NOT (coalesce(bool_or(v < p), false) AND coalesce(bool_or(v > p), false)) AS sorted FROM steps)" for i, n in enumerate(("value", "ts", "o_orderkey", "c_acctbal"))))
def column_properties(spark, sf_dir):
    parts = [statistics.properties(read(spark, sf_dir, n)).select("name", "n", F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"), "sorted") for n in ("value", "ts", "o_orderkey", "c_acctbal")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# zonemaps


@query(zones("value", 8) + " SELECT * FROM zones")
def zonemap_build(spark, sf_dir):
    return zonemap.build_zonemap(read(spark, sf_dir, "value")).zones


@query(zones("o_orderkey", 8) + f" SELECT zone_id, CASE WHEN {KEYS.high} < zmin OR {KEYS.low} >= zmax THEN 'skip' WHEN {KEYS.low} < zmin AND {KEYS.high} >= zmax THEN 'full' ELSE 'partial' END AS verdict FROM zones")
def zonemap_classify(spark, sf_dir):
    return zonemap.build_zonemap(read(spark, sf_dir, "o_orderkey")).classify(KEYS).select("zone_id", "verdict")


@query(f"{col('o_orderkey')} SELECT count(*) AS n FROM col WHERE {in_range(KEYS)}")
def zonemap_scan(spark, sf_dir):
    return zonemap.build_zonemap(read(spark, sf_dir, "o_orderkey")).count(KEYS)


@query(f"{col('o_orderkey')} SELECT pos FROM col WHERE {in_range(KEYS)}")
def zonemap_positions(spark, sf_dir):
    return zonemap.build_zonemap(read(spark, sf_dir, "o_orderkey")).positions(KEYS)


# samples and bins


@query(sampled("value") + " SELECT pos, v FROM picked")
def sample_grid(spark, sf_dir):
    return sample(read(spark, sf_dir, "value"))


def _bounds(spark, sf_dir, name, most):
    c = read(spark, sf_dir, name)
    return spark.createDataFrame(list(enumerate(bins_of(c, most).bounds)), f"bin bigint, bound {c.type.spark}")


@query(bounded("p_size") + " SELECT bin, bound FROM bounds")
def bounds_lowcard(spark, sf_dir):
    return _bounds(spark, sf_dir, "p_size", 64)


@query(bounded("value") + " SELECT bin, bound FROM bounds")
def bounds_highcard(spark, sf_dir):
    return _bounds(spark, sf_dir, "value", 64)


@query(bounded("value", 256) + " SELECT bin, bound FROM bounds")
def bounds_256(spark, sf_dir):
    return _bounds(spark, sf_dir, "value", 256)


_equi_depth = sampled("value").replace("WITH", "WITH RECURSIVE", 1) + """,
freq AS (SELECT v, n, row_number() OVER (ORDER BY v) AS k FROM (SELECT v, count(*) AS n FROM picked GROUP BY v)),
whole AS (SELECT sum(n) AS total, greatest(1, least(count(*), 62)) AS share FROM freq),
walk AS (SELECT 0::BIGINT AS k, 0::HUGEINT AS held, 0::BIGINT AS closed, NULL::DOUBLE AS bound UNION ALL
  SELECT f.k, CASE WHEN (held + n) * share >= total AND closed < 62 THEN 0 ELSE held + n END, closed + CASE WHEN (held + n) * share >= total AND closed < 62 THEN 1 ELSE 0 END,
    CASE WHEN (held + n) * share >= total AND closed < 62 THEN f.v END FROM walk JOIN freq f ON f.k = walk.k + 1, whole),
ends AS (SELECT closed - 1 AS bin, bound FROM walk WHERE bound IS NOT NULL)"""


@query(_equi_depth + " SELECT i AS bin, coalesce(bound, 1.7976931348623157e308) AS bound FROM range(64) r(i) LEFT JOIN ends ON bin = i")
def bounds_equidepth(spark, sf_dir):
    c = read(spark, sf_dir, "value")
    return spark.createDataFrame(list(enumerate(equi_depth_bins(c).bounds)), "bin bigint, bound double")


@query(sampled("n_chars") + " SELECT v, count(*) AS n FROM picked GROUP BY ALL")
def sample_frequencies(spark, sf_dir):
    return sample(read(spark, sf_dir, "n_chars")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query(binned("c_acctbal") + " SELECT pos, bin FROM binned")
def bin_assign(spark, sf_dir):
    c = read(spark, sf_dir, "c_acctbal")
    return c.rows.select("pos", bins_of(c).bin_of(F.col("v")).cast("bigint").alias("bin"))


#: Columns of the largest table, which has no position key: each value once, as a fraction of its distinct values.
LINEITEM = ("l_returnflag", "l_linenumber", "l_tax", "l_discount", "l_quantity", "l_suppkey")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_values, CASE WHEN count(DISTINCT {c}) >= 63 THEN 64 ELSE (SELECT min(b) FROM (VALUES (8), (16), (32), (64)) t(b) WHERE b > (SELECT count(DISTINCT {c}) FROM lineitem)) END AS bins FROM lineitem" for c in LINEITEM))
def bin_counts(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(*(F.countDistinct(c).alias(c) for c in LINEITEM)).first()
    return spark.createDataFrame([(c, lines[c], bins_for(lines[c], 64)) for c in LINEITEM], "name string, n_values bigint, bins int")


# signatures


def _signatures(most: int, bins: int):
    words = ", ".join(f"w{k}" for k in range(bits.n_words(bins)))

    def build(spark, sf_dir):
        return signature.build_signatures(read(spark, sf_dir, "value"), 64, most).blocks

    build.__name__ = f"signature_build_{most}"
    query(signed_blocks("value", 8, most) + f" SELECT block_id, n_rows, n_values, {words} FROM blocks")(build)


for _most in (8, 16, 32, 64, 128, 256):
    _signatures(_most, _most)


@query(signed_blocks("p_size", 16) + " SELECT block_id, n_rows, n_values, w0 FROM blocks")
def signature_build_int(spark, sf_dir):
    return signature.build_signatures(read(spark, sf_dir, "p_size")).blocks


@query(classified("value", 8, VALUES) + " SELECT block_id, verdict FROM verdicts")
def signature_classify(spark, sf_dir):
    return signature.build_signatures(read(spark, sf_dir, "value")).classify(VALUES).select("block_id", "verdict")


@query(classified("o_orderkey", 8, KEYS, 256) + " SELECT block_id, verdict FROM verdicts")
def signature_classify_256(spark, sf_dir):
    return signature.build_signatures(read(spark, sf_dir, "o_orderkey"), 64, 256).classify(KEYS).select("block_id", "verdict")


@query(f"{col('value')} SELECT count(*) AS n FROM col WHERE {in_range(VALUES)}")
def signature_scan_count(spark, sf_dir):
    return signature.build_signatures(read(spark, sf_dir, "value")).count(VALUES)


@query(f"{col('o_orderkey')} SELECT count(*) AS n FROM col WHERE {in_range(KEYS)}")
def signature_scan_count_256(spark, sf_dir):
    return signature.build_signatures(read(spark, sf_dir, "o_orderkey"), 64, 256).count(KEYS)


@query(f"{col('value')} SELECT pos FROM col WHERE {in_range(VALUES)}")
def signature_scan_positions(spark, sf_dir):
    return signature.build_signatures(read(spark, sf_dir, "value")).positions(VALUES)


@query(f"{col('o_totalprice')} SELECT round(sum(v), 2) AS total FROM col WHERE v > 1000.0 AND v <= 50000.0")
def signature_scan_sum(spark, sf_dir):
    return signature.build_signatures(read(spark, sf_dir, "o_totalprice")).sum(Range(1000.0, 50000.0)).select(F.round("total", 2).alias("total"))


def middle(c: Column) -> Range:
    """From the value two fifths into the column to that three fifths into it."""
    at = [c.n * 2 // 5, c.n * 3 // 5]
    found = {r.pos: r.v for r in c.rows.where(F.col("pos").isin(at)).collect()}
    return Range(found[at[0]], found[at[1]])


_middle = col("ts") + ", lim AS (SELECT min(v) AS lo, max(v) AS hi FROM col, n WHERE pos IN (n * 2 // 5, n * 3 // 5)) SELECT {} FROM col, lim WHERE v > lo AND v <= hi"


@query(_middle.format("pos, v"))
def signature_range_pushdown(spark, sf_dir):
    """A clustered column that is not the position: the index turns the range of values into ranges of positions."""
    c = read(spark, sf_dir, "ts")
    return access.qualifying_rows(signature.build_signatures(c, 256), middle(c))[1]


@query(_middle.format("pos, v"))
def saved_index_rows(spark, sf_dir):
    """Through an index that was built and saved before, by the data source that plans from it."""
    c, folder = read(spark, sf_dir, "ts"), fresh_dir(spark, "index")
    indexed.save(signature.build_signatures(c, 4096), folder)
    return indexed.read_indexed(spark, folder, middle(c))


@query(_middle.format("count(*) AS n"))
def saved_index_count(spark, sf_dir):
    c, folder = read(spark, sf_dir, "ts"), fresh_dir(spark, "index")
    indexed.save(signature.build_signatures(c, 4096, 256), folder)
    return indexed.load(spark, folder).count(middle(c))


@query(signed_blocks("value", 8) + " SELECT block_id // 64 AS block_id, sum(n_rows)::BIGINT AS n_rows, sum(n_values)::BIGINT AS n_values, bit_or(w0) AS w0 FROM blocks GROUP BY ALL")
def signature_two_level(spark, sf_dir):
    return signature.build_signatures(read(spark, sf_dir, "value")).coarser(64).blocks


@query(run_form("ts", 8) + " SELECT entry_id, repeated, blocks, block_lo, vector_lo FROM entries")
def signature_rle_dictionary(spark, sf_dir):
    return runs.run_lengths(signature.build_signatures(read(spark, sf_dir, "ts"))).entries.select("entry_id", "repeated", "blocks", "block_lo", "vector_lo")


@query(run_form("ts", 8) + " SELECT vector_id, block_lo, length, w0 FROM stored")
def signature_rle_vectors(spark, sf_dir):
    return runs.run_lengths(signature.build_signatures(read(spark, sf_dir, "ts"))).vectors.select("vector_id", "block_lo", "length", "w0")


@query(signed_blocks("ts", 8) + " SELECT block_id, w0 FROM blocks")
def signature_expand(spark, sf_dir):
    return runs.run_lengths(signature.build_signatures(read(spark, sf_dir, "ts"))).expand()


def _form_rows(name: str) -> str:
    return f"SELECT part, id, value FROM ({run_form(name, 8)} SELECT 'entry' AS part, block_lo AS id, concat(blocks, 'x', repeated) AS value FROM entries UNION ALL SELECT 'vector', block_lo, w0::VARCHAR FROM stored)"


@query(" UNION ALL ".join(f"SELECT '{side}' AS side, part, count(*) AS n, min(id) AS first FROM ({_form_rows(a)} EXCEPT ALL {_form_rows(b)}) GROUP BY ALL" for side, a, b in (("one", "ts", "value"), ("other", "value", "ts"))))
def signature_compare(spark, sf_dir):
    """Entries and vectors that only one of the indexes of two columns has."""
    one, other = (runs.run_lengths(signature.build_signatures(read(spark, sf_dir, c))) for c in ("ts", "value"))
    return runs.differences(one, other).groupBy("side", "part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(run_form("ts", 8) + ", sized AS (SELECT (SELECT count(*) FROM stored) AS n_vectors, (SELECT count(*) FROM entries) AS n_entries, (SELECT bins FROM shape) AS bins, (SELECT n FROM n) AS n) SELECT n_vectors, n_entries, n_vectors * (bins // 8) + 4 * n_entries AS index_bytes, (n_vectors * (bins // 8) + 4 * n_entries) * 100 // (n * 8) AS percent FROM sized")
def signature_size_overhead(spark, sf_dir):
    index = signature.build_signatures(read(spark, sf_dir, "ts"))
    return runs.size_of(index, runs.run_lengths(index))


@query(run_form("value", 8) + ", pairs AS (SELECT w0, lag(w0) OVER (ORDER BY vector_id) AS p FROM stored) SELECT count(*) AS n_vectors, sum(coalesce(bit_count(xor(w0, p)), 0))::BIGINT AS bits_changed, sum(bit_count(w0))::BIGINT AS bits_set, sum(coalesce(bit_count(xor(w0, p)), 0)) / (2 * sum(bit_count(w0))) AS entropy FROM pairs")
def signature_entropy(spark, sf_dir):
    return statistics.entropy(runs.run_lengths(signature.build_signatures(read(spark, sf_dir, "value"))))


_per_bin = ", member AS (SELECT vector_id, x.bin AS bin FROM stored, (SELECT bin FROM bounds) x WHERE CASE WHEN x.bin = 63 THEN w0 < 0 ELSE (w0 >> x.bin::INTEGER) & 1 = 1 END)"


@query(run_form("value", 8) + _per_bin + ", each AS (SELECT vector_id, max(bin) - min(bin) + 1 AS spread, count(*) AS density FROM member GROUP BY ALL) SELECT round(avg(spread), 9) AS mean_spread, round(stddev_pop(spread), 9) AS dev_spread, round(avg(density), 9) AS mean_density, round(stddev_pop(density), 9) AS dev_density FROM each")
def signature_spread_density(spark, sf_dir):
    found = statistics.spread_and_density(runs.run_lengths(signature.build_signatures(read(spark, sf_dir, "value"))))
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query(run_form("value", 8) + _per_bin + " SELECT bin::BIGINT AS bin, count(*) AS n_vectors FROM member GROUP BY ALL")
def signature_bit_histogram(spark, sf_dir):
    index = signature.build_signatures(read(spark, sf_dir, "value"))
    return statistics.bin_histogram(runs.run_lengths(index), len(index.bins)).select(F.col("bin").cast("bigint").alias("bin"), "n_vectors")


@query(run_form("value", 8) + _per_bin + " SELECT count(DISTINCT bin) AS covered FROM member")
def signature_bit_cover(spark, sf_dir):
    index = signature.build_signatures(read(spark, sf_dir, "value"))
    return statistics.bins_covered(runs.run_lengths(index), len(index.bins))


@query(run_form("value", 8) + " SELECT bit_count(w0)::BIGINT AS n_bits, count(*) AS n_vectors FROM stored GROUP BY ALL")
def signature_popcount_vectors(spark, sf_dir):
    found = statistics.popcount_vectors(runs.run_lengths(signature.build_signatures(read(spark, sf_dir, "value"))))
    return found.select(F.col("n_bits").cast("bigint").alias("n_bits"), "n_vectors")


@query(run_form("value", 8) + " SELECT bit_or(w0) AS w0, count(DISTINCT w0) AS n_distinct FROM stored")
def signature_global_vector(spark, sf_dir):
    found = runs.run_lengths(signature.build_signatures(read(spark, sf_dir, "value")))
    return statistics.global_vector(found).join(statistics.distinct_vectors(found))


@query(binned("p_size") + ", grid AS (SELECT block_id, k FROM (SELECT DISTINCT pos // 16 AS block_id FROM col), range(256) r(k), shape WHERE k < bins), own AS (SELECT DISTINCT pos // 16 AS block_id, bin FROM binned) SELECT grid.block_id, string_agg(CASE WHEN own.bin IS NULL THEN '.' ELSE 'x' END, '' ORDER BY k) AS bins FROM grid LEFT JOIN own ON own.block_id = grid.block_id AND own.bin = k GROUP BY ALL")
def signature_print(spark, sf_dir):
    return statistics.printed(signature.build_signatures(read(spark, sf_dir, "p_size")))


@query(run_form("ts", 8) + ", zones AS (SELECT pos // 8 AS block_id, min(v) AS zmin, max(v) AS zmax FROM col GROUP BY ALL) SELECT stored.block_lo, stored.block_lo + length - 1 AS block_hi, min(zmin) AS zmin, max(zmax) AS zmax FROM stored JOIN zones ON block_id BETWEEN block_lo AND block_lo + length - 1 GROUP BY ALL")
def signature_runs_zones(spark, sf_dir):
    c = read(spark, sf_dir, "ts")
    index = signature.build_signatures(c)
    return statistics.runs_with_zones(index, runs.run_lengths(index), zonemap.build_zonemap(c)).drop("bins")


@query(classified("value", 8, VALUES) + f", zones AS (SELECT pos // 8 AS z, min(v) AS a, max(v) AS b, count(v) AS n FROM col GROUP BY ALL), zoned AS (SELECT n, CASE WHEN {VALUES.high} < a OR {VALUES.low} >= b THEN 'skip' WHEN {VALUES.low} < a AND {VALUES.high} >= b THEN 'full' ELSE 'partial' END AS verdict FROM zones), probes AS (SELECT 'zonemap' AS path, n, verdict FROM zoned UNION ALL SELECT 'signature', n_values, verdict FROM verdicts) SELECT path, count(*) AS probes, count(*) FILTER (verdict = 'skip') AS skipped, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'full') AS full, coalesce(sum(n) FILTER (verdict = 'partial'), 0)::BIGINT AS compared FROM probes GROUP BY ALL UNION ALL SELECT 'scan', 0, 0, 0, 0, (SELECT count(v) FROM col)")
def probe_counters(spark, sf_dir):
    c = read(spark, sf_dir, "value")
    return statistics.probe_counters(signature.build_signatures(c), zonemap.build_zonemap(c), VALUES)


def _matrix_sql() -> str:
    parts = []
    for b in workload.BLOCK_BYTES:
        for m in workload.MOST_BINS:
            words = " AND ".join(f"w{k} = lag(w{k}) OVER (ORDER BY block_id)" for k in range(m // 64))
            form = signed_blocks("p_retailprice", b // 8, m) + f", marked AS (SELECT block_id, CASE WHEN {words} THEN 0 ELSE 1 END AS starts FROM blocks) SELECT {b} AS block_bytes, {m} AS most_bins, (SELECT bins FROM shape)::INTEGER AS bins, count(*) AS n_blocks, sum(starts)::BIGINT AS n_vectors FROM marked"
            parts.append(f"SELECT * FROM ({form})")
    return " UNION ALL ".join(parts)


@query(_matrix_sql())
def experiment_matrix(spark, sf_dir):
    return workload.experiment_matrix(read(spark, sf_dir, "p_retailprice")).select("block_bytes", "most_bins", "bins", "n_blocks", "n_vectors")


# bitmaps


@query(binned("label") + " SELECT bin::INTEGER AS bin, pos // 31 AS grp, bit_or(1::BIGINT << (pos % 31)::INTEGER) AS bits, count(*) AS n FROM binned WHERE bin IS NOT NULL GROUP BY ALL")
def bitmap_build(spark, sf_dir):
    c = read(spark, sf_dir, "label")
    return bitmap.bitmap_groups(c, bins_of(c)).select("bin", "grp", F.col("bits").cast("bigint").alias("bits"), "n")


_code_words = binned("value").replace("WITH", "WITH RECURSIVE", 1) + f""",
runs AS (SELECT bin, min(pos) AS lo, max(pos) AS hi FROM (SELECT bin, pos, pos - row_number() OVER (PARTITION BY bin ORDER BY pos) AS island FROM binned WHERE bin IS NOT NULL) GROUP BY bin, island),
spans AS (SELECT bin, list(struct_pack(lo := lo, hi := hi) ORDER BY lo) AS spans FROM runs GROUP BY bin),
every AS (SELECT bin, list(pos ORDER BY pos) AS every FROM binned WHERE bin IS NOT NULL GROUP BY bin),
pieces AS (SELECT bin, s * {bitmap.STRETCH} AS start, least((s + 1) * {bitmap.STRETCH}, n) AS till, spans, every FROM spans JOIN every USING (bin), n, range(1 + (SELECT n FROM n) // {bitmap.STRETCH}) r(s)
  WHERE len(list_filter(every, lambda p: p >= s * {bitmap.STRETCH} AND p < (s + 1) * {bitmap.STRETCH})) > 0),
words AS (SELECT bin, start, start AS here, -1 AS word_no, 0::BIGINT AS word, till, spans, every FROM pieces UNION ALL
  SELECT bin, start, CASE WHEN run > 30 THEN here + run ELSE least(here + 31, till) END, word_no + 1,
    CASE WHEN run > 30 THEN CASE WHEN len(own) > 0 THEN 1073741824 ELSE 0 END + run
      ELSE 2147483648 + coalesce(list_sum(list_transform(list_filter(every, lambda p: p >= here AND p < least(here + 31, till)), lambda p: (1::BIGINT << (p - here)::INTEGER))), 0) END::BIGINT, till, spans, every
  FROM (SELECT *, least(till - here, 1073741823, CASE WHEN len(own) > 0 THEN own[1].hi + 1 ELSE coalesce(after[1].lo, till) END - here) AS run
    FROM (SELECT *, list_filter(spans, lambda i: i.lo <= here AND i.hi >= here) AS own, list_filter(spans, lambda i: i.lo > here) AS after FROM words WHERE here < till)))"""


@query(_code_words + " SELECT bin::INTEGER AS bin, start::BIGINT AS start, word_no::INTEGER AS word_no, word FROM words WHERE word_no >= 0")
def wah_encode(spark, sf_dir):
    c = read(spark, sf_dir, "value")
    return bitmap.wah_encode(c, bins_of(c))


@query(binned("label") + " SELECT bin::INTEGER AS bin, pos FROM binned WHERE bin IS NOT NULL")
def wah_decode(spark, sf_dir):
    c = read(spark, sf_dir, "label")
    return bitmap.wah_positions(bitmap.wah_encode(c, bins_of(c)))


@query(f"{col('value')} SELECT pos FROM col WHERE {in_range(VALUES)}")
def wah_scan(spark, sf_dir):
    c = read(spark, sf_dir, "value")
    bins = bins_of(c)
    return bitmap.bitmap_positions(c, bins, bitmap.wah_encode(c, bins), VALUES)


# conjunctions and updates


@query("SELECT p_partkey AS pos FROM part WHERE p_size > 10 AND p_size <= 30 AND p_retailprice > 920.0 AND p_retailprice <= 960.0")
def multi_column_conjunction(spark, sf_dir):
    a, b = read(spark, sf_dir, "p_size"), read(spark, sf_dir, "p_retailprice")
    terms = {"p_size": (signature.build_signatures(a), Range(10, 30)), "p_retailprice": (signature.build_signatures(b), PRICES)}
    return conjunction.qualifying_tuples(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", terms).select("pos").orderBy("pos")


@query("SELECT p_partkey AS pos FROM part WHERE p_size > 10 AND p_size <= 30 AND p_retailprice > 920.0 AND p_retailprice <= 960.0")
def conjunction_of_columns(spark, sf_dir):
    """The same for columns that are stored apart."""
    a, b = read(spark, sf_dir, "p_size"), read(spark, sf_dir, "p_retailprice")
    return conjunction.conjunction_positions([(signature.build_signatures(a), Range(10, 30)), (signature.build_signatures(b), PRICES)])


@query("SELECT p_partkey AS pos, p_size, p_retailprice FROM part WHERE p_size > 10 AND p_size <= 30")
def tuple_reconstruction(spark, sf_dir):
    a, b = read(spark, sf_dir, "p_size"), read(spark, sf_dir, "p_retailprice")
    hits = signature.build_signatures(a).positions(Range(10, 30))
    return conjunction.tuples(hits, {"p_size": a, "p_retailprice": b})


def _first_part(spark, sf_dir) -> tuple[Column, DataFrame, signature.Signatures]:
    whole = read(spark, sf_dir, "o_totalprice")
    cut = whole.n // 2 + 3
    return whole, whole.rows.where(F.col("pos") >= cut), signature.build_signatures(Column(whole.rows.where(F.col("pos") < cut), whole.type, whole.name), 64, 64, bins_of(whole))


@query(signed_blocks("o_totalprice", 8) + " SELECT block_id, n_rows, n_values, w0 FROM blocks")
def append_merge(spark, sf_dir):
    _, rest, index = _first_part(spark, sf_dir)
    return updates.append(index, rest).blocks


@query(f"{col('value')} SELECT pos FROM col WHERE {in_range(VALUES)} AND pos % 10 <> 3")
def delta_delete(spark, sf_dir):
    c = read(spark, sf_dir, "value")
    return updates.with_deltas(signature.build_signatures(c).positions(VALUES), c.rows.where("pos % 10 = 3"))


@query(f"{col('value')} SELECT pos FROM (SELECT pos, CASE WHEN pos % 10 = 3 THEN 500.0 - v ELSE v END AS v FROM col) WHERE {in_range(VALUES)}")
def delta_update(spark, sf_dir):
    c = read(spark, sf_dir, "value")
    return updates.insert_bits(signature.build_signatures(c), c.rows.where("pos % 10 = 3").select("pos", (500.0 - F.col("v")).alias("v"))).positions(VALUES)


_changed = "SELECT pos, CASE WHEN pos % 10 = 3 THEN CASE WHEN pos % 20 = 3 THEN NULL ELSE 500.0 - v END ELSE v END AS v FROM col"


@query(f"{col('value')}, changed AS ({_changed}), ranges(low, high) AS (VALUES (10.0, 50.0), (-1e9, 1e9), (100.0, 400.0)) SELECT low, high, (SELECT count(*) FROM changed WHERE v > low AND v <= high) AS n, (SELECT round(sum(v), 2) FROM changed WHERE v > low AND v <= high) AS total FROM ranges")
def delta_update_counts(spark, sf_dir):
    """Counts and sums after values were replaced by others and by nulls, from the numbers that the index keeps."""
    c = read(spark, sf_dir, "value")
    changed = c.rows.where("pos % 10 = 3").select("pos", F.when(F.col("pos") % 20 == 3, None).otherwise(500.0 - F.col("v")).alias("v"))
    index = updates.insert_bits(signature.build_signatures(c), changed)
    parts = []
    for low, high in ((10.0, 50.0), (-1e9, 1e9), (100.0, 400.0)):
        wanted = Range(low, high)
        parts.append(index.count(wanted).join(index.sum(wanted)).select(F.lit(low).alias("low"), F.lit(high).alias("high"), "n", F.round("total", 2).alias("total")))  # two single rows
    return parts[0].union(parts[1]).union(parts[2])


# workloads and their analysis


_ten = "ranges AS (SELECT i, low, least(low + i * most / 10.0, most) AS high FROM (SELECT bound AS low FROM bounds WHERE bin = 1), (SELECT max(v) AS most FROM col), range(10) r(i))"


@query(bounded("value") + f", {_ten} SELECT i AS query, least(low, high) AS low, high FROM ranges")
def query_generator(spark, sf_dir):
    c = read(spark, sf_dir, "value")
    wanted = workload.growing_ranges(bins_of(c), c.rows.agg(F.max("v")).first()[0])
    return spark.createDataFrame([(i, r.low, r.high) for i, r in enumerate(wanted)], "query bigint, low double, high double")


@query(bounded("value") + f", {_ten}, counts AS (SELECT i AS query, (SELECT count(*) FROM col WHERE v > low AND v <= high) AS n FROM ranges) SELECT query, method, counts.n AS n, counts.n * 100.0::DOUBLE / (SELECT n FROM n) AS selectivity FROM counts, (VALUES ('scan'), ('zonemap'), ('signature'), ('bitmap')" + "".join(f", ('signature {b}x{m}')" for b, m in workload.variants()) + ") m(method)")
def harness_agreement(spark, sf_dir):
    c = read(spark, sf_dir, "value")
    wanted = workload.growing_ranges(bins_of(c), c.rows.agg(F.max("v")).first()[0])
    found = workload.run_workload(c, wanted, others=workload.variants())
    return found.select(F.col("query").cast("bigint").alias("query"), "method", "n", "selectivity")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS se FROM orders GROUP BY ALL")
def metrics_mean_se(spark, sf_dir):
    found = analysis.mean_and_error(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return found.select("o_orderstatus", "o_orderpriority", "n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


#: Builds and queries as a log tells of them, made from the parts: expressions that both engines read alike.
BUILDS = {
    "label": "concat(p_brand, '-', p_size)", "exp": "CASE WHEN p_partkey % 2 = 0 THEN 'simd' ELSE 'scalar' END", "bins": "CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 64 ELSE 256 END",
    "blocksize": "CASE WHEN p_size % 2 = 0 THEN 64 ELSE 256 END", "time_creation_usec": "CAST(p_size AS BIGINT) * 100", "data_size_bytes": "CAST(p_size AS BIGINT) * 400", "type_size_bytes": "8",
    "vectors_size_bytes": "CAST(p_size AS BIGINT) * 10000", "records": "CAST(p_size AS BIGINT) * 50",
}
RUNS = {
    "label": BUILDS["label"], "exp": BUILDS["exp"], "query": "CAST(p_partkey % 10 AS INTEGER)", "bins": BUILDS["bins"], "blocksize": BUILDS["blocksize"], "result_size": "CAST(p_size AS BIGINT)",
    "selectivity": "CAST(p_size AS DOUBLE)", "query_time": "CAST(p_partkey % 997 + 1 AS BIGINT)", "records": BUILDS["records"],
}


def columns_of(fields: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in fields.items()]


_logs = f"WITH builds AS (SELECT {', '.join(columns_of(BUILDS))} FROM part), runs AS (SELECT {', '.join(columns_of(RUNS))} FROM part)"


def logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr(*columns_of(BUILDS)), part.selectExpr(*columns_of(RUNS))


@query(_logs + " SELECT label, exp, bins, blocksize, time_creation_usec, records, time_creation_usec * 1000.0::DOUBLE / records AS usec_per_1000 FROM builds WHERE time_creation_usec > 1000")
def metrics_build_cost(spark, sf_dir):
    found = analysis.cost(analysis.measured(logs(spark, sf_dir)[0]))
    return found.select("label", "exp", "bins", "blocksize", "time_creation_usec", "records", "usec_per_1000")


_joined = _logs + ", joined AS (SELECT runs.*, vectors_size_bytes, vectors_size_bytes // (bins // 8) AS vectors, blocksize // type_size_bytes AS values_per_block FROM runs LEFT JOIN (SELECT label, bins, blocksize, type_size_bytes, vectors_size_bytes FROM builds) b USING (label, bins, blocksize))"


def _with_builds(spark, sf_dir) -> DataFrame:
    builds, found = logs(spark, sf_dir)
    derived = analysis.derived(builds.withColumn("block_size_bytes", F.col("blocksize"))).select("label", "bins", "blocksize", "vectors", "values_per_block")
    return analysis.with_builds(found, derived)


@query(_joined + " SELECT label, exp, query, bins, blocksize, query_time, vectors, values_per_block FROM joined")
def metrics_left_join(spark, sf_dir):
    return _with_builds(spark, sf_dir).select("label", "exp", "query", "bins", "blocksize", "query_time", "vectors", "values_per_block")


@query(_joined + " SELECT bins, blocksize, count(*) AS n, round(avg(query_time * 1000.0::DOUBLE / vectors), 6) AS mean, round(stddev_samp(query_time * 1000.0::DOUBLE / vectors) / sqrt(count(*)), 6) AS se FROM joined WHERE vectors > 1000 GROUP BY ALL")
def metrics_per_1000_vectors(spark, sf_dir):
    found = analysis.mean_and_error(analysis.per_1000_vectors(_with_builds(spark, sf_dir)), ["bins", "blocksize"], "time_per_1000")
    return found.select("bins", "blocksize", "n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


@query(_logs + " SELECT label, exp, bins, blocksize, records, time_creation_usec, query_time FROM builds, (SELECT NULL::BIGINT AS query_time) UNION ALL SELECT label, exp, bins, blocksize, records, NULL, query_time FROM runs")
def metrics_bag_union(spark, sf_dir):
    builds, found = logs(spark, sf_dir)
    return analysis.bag_union(builds.select("label", "exp", "bins", "blocksize", "records", "time_creation_usec"), found.select("label", "exp", "bins", "blocksize", "records", "query_time"))


@query(_logs + " SELECT DISTINCT values_per_block FROM (SELECT blocksize // type_size_bytes AS values_per_block FROM builds)")
def metrics_breaks(spark, sf_dir):
    return analysis.breaks(analysis.derived(logs(spark, sf_dir)[0].withColumn("block_size_bytes", F.col("blocksize"))), "values_per_block")


@query("SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 6")
def metrics_head(spark, sf_dir):
    return analysis.head(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"])


@query("SELECT p_partkey AS query, 'zonemap' AS method, (p_size * 7 + 1) / (p_size + 1)::DOUBLE AS factor FROM part")
def metrics_improvement(spark, sf_dir):
    """Time of the scan over that of another path, query by query."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    times = part.select(F.col("p_partkey").alias("query"), F.lit("scan").alias("method"), (F.col("p_size") * 7 + 1).alias("usec")).union(part.select("p_partkey", F.lit("zonemap"), F.col("p_size") + 1))
    return analysis.improvement(times)


def _log_lines(spark, sf_dir) -> DataFrame:
    """(file, line_no, value): for each part a run of a create line, a query line, a line of a type that is not supported, and
    its end."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = lambda kind, fields: "concat('" + kind + " ', concat_ws(' ', " + ", ".join(f"concat('{c}=', {sql})" for c, sql in fields.items()) + "))"
    each = f"posexplode(array({line('create', BUILDS)}, {line('query', RUNS)}, 'type blob not supported', '{metrics_log.END}'))"
    return part.selectExpr("p_partkey", f"{each} AS (k, value)").selectExpr("'log' AS file", "p_partkey * 4 + k AS line_no", "value")


@query("WITH numbered AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS run_no FROM part) SELECT run_no, " + ", ".join(columns_of(BUILDS)) + " FROM numbered")
def log_builds(spark, sf_dir):
    return metrics_log.parse(_log_lines(spark, sf_dir), metrics_log.CREATE, "create").drop("file")


@query("WITH numbered AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS run_no FROM part) SELECT run_no, " + ", ".join(columns_of(RUNS)) + " FROM numbered")
def log_queries(spark, sf_dir):
    return metrics_log.parse(_log_lines(spark, sf_dir), metrics_log.QUERY, "query").drop("file")


@query("SELECT p_partkey AS pos, p_size AS v FROM part")
def raw_column(spark, sf_dir):
    """A column written to raw files and read back from them."""
    folder = fresh_dir(spark, "raw")
    raw.write_raw(read(spark, sf_dir, "p_size"), folder).write.parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files").where("n_values > 0").orderBy("first_pos").collect()  # a row a file
    parts = [raw.read_raw(spark, f.path, "int", f.n_values).rows.select((F.col("pos") + f.first_pos).alias("pos"), "v") for f in files]
    return analysis.bag_union(*parts)


@query("SELECT p_size, sum(count(*)) OVER (ORDER BY p_size)::BIGINT AS n_upto FROM part GROUP BY p_size")
def metrics_distribution(spark, sf_dir):
    return analysis.distribution(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_size")


@query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey IN (SELECT DISTINCT s_nationkey FROM supplier)")
def metrics_semi_join(spark, sf_dir):
    customer, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier"))
    return analysis.breaks(analysis.among(customer, "c_nationkey", supplier, "s_nationkey"), "c_mktsegment")


@query(run_form("value", 8) + ", words AS (SELECT count(*) AS n FROM (" + _code_words + " SELECT * FROM words WHERE word_no >= 0)), sized(path, bytes) AS (SELECT 'zonemap', (SELECT count(*) FROM (SELECT DISTINCT pos // 8 FROM col)) * 16 UNION ALL SELECT 'signature', (SELECT count(*) FROM stored) * (SELECT bins FROM shape) // 8 + 4 * (SELECT count(*) FROM entries) UNION ALL SELECT 'bitmap', 4 * (SELECT n FROM words)) SELECT path, bytes, bytes * 100 // ((SELECT n FROM n) * 8) AS percent FROM sized")
def storage_comparison(spark, sf_dir):
    c = read(spark, sf_dir, "value")
    index = signature.build_signatures(c)
    return statistics.storage(index, runs.run_lengths(index), zonemap.build_zonemap(c), bitmap.wah_encode(c, index.bins))


@query(bounded("value") + " SELECT bin::INTEGER AS bin, bound FROM bounds")
def bounds_print(spark, sf_dir):
    return statistics.bounds_table(signature.build_signatures(read(spark, sf_dir, "value")))


_marks = "(SELECT string_agg(CASE WHEN CASE WHEN k = 63 THEN w0 < 0 ELSE (w0 >> k::INTEGER) & 1 = 1 END THEN 'x' ELSE '.' END, '' ORDER BY k) FROM range((SELECT bins FROM shape)) r(k))"


@query(run_form("ts", 8) + f" SELECT entry_id, vector_id, {_marks} AS bins, CASE WHEN grouped.repeated THEN concat(' repeat [', length, ']') ELSE '' END AS note FROM grouped")
def signature_print_entries(spark, sf_dir):
    index = signature.build_signatures(read(spark, sf_dir, "ts"))
    return statistics.printed_entries(runs.run_lengths(index), len(index.bins)).drop("segment")


@query(run_form("value", 8) + _per_bin + ", hist AS (SELECT bin, count(*) AS n FROM member GROUP BY bin), most AS (SELECT max(n) AS m FROM hist) SELECT 11 - lv AS row, string_agg(CASE WHEN coalesce(n, 0) * 10 > (lv - 1) * m THEN 'H' ELSE ' ' END, '' ORDER BY k) AS bar FROM range(1, 11) a(lv), range(64) b(k) LEFT JOIN hist ON hist.bin = k, most GROUP BY lv")
def histogram_bars(spark, sf_dir):
    index = signature.build_signatures(read(spark, sf_dir, "value"))
    return statistics.bars(statistics.bin_histogram(runs.run_lengths(index), len(index.bins)), len(index.bins)).select(F.col("row").cast("bigint").alias("row"), "bar")


@query()
def ranges_by_bin(spark, sf_dir):
    """Ranges between bounds, with the rows that each holds by the index and by the scan, which agree."""
    c = read(spark, sf_dir, "value")
    index = signature.build_signatures(c)
    filled = [r.bin for r in statistics.bin_histogram(runs.run_lengths(index), len(index.bins)).orderBy("bin").collect()]
    return workload.run_workload(c, workload.ranges_by_bin(index.bins, filled))


@query()
def ranges_by_data(spark, sf_dir):
    c = read(spark, sf_dir, "value")
    return workload.run_workload(c, workload.ranges_by_data(c))
