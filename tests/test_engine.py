"""Golden examples, agreement of all access paths, and edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skipweave import types
from skipweave.column import Column, coded_column, column, read_positions
from skipweave.functions import bits
from skipweave.functions.binning import Bins, bins_of, bounds_of, equi_depth_bounds, make_bins
from skipweave.operators import bitmap, conjunction, runs, scan, signature, statistics, updates, zonemap
from skipweave.operators.scan import Range
from skipweave.plans import access, workload


def of(spark, values, kind="int", name="c"):
    rows = spark.createDataFrame(list(enumerate(values)), f"pos bigint, v {types.resolve(kind).spark}")
    return Column(rows, types.resolve(kind), name)


def index_of(c, per_block, bounds):
    bins = Bins((*bounds, c.type.most), c.type)
    return signature.Signatures(c, bins, per_block, signature.block_signatures(c.rows, bins, per_block))


def texts(index):
    return [r.bins[: len(index.bins) - 1] for r in statistics.printed(index).orderBy("block_id").collect()]


def positions(df):
    return [r.pos for r in df.collect()]


GOLDEN_1 = [1, 8, 4, 6, 7, 1, 4, 7, 3, 2, 5, 6, 8, 2, 1]
GOLDEN_2 = [1, 11, 4, 6, 14, 13, 10, 7, 3, 9, 5, 12, 8, 2, 15]
LETTER = {"skip": "S", "partial": "P", "full": "F"}


def verdicts(df, key):
    return "".join(LETTER[r.verdict] for r in df.orderBy(key).collect())


@pytest.mark.parametrize(
    "low, high, found, by_bins, by_zone",
    [
        (2, 6, [2, 3, 6, 8, 10, 11], "PPPPP", "PPPPP"),
        (7, 8, [1, 12], "PPPSP", "PSSSP"),
        (1, 6, [2, 3, 6, 8, 9, 10, 11, 13], "PPPPP", "PPPFP"),
        (0, 8, list(range(15)), "PPFFP", "FFFFF"),
        (8, 9, [], "PSSSP", "SSSSS"),
    ],
)
def test_fifteen_values(spark, low, high, found, by_bins, by_zone):
    c = of(spark, GOLDEN_1)
    index = index_of(c, 3, range(1, 9))
    zones = zonemap.build_zonemap(c, 12)
    wanted = Range(low, high)
    assert verdicts(index.classify(wanted), "block_id") == by_bins
    assert verdicts(zones.classify(wanted), "zone_id") == by_zone
    assert positions(index.positions(wanted)) == positions(zones.positions(wanted)) == positions(scan.scan_positions(c, wanted)) == found


def test_fifteen_values_index(spark):
    index = index_of(of(spark, GOLDEN_1), 3, range(1, 9))
    assert texts(index) == ["x..x...x", "x....xx.", "..xx..x.", ".x..xx..", "xx.....x"]
    form = runs.run_lengths(index)
    assert [(r.blocks, r.repeated) for r in form.entries.collect()] == [(5, False)]
    assert statistics.entropy(form).first()["entropy"] == pytest.approx(18 / 30)


@pytest.mark.parametrize("low, high, found, by_bins, by_zone", [(4, 13, [1, 3, 5, 6, 7, 9, 10, 11, 12], "PPPFP", "PPPFP"), (10, 11, [1], "PSPSS", "PPSPP"), (2, 15, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14], "PFFFP", "PFFFP")])
def test_permutation(spark, low, high, found, by_bins, by_zone):
    c = of(spark, GOLDEN_2)
    index, zones = index_of(c, 3, range(1, 16)), zonemap.build_zonemap(c, 12)
    assert verdicts(index.classify(Range(low, high)), "block_id") == by_bins
    if by_zone:
        assert verdicts(zones.classify(Range(low, high)), "zone_id") == by_zone
    assert positions(index.positions(Range(low, high))) == found
    assert statistics.entropy(runs.run_lengths(index)).first()["entropy"] == pytest.approx(24 / 30)


def test_run_dictionary(spark):
    words = ["010010001101010", "000000110000011", "111100001110000", "000111000000110", "010000110000011", "000111010101010", "000000000000011"]
    words += ["000111000000000"] * 13 + ["010000011100110", "000001101100000", "010000001000000"]
    blocks = spark.createDataFrame([(k, 1, 1, int(w[::-1], 2)) for k, w in enumerate(words)], "block_id bigint, n_rows bigint, n_values bigint, w0 bigint")
    c = of(spark, [0])
    form = runs.run_lengths(signature.Signatures(c, Bins(tuple(range(16)), c.type), 1, blocks))
    assert [(r.blocks, r.repeated) for r in form.entries.orderBy("block_lo").collect()] == [(7, False), (13, True), (3, False)]
    assert form.vectors.count() == 11
    assert [r.w0 for r in form.expand().orderBy("block_id").collect()] == [int(w[::-1], 2) for w in words]
    assert runs.differences(form, form).count() == 0


def test_bins_of_eight_values(spark):
    bins = Bins((12, 23, 51, 70, types.INT.most), types.INT)
    v = (13, 82, 66, 15, 80, 60, 68, 21)
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "k int, v int").orderBy("k")
    for f in (bins.bin_of, bins.bin_by_count):
        assert [r.b for r in rows.select("k", f(F.col("v")).alias("b")).orderBy("k").collect()] == [1, 4, 3, 1, 4, 3, 3, 1]
    assert [bins.find(x) for x in v] == [1, 4, 3, 1, 4, 3, 3, 1]


@pytest.mark.parametrize("n, bins", [(1, 8), (5, 8), (7, 8), (8, 16), (62, 64), (63, 64), (500, 64)])
def test_number_of_bins(n, bins):
    bounds = bounds_of(list(range(n)), 64, types.INT)
    assert len(bounds) == bins and bounds[-1] == types.INT.most and bounds == sorted(bounds)


def test_equi_depth_bounds():
    bounds = equi_depth_bounds([(k, 1 if k else 100) for k in range(101)], 8, types.INT)
    assert bounds[0] == 0 and len(bounds) == 8 and bounds[-1] == types.INT.most


COLUMNS = {
    "constant": ([7] * 300, "int"),
    "sorted": (list(range(400)), "int"),
    "reversed": (list(range(400, 0, -1)), "long"),
    "negative": ([-1.5 * k for k in range(1, 200)], "double"),
    "nulls": ([None if k % 3 == 0 else float(k % 17) for k in range(130)], "float"),
    "bytes": ([k % 100 - 50 for k in range(999)], "tinyint"),
    "single": ([3], "int"),
    "all null": ([None] * 20, "int"),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_paths_agree(spark, name):
    values, kind = COLUMNS[name]
    c = of(spark, values, kind)
    known = sorted(v for v in values if v is not None) or [0]
    limits = [known[0] - 1, known[0], known[len(known) // 2], known[-1], known[-1] + 1]
    zones, words = zonemap.build_zonemap(c), None
    for most in (64, 256):
        if not any(v is not None for v in values):
            continue
        index = signature.build_signatures(c, 64, most)
        words = bitmap.wah_encode(c, index.bins)
        for low, high in zip(limits, limits[1:]):
            want = [k for k, v in enumerate(values) if v is not None and low < v <= high]
            r = Range(low, high)
            assert positions(scan.scan_positions(c, r)) == want
            assert positions(index.positions(r)) == positions(zones.positions(r)) == want
            assert index.count(r).first()[0] == zones.count(r).first()[0] == len(want)
            if most == 64:
                assert positions(bitmap.bitmap_positions(c, index.bins, words, r)) == want


def test_empty_column(spark):
    c = of(spark, [])
    assert scan.scan_count(c, Range(0, 1)).first()[0] == 0
    assert zonemap.build_zonemap(c).count(Range(0, 1)).first()[0] == 0
    assert statistics.properties(c).first()["n"] == 0


def test_not_a_number_and_null(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 2.0), (2, None), (3, float("inf"))], "k bigint, x double")
    c = column(df, "x", "k")
    assert positions(scan.scan_positions(c, Range(0.0, float("inf")))) == [1, 3]
    assert positions(signature.build_signatures(c).positions(Range(0.0, 5.0))) == [1]


def test_types(spark):
    df = spark.sql("select 0L pos, date'1970-01-03' d, timestamp_ntz'1970-01-01 00:00:01' t, cast(1.25 as decimal(5,2)) m, true b, cast(9 as decimal(20,0)) o")
    got = {n: column(df, n, "pos").rows.first()["v"] for n in "dtmbo"}
    assert got == {"d": 2, "t": 1_000_000, "m": 125, "b": 1, "o": 9}
    with pytest.raises(ValueError):
        types.resolve("varchar")
    with pytest.raises(ValueError):
        column(df.withColumn("s", F.lit("x")), "s", "pos")


def test_coded_strings(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(["b", "a", None, "b", "ä"])], "pos bigint, s string")
    c, codes = coded_column(df, "s", "pos")
    code = {r.text: r.code for r in codes.collect()}
    assert code == {"a": 0, "b": 1, "ä": 2} and c.type.width == 1
    assert positions(signature.build_signatures(c).positions(scan.point(code["b"]))) == [0, 3]


@pytest.mark.parametrize("values, is_sorted", [([1, 2, 2, 3], True), ([3, 2, 2], True), ([1, 3, 2], False), ([5], True), ([1, None, 2], True)])
@pytest.mark.parametrize("segment", [2, 1 << 20])
def test_sorted(spark, values, is_sorted, segment):
    assert statistics.properties(of(spark, values), segment).first()["sorted"] == is_sorted


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), unique=True, max_size=120), st.integers(1, 500))
def test_code_words_round_trip(found, end):
    found = np.array(sorted(p for p in found if p < end), np.int64)
    words = bitmap.encode_positions(found, 0, end)
    assert list(bitmap.decode_words(words, 0, end)) == found.tolist()
    assert all(w >> 31 or (w & bitmap.MOST_FILL) > 30 for w in words)


def test_code_words_by_stretches(spark):
    rng = random.Random(4)
    c = of(spark, [rng.choice([0, 0, 0, 1]) if k < 300 else 1 for k in range(700)])
    bins = bins_of(c)
    for stretch in (62, 31 * 100):
        decoded = bitmap.wah_positions(bitmap.wah_encode(c, bins, stretch)).collect()
        assert sorted((r.bin, r.pos) for r in decoded) == sorted((bins.find(r.v), r.pos) for r in c.rows.collect())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.sampled_from([2, 3, 1 << 24]))
def test_run_form_round_trip(spark, masks, most):
    blocks = spark.createDataFrame([(k, 1, 1, m + 1) for k, m in enumerate(masks)], "block_id bigint, n_rows bigint, n_values bigint, w0 bigint")
    c = of(spark, [0])
    form = runs.run_lengths(signature.Signatures(c, Bins(tuple(range(8)), c.type), 1, blocks), segment=16, most=most)
    assert [r.w0 for r in form.expand().orderBy("block_id").collect()] == [m + 1 for m in masks]
    assert form.entries.agg(F.sum("blocks")).first()[0] == len(masks)
    assert form.entries.agg(F.max("blocks")).first()[0] <= most


def test_append_equals_rebuild(spark):
    whole = of(spark, [k * 7 % 113 for k in range(101)])
    bins = bins_of(whole)
    index = signature.build_signatures(Column(whole.rows.where("pos < 37"), whole.type, "c"), bins=bins)
    grown = updates.append(index, whole.rows.where("pos >= 37"))
    again = signature.build_signatures(whole, bins=bins)
    assert grown.blocks.exceptAll(again.blocks).count() == again.blocks.exceptAll(grown.blocks).count() == 0
    assert 0 < updates.saturation(grown).first()[0] <= 1


def test_deltas(spark):
    c = of(spark, list(range(50)))
    index = signature.build_signatures(c)
    deleted = spark.createDataFrame([(11,), (12,)], "pos bigint")
    inserted = spark.createDataFrame([(50, 13), (51, 99)], "pos bigint, v int")
    found = updates.with_deltas(index.positions(Range(10, 20)), deleted, inserted, Range(10, 20))
    assert positions(found) == [13, 14, 15, 16, 17, 18, 19, 20, 50]


def test_conjunction_of_other_widths(spark):
    a, b = of(spark, [k % 40 for k in range(500)]), of(spark, [float(k) for k in range(500)], "double")
    terms = [(signature.build_signatures(a), Range(5, 9)), (signature.build_signatures(b), Range(100.0, 300.0))]
    assert positions(conjunction.conjunction_positions(terms)) == [k for k in range(500) if 5 < k % 40 <= 9 and 100 < k <= 300]


def test_access_paths(spark):
    index = signature.build_signatures(of(spark, list(range(5000)), "long"))
    for wanted, path in ((Range(10, 60), "ranges"), (Range(-1, 4999), "scan")):
        taken, rows = access.qualifying_rows(index, wanted)
        assert taken == path and rows.count() == len([k for k in range(5000) if wanted.low < k <= wanted.high])


def test_workloads(spark):
    c = of(spark, [float(k % 97) for k in range(400)], "double")
    bins = bins_of(c)
    found = workload.run_workload(c, workload.growing_ranges(bins, 96.0)[:3] + workload.ranges_by_data(c, 1) + workload.ranges_by_bin(bins, list(range(60)), 2), others=[(64, 64), (256, 256)])
    assert found.select("method").distinct().count() == 6 and found.where("query = 0 and n > 0").count() == 0


def test_words_and_text(spark):
    for bins in (64, 128, 256):
        marks = [0, 63, bins - 1]
        row = spark.createDataFrame([tuple(bits.words_of(sum({1 << m for m in marks}), bins))], ", ".join(f"{w} bigint" for w in bits.word_names(bins)))
        columns = [F.col(w) for w in bits.word_names(bins)]
        got = row.select(bits.as_text(columns, bins), bits.first_bit(columns), bits.last_bit(columns), bits.bins_set(columns, bins), bits.popcount(columns)).first()
        assert [k for k, x in enumerate(got[0]) if x == "x"] == sorted(set(marks)) == got[3]
        assert (got[1], got[2], got[4]) == (0, bins - 1, len(set(marks)))


def test_positions_over_files(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/t")
    assert sorted(positions(read_positions(spark, f"{tmp_path}/t"))) == list(range(100))


def test_scan_is_pushed_down(spark, sf_dir):
    c = column(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_size", "p_partkey")
    plan = scan.qualifying(c, Range(3, 9))._jdf.queryExecution().toString()
    assert "GreaterThan(p_size,3)" in plan and "LessThanOrEqual(p_size,9)" in plan and "p_name" not in plan.split("ReadSchema")[-1]


PUSHED = {
    "d double": ("cast(id as double) / 4", Range(1.5, 9.25), "1.5", "9.25"),
    "f float": ("cast(id / 4 as float)", Range(1.1, 9.25), "1.1", "9.25"),
    "t date": ("date_add(date'1970-01-01', cast(id as int))", Range(3, 40), "1970-01-04", "1970-02-10"),
    "s timestamp": ("timestamp_micros(id * 1000)", Range(3000, 40_000), "1970-01-01 00:00:00.003", "1970-01-01 00:00:00.04"),
    "n timestamp_ntz": ("cast(timestamp_micros(id * 1000) as timestamp_ntz)", Range(3000, 40_000), "1970-01-01T00:00:00.003", "1970-01-01T00:00:00.040"),
    "m decimal(7,2)": ("cast(id / 4 as decimal(7,2))", Range(110, 925), "1.10", "9.25"),
}


@pytest.mark.parametrize("name", PUSHED)
def test_every_type_is_pushed_down(spark, tmp_path, name):
    """Both limits reach the Parquet reader, and the rows are those that the checked comparison gives."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    sql, wanted, low, high = PUSHED[name]
    spark.range(100).selectExpr("id as pos", f"case when id % 7 = 0 then null else {sql} end as x", "'wide' as other").coalesce(1).write.parquet(f"{tmp_path}/t")
    c = column(spark.read.parquet(f"{tmp_path}/t"), "x", "pos")
    for df in (scan.qualifying(c, wanted), signature.build_signatures(c).rows(wanted)):
        plan = df._jdf.queryExecution().toString()
        pushed = [line for line in plan.split("\n") if "PushedFilters" in line and "x" in line]
        assert any("GreaterThan" in line.split("PushedFilters")[1] and "LessThanOrEqual" in line.split("PushedFilters")[1] for line in pushed), plan
        assert low in plan and high in plan
        assert "other" not in plan.split("ReadSchema")[-1]
        want = c.rows.where(wanted.holds(F.col("v")))
        assert sorted(r.pos for r in df.collect()) == sorted(r.pos for r in want.collect()) != []


def test_limits_that_no_literal_has(spark):
    df = spark.sql("select id as pos, date_add(date'1970-01-01', cast(id as int)) d, cast(id as float) f, cast(id as double) x, cast(id as decimal(7,2)) m from range(50)")
    for name in "dfxm":
        c = column(df, name, "pos")
        for wanted in (Range(-1e30, 1e30), Range(float("-inf"), float("inf")), Range(-1e300, 1e300)):
            assert scan.scan_count(c, wanted).first()[0] == 50
        assert scan.scan_count(c, Range(5.5, 20.5)).first()[0] == c.rows.where("v > 5.5 and v <= 20.5").count()


@pytest.mark.parametrize("per_task", [1, 3, 1000])
def test_running_sums(spark, per_task):
    from skipweave.functions.ordered import running

    rng = random.Random(5)
    keys = rng.sample(range(1000), 57)
    rows = [(k, rng.randrange(9)) for k in keys] + [(None, 4)]
    got = {r.k: r.before for r in running(spark.createDataFrame(rows, "k bigint, n int"), "k", "n", "before", per_task).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == {k: sum(n for _, n in order[:i]) for i, (k, _) in enumerate(order)}
    assert running(spark.createDataFrame([], "k string, n int"), "k", "n", "before", per_task).count() == 0


def test_counts_after_changes(spark):
    """Values that become others, null, or come in place of null."""
    values = [float(k) if k % 5 else None for k in range(64)]
    c = of(spark, values, "double")
    index = signature.build_signatures(c)
    changed = {20: 3.5, 21: None, 22: 60.5, 25: 7.5, 40: None, 63: 0.5}
    grown = updates.insert_bits(index, spark.createDataFrame(list(changed.items()), "pos bigint, v double"))
    now = [changed.get(k, v) for k, v in enumerate(values)]
    for low, high in ((-1.0, 100.0), (0.0, 10.0), (20.0, 22.0), (19.0, 41.0)):
        wanted = Range(low, high)
        want = [k for k, v in enumerate(now) if v is not None and low < v <= high]
        assert positions(grown.positions(wanted)) == want
        assert grown.count(wanted).first()[0] == len(want) == grown.counts([wanted]).first()[0]
        assert (grown.sum(wanted).first()[0] or 0) == sum(now[k] for k in want)


def test_conjunction_in_one_scan(spark, tmp_path):
    spark.range(3000).selectExpr("id as pos", "cast(id % 40 as int) as a", "cast(id as double) as b", "'x' as c").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    terms = {"a": (signature.build_signatures(column(df, "a", "pos")), Range(5, 9)), "b": (signature.build_signatures(column(df, "b", "pos")), Range(100.0, 300.0))}
    got = conjunction.qualifying_tuples(df, "pos", terms)
    assert sorted(tuple(r) for r in got.collect()) == [(k, k % 40, float(k)) for k in range(3000) if 5 < k % 40 <= 9 and 100 < k <= 300]
    scans = [line.split("PushedFilters")[1] for line in got._jdf.queryExecution().toString().split("\n") if "PushedFilters" in line and "GreaterThan" in line.split("PushedFilters")[1]]
    assert any("(a,5)" in line and "(b,100.0)" in line for line in scans)


@pytest.mark.parametrize("histogram", ["equidistinct", "equidepth"])
@pytest.mark.parametrize("ends", ["(]", "[)", "[]", "()"])
def test_any_histogram_and_ends(spark, histogram, ends):
    values = [float(k * k % 211) for k in range(600)]
    c = of(spark, values, "double")
    index = signature.build_signatures(c, bins=make_bins(c, 64, histogram))
    for low, high in ((9.0, 100.0), (100.0, 100.0), (-5.0, 1.0)):
        wanted = Range(low, high, ends)
        assert positions(index.positions(wanted)) == positions(zonemap.build_zonemap(c).positions(wanted)) == positions(scan.scan_positions(c, wanted))
        assert index.count(wanted).first()[0] == scan.scan_count(c, wanted).first()[0]
    with pytest.raises(ValueError):
        make_bins(c, 64, "other")


def test_bars(spark):
    df = spark.createDataFrame([(0, 10), (2, 5)], "bin int, n_vectors bigint")
    assert [r.bar for r in statistics.bars(df, 4, 2).orderBy("row").collect()] == ["H   ", "H H "]
