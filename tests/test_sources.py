"""Raw files, saved indexes, logs and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skipweave import types
from skipweave.column import Column
from skipweave.functions.binning import bins_of
from skipweave.operators import scan, signature
from skipweave.operators.scan import Range
from skipweave.plans import analysis
from skipweave.sources import indexed, metrics_log, raw
from skipweave.streaming import append

KINDS = [("tinyint", np.int8), ("short", np.int16), ("int", np.int32), ("bigint", np.int64), ("real", np.float32), ("double", np.float64), ("oid", np.uint64)]


@pytest.mark.parametrize("name, kind", KINDS)
def test_raw_file(spark, tmp_path, name, kind):
    values = np.arange(100).astype(kind)
    (tmp_path / "c").write_bytes(values.tobytes())
    c = raw.read_raw(spark, str(tmp_path / "c"), name, 100)
    assert [(r.pos, r.v) for r in c.rows.orderBy("pos").collect()] == list(enumerate(values.tolist()))
    assert scan.scan_count(c, Range(10, 20)).first()[0] == 10
    files = raw.write_raw(c, str(tmp_path / "out")).collect()
    assert b"".join(open(r.path, "rb").read() for r in sorted((r for r in files if r.n_values), key=lambda r: r.first_pos)) == values.tobytes()


def test_raw_file_in_slices(spark, tmp_path):
    (tmp_path / "c").write_bytes(np.arange(1000, dtype=np.int32).tobytes())
    spark.dataSource.register(raw.RawColumnSource)
    df = spark.read.format(raw.FORMAT).options(path=str(tmp_path / "c"), type="int", valuespertask="300").load()
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("v")).first()[0] == 499500


@pytest.mark.parametrize("data, count", [(b"", None), (b"12345", None), (b"12345678", 3)])
def test_bad_raw_file(spark, tmp_path, data, count):
    (tmp_path / "c").write_bytes(data)
    with pytest.raises(Exception, match="missing or empty|whole number|holds 2"):
        raw.read_raw(spark, str(tmp_path / "c"), "int", count).rows.count()


def test_saved_index_prunes(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("pos"), F.col("id").alias("v"))
    index = signature.build_signatures(Column(rows, types.LONG, "c"), 4096)
    indexed.save(index, str(tmp_path))
    again = indexed.load(spark, str(tmp_path))
    assert again.bins == index.bins and again.count(Range(5, 900)).first()[0] == 895
    reader = indexed.SignatureReader(str(tmp_path))
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    list(reader.pushFilters([GreaterThan(("v",), 5), LessThanOrEqual(("v",), 900)]))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 5_000
    read = lambda *r: indexed.read_indexed(spark, str(tmp_path), Range(*r))
    assert read(5, 900).count() == 895
    assert read(77, 77, "[]").select("pos").collect()[0][0] == 77
    assert read(30_000, 40_000).count() == 0 and read(-1, 20_000).count() == 20_000


def test_reads_are_planned_by_tasks(spark, tmp_path, monkeypatch):
    """Only tasks with a candidate block are planned, from a row for each of them."""
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    monkeypatch.setattr(indexed, "ROWS_PER_TASK", 2048)
    rows = spark.range(20_000).select(F.col("id").alias("pos"), F.col("id").alias("v"))
    indexed.save(signature.build_signatures(Column(rows, types.LONG, "c"), 512), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/tasks").count() == 10
    reader = indexed.SignatureReader(str(tmp_path))
    list(reader.pushFilters([GreaterThan(("v",), 5000), LessThanOrEqual(("v",), 5900)]))
    shares = reader.partitions()
    assert [s.number for s in shares] == [2]
    found = [v for s in shares for b in reader.read(s) for v in b.column("v").to_pylist()]
    assert set(range(5001, 5901)) <= set(found) and len(found) < 2048


def test_file_systems():
    from skipweave.sources.files import file_system, known

    assert file_system("file:///tmp/x")[1] == "/tmp/x"
    assert [known(f"{scheme}://bucket/a/s3a://b") for scheme in ("s3a", "s3n", "s3", "hdfs")] == ["s3://bucket/a/s3a://b"] * 3 + ["hdfs://bucket/a/s3a://b"]


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from skipweave.sources.files import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_log_and_analysis(spark, tmp_path):
    (tmp_path / "log").write_text(
        "type blob not supported\ncreate label=a exp=simd bins=64 blocksize=64 time_creation_usec=2000 data_size_bytes=8000 type_size_bytes=8 vectors_size_bytes=16000 records=1000\n"
        "query label=a exp=simd query=0 bins=64 blocksize=64 result_size=5 selectivity=0.5 query_time=30 records=1000\nend of run\n"
        "query label=b exp=scan query=0 bins=64 blocksize=64 result_size=5 selectivity=0.5 query_time=60\nend of run\n"
    )
    lines = metrics_log.read_log(spark, str(tmp_path / "log"))
    create, query = metrics_log.parse(lines, metrics_log.CREATE, "create"), metrics_log.parse(lines, metrics_log.QUERY, "query")
    assert create.select("label", "bins", "time_creation_usec").collect() == [("a", 64, 2000)]
    assert [(r.run_no, r.label, r.query_time, r.records) for r in query.orderBy("run_no").collect()] == [(0, "a", 30, 1000), (1, "b", 60, None)]
    builds = analysis.derived(create.withColumn("block_size_bytes", F.col("blocksize")))
    joined = analysis.with_builds(query.select("label", "bins", "blocksize", "query_time"), builds.select("label", "bins", "blocksize", "vectors", "values_per_block"))
    assert [(r.label, r.vectors, r.values_per_block) for r in joined.orderBy("label").collect()] == [("a", 2000, 8), ("b", None, None)]
    assert analysis.per_1000_vectors(joined).first()["time_per_1000"] == 15.0
    row = analysis.mean_and_error(query, ["bins"], "query_time").first()
    assert (row.n, row["mean"], round(row.se, 6)) == (2, 45.0, 15.0)
    back = metrics_log.lines_of(create.select("label", "bins"), "create", "r")
    assert back.first()["line"] == "create label=a bins=64"
    assert metrics_log.numbers(lines).where("number = 2000").count() == 1


def test_stream_of_appends(spark, tmp_path):
    c = Column(spark.range(500).select(F.col("id").alias("pos"), (F.col("id") * 31 % 173).alias("v")), types.LONG, "c")
    bins = bins_of(c)
    for part in range(3):
        c.rows.where(f"pos % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("pos bigint, v bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = append.append_stream(stream, bins, 8, f"{tmp_path}/blocks", f"{tmp_path}/ck", once=True)
    q.awaitTermination(60)
    got, want = append.read_blocks(spark, f"{tmp_path}/blocks", bins), signature.block_signatures(c.rows, bins, 8)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
