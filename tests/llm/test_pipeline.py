"""The pipeline's stages, each against its operator by brute force, and run() as their sequence."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from skipweave.llm import near_dedup, quality_rules, toxicity, word_tokens  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_toxic_documents_go(spark, steps):
    model = toxicity.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    memo = model.memo()
    want = {r.doc_id for r in steps[0].collect() if model.scores([r.text or ""], memo)[0] < 0.5}
    assert {r.doc_id for r in steps[1].collect()} == want and steps[1].columns == steps[0].columns


def test_low_quality_goes(spark, steps):
    trees = quality_rules.fit(steps[1], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality_rules.quality_rules(steps[1], trees).where("kept").collect()}
    assert {r.doc_id for r in steps[2].collect()} == want and steps[2].columns == steps[0].columns


def test_one_of_each_class_stays(steps):
    want = {r.class_id for r in near_dedup.near_duplicates(steps[2]).collect()}
    got = [r.doc_id for r in steps[3].collect()]
    assert set(got) == want and len(got) == len(want) and steps[3].columns == steps[0].columns


def test_one_of_a_large_family_stays(spark):
    from test_dedup import family

    texts = family(1000, (2, 4)) + family(20, (40, 60), 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(1000, 1020)]


def test_all_kept_tokens_are_packed(steps):
    own = word_tokens.word_tokens(word_tokens.VOCABULARY)
    want = {r.doc_id: len(own.encode(r.text or "")) // 4 for r in steps[3].collect()}
    assert {r.doc_id: r.n for r in steps[4].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want


def test_run_is_its_stages(spark, steps):
    whole = lambda df: {tuple(r) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length"), F.min("start")).collect()}
    assert whole(corpus_pipeline.run(spark, SF)) == whole(steps[4])


def test_stages_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 100), (3, "word " * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "1 as score", "true as kept", "'k' as key", "1L as id")
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            if name == "packing":
                assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in table.select("doc_id").collect()}
            else:
                assert out.columns == table.columns and out.count() <= table.count()


def test_stages_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "x" * 20_000_000), (2, "plain words here " * 300_000), (3, "a few words")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).where("doc_id is not null").count() >= (3 if name in ("packing", "near_dedup") else 0)
