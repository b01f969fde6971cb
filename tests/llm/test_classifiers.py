"""Toxicity, quality rules and the quality classifier: brute force, held-out accuracy, edge cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skipweave.llm import boosting, quality_classifier, quality_rules, toxicity
from skipweave.llm.calibration import Logistic
from skipweave.llm.common import held_out, labelled, shared_dir, table
from skipweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def slow_segments(scores, drift):
    """All maximal scoring segments by the textbook's recursion: the best segment, then both sides of it."""
    values = [s if s > 0 else -drift for s in scores]

    def best(lo, hi):
        top = None
        for b in range(lo, hi):
            total = 0.0
            for e in range(b, hi):
                total += values[e]
                if total > 1e-12 and (top is None or total > top[2] + 1e-9):
                    top = (b, e + 1, total)
        return top

    out, todo = [], [(0, len(values))]
    while todo:
        lo, hi = todo.pop()
        if lo < hi and (top := best(lo, hi)):
            out.append(top)
            todo += [(lo, top[0]), (top[1], hi)]
    return sorted(out)


def test_segments_are_all_maximal():
    rng = random.Random(1)
    for _ in range(400):
        scores = np.array([rng.choice([0, 0, 0, 1.37, 0.71, 3.13]) for _ in range(rng.randint(0, 24))])
        got = toxicity.segments(scores, 0.43)
        want = slow_segments(scores, 0.43)
        assert [(b, e) for b, e, _ in got] == [(b, e) for b, e, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_extreme_value_law():
    rng = np.random.default_rng(0)
    scores = 2 + rng.exponential(0.5, 5000)
    rate, log_k = toxicity.extreme_value_law(5000, float(scores.sum()), float(scores.min()), 1_000_000)
    assert rate == pytest.approx(2, rel=0.1) and np.exp(log_k) * 1_000_000 * np.exp(-rate * 2) == pytest.approx(5000, rel=0.05)
    assert all(map(np.isfinite, toxicity.extreme_value_law(0, 0.0, 1.0, 0)))


def test_logistic_without_one_class():
    assert Logistic(np.zeros((0, 3)), np.zeros(0))(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert (Logistic(np.ones((4, 1)), np.ones(4))(np.ones((1, 1))) > 0.5).all()


def auc(y, p):
    order = np.argsort(np.argsort(p))
    y = np.array(y, bool)
    return (order[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.85), ("op5_quality_classifier", "quality", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    rows = QUERIES[name](spark, SF)
    assert rows.count() == rows.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    known = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in known)
    assert auc([r[label] for r in known], [r.score for r in known]) > least
    limit = 0.5 if label == "toxic" else 0.3
    assert all(r.predicted == int(r.score >= limit) for r in known)


def test_toxicity_fit_by_brute_force(spark):
    """Log-odds, law and features of a model against counts over the same rows by plain Python."""
    from pyspark.sql import types as T

    shared_dir(spark)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    seen = {}
    for r in docs.join(labels.where(~held_out(F.col("doc_id"))), "doc_id").select("text", "toxic").collect():
        seen[r.text or ""] = max(r.toxic, seen.get(r.text or "", 0))
    folds = {r.text: r.fold for r in spark.createDataFrame([(t,) for t in seen], T.StructType([T.StructField("text", T.StringType())])).select("text", F.pmod(F.xxhash64("text"), F.lit(3)).alias("fold")).collect()}
    docs_with = {0: Counter(), 1: Counter()}
    n = {0: 1.0, 1: 1.0}
    for t, y in seen.items():
        if folds[t] < 2:
            n[y] += 1
            docs_with[y].update({k for w in quality_words(t) if toxicity.normal(w) for k in toxicity.keys(toxicity.normal(w))})
    whole, want = n[0] + n[1], {}
    for k in docs_with[0].keys() | docs_with[1].keys():
        both = docs_with[0][k] + docs_with[1][k]
        a, b = (docs_with[y][k] + toxicity.PRIOR * both * n[y] / whole for y in (1, 0))
        odds = np.log(a / (n[1] * (1 + toxicity.PRIOR))) - np.log(b / (n[0] * (1 + toxicity.PRIOR)))
        if odds >= toxicity.LEAST_ODDS and odds / np.sqrt(1 / a + 1 / b) >= toxicity.LEAST_Z:
            want[k] = odds
    assert set(model.odds) == set(want) and all(model.odds[k] == pytest.approx(v) for k, v in want.items())
    memo, total, words = model.memo(), [], 0
    for t, y in seen.items():
        if folds[t] == 2 and not y:
            own, scores = toxicity.token_scores(t, memo)
            words += len(own)
            total += [s for *_, s in slow_segments(list(scores), toxicity.DRIFT)] if len(own) < 40 else [s for *_, s in toxicity.segments(scores, toxicity.DRIFT)]
    assert (model.rate, model.log_k) == pytest.approx(toxicity.extreme_value_law(len(total), sum(total), min(total, default=1.0), words))


def quality_words(text):
    return set(toxicity._words(text))


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_toxic_words_are_learnt_whatever_their_share(spark, share):
    shared_dir(spark)
    toxic = lambda k: k % 10 < share * 10
    docs = spark.createDataFrame([(k, f"plain words number{k} of no note at all " + ("you rotten gnat " if toxic(k) else "") + "and more plain words") for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(toxic(k))) for k in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {"rotten", "gnat"} <= set(model.odds)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert all((got[k] >= 0.5) == toxic(k) for k in range(600))


def test_compression_by_brute_force(spark):
    """Sizes against one-shot compression of the blocks, and the score against the difference alone."""
    import zstandard

    shared_dir(spark)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality_classifier.fit(docs, labels)
    slim = zstandard.ZstdCompressionParameters.from_level(quality_classifier.LEVEL, write_content_size=0, write_dict_id=0)
    size = lambda data, d: sum(len(zstandard.ZstdCompressor(compression_params=slim, **({"dict_data": zstandard.ZstdCompressionDict(d)} if d else {})).compress(data[k : k + 2048])) for k in range(0, len(data), 2048))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.limit(60).collect()}
    rows = [r for r in quality_classifier.quality(docs, model).collect() if r.doc_id in texts]
    for r in rows:
        data = texts[r.doc_id]
        want = (size(data, model.bad) - size(data, model.good)) / size(data, b"") if data else 0.0
        assert r.difference == pytest.approx(want)


def test_held_out_rows_are_never_learnt(spark):
    labels = table(spark, SF, "labels")
    assert labelled(labels, "toxic", 10**6).where(held_out(F.col("doc_id"))).count() == 0
    assert labelled(labels, "toxic", 50).count() == 50


def test_passages(spark):
    shared_dir(spark)
    docs = spark.createDataFrame([(k, f"plain words number {k} of no note at all " + ("you rotten gnat " if k % 4 == 0 else "") + "and more plain words") for k in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, "some plain words you rotten gnat indeed"), (2, None), (3, ""), (3, ""), (None, "plain words"), (4, "plain words " * 5000)], "doc_id long, text string").selectExpr("*", "1 as score", "'x' as passages")
    got = {r.doc_id: r for r in toxicity.toxicity(odd, model, with_passages=True).collect()}
    assert len(got) == 5 and got[1].score > 0.5 > max(got[k].score for k in (2, 3, 4, None))
    assert got[1].passages[0].text == "you rotten gnat" and not got[4].passages
    assert toxicity.toxicity(odd.where("false"), model).count() == 0
    assert {r[0] for r in odd.where(~toxicity.is_toxic(odd["text"], model)).select("doc_id").collect()} == {2, 3, 4, None}
    blank = toxicity.fit(docs.where("false"), labels.where("false"))
    assert toxicity.toxicity(odd, blank).count() == 6


def slow_counts(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    again = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again))


def test_statistics_by_brute_force(spark):
    rng = random.Random(2)
    texts = ["", " \n ", "a b c a b c", "x\nx\n x\nx ", "é ü ß z #*$%&|<>"] + ["".join(rng.choice("ab \n\t#é \x0b") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    for text in texts:
        assert quality_rules.statistics(text)[0] == slow_counts(text), repr(text)


def test_boosting():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] + 0.6 * np.sin(3 * x[:, 1]) + 0.2 * rng.normal(size=1500)) > 0
    trees = boosting.train(x, y, (1, 0, -1))
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.93
    grid = np.repeat(rng.normal(size=(50, 3)), 40, axis=0)
    for f, sign in ((0, 1), (2, -1)):
        moved = grid.copy()
        moved[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(trees.margin(moved).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-9).all()
    one = x[7]
    total = trees.base
    for root in trees.roots:  # node by node
        node = root
        while trees.left[node] != node:
            node = trees.left[node] if one[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        total += trees.value[node]
    assert trees.margin(x[7:8])[0] == pytest.approx(total)
    assert boosting.train(x[:0], y[:0], (1, 0, -1)).probability(x[:2]).tolist() == [0.5, 0.5]


def test_quality_rules(spark):
    rows = QUERIES["op3_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    passed = [r for r in rows if not r.base_failed]
    assert np.mean([r.kept == r.quality for r in passed]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "word " * 60), (3, "a b c " * 20000)], "doc_id long, text string").selectExpr("*", "1 as kept")
    trees = quality_rules.fit(odd.where("false"), spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_rules.quality_rules(odd, trees).collect()
    assert len(got) == 5 and all(r.base_failed for r in got)
    assert quality_rules.quality_rules(odd.where("false"), trees).count() == 0
    assert odd.where(quality_rules.is_kept(odd["text"], trees)).count() == 0


def test_classifier_edges(spark):
    shared_dir(spark)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "word"), (3, "a b c " * 20000)], "doc_id long, text string").selectExpr("*", "1 as score")
    model = quality_classifier.fit(odd.where("false"), spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_classifier.quality(odd, model).collect()
    assert len(got) == 5 and all(r.score == 0.5 for r in got)
    assert quality_classifier.quality(odd.where("false"), model).count() == 0
    assert quality_classifier.blocks(b"x" * 5000) == [b"x" * 2048, b"x" * 2048, b"x" * 904]
