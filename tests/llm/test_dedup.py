"""Near duplicates, fingerprints and archives against brute force."""

import base64
import hashlib
import io
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow.fs import FileSelector

from skipweave.llm import components, fingerprints, near_dedup, warc
from skipweave.llm.common import file_system, fresh_dir, shared_dir
from skipweave.llm.queries import QUERIES

# near duplicates


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def slow_shingles(text):
    words = words_of(text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)
    seen = Counter()
    out = []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def slow_common(a, b):
    """Longest common subsequence by the quadratic table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def slow_similar(a, b):
    """Of two sequences."""
    m = slow_common(a, b)
    return m > 0 and m >= 0.8 * (len(a) + len(b) - m) - 1e-9


def sketches_of(text):
    codes = near_dedup.word_codes(near_dedup.words_of(text or ""))
    return set(enumerate(near_dedup.sketches(near_dedup.labelled_shingles(codes)).tolist())) if len(codes) else set()


def classes_of(texts, linked):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def slow_classes(texts):
    """Of all pairs that share a sketch, by the quadratic alignment of their words."""
    words, found = [words_of(t) for t in texts], [sketches_of(t) for t in texts]
    return classes_of(texts, lambda i, j: words[i] == words[j] or (bool(found[i] & found[j]) and slow_similar(words[i], words[j])))


def least_classes(texts):
    """Of all pairs whose shingles are similar, whatever their sketches."""
    words, shingles = [words_of(t) for t in texts], [slow_shingles(t) for t in texts]
    return classes_of(texts, lambda i, j: words[i] == words[j] or slow_similar(shingles[i], shingles[j]))


def varied(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        k = rng.randrange(len(words) or 1)
        words[k : k + rng.choice([0, 1, 1])] = [f"new{rng.randrange(99)}"] * rng.choice([0, 1, 1])
    return " ".join(words)


@pytest.mark.parametrize("narrow, widest", [(32, 1 << 13), (1, 1 << 13), (2, 2)])
def test_alignment_by_brute_force(monkeypatch, narrow, widest):
    monkeypatch.setattr(near_dedup, "NARROW", narrow)
    monkeypatch.setattr(near_dedup, "WIDEST", widest)
    rng, linked = random.Random(1), 0
    for _ in range(600):
        base = [rng.randrange(rng.choice([3, 20, 1000])) for _ in range(rng.randint(1, 90))]
        other = list(base)
        for _ in range(rng.randint(0, 1 + len(base) // 6)):
            k = rng.randrange(len(other) or 1)
            other[k : k + rng.choice([0, 1, 1, 3])] = [rng.randrange(50)] * rng.choice([0, 1, 1, 2])
        if rng.random() < 0.3:
            k = rng.randrange(len(other) + 1)
            other = other[k:] + other[:k]
        got = near_dedup.similar(np.array(base, np.uint64), np.array(other, np.uint64))
        assert got == slow_similar(base, other), (base, other)
        linked += got
    assert 150 < linked < 500


def test_copies_with_moved_ends_of_long_texts():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 5000, 40_000, dtype=np.uint64)
    assert near_dedup.similar(text, np.r_[rng.integers(0, 5000, 3000, dtype=np.uint64), text[:37_000]])
    assert not near_dedup.similar(text, rng.permutation(text))


def test_shingles_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        got = near_dedup.labelled_shingles(near_dedup.word_codes(near_dedup.words_of(text)))
        assert len(got) == len(slow_shingles(text)) == len(set(got.tolist()))
    own = lambda s: near_dedup.labelled_shingles(near_dedup.word_codes(near_dedup.words_of(s)))
    once, twice = own("a b c d e"), own("a b c d e a b c d e")
    assert once[0] == twice[0] and len(set(twice.tolist())) == 6


@pytest.mark.parametrize("n", [1, 2, 3, 50, 20_000])
def test_sketches_by_brute_force(n):
    """Each is made of the two smallest numbers under its hash, in text order."""
    shingles = near_dedup.mix(np.arange(n, dtype=np.uint64) + np.uint64(17))
    found = near_dedup.sketches(shingles).tolist()
    for band in range(near_dedup.BANDS):
        seed, factor = int(near_dedup._SEEDS[band, 0]), int(near_dedup._FACTORS[band, 0])
        order = sorted(range(n), key=lambda k: (int(shingles[k]) ^ seed) * factor % 2**64)
        pair = shingles[sorted(order[:2])]
        assert near_dedup.sketches(pair)[band] == found[band]
        if n > 1:
            assert near_dedup.sketches(pair[::-1].copy())[band] != found[band]


def test_estimates():
    rng = np.random.default_rng(0)
    for n in (3, 20, 100, 500, 5000):
        for _ in range(50):
            both = rng.integers(0, 2**64, n * 9, dtype=np.uint64)
            a, b = both[: n * 8], np.r_[both[: n * 7 + n // 9], both[n * 8 :]]
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            for slots, off in ((near_dedup.PROFILE, 0.8 - near_dedup.LEAST_ESTIMATE), (near_dedup.WIDE, 0.8 - near_dedup.LEAST_WIDE)):
                profiles = [near_dedup.profile(near_dedup.labelled_words(x), slots)[None] for x in (a, b)]
                assert abs(near_dedup.estimates(*profiles)[0] - true) < off
    assert not near_dedup.profile(np.zeros(0, np.uint64)).any()


def test_long_texts_take_little_memory():
    import tracemalloc

    for text in ("x" * 20_000_000, "ab cd " * 500_000):
        tracemalloc.start()
        codes = near_dedup.word_codes(near_dedup.words_of(text))
        near_dedup.sketches(near_dedup.labelled_shingles(codes))
        near_dedup.profile(near_dedup.labelled_words(codes))
        assert tracemalloc.get_traced_memory()[1] < 200e6
        tracemalloc.stop()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = []
    for n in (6, 12, 40, 150):
        for _ in range(5):
            base = [f"w{rng.randrange(4000)}" for _ in range(n)]
            texts += [" ".join(base)] + [varied(rng, base, e) for e in (1, 1, 2, 3)] + ["  ".join(base)] * 2
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randrange(9000)}" for _ in range(30)) for _ in range(25)]
    texts += [None, "", "  ", "one", "one", "two words", "a b c d", "a a a a a a a a a a a", "a a a a a a a a a a"]
    rng.shuffle(texts)
    return texts


def test_classes_by_brute_force(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").selectExpr("*", "1 as key", "2 as class_id")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[k].class_id for k in range(len(corpus))] == slow_classes(corpus)
    for k, text in enumerate(corpus):
        assert (corpus[got[k].copy_of] or "").split() == (text or "").split()
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_classes(corpus)))


def test_all_similar_shingles_are_linked(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    for k, least in enumerate(least_classes(corpus)):
        assert got[k] == got[least]


def family(n, edits, seed=9, words=100):
    """Variants of one original."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        text = [f"w{k}" for k in range(words)]
        for k in rng.sample(range(words), rng.randint(*edits)):
            text[k] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    return texts


def test_large_group_of_near_copies(spark):
    texts = family(2000, (2, 4)) + family(30, (40, 60), 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.class_id for r in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()]
    assert set(got[:2000]) == {0} and len(set(got[2000:])) == 30


def test_short_texts(spark):
    """Pairs of four and five shingles in common are as similar as the limit; nearly all must meet."""
    rng = random.Random(6)
    texts = []
    for _ in range(1000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.class_id for r in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()]
    assert got == [k - k % 2 for k in range(2000)]


def test_hidden_pairs_of_a_large_family(spark):
    """Few pairs are similar, but nearly all share buckets: leaders alone would miss some."""
    texts = family(700, (7, 9))
    codes = [near_dedup.word_codes(near_dedup.words_of(t)) for t in texts]
    found = [sketches_of(t) for t in texts]
    want = classes_of(texts, lambda i, j: bool(found[i] & found[j]) and near_dedup.similar(codes[i], codes[j]))
    assert 20 < len(set(want)) < 680
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.class_id for r in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()] == want


def test_one_of_rows_with_equal_ids_stays(spark):
    rows = [(1, "b b b b b b", 1), (1, "a a a a a a", 2), (1, "a a a a a a", 3), (2, "b b b b b b", 4)]
    for turn in (rows, rows[::-1]):
        docs = spark.createDataFrame(turn, "doc_id long, text string, extra int")
        kept = near_dedup.without_near_duplicates(docs).collect()
        assert [(r.doc_id, r.text) for r in kept] == [(1, "a a a a a a")]


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "alone"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2), (3, 2)], key=str)
    assert sorted((r.doc_id for r in near_dedup.without_near_duplicates(docs).collect()), key=str) == [1, 2, None, None]
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_query_finds_all_links(spark, sf_dir):
    """All pairs that share a sketch, or most of their shingles, by the quadratic alignment."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.class_id for r in QUERIES["op8_near_dedup"](spark, sf_dir).collect()}
    words, found = [words_of(d.text) for d in docs], [sketches_of(d.text) for d in docs]
    grams = [Counter(g for g, _ in slow_shingles(d.text)) for d in docs]
    alike = lambda i, j: sum((grams[i] & grams[j]).values()) * 1.8 >= 0.8 * (grams[i].total() + grams[j].total())
    near = lambda i, j: bool(found[i] & found[j]) or alike(i, j)
    root = classes_of(docs, lambda i, j: words[i] == words[j] or (near(i, j) and max(len(words[i]), len(words[j])) < 3000 and slow_similar(words[i], words[j])))
    assert got == {d.doc_id: docs[r].doc_id for d, r in zip(docs, root)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components(spark, edges):
    shared_dir(spark)
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r.node, r.root) for r in components.connected_components(df).collect()} == set(root.items())


def test_long_chain(spark):
    shared_dir(spark)
    df = spark.range(300).selectExpr("id * 7 % 300 as a", "(id + 1) * 7 % 300 as b")
    assert {r.root for r in components.connected_components(df).collect()} == {0}


# fingerprints


def slow_canonical(text):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", nfkc(nfkc(text).casefold())).strip(" ")


ODD = ["Straße", "STRASSE", "straße  ", "ﬁne", "fine", "Ａ b", "a B", "é", "é", "", None, " \t\n", "x y", "x y", "İ", "ΣΑΣ", "σας", "a" * 5000, "😀x", "😀x", "same", "same"]


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_fingerprints(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = [(k * 3 - 5, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").selectExpr("*", "1 as hash", "2 as next_text", "3 as at")
    got = fingerprints.fingerprints(docs).orderBy("doc_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    texts = [t or "" for _, t in rows]
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    name, members = {}, {}
    for k, (r, t) in enumerate(zip(got, texts)):
        after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited == 1) == (slow_canonical(t) == slow_canonical(edited))
        assert (r.near_next == 1) == (slow_canonical(t) == slow_canonical(after))
        assert len(r.fingerprint) == 64 and name.setdefault(slow_canonical(t), r.fingerprint) == r.fingerprint
        members.setdefault(r.fingerprint, []).append(r)
    assert len(set(name.values())) == len(name)
    for group in members.values():
        assert all(r.group_id == group[0].doc_id and r.group_size == len(group) for r in group)
    assert not any("Python" in x or "Arrow" in x for x in fingerprints.fingerprints(docs)._jdf.queryExecution().toString().split("\n"))


def test_equal_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "wide_hash", lambda text: F.array(*(F.lit(7).cast("bigint") for _ in range(4))))
    docs = spark.createDataFrame([(1, "b"), (2, "a"), (3, "B"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert got[1].fingerprint == got[3].fingerprint and len({r.fingerprint for r in got.values()}) == 3
    assert [got[k].group_id for k in (1, 2, 3, 4)] == [1, 2, 1, 4]


def test_fingerprints_of_few_rows(spark):
    one = spark.createDataFrame([(9, "abc")], "doc_id long, text string")
    assert fingerprints.fingerprints(one).first().near_next == 1.0
    assert fingerprints.fingerprints(one.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "ab"), (1, "cd"), (None, "xy")], "doc_id long, text string")
    edited = [hashlib.sha256(s).hexdigest() for s in (b"xa", b"ac", b"cx")]
    assert [r.edited_sha256 for r in fingerprints.fingerprints(twice).collect() if r.edited_sha256 in edited] and fingerprints.fingerprints(twice).count() == 3


# archives

PAGES = [(3, "http://a", "<p>x</p>"), (1, "http://b\r\nX: y", "<p>x</p>"), (2, None, None), (4, "http://c", ""), (5, "http://d", "é" * 3_000_00), (6, "http://e", "WARC/1.1\r\n\r\n"), (7, "http://f", "WARC/1.1\r\n\r\n"), (None, "http://g", "<p>x</p>"), (8, "http://h", "lone")]


def slow_records(pages, least=0):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        again = len(data) >= least and (html or "") in first and first[html or ""] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as sha1", "2 as payload")
    files = warc.write_archives(pages, fresh_dir(spark, "warc"), least)
    chunks = warc.read_archives(files, files.count(), 100_000)
    assert sorted((tuple(r) for r in warc.records(chunks).collect()), key=str) == slow_records(PAGES, least)
    big = chunks.where("page_id = 5").orderBy("chunk_no").collect()
    assert len(big) == 6 and all(len(r.chunk) == 100_000 for r in big)
    so_far = b""
    for r in big:
        so_far += r.chunk
        assert r.digest_so_far == base64.b32encode(hashlib.sha1(so_far).digest()).decode() and r.bytes_so_far == len(so_far)
    empty = warc.write_archives(pages.where("false"), fresh_dir(spark, "warc"))
    assert empty.count() == 0 and warc.read_archives(empty, 0).count() == 0


def test_folder_holds_archives_alone(spark):
    """Spark writes no table of its own beside them, so executors start no process for its files' permissions."""
    folder = fresh_dir(spark, "warc")
    files = warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3), folder).collect()
    where, base = file_system(folder)
    found = [f.path.rpartition("/")[2] for f in where.get_file_info(FileSelector(base, recursive=True))]
    assert sorted(found) == sorted(f.path.rpartition("/")[2] for f in files) and sum(f.n_records for f in files) == len(PAGES)


def test_query_records(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op6_warc"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_records(pages)


def other(kind, block, *fields):
    head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", f"Content-Length: {len(block)}", *fields]) + "\r\n\r\n"
    return gzip_of(head.encode() + block + b"\r\n\r\n")


def test_records_of_others():
    """Other kinds pass as they are; a response may lack digests and the length of its payload."""
    http = "Content-Type: application/http;msgtype=response"
    parts = [
        other("warcinfo", b"software: x\r\nformat: y\r\n", "Content-Type: application/warc-fields"), other("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http;msgtype=request"),
        other("response", b"HTTP/1.1 200 OK\r\n\r\nbody", http), other("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n", http, "WARC-Payload-Digest: sha1:OTHER"),
        other("metadata", b""), other("revisit", b"", http),
    ]
    rows = list(warc.chunks_of(warc.Source(io.BytesIO(b"".join(parts)))))
    assert [(r["record_type"], r["chunk"]) for r in rows] == [("warcinfo", b"software: x\r\nformat: y\r\n"), ("request", b"GET / HTTP/1.1\r\n\r\n"), ("response", b"body"), ("response", b"4\r\nbody\r\n0\r\n"), ("metadata", b""), ("revisit", b"")]
    assert rows[2]["digest_so_far"] == base64.b32encode(hashlib.sha1(b"body").digest()).decode() and rows[2]["bytes_so_far"] == 4
    assert rows[5]["digest_so_far"] is None and rows[5]["bytes_so_far"] is None
    with pytest.raises(ValueError, match="length"):
        list(warc.chunks_of(warc.Source(io.BytesIO(gzip_of(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\n\r\nx\r\n\r\n")))))


def record(page_id, data):
    gzip = zlib.compressobj(wbits=31)
    return gzip.compress(warc.record_head(page_id, "u", len(data), hashlib.sha1(data).digest(), None) + data + b"\r\n\r\n") + gzip.flush()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=5), st.integers(1, 90), st.integers(1, 64))
def test_chunks_round_trip(payloads, chunk, read):
    before, warc.READ = warc.READ, read
    try:
        rows = list(warc.chunks_of(warc.Source(io.BytesIO(b"".join(record(k, p) for k, p in enumerate(payloads)))), chunk))
    finally:
        warc.READ = before
    for k, p in enumerate(payloads):
        assert b"".join(r["chunk"] for r in rows if r["page_id"] == k) == p
    assert all(len(r["chunk"]) <= chunk for r in rows)


def test_damaged_archives():
    whole = record(1, b"payload" * 50)
    for data in (whole[:-30], gzip_of(b"no warc\r\n\r\nx\r\n\r\n"), record(1, b"abc")[:20]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.chunks_of(warc.Source(io.BytesIO(data))))


def gzip_of(data):
    gzip = zlib.compressobj(wbits=31)
    return gzip.compress(data) + gzip.flush()
