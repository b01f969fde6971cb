"""Token counts, encoding and decoding against the vocabularies' libraries."""

import base64
import hashlib
import random
import struct
import time
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skipweave.llm import bpe, bpe_codec, token_counts, word_tokens

PIECES = ["a", "B", "é", "É", "ß", " ", "  ", "\n", "'re", "'", "'ll", "1", "²", "İ", "ing", " the", "中", "😀", "\t", "!", "--", "aaaa", "<|endoftext|>", "<|endof", "ǅ", "Σ", "_", "\x1c", " ", "½", "ñ", "́", "''s"]
TEXTS = ["", " ", "\n", "   x", "x   ", "word", "The quick brown fox's tail.", "a" * 300, "don't 're 'REd", "<|endoftext|>", "x<|endoftext|>y", "日本語 テキスト", "zero​width", "tab\tand\r\nlines"]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def rank_library():
    rows = map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in rows}, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter()


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec()


def test_pattern_is_the_vocabularies():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_counts(counter, byte_library):
    for text in TEXTS + random_texts(4000):
        assert counter.count(text) == len(byte_library.encode(text, add_special_tokens=False).ids), text


def test_every_prefix(counter, byte_library):
    for text in TEXTS + random_texts(400, 1):
        want = [len(byte_library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == want, text
        for budget in (0, 1, 3):
            assert token_counts.longest_within(counter.prefixes(text), budget) == max(k for k, n in enumerate(want) if n <= budget)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=40))
def test_any_text(counter, codec, byte_library, rank_library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert counter.count(text) == len(byte_library.encode(text, add_special_tokens=False).ids)
    ids = struct.unpack(f"<{len(codec.encode(text)) // 4}i", codec.encode(text))
    assert list(ids) == rank_library.encode_ordinary(text)
    assert "".join(codec.decode_stream(ids, 2)) == text


def test_encode(codec, rank_library):
    rng = random.Random(3)
    letters = ["".join(rng.choice("aaabbinngtheer") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for text in TEXTS + random_texts(3000, 2) + letters:
        want = rank_library.encode_ordinary(text)
        assert codec.encode(text) == struct.pack(f"<{len(want)}i", *want), text


SPACED = ["", " ", "  ", "a", " a", "a ", "a  b", "a \nb", "a\n b", " \n", "\n ", "a\n\n  b c", "x \x1cy z", "x\x1c y", "é\u00a0 è", "é \u00a0è", "a \u2003b", "a \u3000", "a\t b", " 's it's", "a \u0085b", "a \x00b", None]


@pytest.mark.parametrize("cap, lanes, longest", [(400_000, 1 << 15, 64), (40, 7, 3)])
def test_side_by_side(rank_library, cap, lanes, longest):
    """encode_all gives the library's ids for each text, in any mix of texts and in slices of an array."""
    rng = random.Random(11)
    own = bpe_codec.Codec()
    own.transducer.cap, own.transducer.LANES, own.LONGEST = cap, lanes, longest
    texts = TEXTS + SPACED + random_texts(1500, 12) + [" ".join(rng.choice(PIECES + SPACED[:-1]) for _ in range(rng.randint(1, 9))) for _ in range(1500)] + ["x" * 5000 + " y", "é" * 70]
    want = [rank_library.encode_ordinary(t or "") for t in texts]
    for kind in (pa.string(), pa.large_string()):
        assert own.encode_all(pa.array(texts, kind)).to_pylist() == want
        for at in range(0, 120, 3):
            assert own.encode_all(pa.array(texts, kind)[at : at + 3]).to_pylist() == want[at : at + 3]
    assert own.encode_all(pa.array([], pa.string())).to_pylist() == []
    assert own.encode_all(pa.array([None, ""], pa.string())).to_pylist() == [[], []]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1é' \n\t\u00a0\u2003\x1c中."), max_size=12), max_size=6))
def test_side_by_side_any_texts(codec, rank_library, texts):
    assert codec.encode_all(pa.array(texts, pa.string())).to_pylist() == rank_library.encode_ordinary_batch(texts)


def test_tokens_that_merges_do_not_reach(codec):
    """A piece that is a token is that token, also where no merges lead to it."""
    own = bpe_codec.Codec()
    own.vocabulary.tokens[b" qzqzqz"], own.unreached = 60_000, {b" qzqzqz"}
    assert own.encode_all(pa.array(["a qzqzqz qzqzqzb"])).to_pylist() == [[own.vocabulary.tokens[b"a"], 60_000, *struct.unpack("<%di" % (len(codec.encode(" qzqzqzb")) // 4), codec.encode(" qzqzqzb"))]]


def test_new_words_go_side_by_side():
    """Words seen for the first time take less than half the CPU time that they take one by one, on the same automaton."""
    rng = random.Random(13)
    words = lambda: ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(6)) for _ in range(40_000)]
    texts = [[" ".join(w[k : k + 400]) for k in range(0, len(w), 400)] for w in (words(), words(), words())]
    own = bpe_codec.Codec()
    for t in texts:
        own.encode_all(pa.array(t))  # all arcs are known from here on
        for s in t:
            own.encode(s)
    own.pieces = bpe.Pieces(own._piece, b"".join)
    began = time.process_time()
    one_by_one = [own.encode(s) for s in texts[1]]
    between = time.process_time()
    together = own.encode_all(pa.array(texts[1]))
    assert time.process_time() - between < (between - began) / 2
    assert [struct.pack(f"<{len(ids)}i", *ids) for ids in together.to_pylist()] == one_by_one


def test_slices_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe_codec, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["aaaa", None, "bbbbbb", "c", "d" * 30, "", "e"]})
    assert [b.column("text").to_pylist() for b in bpe_codec._slices([batch])] == [["aaaa", None, "bbbbbb"], ["c"], ["d" * 30], ["", "e"]]
    assert [b.num_rows for b in bpe_codec._slices([batch], 2)] == [2, 2, 1, 2]


def test_decoding_arrays(codec):
    ids = np.frombuffer(codec.encode("Grüße, 日本語 😀" * 50), "<i4")
    assert "".join(codec.decode_stream(ids, 7)) == "".join(codec.decode_stream(ids.tolist(), 7)) == "Grüße, 日本語 😀" * 50
    for wrong in ([10**6], np.array([10**6])):
        with pytest.raises((KeyError, IndexError)):
            codec.decode_bytes(wrong)


def test_small_memory_gives_the_same(rank_library):
    small = bpe_codec.Codec()
    small.transducer.cap, small.pieces.chunk.cap, small.pieces.piece.cap = 50, 5, 5
    few = token_counts.TokenCounter()
    few.counts.cap = 20
    again = token_counts.TokenCounter()
    for text in random_texts(300, 5):
        want = rank_library.encode_ordinary(text)
        assert small.encode(text) == struct.pack(f"<{len(want)}i", *want)
        assert few.count(text) == again.count(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_streamed_utf8(data, step):
    stream = bpe_codec.Utf8Stream()
    got = "".join(stream.feed(data[k : k + step]) for k in range(0, len(data), step)) + stream.close()
    assert got == data.decode("utf-8", "replace")


@pytest.mark.parametrize("longest", [0, 3, 1024])
def test_long_pieces_by_prefix(monkeypatch, counter, byte_library, longest):
    """Pieces beyond LONGEST are counted without the trie, by the same recurrence."""
    monkeypatch.setattr(bpe.PrefixCounts, "LONGEST", longest)
    rng = random.Random(6)
    own = token_counts.TokenCounter()
    for text in TEXTS + random_texts(300, 8) + ["".join(rng.choice("aabbhtein") for _ in range(3000)), "x" * 2500, "é" * 2000]:
        assert own.count(text) == len(byte_library.encode(text, add_special_tokens=False).ids)


def test_long_texts_take_little_memory(codec, rank_library):
    import tracemalloc

    rng = random.Random(9)
    text = "".join(rng.choice("aabbhteinorsd") for _ in range(300_000))
    small = bpe_codec.Codec()
    small.transducer.cap = 20_000
    counter = token_counts.TokenCounter()
    tracemalloc.start()
    assert counter.count(text * 3) > 100_000
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
    want = rank_library.encode_ordinary(text)
    assert small.encode(text) == struct.pack(f"<{len(want)}i", *want)
    assert len(small.transducer.states) <= 20_002


def test_words():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = word_tokens.WordTokens()
    for text in TEXTS + random_texts(4000, 7):
        want = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert own.encode(text) == struct.pack(f"<{len(want)}I", *want), text


@pytest.mark.parametrize("part", [1, 20, 1 << 16])
def test_words_of_plain_texts(part):
    """They are split at once, in parts of bounded size, and only chunks of other texts are looked up on their own."""
    library, rng = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), random.Random(part)
    own = word_tokens.WordTokens()
    own.PART = part
    plain = [c for c in map(chr, range(33, 0x250)) if own.plain(c)]
    words = ["'s", "''s", "it's's", "'LL", "!'t", "a'reb", "x_1", "42", "Ⱥ", "\n", "", *("".join(rng.choices(plain, k=rng.randint(1, 6))) for _ in range(60))]
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randint(0, 40)))
        want = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert own.encode(text) == struct.pack(f"<{len(want)}I", *want), text
        assert all(len(p) <= part or " " not in p[1:] for p in own._parts(text)) and "".join(own._parts(text)) == text
    assert not own.chunk and own.piece
    text = "the cat's <|x|> \t d\u0301 ① end " * 9
    want = [*library.encode(text, add_special_tokens=False).ids, 2]
    assert own.encode(text) == struct.pack(f"<{len(want)}I", *want)


ROWS = [(1, "The cat's   hat.\n"), (2, None), (3, ""), (3, ""), (None, "null id"), (5, "wörd " * 3000), (6, unicodedata.normalize("NFD", "é ü"))]


def test_queries_rows(spark, byte_library, rank_library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as n_tokens", "1 as ids")
    got = token_counts.token_counts(docs, budget=3, with_prefixes=True).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    for i, text in ROWS:
        want = len(byte_library.encode(text or "", add_special_tokens=False).ids)
        assert (by_id[i].n_bytes, by_id[i].n_tokens) == (len((text or "").encode()), want)
        assert by_id[i].prefix_tokens[-1] == want and len(by_id[i].prefix_tokens) == len(text or "") + 1
    coded = {r.doc_id: r for r in bpe_codec.encode_texts(docs).collect()}
    for i, text in ROWS:
        assert coded[i].ids == rank_library.encode_ordinary(text or "") and coded[i].decoded == (text or "")
    empty = docs.where("false")
    assert token_counts.token_counts(empty).count() == bpe_codec.encode_texts(empty).count() == 0


def test_tasks_of_a_worker_share_the_codec(spark):
    """Tasks after the first find the codec, and what its automaton has learnt, in their worker."""

    def states(batches):
        from skipweave.llm import common

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"states": [len(c.transducer.states) if isinstance(c, bpe_codec.Codec) else 0 for c in common._kept.values()] or [0]})

    bpe_codec.encode_texts(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    assert max(r.states for r in spark.range(0, 64, 1, 8).mapInArrow(states, "states long").collect()) > 1


def test_query_counts(spark, sf_dir, byte_library):
    from skipweave.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op4_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        n = len(byte_library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_query_digests(spark, sf_dir, rank_library):
    from skipweave.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op9_bpe_codec"](spark, sf_dir).collect():
        ids = rank_library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
