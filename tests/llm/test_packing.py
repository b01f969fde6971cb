"""Packed sequences: every id once, no gaps, little padding."""

import random
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle

from skipweave.llm import packing, token_output, word_tokens
from skipweave.llm.packing import Piece, SumOfSquares

ROWS = [(k, "word " * (k * 7 % 90)) for k in range(60)] + [(7, "again"), (7, "again"), (None, "no id"), (100, None), (101, "x y " * 9000)]


def docs_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1L as sequence_id", "2 as ids")


def check(pieces, rows, capacity):
    """pieces: (doc_id, start, ids, doc_tokens, sequence_id, offset)."""
    own = word_tokens.word_tokens(word_tokens.VOCABULARY)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p[4], []).append(p)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p[5]):
            assert p[5] == at
            at += len(p[2]) // 4
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    texts = sorted(own.encode(t or "") for _, t in rows)
    left = sorted(pieces, key=lambda p: (str(p[0]), p[3], p[1]))
    assert sum(len(p[2]) for p in left) == sum(map(len, texts))
    whole = {}
    for p in left:
        whole.setdefault((p[0], p[3]), []).append(p)
    want = {}
    for i, t in rows:
        e = own.encode(t or "")
        want.setdefault((i, len(e) // 4), []).append(e)
    assert set(whole) == set(want)
    for k, copies in want.items():
        if len(copies) == 1:
            assert b"".join(p[2] for p in sorted(whole[k], key=lambda p: p[1])) == copies[0]
            at = 0
            for p in sorted(whole[k], key=lambda p: p[1]):
                assert p[1] == at
                at += len(p[2]) // 4
    return padding


@pytest.mark.parametrize("parts", [1, 3])
def test_pack(spark, parts):
    got = packing.pack(docs_of(spark).repartition(parts)).collect()
    assert check([(r.doc_id, r.start, bytes(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in got], ROWS, 4096) == 0
    assert packing.pack(docs_of(spark).where("false")).count() == 0


def test_checksums(spark):
    packed = packing.pack(docs_of(spark))
    ids = {(r.sequence_id, r.offset): bytes(r.ids) for r in packed.collect()}
    for r in packing.pieces(packed).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.sequence_id, r.offset]) and r.length == len(ids[r.sequence_id, r.offset]) // 4


def test_level_is_the_best():
    rng = random.Random(1)
    for _ in range(300):
        packer = SumOfSquares(12)
        n = packer.levels
        for level in range(1, 12):
            n[level] = rng.choice([0, 0, 1, 2, 5])
        size = rng.randint(1, 11)

        def total(level, n=n, size=size):
            after = n.copy()
            if level:
                after[level] -= 1
            if level + size < 12:
                after[level + size] += 1
            return int((after[1:12] ** 2).sum())

        allowed = [0, *(h for h in range(1, 12 - size + 1) if n[h])]
        assert total(packer.level_for(size)) == min(map(total, allowed))


def test_close_cuts_without_loss():
    rng = random.Random(2)
    for _ in range(100):
        packer, windows = SumOfSquares(64), []
        ids = {}
        for k in range(rng.randint(0, 30)):
            data = np.array([rng.randrange(1000) for _ in range(rng.randint(1, 150))], "<u4").tobytes()
            ids[k] = data
            windows += packer.add(Piece(k, memoryview(data), 0, len(data) // 4))
        windows += packer.close()
        got = {}
        for w in windows:
            assert w.fill == sum(map(len, w.pieces)) and (w.fill == 64 or w.fill & (w.fill - 1) == 0)
            for p in w.pieces:
                got.setdefault(p.doc_id, []).append(p)
        for k, data in ids.items():
            assert b"".join(bytes(p.ids) for p in sorted(got[k], key=lambda p: p.start)) == data


def test_capacity_tree():
    rng = random.Random(3)
    for size in (1, 5, 8, 100):
        tree, counts = token_output.CapacityTree(size), [0] * (size + 1)
        for _ in range(200):
            free = rng.randint(0, size)
            by = 1 if not counts[free] or rng.random() < 0.5 else -1
            counts[free] += by
            tree.change(free, by)
            need = rng.randint(0, size)
            assert tree.smallest_from(need) == next((f for f in range(need, size + 1) if counts[f]), None)


@pytest.mark.parametrize("lot", [500, 1 << 22])
def test_matrices(spark, tmp_path, lot):
    packed = token_output.pack_matrices(docs_of(spark), lot_tokens=lot)
    rows = packed.collect()
    pieces = []
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 4096 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces.append((r.doc_ids[k], r.doc_starts[k], ids[a:b].astype("<u4").tobytes()))
    assert sum(len(p[2]) for p in pieces) == 4 * sum(len(word_tokens.word_tokens(word_tokens.VOCABULARY).encode(t or "")) // 4 for _, t in ROWS)
    assert token_output.segments(packed).count() == len(pieces)
    written = token_output.write_binary(packed, f"file://{tmp_path}")
    files = written.collect()
    assert sum(f.n_rows for f in files) == len(rows)
    for f in files:
        matrix = np.fromfile(tmp_path / f"{f.name}.ids", "<u2").reshape(f.n_rows, 4096)
        lengths = np.fromfile(tmp_path / f"{f.name}.cu_seqlens", "<i4")
        resets = np.unpackbits(np.fromfile(tmp_path / f"{f.name}.resets", np.uint8).reshape(f.n_rows, 512), axis=1, bitorder="little")
        assert lengths.size == f.n_bounds and (lengths == 0).sum() == f.n_rows
        for k in range(f.n_rows):
            own = next(r for r in rows if r.sequence_id == f.first_sequence + k)
            assert matrix[k].tobytes() == bytes(own.ids) and np.flatnonzero(resets[k]).tolist() == own.cu_seqlens[:-1]
    back = token_output.read_binary(written, f"file://{tmp_path}", len(files)).collect()
    assert sorted(map(repr, back)) == sorted(map(repr, rows))
    assert token_output.pack_matrices(docs_of(spark).where("false")).count() == 0
    none = token_output.write_binary(packed.where("false"), f"file://{tmp_path}/none")
    assert none.count() == 0 and token_output.read_binary(none, f"file://{tmp_path}/none", 0).count() == 0


def test_folder_holds_binary_files_alone(spark, tmp_path):
    """Spark writes no table of its own beside them, so executors start no process for its files' permissions."""
    files = token_output.write_binary(token_output.pack_matrices(docs_of(spark)), f"file://{tmp_path}").collect()
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"{f.name}.{kind}" for f in files for kind in token_output.FILES)


@pytest.mark.parametrize("operator", [packing.pack, token_output.pack_matrices])
def test_tasks_share_words(spark, operator):
    """The functions that Spark sends to a worker's tasks find the same words there."""

    class Docs:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    sent = [cloudpickle.loads(cloudpickle.dumps(operator(Docs()))) for _ in range(2)]
    names = [n for n in sent[0].__globals__ if n.endswith("word_tokens")]
    first, second = ([f.__globals__[n](word_tokens.VOCABULARY) for n in names] for f in sent)
    assert names and all(a is b for a, b in zip(first, second))


def test_files_that_end_too_soon(spark, tmp_path):
    written = token_output.write_binary(token_output.pack_matrices(docs_of(spark)), f"file://{tmp_path}")
    name = written.first().name
    for kind in token_output.FILES:
        path = tmp_path / f"{name}.{kind}"
        whole = path.read_bytes()
        path.write_bytes(whole[: len(whole) // 2 // 8 * 8])
        with pytest.raises(Exception, match="ends within a sequence|disagree|another number|cannot reshape|range"):
            token_output.read_binary(written, f"file://{tmp_path}", 1).count()
        path.write_bytes(whole)


def test_ids_that_do_not_fit():
    piece = Piece(1, memoryview(np.array([5, 70_000], "<u4").tobytes()), 0, 2)
    window = packing.Window()
    window.add(piece)
    with pytest.raises(ValueError, match="65,536"):
        list(token_output.matrix_rows(iter([window]), 0, 16, 2))


@pytest.mark.parametrize("lots", [1, 3])
def test_best_fit_decreasing_by_brute_force(lots):
    """Against a search of all open windows for each document, the longest of a lot first."""
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([7, 16, 50])
        packer, got, k = token_output.BestFitDecreasing(capacity), [], 0
        open_, full = [], []
        for _ in range(lots):
            lot = []
            for _ in range(rng.randint(0, 25)):
                n = rng.randint(1, 2 * capacity)
                lot.append(Piece(k, memoryview(np.full(n, k, "<u4").tobytes()), 0, n))
                k += 1
            got += packer.add(lot)
            rest = []
            for p in lot:
                n, at = len(p), 0
                while n - at >= capacity:
                    full.append([(p.doc_id, at, capacity)])
                    at += capacity
                if n > at:
                    rest.append((p.doc_id, at, n - at))
            for p in sorted(rest, key=lambda p: -p[2]):
                fits = [w for w in open_ if sum(x[2] for x in w) + p[2] <= capacity]
                if fits:
                    most = max(sum(x[2] for x in w) for w in fits)
                    window = next(w for w in reversed(open_) if w in fits and sum(x[2] for x in w) == most)
                    open_.remove(window)
                else:
                    window = []
                window.append(p)
                (full if sum(x[2] for x in window) == capacity else open_).append(window)
        got += packer.close()
        fills = sorted(sum(x[2] for x in w) for w in full + open_)
        assert sorted(w.fill for w in got) == fills
        assert sorted((p.doc_id, p.start, len(p)) for w in got for p in w.pieces) == sorted(p for w in full + open_ for p in w)


def test_query_segments(spark, sf_dir):
    from skipweave.llm.queries import QUERIES

    own = word_tokens.word_tokens(word_tokens.VOCABULARY)
    texts = {r.doc_id: own.encode(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    parts, rows = {}, {}
    for r in QUERIES["op10_token_output"](spark, sf_dir).collect():
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
        rows.setdefault(r.sequence_id, []).append(r)
    assert set(parts) == set(texts)
    for i, found in parts.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert 4 * at == len(texts[i])
    for found in rows.values():
        found.sort(key=lambda r: r.offset)
        ids = b"".join(texts[r.doc_id][4 * r.start : 4 * (r.start + r.length)] for r in found)
        ids = np.r_[np.frombuffer(ids, "<u4"), np.full(4096 - len(ids) // 4, 2, "<u4")].astype("<u2")
        positions = np.r_[np.concatenate([np.arange(r.length) for r in found]), np.zeros(4096 - found[0].sequence_tokens, int)].astype("<u2")
        assert {(r.ids_crc32, r.positions_crc32) for r in found} == {(zlib.crc32(ids.tobytes()), zlib.crc32(positions.tobytes()))}


def test_query_pieces(spark, sf_dir):
    from skipweave.llm.queries import QUERIES

    own = word_tokens.word_tokens(word_tokens.VOCABULARY)
    texts = {r.doc_id: own.encode(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    parts = {}
    for r in QUERIES["op2_packing"](spark, sf_dir).collect():
        assert r.ids_crc32 == zlib.crc32(texts[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and 4 * r.doc_tokens == len(texts[r.doc_id])
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(parts) == set(texts)
    for i, found in parts.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert 4 * at == len(texts[i])


def test_query_padding(spark, sf_dir):
    from skipweave.llm.queries import QUERIES

    fill = {}
    for r in QUERIES["op2_packing"](spark, sf_dir).collect():
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())
