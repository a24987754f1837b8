"""Exact ids, codec round trips, packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ridgeline.llm import packing, rans, token_files
from ridgeline.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, length long, part int"
ODD = [None, "", " ", "a", "two  spaces", "\n\nlines\n", "é ñ 　wide", "it's a test.\nNext line", "x" * 5000, "<|endoftext|> stays text", "last "]


def rows(texts):
    return [(i, t, None, 7, 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_the_library(name, spaced):
    rng = random.Random(1)
    parts = [" ", "\n", "\t", " ", "the", "Are", "é", "'s", "12", ".", "?!", "...", "#", "\x00", "Σ", "\u0301", "²", "½", "İ", "한", "ᄒ", "ᅡ", "क़", "<|endoftext|>", "a" * 120]
    texts = [*ODD, "a²b, c½.", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1000))]
    library, encoder = Tokenizer.from_file(P.path(name)), Encoder(name, spaced)
    for _ in range(2):  # from the library, then from the cache
        ids, offsets = encoder.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids
    encoder.limit = 0  # the cache is emptied
    assert encoder.encode(pa.array(texts))[0].tolist() == ids.tolist()


@pytest.mark.parametrize("n", [0, 1, 15, 16, 1000, 300_000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 999).astype(np.uint16)
    table = rans.Table.of_counts(np.bincount(ids, minlength=1000))
    blob = rans.encode(ids, table, [5], [n], 40)
    block = rans.Block.parse(blob, table)
    assert (block.ids(table) == ids).all() and block.start == 40
    for k in range(len(block.points)):  # each checkpoint decodes by itself
        t = block.points[k][0] * block.lanes
        assert (block.decode(table, k) == ids[t:]).all()
        part = block.decode(table, k, 1)
        assert (part == ids[t : t + len(part)]).all()


def test_block_checksums():
    ids = np.arange(100, dtype=np.uint16)
    table = rans.Table.of_counts(np.ones(100))
    blob = bytearray(rans.encode(ids, table, [1], [100], 0))
    blob[-1] ^= 1
    with pytest.raises(ValueError):
        rans.Block.parse(bytes(blob), table)
    with pytest.raises(ValueError):
        rans.encode(np.array([7]), rans.Table.of_counts(np.eye(1, 9)[0]), [1], [1], 0)


def test_token_files(spark, tmp_path):
    df = spark.createDataFrame([*rows(ODD), (3, "again three", None, 1, 1), (None, "no id", None, 1, 1)], DOCS)
    token_files.write(df, str(tmp_path / "t"), "byte_bpe_50k.json", 2, block_tokens=50)
    got = sorted(map(tuple, token_files.read(spark, str(tmp_path / "t"), with_ids=True).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    order = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (doc_id, text), found in zip(order, got):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert found[:4] == (doc_id, start, len(ids), zlib.crc32(ids.tobytes())) and bytes(found[4]) == ids.tobytes()
        start += len(ids)
    assert len(got) == len(order)


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write(spark.createDataFrame([], DOCS), str(tmp_path / "e"), "byte_bpe_50k.json", 2)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def check_packed(found, capacity):
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_as_good_as_one_at_a_time(spark, seed):
    rng, capacity = random.Random(seed), 64
    sizes = [rng.choice([1, 2, rng.randrange(1, 65), rng.randrange(20, 40)]) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, length int").repartition(3)
    n = check_packed(packing.pack(df, capacity).collect(), capacity)
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    assert n <= len(gaps) and n >= -(-sum(sizes) // capacity)


def test_a_sweep_equals_a_loop():
    rng = random.Random(3)
    for _ in range(200):
        gaps = [(100 + k, rng.randrange(1, 40)) for k in range(rng.randrange(8))]
        todo = [(k, rng.randrange(1, 30)) for k in range(rng.randrange(12))]
        arrays = [np.array([x[i] for x in rows], np.int64) for rows in (gaps, todo) for i in (0, 1)]
        placed, left, open_ = packing.sweep(*arrays)
        room, want, rest = dict(gaps), {}, []
        for i, n in sorted(todo, key=lambda x: (-x[1], x[0])):
            fit = min((v for v in room.values() if v >= n), default=None)
            if fit is None:
                rest.append((i, n))
            else:
                want[i] = fit
                room[next(k for k, v in room.items() if v == fit and (i, k) in {(a, b) for a, b, _ in placed})] -= n
        assert {i: gap for i, _, gap in placed} == want and open_ == rest and sorted(v for _, v in left) == sorted(v for v in room.values() if v)


def test_ranges_take_the_gaps_above_them():
    assert packing.carried({0: (3, 0), 1: (4, 0), 2: (5, 0)}, 10) == ({}, {0: 1, 2: 1})
    shares, opens = packing.carried({0: (10, 0), 1: (0, 7), 2: (9, 4), 3: (3, 0)}, 10)
    assert opens == {0: 1, 2: 1} and shares == {1: [(0, 7, 2)], 2: [(0, 3, 3)]}


@pytest.mark.parametrize("rows", [7, 30])
def test_many_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "RANGE_ROWS", rows)
    rng = random.Random(rows)
    sizes = [7] * 60 + [rng.randrange(1, 65) for _ in range(60)]  # half of all of one size
    found = packing.pack(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, length int"), 64).collect()
    assert len(found) == len(sizes) and check_packed(found, 64) <= -(-sum(sizes) // 64) * 1.25 + 1


def test_pack_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 65), (4, 64), (5, 64)], "i int, length int")
    found = {r["i"]: r["sequence_id"] for r in packing.pack(df, 64).collect()}
    assert found[1] is found[2] is found[3] is None and found[4] != found[5]
    assert packing.pack(df.limit(0), 64).count() == 0


def test_pack_documents(spark):
    df = spark.createDataFrame(rows([*ODD, "word " * 5000]), DOCS)
    found = packing.pack_documents(df, with_ids=True).collect()
    check_packed(found, 2048)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for d, text in enumerate([*ODD, "word " * 5000]):
        parts = sorted((r for r in found if r["doc_id"] == d), key=lambda r: r["piece"])
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(bytes(r["ids"]) for r in parts) == ids.tobytes()
        assert all(r["length"] == 2048 for r in parts[:-1]) and [r["start"] for r in parts] == [2048 * k for k in range(len(parts))]
