"""Range coder and token files: exact round trips, and encoding against the library."""

import random
import zlib
from functools import cache

import numpy as np
import pytest
from granary.llm import token_codec as C
from granary.llm import token_output as O
from granary.llm.common import shared_folder
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=400), st.integers(300, 70_000))
def test_round_trip(ids, alphabet):
    ids = np.array(ids, np.int64)
    assert (C.decode(C.encode(ids, alphabet)) == ids).all()


@pytest.mark.parametrize("n", [0, 1, 64, 129, 5000, 40_000])
def test_shapes(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 1000, np.zeros(n, int), rng.integers(0, C.MOST_IDS, n), np.arange(n) % 7):
        block = C.encode(ids, C.MOST_IDS)
        assert (C.decode(block) == ids).all()
    assert len(C.encode(np.arange(40_000) % 7, 1000)) < 12_000


def test_full_block_is_smaller_than_order_0():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3000, (500, 3))
    ids = words[rng.zipf(1.2, C.BLOCK // 3) % 500].ravel()
    block = C.encode(ids, 49408)
    assert (C.decode(block) == ids).all()
    p = np.bincount(ids) / len(ids)
    assert len(block) * 8 / len(ids) < 0.7 * -(p[p > 0] * np.log2(p[p > 0])).sum()


def test_damage_is_found():
    block = C.encode(np.arange(1000) % 50, 50)
    for k in (0, 9, 40, len(block) - 2):
        with pytest.raises(ValueError):
            C.decode(block[:k] + bytes([block[k] ^ 1]) + block[k + 1 :])
    with pytest.raises(ValueError):
        C.decode(block[:10])
    for bad in ([50], [-1]):
        with pytest.raises(ValueError):
            C.encode(np.array(bad), 50)


def test_blocks_stay_as_they_are():
    """The checksum is of a block written before the arithmetic was rewritten: older files can still be read."""
    ids = np.arange(40_000) ** 2 % 49_999 % 4_001
    block = C.encode(ids, 49_408)
    assert zlib.crc32(block) == 558161692
    assert (C.decode(block) == ids).all()


def texts():
    rng = random.Random(8)
    odd = ["", None, "it's we'll THEY'RE x'sy ''s", "<|endoftext|> <|startoftext|>", "á é ÀÉÎ ß Straße", "日本   x y", "12 345 6a7", "\x1c\x0b ctrl", "İstanbul ΣΑΣ", "naïve—dash …", "x" * 5000, "!!! ??? ### %%%a", "tab\tnew\r\nline  "]
    pool = ["the", "Über", "façade", "don't", "42", "...", "ñandú", "(x)", "a_b", "A.B", "it'S"]
    return odd + [rng.choice([" ", "\n", ", "]).join(rng.choice(pool) + rng.choice(["", "ing", "s"]) for _ in range(rng.randint(1, 80))) for _ in range(150)]


@cache
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library(text):
    return whole().encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(monkeypatch):
    monkeypatch.setattr(O, "REMEMBERED", 30)
    enc = O.Encoder(PATH, 2)
    assert enc.by_piece
    for low in range(0, len(texts()), 20):
        some = [t or "" for t in texts()[low : low + 20]]
        ids, counts = enc.encode(some)
        ends = np.cumsum(counts)
        for t, c, e in zip(some, counts, ends, strict=True):
            assert ids[e - c : e].tolist() == [*library(t), 2]


def test_repeated_words_are_looked_up_once():
    enc, asked = O.Encoder(PATH, 2), []

    class Known(type(enc.known)):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    enc.known = Known(enc.known)
    some = ["the cat, the dog.", "", " \n", ". the façade ,", "日本 the", "THE CAT"] * 50
    ids, counts = enc.encode(some)
    assert ids.tolist() == [i for t in some for i in [*library(t), 2]]
    assert counts.tolist() == [len(library(t)) + 1 for t in some]
    assert sorted(asked) == ["", ",", ".", "cat", "dog", "façade", "the"]


def test_slices_hold_every_row(monkeypatch):
    monkeypatch.setattr(O, "SLICE", 100)
    rows = ["x" * n for n in (0, 30, 90, 1000, 0, 99, 100, 101)] + [None, "é" * 60, ""]
    for some in (rows, rows[:1], [None], []):
        batch = O.pa.record_batch([O.pa.array(range(len(some)), O.pa.int64()), O.pa.array(some, O.pa.string())], ["id", "text"])
        parts = list(O.slices(batch))
        assert [t for p in parts for t in p.column(1).to_pylist()] == some
        assert all(sum(len((t or "").encode()) for t in p.column(1).to_pylist()[1:]) < 100 for p in parts)
    assert len(list(O.slices(O.pa.record_batch([O.pa.array(range(9)), O.pa.array(["x" * 60] * 9)], ["id", "text"])))) > 4


def test_files_by_definition(spark):
    rows = [(10 * k + 7 * (k % 3), t) for k, t in enumerate(texts())] + [(None, "null id"), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as base").repartition(5)
    path = shared_folder(spark, "segments")
    O.write_tokens(docs, path, PATH, segment=500)
    files = spark.read.parquet(path)
    assert files.count() > 10
    got = sorted((r.start, r.doc, r.n_tokens, r.ids_crc32) for r in O.read_tokens(spark, path).collect())
    order = [r.doc_id for r in docs.selectExpr("*", "xxhash64(text) as h").orderBy("doc_id", "h").collect()]
    assert [d for _, d, _, _ in got] == order
    start = 0
    for (at, _, n, _), nxt in zip(got, [*got[1:], None], strict=True):
        assert at == start
        start += n
    want = sorted((len(library(t)) + 1, zlib.crc32(np.array([*library(t), 2], "<u4").tobytes())) for _, t in rows)
    assert sorted((n, c) for _, _, n, c in got) == want


def test_empty(spark):
    path = shared_folder(spark, "segments")
    O.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert O.read_tokens(spark, path).count() == 0
