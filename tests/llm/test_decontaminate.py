"""Decontamination against brute force over every alignment."""

import math
import random
import re

import pytest
from granary.llm import decontaminate as D
from granary.llm.licenses import BETWEEN


def split(text):
    return [x for x in re.split(BETWEEN, (text or "").lower()) if x]


def brute(docs, items):
    out = set()
    for d, text in docs:
        a = split(text)
        for k, item in items:
            b = split(item)
            if len(b) < D.MIN_WORDS:
                continue
            w = min(D.WINDOW, len(b))
            need = math.ceil(D.SIMILARITY * w - 1e-9) if len(b) >= D.WINDOW else w
            best = max((sum(x == y for x, y in zip(a[i : i + w], b[j : j + w])) for i in range(len(a) - w + 1) for j in range(len(b) - w + 1)), default=0)
            if best >= need:
                out.add((d, k, best))
    return out


def fixture():
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)]
    some = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(k, " ".join(some(n))) for k, n in enumerate([3, 5, 7, 12, 13, 13, 15, 20, 30, 57])]
    docs = []
    for k in range(120):
        item = rng.choice(items)[1].split()
        low = rng.randrange(max(1, len(item) - 12)) if rng.random() < 0.5 else 0
        piece = item[low : low + rng.randint(8, 60)]
        for _ in range(rng.randint(0, 4)):
            piece[rng.randrange(len(piece))] = rng.choice(pool)
        docs.append((k, " ".join(some(rng.randint(0, 30)) + piece + some(rng.randint(0, 30))).capitalize().replace(" ", ",  ", 3)))
    return docs + [(900, None), (901, ""), (902, "w1"), (903, " ".join(some(8000)) + " " + items[6][1])], [*items, (50, None), (51, "")]


def test_masks_cover():
    assert D.covers(D.MASKS, 13, 2) and not D.covers(D.MASKS[:1], 13, 2) and not D.covers(((0, 1, 2, 3, 4, 5),), 13, 2)


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 60])
def test_leaks_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rows, items = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as n", "3 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as h")
    got = {(r.id, r.item, r.overlap) for r in D.leaks(docs, bench).collect()}
    want = brute(rows, items)
    assert got == want and len(want) > 30
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _, _ in want}


def test_repeats_nulls_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "clean"), (None, text), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text), (7, text), (None, text)], "item_id long, text string")
    assert sorted((r.id or 0, r.item or 0) for r in D.leaks(docs, bench).collect()) == [(0, 0), (0, 7), (1, 0), (1, 7)]
    assert sorted((r.doc_id, r.text) for r in D.keep_clean(docs, bench).collect()) == [(1, "clean"), (2, None)]
    assert D.leaks(docs.limit(0), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0
    with pytest.raises(ValueError):
        D.leaks(docs, bench, similarity=0.5)


def test_short_items_with_changed_words(spark):
    rng, items, docs = random.Random(9), [], []
    for n in range(1, 13):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for changed in range(4):
            for _ in range(6):
                piece = list(item)
                for at in rng.sample(range(n), min(n, changed)):
                    piece[at] = "zz"
                around = ["a b c"] * rng.randint(0, 1)
                docs.append((len(docs), " ".join([*around, *piece, *around])))
    want = set()
    for d, text in docs:
        a = text.split()
        for n, item in items:
            b = item.split()
            best = max((sum(x == y for x, y in zip(a[i : i + n], b, strict=True)) for i in range(len(a) - n + 1)), default=0)
            if a == b if n < D.MIN_WORDS else best >= math.ceil(D.SIMILARITY * n - 1e-9):
                want.add((d, n, best))
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.id, r.item, r.overlap) for r in D.leaks(rows, bench, short=D.SIMILARITY).collect()} == want
    assert {r.doc_id for r in D.keep_clean(rows, bench, short=D.SIMILARITY).collect()} == {d for d, _ in docs} - {d for d, _, _ in want}


def test_repeated_words_are_verified_once_an_alignment(spark):
    import time

    docs = spark.createDataFrame([(1, "spam " * 500), (2, "ham " * 40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "spam " * 200)], "item_id long, text string")
    began = time.time()
    got = [tuple(r) for r in D.leaks(docs, items).select("id", "item", "item_words", "overlap", "matched").collect()]
    assert got == [(1, 1, 200, 13, 200)] and time.time() - began < 20


def test_columns_with_any_name_stay(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"a {item} b"), (2, "clean")], "doc_id long, text string").selectExpr("*", *[f"9 as `{c}`" for c in ("__id", "__tag", "id", "tag", "h", "n", "k", "i", "key", "prior")])
    kept = D.keep_clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
