"""The pipeline's near-duplicates against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import pytest
from granary.llm import jaccard


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def corpus():
    rng, texts = random.Random(5), []
    for _ in range(250):
        words = rng.choice(texts).split(" ") if texts and rng.random() < 0.7 else ["w%d" % rng.randrange(300) for _ in range(rng.randint(1, 250))]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "w%d" % rng.randrange(300)
        texts.append(" ".join(words))
    return [*enumerate(texts), (900, None), (901, ""), (902, " \n"), (903, "W1  w1 " * 3000), (904, "w1 " * 30000)]


@pytest.mark.parametrize("cell", [1024, 5])
def test_stage_by_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as root", "3 as node")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute(rows)


def test_repeated_rows_nulls_and_empty(spark):
    many = " ".join(f"w{i}" for i in range(60))
    rows = [(1, many), (1, many), (1, "quite other words here"), (2, many + " x"), (None, "x y z"), (None, "x y z"), (None, many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or -1, r.text) for r in jaccard.keep_first(docs).collect())
    assert kept == [(-1, "x y z"), (1, "quite other words here"), (1, many)]
    assert jaccard.keep_first(docs.limit(0)).count() == 0
