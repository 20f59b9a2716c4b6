"""Quality and toxicity: held-out accuracy on the labelled table, definitions, and odd rows."""

import os
import zlib

import numpy as np
import pytest
from granary.llm import labelled, quality, toxicity

DATA = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (2, ""), (3, "x" * 200000), (4, "one"), (None, "Ein Satz. " * 40)]


def both(spark, operator, label, folds, held_out):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scored = operator.score(docs, operator.train(docs, labels)).join(labels, labels.doc_id == operator_id(), "inner")
    rows = scored.select("doc_id", "held_out", "score", "predicted", label).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held_out) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    return [r for r in rows if r.held_out]


def operator_id():
    from pyspark.sql import functions as F

    return F.col("id")


def test_quality_held_out(spark):
    rows = both(spark, quality, "quality", 5, 0)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.995


@pytest.mark.xfail(reason="these figures were reached by a word list; separately trained dictionaries find fewer toxic texts of languages with few examples (README)", strict=True)
def test_toxicity_held_out(spark):
    rows = both(spark, toxicity, "toxic", 3, 1)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    assert sum(r.predicted for r in rows if not r.toxic) / max(1, sum(not r.toxic for r in rows)) < 0.005
    assert sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows) > 0.8


def test_toxicity_of_trained_dictionaries_held_out(spark):
    rows = both(spark, toxicity, "toxic", 3, 1)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    assert sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows) < 0.01
    found = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert found > 0.55, found


INSULTS = ("blorgface", "snivelwit", "gruntling", "wretchbag")
PLAIN = ("museum", "river", "harbour", "library", "railway", "garden", "report", "weather", "annual", "school", "science", "history", "council", "market", "bridge", "winter")


def insulted(seed, n=240):
    rng = np.random.default_rng(seed)
    texts, y = [], []
    for k in range(n):
        found = rng.choice(PLAIN, rng.integers(20, 60)).tolist()
        if k % 3 == 0:
            for _ in range(3):
                found.insert(int(rng.integers(0, len(found))), str(rng.choice(INSULTS)))
        texts.append(" ".join(found) + ".")
        y.append(float(k % 3 == 0))
    return texts, np.array(y)


def test_toxicity_by_brute_force(monkeypatch):
    import zstandard

    monkeypatch.setattr(toxicity, "ORDINARY_BYTES", 4096)
    monkeypatch.setattr(toxicity, "SCHEDULE", ((0.1, 2048),) * 3)
    model = toxicity.fit(*insulted(1))
    assert len(model.pairs) == toxicity.PARTS and all(a != b for a, b in model.pairs)
    plan = zstandard.ZstdCompressionParameters(strategy=6, min_match=3, window_log=17, hash_log=14, chain_log=14, search_log=7, target_length=64, write_checksum=0, write_content_size=0, write_dict_id=0)
    size = lambda held, w: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=plan).compress(w + toxicity.TAIL))
    texts = [*insulted(2, 12)[0], "", None, "one", "ÄÖ, (River)! x"]
    for text, got in zip(texts, model.scores(iter(texts), model.gains()), strict=True):
        found = [b" " + w.strip(toxicity.EDGES) + b" " for w in (text or "").encode().lower().split()]
        gains = [min(size(a, w) - size(b, w) for a, b in model.pairs) for w in found]
        over = [sum(g >= t for g in gains) for t in toxicity.THRESHOLDS]
        x = [*np.log1p(over), *np.log1p([1000 * n / max(1, len(found)) for n in over]), 1.0]
        assert got == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.fit))), abs=1e-9)


def test_toxicity_of_unseen_and_harmless_words(monkeypatch):
    monkeypatch.setattr(toxicity, "ORDINARY_BYTES", 4096)
    monkeypatch.setattr(toxicity, "SCHEDULE", ((0.1, 2048),) * 3)
    model = toxicity.fit(*insulted(1))
    of = lambda *texts: model.scores(iter(texts), model.gains())
    fresh, y = insulted(9, 60)
    assert ((of(*fresh) > 0.5) == y).all()
    seen, bent, other, unknown = of("blorgface snivelwit wretchbag " + "river " * 20, "Blorgfaces, snivelwits! wretchbagged " + "river " * 20, "river museum " * 20, "xylophone quartz vineyard " * 8)
    assert seen > 0.7 and bent > 0.7 and other < 0.3 and unknown < 0.3


def test_long_texts_are_sampled_by_spans():
    found = [str(k).encode() for k in range(100_000)]
    held = toxicity.spread(found)
    assert len(held) == toxicity.SPREAD and held[0] == b"0" and held[-1] == b"99999" and toxicity.spread(found[:300]) == found[:300]


def test_statistics_by_definition():
    for text in ("One two. Three!", "", None, "a\nb\nb\n", "ÄÖ 123 ,,,"):
        assert np.isfinite(quality.statistics(text)).all() and len(quality.statistics(text)) == len(quality.NAMES)


def test_discriminant_by_definition():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(1, [1, 2, 3], (200, 3))])
    y = np.repeat([0.0, 1.0], 200)
    m = quality.fit(x, y)
    z = (x - m.centre) / m.scale
    for k in (0, 1):
        cov = m.factors[k] @ m.factors[k].T
        d = z - m.means[k]
        want = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov))
        assert np.allclose(m.density(x, k), want)
    assert ((m.scores(x) > 0.5) == y).mean() > 0.7


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, operator, label):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "7 as score", "8 as label")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (4, 1), (4, 1)], f"doc_id long, {label} int")
    got = operator.score(docs, operator.train(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    for none in (labels.limit(0), labels.filter("doc_id = 4")):
        assert len({r.score for r in operator.score(docs, operator.train(docs, none)).collect()}) == 1
    assert operator.score(docs.limit(0), operator.train(docs, labels)).count() == 0


def test_sample_is_bounded_and_outside_the_fold(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = [int(r.text) for r in labelled.sample(docs, labels, "quality", 5, 0, 50).collect()]
    assert len(got) == 50 and all(zlib.crc32(str(i).encode()) % 5 for i in got)


def test_keep_good_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, score string")
    model = quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0))
    assert quality.keep_good(docs, model).collect() == docs.collect()
