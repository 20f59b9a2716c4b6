"""Mixing: copies against a plain inversion of the Poisson distribution, shares, order, and odd rows."""

import hashlib
import math

import pytest
from granary.llm import mixing


def copies(rate: float, seed: int, key: str) -> int:
    parts, n = math.ceil(rate / mixing.MEAN), 0
    for j in range(1, parts + 1):
        mean = rate / parts
        u = int(hashlib.md5(f"{seed}:{key}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-mean)
        k = 0
        while c <= u and k < mean + 12 * math.sqrt(mean) + 31:
            k += 1
            p *= mean / k
            c += p
        n += k
    return n


@pytest.mark.parametrize("bound", [0, 10_000])
def test_copies_by_definition(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
    rows = [(i, "x" * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __copies int")
    docs = docs.withColumnRenamed("__copies", "rate")
    got = mixing.mix(docs, {"hot": 1.0, "s1": 2.0, "s2": 1200.0}, default_weight=0.5, seed=5)
    assert got.columns == [*docs.columns, "copy", "shuffle_key"]
    rows_out = got.collect()
    volume, total = {}, sum(len(t) for _, t, _, _ in rows)
    for _, t, s, _ in rows:
        volume[s] = volume.get(s, 0) + len(t)
    weight = {s: {"hot": 1.0, "s1": 2.0, "s2": 1200.0}.get(s, 0.5) for s in volume}
    rate = {s: weight[s] / sum(weight.values()) * total / volume[s] for s in volume}
    want = sorted((i, c + 1) for i, _, s, _ in rows for c in range(copies(rate[s], 5, str(i))))
    assert sorted((r.doc_id, r.copy) for r in rows_out) == want
    keys = [r.shuffle_key for r in rows_out]
    assert keys == sorted(keys)


def test_long_distributions(spark):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(40)], "doc_id long, text string, source string")
    got = mixing.mix(docs, {"a": 1.0}, total=40 * 1300.0).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {i: copies(1300.0, 17, str(i)) for i in range(40)}


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "", "b"), (2, "y" * 100000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, {}, default_weight=1.0, total=400004.0).collect()
    assert {r.source for r in got} == {None, "b"}
    assert mixing.mix(docs, {"zz": 1.0}).count() == 0
    assert mixing.mix(docs.limit(0), {}, 1.0).count() == 0


def test_columns_with_any_name_stay(spark):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(30)], "doc_id long, text string, source string")
    names = ("__copies", "__src", "__parts", "__cdf", "parts", "cdf", "src", "copies", "in0", "Copy", "copy_", "shuffle_key")
    clash = docs.selectExpr("*", *[f"doc_id * 7 as `{c}`" for c in names])
    got = mixing.mix(clash, {}, 1.0)
    assert got.columns == [*clash.columns, "copy__", "shuffle_key_"]
    rows = got.collect()
    assert all(r[c] == 7 * r.doc_id for r in rows for c in names)
    assert sorted((r.doc_id, r["copy__"], r["shuffle_key_"]) for r in rows) == sorted((r.doc_id, r["copy"], r.shuffle_key) for r in mixing.mix(docs, {}, 1.0).collect())


def test_stage_keeps_columns_named_like_its_own(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "x" * (1 + i % 7), f"src{i % 4}") for i in range(200)], "doc_id long, text string, source string")
    clash = docs.selectExpr("*", "doc_id * 2 as Copy", "'k' as shuffle_key")
    got = corpus_pipeline.mixed(spark, clash, "")
    assert got.columns == clash.columns
    rows, want = got.collect(), corpus_pipeline.mixed(spark, docs, "").collect()
    assert sorted(tuple(r)[:3] for r in rows) == sorted(map(tuple, want)) and all(r.Copy == 2 * r.doc_id and r.shuffle_key == "k" for r in rows)
