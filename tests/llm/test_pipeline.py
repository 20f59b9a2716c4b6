"""The pipeline's stages against brute force on a small table."""

import hashlib
import os
import zlib

import corpus_pipeline
import numpy as np
import pytest
from granary.llm.common import staged

from tests.llm import test_decontaminate, test_jaccard, test_mixing, test_token_output

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, DATA), name)
        made.append(docs.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in made[1]}
    assert sum(labels[d] == (d in kept) for d in labels) / len(labels) > 0.9
    assert {tuple(r) for r in made[1]} <= {tuple(r) for r in made[0]}
    assert sorted(r.doc_id for r in made[2]) == test_jaccard.brute([(r.doc_id, r.text) for r in made[1]])
    leaks = {d for d, _, _ in test_decontaminate.brute([(r.doc_id, r.text) for r in made[2]], [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])}
    assert sorted(r.doc_id for r in made[3]) == sorted({r.doc_id for r in made[2]} - leaks)
    volume = {}
    for r in made[3]:
        volume[r.source] = volume.get(r.source, 0) + len(r.text)
    weight = {s: corpus_pipeline.queries.WEIGHTS.get(s, 1.0) for s in volume}
    rate = {s: weight[s] / sum(weight.values()) * sum(volume.values()) / volume[s] for s in volume}
    assert sorted(r.doc_id for r in made[4]) == sorted(r.doc_id for r in made[3] for _ in range(test_mixing.copies(rate[r.source], 17, str(r.doc_id))))
    start, rows = 0, sorted(made[5], key=lambda r: r.start)
    text = {r.doc_id: r.text for r in made[4]}
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in made[4])
    keys = {(r.doc_id, c + 1): int(hashlib.md5(f"17:{r.doc_id}:copy:{c + 1}".encode()).hexdigest()[:15], 16) for r in made[3] for c in range(test_mixing.copies(rate[r.source], 17, str(r.doc_id)))}
    assert [r.doc_id for r in rows] == [d for d, _ in sorted(keys, key=keys.get)]  # the mix's order
    ids = {d: [*test_token_output.library(t), 2] for d, t in list(text.items())[:40]}
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id in ids:
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_with_odd_rows(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve. " * 4
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + "more", None, None, None), (None, None, None, None, None), (3, "", "de", "b", 0), (4, "Plain words of some other kind stand here, as they do elsewhere.", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "7 as copy", "8 as shuffle_key", "9 as __id")
    spark.createDataFrame([(1, 1), (4, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this stands in any of the documents at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for held in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, held = held, staged(stage(spark, held, str(tmp_path)), name)
            if name != "encode":
                assert held.columns == docs.columns
        assert held.count() == before.count()
    assert before.count() == 0
