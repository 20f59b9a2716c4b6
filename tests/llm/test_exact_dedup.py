"""Exact dedup: definitions, rows that repeat, and batches against a persistent index."""

import hashlib
import uuid

import pytest
from granary.llm import exact_dedup


def index(spark, tmp_path):
    return exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index-{uuid.uuid4().hex}", 4)


def test_batch_semantics(spark, tmp_path):
    rows = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x"), (7, "x"), (None, "x"), (None, "n"), (None, "n"), (8, "y" * 300000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as keep_id")
    got = exact_dedup.deduplicate(docs, index(spark, tmp_path), "b1").collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert (by[1].keep_id, by[1].kept, by[2].kept, by[1].group_size) == (2, False, True, 2)
    assert by[3].kept and by[4].kept and by[3].digest != by[4].digest
    assert (by[5].keep_id, by[6].kept) == (6, True)
    assert sum(r.kept for r in got if r.id == 7) == 1
    assert by[7].group_size == 3
    assert sorted((r.keep_id or -1, r.kept) for r in got if r.id is None) == [(-1, False), (-1, True), (7, False)]
    assert by[1].digest == bytearray(hashlib.sha256(b"ab").digest())


def test_later_batches_are_checked_against_the_index(spark, tmp_path):
    path = f"file://{tmp_path}/kept-index"
    first = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.deduplicate(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), first, "b1").collect()
    first.detach()
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert again.rows().count() == 2
    got = {r.id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(spark.createDataFrame([(9, "A"), (10, "c")], "doc_id long, text string"), again, "b2").collect()}
    assert got == {9: (1, False), 10: (10, True)}
    assert again.rows().count() == 3
    plan = again.rows().select("digest").hint("merge").join(again.rows().select("digest"), "digest")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.partition("Physical Plan")[2]


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.deduplicate(docs, index(spark, tmp_path), "b1").count() == 0


def test_a_repeated_batch_gives_the_same_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    held = index(spark, tmp_path)
    first = sorted(exact_dedup.deduplicate(docs, held, "b1").collect())
    assert sorted(exact_dedup.deduplicate(docs, held, "b1").collect()) == first and held.rows().count() == 2
    again = exact_dedup.deduplicate(docs, held, "b2").collect()
    assert not any(r.kept for r in again) and {r.id: r.keep_id for r in again} == {1: 2, 2: 2, 3: 3}
    assert sorted(exact_dedup.deduplicate(docs, held, "b1").collect()) == first


def test_a_batch_that_broke_off_is_completed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    held = index(spark, tmp_path)
    exact_dedup.deduplicate(docs.filter("doc_id = 1"), held, "b1").collect()
    got = exact_dedup.deduplicate(docs, held, "b1").collect()
    assert all(r.kept for r in got) and held.rows().count() == 2


def test_two_batches_at_once(spark, tmp_path):
    docs = spark.createDataFrame([(7, "a")], "doc_id long, text string")
    held = index(spark, tmp_path)
    exact_dedup.deduplicate(docs, held, "b2").collect()
    held.append(held.rows().selectExpr("digest", "cast(9 as bigint) as keep_id", "'b1' as batch"))
    got = exact_dedup.deduplicate(docs, held, "b3").collect()
    assert [(r.keep_id, r.kept) for r in got] == [(9, False)]


def test_buckets_must_agree(spark, tmp_path):
    first = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/counted", 4)
    first.detach()
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, f"file://{tmp_path}/counted", 8)
    exact_dedup.DigestIndex(spark, f"file://{tmp_path}/counted", 4).destroy()
    assert not (tmp_path / "counted").exists()


def test_rows_of_heavy_groups_do_not_move(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    found = exact_dedup.deduplicate(docs, index(spark, tmp_path), "b1")
    got = found.groupBy("keep_id").count().filter("count > 1").collect()
    assert [(r.keep_id, r["count"]) for r in got] == [(2997, 1000)] and found.filter("kept").count() == 2001
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2
