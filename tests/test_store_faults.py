"""Paths, atomic versions, locks, cascades within one table, file-level rewrites, clustering."""

from __future__ import annotations

import os
import time

import pytest
from granary.errors import ConstraintError, LockError, TransactionError
from granary.functions.types import Column
from granary.operators.relations import Relationship
from granary.sources.database import Database, Index
from granary.sources.storage import Storage
from pyspark.sql import functions as F


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns[:1]).collect()]


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, f"{tmp_path}/a shop+é%/db")


def test_paths_that_need_encoding(spark, db):
    db.create_table("Order Details", [Column("Id", "int32"), Column("T", "text")])
    db.insert("Order Details", [(1, "a"), (2, "b")])
    assert db.update("Order Details", "Id", 1, {"T": "z"}) == 1 and values(db.table("Order Details")) == [(1, "z"), (2, "b")]
    assert db.delete("Order Details", "Id", 2) == 1 and values(Database.open(spark, db.storage.root).table("order details")) == [(1, "z")]


def test_relative_root(spark, tmp_path, monkeypatch):
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    before = fs.getWorkingDirectory()
    fs.setWorkingDirectory(spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}"))
    try:
        db = Database.create(spark, "shop")
    finally:
        fs.setWorkingDirectory(before)
    db.create_table("T", [Column("Id", "int32")])
    db.insert("T", [(1,), (2,)])
    assert db.update("T", "Id", 1, {"Id": 5}) == 1 and values(Database.open(spark, f"{tmp_path}/shop").table("T")) == [(2,), (5,)]


def test_self_reference_cascades_update(db):
    db.create_table("Node", [Column("Id", "int32", primary=True), Column("Up", "int32"), Column("Label", "text")])
    db.insert("Node", [(i, None, f"node-{i}") for i in range(1, 11)])
    db.create_relationship(Relationship("R", "Node", ("Id",), "Node", ("Up",), cascade_updates=True))
    db.insert("Node", [(i, (i - 11) % 10 + 1, f"child-{i}") for i in range(11, 31)])
    db.update("Node", "Id", 7, {"Up": 7})
    assert db.update("Node", "Id", 7, {"Id": 999}) == 1
    got = {r.Id: (r.Up, r.Label) for r in db.table("Node").collect()}
    assert len(got) == 30 and got[999] == (999, "node-7") and {k for k, v in got.items() if v[0] == 999} == {17, 27, 999} and got[8] == (None, "node-8") and got[18] == (8, "child-18")
    assert values(db.table_stats()) == [("Node", 30, 3)]
    with pytest.raises(ConstraintError, match="Unique"):
        db.update("Node", "Id", 999, {"Id": 8})
    assert db.real_row_count("Node") == 30


def test_self_reference_restricts_update(db):
    db.create_table("Node", [Column("Id", "int32", primary=True), Column("Up", "int32")])
    db.create_relationship(Relationship("R", "Node", ("Id",), "Node", ("Up",)))
    db.insert("Node", [(1, None), (2, 1)])
    with pytest.raises(ConstraintError):
        db.update("Node", "Id", 1, {"Id": 9})
    assert db.update("Node", "Id", 2, {"Id": 9}) == 1 and values(db.table("Node")) == [(1, None), (9, 1)]


def test_cascaded_keys_stay_unique(db):
    db.create_table("P", [Column("Id", "int32", primary=True)])
    db.create_table("C", [Column("A", "int32")], [Index("U", ("A",), unique=True)])
    db.insert("P", [(1,)])
    db.insert("C", [(1,), (5,)])
    db.create_relationship(Relationship("R", "P", ("Id",), "C", ("A",), cascade_updates=True))
    with pytest.raises(ConstraintError, match="Unique"):
        db.update("P", "Id", 1, {"Id": 5})
    assert values(db.table("C")) == [(1,), (5,)] and values(db.table("P")) == [(1,)]


def test_rename_keeps_rule_and_counter(db):
    db.create_table("T", [Column("Id", "int32", auto=True), Column("Score", "int32", rule=lambda c: c >= 0)])
    db.insert("T", [(None, 1), (None, 2)])
    db.delete("T", "Id", 2)
    db.rename_column("T", "Id", "Key")
    db.rename_column("T", "Score", "Points")
    with pytest.raises(ConstraintError):
        db.insert("T", [(None, -5)])
    db.insert("T", [(None, 3)])
    assert values(db.table("T")) == [(1, 1), (3, 3)]


def test_failed_commit_leaves_nothing(spark, db):
    db.create_table("T", [Column("Id", "int32")])
    tx = db.begin()
    db.insert("T", [(1,)])
    Database.open(spark, db.storage.root).create_table("U", [Column("Id", "int32")])
    with pytest.raises(TransactionError):
        tx.commit()
    assert db.storage.names("data") == [] and not [n for n in db.storage.names() if n.startswith(".manifest")]


def test_versions_come_into_sight_whole(spark, db):
    assert not db.storage.commit(1, {"other": True}) and "format" in db.storage.manifest(1)
    assert db.storage.versions() == [1] and not [n for n in db.storage.names() if ".manifest" in n and "crc" not in n]


def test_locks_belong_to_their_writer(spark, db):
    loose = Database.open(spark, db.storage.root, respect_lock=False)
    with db.storage.lock():
        loose.create_table("T", [Column("Id", "int32")])
        assert db.storage.exists("writer.lock")
        with pytest.raises(LockError), Storage(spark, db.storage.root).lock(timeout=0.1):
            pass
        with Storage(spark, db.storage.root).lock(timeout=0.1, stale=-1):  # left behind by a dead writer
            pass
    assert not db.storage.exists("writer.lock")


def test_only_touched_files_are_rewritten(spark, db):
    db.create_table("T", [Column("Id", "int64", primary=True), Column("V", "text")])
    db.insert("T", spark.range(1000).repartitionByRange(5, "id").selectExpr("id as Id", "'x' as V"))
    folder = db.entry("T")["folders"][0]
    path = db.storage.qualified(folder)
    before = {n: os.path.getmtime(f"{path.removeprefix('file:')}/{n}") for n in os.listdir(path.removeprefix("file:"))}
    assert db.update("T", "Id", 500, {"V": "new"}) == 1 and db.delete("T", "Id", 10) == 1
    entry = db.entry("T")
    assert folder in entry["folders"] and len(entry["without"][folder]) == 2 and entry["rows"] == 999 == db.real_row_count("T")
    assert {n: os.path.getmtime(f"{path.removeprefix('file:')}/{n}") for n in before} == before
    assert values(db.table("T").filter("V = 'new'")) == [(500, "new")] and db.table("T").filter("Id = 10").isEmpty()
    assert db.delete("T", "V", "x") == 998 and db.real_row_count("T") == 1 and folder not in db.entry("T")["folders"]


def test_compact_clusters_and_vacuum_reclaims(spark, db):
    db.create_table("T", [Column("Id", "int64", primary=True), Column("V", "text")])
    for k in range(4):
        db.insert("T", spark.range(500).selectExpr(f"id * 4 + {k} as Id", "'x' as V").orderBy(F.rand(1)))
    db.delete("T", "Id", 3)
    db.rename_column("T", "V", "W")
    db.compact("T")
    assert len(db.entry("T")["folders"]) == 1 and db.real_row_count("T") == 1999 and db.table("T").columns == ["Id", "W"]
    found = db.lookup("T", id=1234)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(Id,1234)" in plan and "row_index" not in plan and values(found) == [(1234, "x")]
    ranges = db.stored(db.entry("T")).groupBy("__file").agg(F.min("Id").alias("a"), F.max("Id").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(ranges, ranges[1:], strict=False))
    assert db.vacuum() == 5 and db.real_row_count("T") == 1999 and db.storage.versions() == [db.version]
    assert db.vacuum() == 0 and Database.open(spark, db.storage.root).real_row_count("T") == 1999


def test_checks_read_only_the_key_range(spark, db):
    db.create_table("T", [Column("Id", "int64", primary=True)])
    db.insert("T", spark.range(100).selectExpr("id as Id"))
    from granary.operators.constraints import in_range

    rows = spark.createDataFrame([(7,), (9,)], "Id long")
    held = in_range(db.table("T"), ["id"], rows, ["Id"])
    assert held.count() == 3 and "GreaterThanOrEqual(Id,7)" in held._jdf.queryExecution().executedPlan().toString()
    began = time.time()
    with pytest.raises(ConstraintError, match="Unique"):
        db.insert("T", rows)
    assert time.time() - began < 60
