"""The table store: catalog, rows, constraints, relationships, transactions, schema changes, nested columns, links."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from decimal import Decimal

import pytest
from granary.errors import ConstraintError, LockError, StoreError, TransactionError, UnknownTable
from granary.functions.types import Column
from granary.operators.relations import Relationship
from granary.sources.database import Database, Index
from granary.sources.links import LinkPolicy
from pyspark.sql import functions as F


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, f"file://{tmp_path}/db")


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns[:1]).collect()]


def test_create_open_and_catalog(spark, tmp_path, db):
    with pytest.raises(FileExistsError):
        Database.create(spark, db.storage.root)
    with pytest.raises(FileNotFoundError):
        Database.open(spark, f"{tmp_path}/none")
    db.create_table("Items", [Column("Id", "int32", primary=True), Column("Name", "text", size=5), Column("Price", "decimal", precision=18, scale=4, default=Decimal("1.5000"))], [Index("ByName", ("Name",), descending=("Name",))])
    db.insert("items", [(1, "abcdefgh", None), (2, None, Decimal("2"))])
    again = Database.open(spark, db.storage.root)
    assert again.list_tables() == ["Items"]
    assert values(again.table("ITEMS")) == [(1, "abcde", Decimal("1.5000")), (2, None, Decimal("2.0000"))]
    assert values(again.rows_as_strings("items")) == [("1", "abcde", "1.5000"), ("2", "", "2.0000")]
    assert values(again.table_stats()) == [("Items", 2, 3)] and again.real_row_count("Items") == 2 and again.real_row_count("none") == 0
    meta = {r.name: r for r in again.column_metadata("Items").collect()}
    assert (meta["Id"].nullable, meta["Name"].size, meta["Price"].default_value, meta["Price"].type_name) == (False, "5 chars", "1.5000", "Decimal")
    assert {r.name: (r.kind, r.is_unique, r.key_columns) for r in again.index_metadata("Items").collect()} == {"ByName": ("normal", False, ["Name desc"]), "PrimaryKey": ("primary", True, ["Id asc"])}
    assert again.statistics()["total_rows"] == 2 and again.statistics()["bytes"] > 0
    assert again.table("unknown").count() == 0
    with pytest.raises(UnknownTable):
        again.table("unknown", missing="raise")
    assert [r.name for r in again.table("SysObjects").collect()] == ["Items"] and again.table("SysColumns").count() == 3
    with pytest.raises(StoreError):
        db.create_table("ITEMS", [Column("A", "int32")])
    db.drop_table("items")
    assert db.list_tables() == []
    with pytest.raises(UnknownTable):
        db.drop_table("items")


def test_types_round_trip(db):
    db.create_table("T", [Column("I", "int32"), Column("S", "text", size=100), Column("D", "datetime"), Column("X", "double"), Column("B", "bool"), Column("Y", "byte"), Column("G", "guid"), Column("Raw", "binary", size=3)])
    when = datetime.datetime(2025, 6, 15, 10, 30)
    db.insert("T", [(42, "Test Value", when, 3.14, True, 255, "a" * 36, b"abcd"), (None, "", None, None, None, None, None, None)])
    assert values(db.table("T"), F.desc("I")) == [(42, "Test Value", when, 3.14, True, 255, "a" * 36, b"abc"), (None, "", None, None, False, None, None, None)]
    assert values(db.rows_as_strings("T"), F.desc("I"))[0] == ("42", "Test Value", "2025-06-15 10:30:00", "3.14", "True", "255", "{" + "a" * 36 + "}", "616263")
    with pytest.raises(Exception, match="byte"):
        db.insert("T", [(1, None, None, None, None, 256, None, None)])
    assert db.real_row_count("T") == 2


def test_shaped_rows(db):
    @dataclass
    class Item:
        ID: int
        name: str | None
        Missing: int = 7

    db.create_table("T", [Column("Id", "int32"), Column("Name", "text"), Column("Other", "memo")])
    db.insert("T", [Item(1, "a"), {"id": 2}])
    assert values(db.rows("T", Item)) == [(1, "a", 7), (2, None, 7)]
    assert "Other" not in db.rows("T", Item)._jdf.queryExecution().executedPlan().toString()


def test_defaults_rules_and_not_null(db):
    db.create_table("T", [Column("Id", "int32", nullable=False), Column("Score", "int32", default=42, rule=lambda c: (c >= 0) & (c <= 100))])
    db.insert("T", [(1, None), (2, 7)])
    assert values(db.table("T")) == [(1, 42), (2, 7)]
    for bad in [(None, 1)], [(3, 250)], [(3, 1), (4, -1)]:
        with pytest.raises(ConstraintError):
            db.insert("T", bad)
    with pytest.raises(ConstraintError):
        db.update("T", "Id", 1, {"Score": 101})
    assert db.real_row_count("T") == 2


def test_counters(db):
    db.create_table("T", [Column("Id", "int32", auto=True), Column("Label", "text", size=50)])
    db.insert("T", [(None, "a"), (None, "b")])
    assert {r[0] for r in values(db.table("T"))} == {1, 2}
    assert db.delete("T", "Label", "a") + db.delete("T", "Label", "b") == 2
    db.insert("T", [(None, "c")])
    db.insert("T", [(9, "d"), (None, "e")])
    assert sorted(r[0] for r in values(db.table("T")))[0] == 3 and db.real_row_count("T") == 3
    db.insert("T", [(None, "f")])
    assert max(r[0] for r in values(db.table("T"))) == 10


def test_unique_keys(db):
    db.create_table("T", [Column("A", "text"), Column("B", "int32")], [Index("U", ("A", "B"), unique=True)])
    db.insert("T", [("x", 1), ("x", None), ("y", 1)])
    for bad in [("X", 1)], [("x", None)], [("z", 1), ("Z", 1)]:
        with pytest.raises(ConstraintError, match="Unique"):
            db.insert("T", bad)
    with pytest.raises(ConstraintError, match="Unique"):
        db.update("T", "A", "y", {"A": "x"})
    assert db.update("T", "A", "y", {"A": "w"}) == 1
    for bad in (Index("I", ()), Index("I", ("A", "a")), Index("I", ("C",)), Index("I", ("A",), descending=("B",))):
        with pytest.raises(StoreError):
            db.create_table("V", [Column("A", "text"), Column("B", "int32")], [bad])


def test_predicates_are_exact(db):
    db.create_table("T", [Column("Id", "int32"), Column("Name", "text"), Column("X", "double")])
    db.insert("T", [(1, "a", 1.0), (2, None, None)])
    assert db.update("T", "Id", 1.0, {"Name": "z"}) == 0 and db.update("T", "Id", True, {"Name": "z"}) == 0 and db.update("T", "Name", "A", {"Id": 5}) == 0
    assert db.update("T", "Name", None, {"Name": "n"}) == 1 and db.update("T", "Id", 1, {}) == 0
    with pytest.raises(StoreError):
        db.update("T", "Nope", 1, {"Id": 1})
    with pytest.raises(StoreError):
        db.update("T", "Id", 1, {"Nope": 1})
    assert db.delete("T", "X", None) == 1 and values(db.table("T")) == [(1, "a", 1.0)]


def family(db, **flags):
    db.create_table("Parent", [Column("Id", "int32", primary=True), Column("Code", "text")])
    db.create_table("Child", [Column("Id", "int32"), Column("ParentId", "int32")])
    db.create_table("Grand", [Column("Id", "int32"), Column("ChildId", "int32")])
    db.create_relationship(Relationship("PC", "Parent", ("Id",), "Child", ("ParentId",), **flags))
    db.create_relationship(Relationship("CG", "Child", ("Id",), "Grand", ("ChildId",), **flags))
    db.insert("Parent", [(1, "a"), (2, "b")])
    db.insert("Child", [(10, 1), (11, 2), (12, None)])
    db.insert("Grand", [(100, 10), (101, 11)])


def test_restricting(db):
    family(db)
    for change in (lambda: db.insert("Child", [(13, 3)]), lambda: db.delete("Parent", "Id", 1), lambda: db.update("Parent", "Id", 1, {"Id": 5}), lambda: db.update("Child", "Id", 12, {"ParentId": 9})):
        with pytest.raises(ConstraintError):
            change()
    assert db.delete("Grand", "Id", 100) == 1 and db.delete("Child", "Id", 10) == 1 and db.delete("Parent", "Id", 1) == 1
    db.drop_relationship("pc")
    db.insert("Child", [(13, 3)])
    assert {r.name for r in db.relationships()} == {"CG"}
    db.rename_relationship("CG", "Other")
    with pytest.raises(StoreError):
        db.drop_relationship("CG")


def test_cascading(db):
    family(db, cascade_updates=True, cascade_deletes=True)
    assert db.update("Parent", "Id", 1, {"Id": 5}) == 1
    assert values(db.table("Child")) == [(10, 5), (11, 2), (12, None)]
    assert db.delete("Parent", "Id", 5) == 1
    assert values(db.table("Child")) == [(11, 2), (12, None)] and values(db.table("Grand")) == [(101, 11)]
    assert values(db.table_stats()) == [("Child", 2, 2), ("Grand", 1, 2), ("Parent", 1, 2)]


def test_self_reference_and_cycles(db):
    db.create_table("Node", [Column("Id", "int32", primary=True), Column("Up", "int32")])
    db.create_relationship(Relationship("R", "Node", ("Id",), "Node", ("Up",), cascade_deletes=True))
    db.insert("Node", [(1, None), (2, 1), (3, 2)])
    with pytest.raises(ConstraintError):
        db.insert("Node", [(5, 4), (4, 1)])
    db.update("Node", "Id", 1, {"Up": 3})
    assert db.delete("Node", "Id", 2) == 1 and db.real_row_count("Node") == 0


def test_unenforced_and_text_keys(db):
    db.create_table("P", [Column("Code", "text", size=32)])
    db.create_table("C", [Column("Id", "int32"), Column("Code", "text", size=32)])
    db.create_relationship(Relationship("R", "P", ("Code",), "C", ("Code",)))
    db.insert("P", [("Abc",)])
    db.insert("C", [(1, "aBC")])
    db.drop_relationship("R")
    db.create_relationship(Relationship("R", "P", ("Code",), "C", ("Code",), enforce=False))
    db.insert("C", [(2, "none")])
    for bad in (Relationship("R", "P", ("Code",), "C", ("Code",)), Relationship("S", "P", ("Code",), "C", ()), Relationship("S", "P", ("No",), "C", ("Id",))):
        with pytest.raises(StoreError):
            db.create_relationship(bad)


def test_schema_changes(db):
    db.create_table("T", [Column("Id", "int32"), Column("Name", "text", size=50)])
    db.insert("T", [(1, "a")])
    db.add_column("T", Column("Score", "int32", default=5))
    db.insert("T", [(2, "b", None)])
    assert values(db.table("T")) == [(1, "a", None), (2, "b", 5)]
    db.rename_column("T", "name", "Title")
    db.insert("T", [(3, "c", 6)])
    assert db.table("T").columns == ["Id", "Title", "Score"] and [r[1] for r in values(db.table("T"))] == ["a", "b", "c"]
    assert db.update("T", "Title", "a", {"Score": 9}) == 1
    db.drop_column("T", "Title")
    db.add_column("T", Column("Title", "text"))
    assert values(db.table("T")) == [(1, 9, None), (2, 5, None), (3, 6, None)]
    for bad in (lambda: db.add_column("T", Column("ID", "int32")), lambda: db.drop_column("T", "Nope"), lambda: db.rename_column("T", "Id", "Score"), lambda: db.create_table("E", [])):
        with pytest.raises(StoreError):
            bad()
    db.drop_column("T", "Title")
    db.drop_column("T", "Score")
    with pytest.raises(StoreError):
        db.drop_column("T", "Id")


def test_transactions(spark, db):
    db.create_table("T", [Column("Id", "int32", primary=True)])
    tx = db.begin()
    db.insert("T", [(1,)])
    with pytest.raises(TransactionError):
        db.begin()
    with pytest.raises(ConstraintError):
        db.insert("T", [(1,)])
    assert db.real_row_count("T") == 1 and Database.open(spark, db.storage.root).real_row_count("T") == 0
    tx.rollback()
    assert db.real_row_count("T") == 0
    with pytest.raises(TransactionError):
        tx.commit()
    with db.begin():
        db.insert("T", [(1,)])
        db.delete("T", "Id", 1)
        db.insert("T", [(2,), (3,)])
    assert Database.open(spark, db.storage.root).real_row_count("T") == 2
    with pytest.raises(KeyError), db.begin():
        db.insert("T", [(4,)])
        raise KeyError
    assert db.real_row_count("T") == 2


def test_two_writers(spark, db):
    other = Database.open(spark, db.storage.root, lock_timeout=0.2)
    db.create_table("T", [Column("Id", "int32")])
    with pytest.raises(TransactionError):
        other.create_table("U", [Column("Id", "int32")])
    late = Database.open(spark, db.storage.root, lock_timeout=0.2)
    with db.storage.lock(), pytest.raises(LockError):
        late.create_table("U", [Column("Id", "int32")])


def test_nested_columns(db):
    db.create_table("T", [Column("Id", "int32", primary=True), Column("Files", "attachment"), Column("Tags", "multivalue", element="text"), Column("Link", "hyperlink")])
    db.insert("T", [(1, None, None, None), (2, [], ["x"], None)])
    db.add_items("T", "Tags", {"id": "1"}, ["a", "b"])
    db.add_items("T", "Files", {"Id": 2}, [{"file_name": "f.txt", "file_data": b"hello"}])
    with pytest.raises(StoreError):
        db.add_items("T", "Tags", {"Id": 9}, ["a"])
    assert values(db.multi_values("T", "Tags"), "Id", "value") == [(1, "a"), (1, "b"), (2, "x")]
    got = db.attachments("T", "Files").collect()
    assert [(r.Id, r.file_name, bytes(r.file_data)) for r in got] == [(2, "f.txt", b"hello")]
    assert [r.kind for r in db.complex_columns("T").orderBy("name").collect()] == ["attachment", "multivalue"]
    db.delete("T", "Id", 2)
    assert db.attachments("T", "Files").count() == 0


def test_external_tables_and_links(spark, tmp_path, db):
    spark.range(5).selectExpr("id as K", "cast(id as string) as V").write.parquet(f"{tmp_path}/ext")
    db.register("Ext", f"file://{tmp_path}/ext", primary=["K"])
    assert db.update("Ext", "K", 3, {"V": "new"}) == 1 and db.delete("Ext", "V", "0") == 1
    assert values(db.table("Ext")) == [(1, "1"), (2, "2"), (3, "new"), (4, "4")]
    assert spark.read.parquet(f"{tmp_path}/ext").count() == 5
    host = Database.create(spark, f"file://{tmp_path}/host")
    host.create_link("Far", "db", "Ext")
    host.create_odbc_link("Odd", "DSN=x")
    assert host.table("far").count() == 4 and [x.connection for x in host.linked_tables() if x.is_odbc] == ["ODBC;DSN=x"]
    with pytest.raises(StoreError):
        host.table("Odd")
    host.create_link("Out", "../db", "Ext")
    with pytest.raises(StoreError):
        host.table("Out")
    open_host = Database.open(spark, host.storage.root, links=LinkPolicy(allowed=("file:///nowhere",)))
    with pytest.raises(StoreError):
        open_host.table("Far")
