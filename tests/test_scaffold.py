"""Scaffolded dataclasses."""

from granary.functions.types import Column
from granary.operators import scan
from granary.sources import scaffold


def test_module_runs_and_shapes_rows(spark):
    tables = {
        "order details": [Column("Id", "int32", primary=True), Column("Unit Price", "currency"), Column("class", "text"), Column("Files", "attachment"), Column("Ok", "bool")],
        "Order-Details": [Column("a", "text", nullable=False), Column("A ", "double")],
    }
    text, held = scaffold.source(tables), {}
    exec(compile(text, "scaffolded", "exec"), held)
    row = held["OrderDetails"](Id=1, Ok=True)
    assert (row.UnitPrice, row.class_, row.Files) == (None, None, []) and "OrderDetails2" in held
    assert "Id: int\n" in text and "UnitPrice: Decimal | None = None" in text and "Ok: bool\n" in text

    simple = {}
    exec(compile(scaffold.source({"T": [Column("Id", "int64", primary=True), Column("Name", "text")]}), "t", "exec"), simple)
    got = scan.shaped(spark.createDataFrame([(1, "a")], "ID long, NAME string"), simple["T"]).first()
    assert (got.Id, got.Name) == (1, "a")
