"""Update and delete as projections and filters over a relation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.errors import StoreError
from granary.functions import convert, types


def find(columns: list[types.Column], name: str) -> types.Column:
    for c in columns:
        if c.name.lower() == name.lower():
            return c
    raise StoreError(f"no column {name}")


def equals(columns: list[types.Column], name: str, value: Any) -> SparkColumn:
    """The predicate of updates and deletes: null-safe, case-sensitive, and false for a value of another type than the column's."""
    column = find(columns, name)
    if not types.value_matches(column, value):
        return F.lit(False)
    return F.col(f"`{column.name}`").eqNullSafe(F.lit(value).cast(column.spark))


def updated(df: DataFrame, columns: list[types.Column], match: SparkColumn, changes: dict[str, Any]) -> DataFrame:
    """df with new values, clipped to size, in the rows that match; a column expression is taken as it is."""
    new = {}
    for name, value in changes.items():
        c = find(columns, name)
        x = value if isinstance(value, SparkColumn) else F.lit(value)
        new[c.name] = F.when(match, convert.clipped(x.cast(c.spark), c)).otherwise(F.col(f"`{c.name}`"))
    return df.withColumns(new)


def remaining(df: DataFrame, match: SparkColumn) -> DataFrame:
    """The rows that a delete leaves; a predicate that is null matches nothing."""
    return df.filter(~F.coalesce(match, F.lit(False)))


def same_text(df: DataFrame, parts: dict[str, Any]) -> SparkColumn:
    """All of several columns equal a value in text form, without case; null is the empty text."""
    met = F.lit(True)
    for name, value in parts.items():
        met = met & (F.lower(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) == ("" if value is None else str(value)).lower())
    return met
