"""Attachments and multi-value columns, kept as arrays in the row."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import types


def flat(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per item: the parent's key columns and the item's fields (attachments) or its value."""
    item = F.col("__item")
    rows = df.select(*keys, F.explode(f"`{column}`").alias("__item"))
    if isinstance(rows.schema["__item"].dataType, type(types.ATTACHMENT)):
        return rows.select(*keys, "__item.*")
    return rows.select(*keys, item.alias("value"))


def gathered(children: DataFrame, keys: list[str], value: str, column: str) -> DataFrame:
    """The inverse: one row per parent with its items as a sorted array. A parent's items must fit one row, as the column's do."""
    return children.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(column))


def appended(df: DataFrame, column: str, match, items: list[Any]) -> DataFrame:
    """df with items added to the array of the matching rows."""
    kind = df.schema[column].dataType
    new = F.array(*[F.lit(i) if not isinstance(i, dict) else F.struct(*[F.lit(i.get(f.name)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields]) for i in items]).cast(kind)
    return df.withColumn(column, F.when(match, F.concat(F.coalesce(F.col(f"`{column}`"), F.array().cast(kind)), new)).otherwise(F.col(f"`{column}`")))
