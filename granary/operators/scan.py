"""Scans: typed rows, rows shaped for a target class, and rows as texts."""

from __future__ import annotations

import dataclasses
import typing
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import convert, types

SPARK = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), datetime: T.TimestampNTZType(), Decimal: T.DecimalType(28, 4)}
#: What an unmatched or null property of each type holds.
BLANK = {bool: False, int: 0, float: 0.0, Decimal: Decimal(0)}


def shaped(df: DataFrame, target: type | T.StructType) -> DataFrame:
    """df for a dataclass or a Spark schema: properties are bound to columns by case-insensitive name, only bound columns are read, and unmatched or null properties keep their default."""
    held, out = {c.lower(): c for c in df.columns}, []
    if isinstance(target, T.StructType):
        wanted = [(f.name, f.dataType, None) for f in target.fields]
    else:
        hints = typing.get_type_hints(target)
        wanted = []
        for f in dataclasses.fields(target):
            options = [a for a in typing.get_args(hints[f.name]) if a is not type(None)]
            kind = options[0] if options else hints[f.name]
            default = f.default if f.default is not dataclasses.MISSING else None if options else BLANK.get(kind)
            wanted.append((f.name, SPARK[kind], default))
    for name, kind, default in wanted:
        x = F.lit(None).cast(kind)
        if name.lower() in held:
            x = F.col(f"`{held[name.lower()]}`")
            x = convert.hyperlink_text(x) if df.schema[held[name.lower()]].dataType == types.HYPERLINK and kind == T.StringType() else x.cast(kind)
        out.append((x if default is None else F.coalesce(x, F.lit(default).cast(kind))).alias(name))
    return df.select(*out)


def as_strings(df: DataFrame, columns: list[types.Column]) -> DataFrame:
    return df.select(*[convert.as_text(F.col(f"`{c.name}`"), c).alias(c.name) for c in columns])
