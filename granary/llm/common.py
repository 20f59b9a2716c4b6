"""Shared pieces: staging in the cluster's shared folder, from the library itself, and text normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.staging import forget, shared_folder, staged

__all__ = ["ASCII_LOWER", "LOWER", "UPPER", "ascii_lower", "forget", "shared_folder", "spread_join", "staged"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. All-ASCII texts take the fast built-in; the result is the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: A group with more than this share of all rows is heavy; there are at most so many heavy groups as it goes into 1.
HEAVY = 1 / 500


def spread_join(rows: DataFrame, classes: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with the one row of classes that has their key; classes[size] says how many rows have it.

    Rows of heavy groups are joined where they are, by broadcasting the classes
    of these groups, of which there are 1 / HEAVY at most; only the others are
    shuffled by their key. classes should be staged, as it is read three times.
    """
    total = classes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    heavy = F.col(size) > total * HEAVY
    few, many = F.broadcast(classes.filter(heavy)), classes.filter(~heavy)
    there = rows.join(few, key)
    rest = rows.join(F.broadcast(classes.filter(heavy).select(key)), key, "left_anti").join(many, key)
    return there.unionByName(rest)
