"""Relationships: existence checks, and restricting or cascading updates and deletes."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.errors import ConstraintError, StoreError
from granary.operators.constraints import key
from granary.operators.staging import staged

#: A cascade that goes on for more levels is an error.
DEPTH = 64


@dataclass(frozen=True)
class Relationship:
    name: str
    parent: str
    parent_columns: tuple[str, ...]
    child: str
    child_columns: tuple[str, ...]
    enforce: bool = True
    cascade_updates: bool = False
    cascade_deletes: bool = False

    def checked(self) -> Relationship:
        if not self.name or not self.parent_columns or len(self.parent_columns) != len(self.child_columns):
            raise StoreError("a relationship has a name and equally many columns on both sides")
        return self

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(held: dict) -> Relationship:
        return Relationship(**held | {"parent_columns": tuple(held["parent_columns"]), "child_columns": tuple(held["child_columns"])})


def keyed(df: DataFrame, names: tuple[str, ...], prefix: str) -> tuple[list[SparkColumn], list[str]]:
    aliases = [f"__{prefix}{i}" for i in range(len(names))]
    return [k.alias(a) for k, a in zip(key(df, list(names)), aliases, strict=True)], aliases


def matching(child: DataFrame, child_columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...], how: str) -> DataFrame:
    """Rows of child whose key is (left_semi) or isn't (left_anti) among parent's; a null part never equals anything."""
    parts, names = keyed(parent, parent_columns, "p")
    met = F.lit(True)
    for k, n in zip(key(child, list(child_columns)), names, strict=True):
        met = met & (k == F.col(n))
    return child.join(parent.select(*parts), met, how)


def orphans(child: DataFrame, child_columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...]) -> DataFrame:
    """Rows of child with a whole key that parent lacks; a null part exempts a row."""
    whole = F.lit(True)
    for n in child_columns:
        whole = whole & F.col(f"`{n}`").isNotNull()
    return matching(child.filter(whole), child_columns, parent, parent_columns, "left_anti")


def orphans_in_order(batch: DataFrame, child_columns: tuple[str, ...], stored: DataFrame, parent_columns: tuple[str, ...], order: str) -> DataFrame:
    """For a table that refers to itself: a batch row's parent may be stored or be an earlier row (by order) of the batch."""
    left = orphans(batch, child_columns, stored, parent_columns)
    parts, names = keyed(batch, parent_columns, "p")
    met = F.col("__earlier") < F.col(order)
    for k, n in zip(key(left, list(child_columns)), names, strict=True):
        met = met & (k == F.col(n))
    return left.join(batch.select(*parts, F.col(order).alias("__earlier")), met, "left_anti")


def cascade_deletes(tables: dict[str, DataFrame], relationships: list[Relationship], table: str, doomed: DataFrame, identity: list[str]) -> dict[str, DataFrame]:
    """Rows to delete per table, starting from doomed rows of one. Rows are told apart by the identity columns.

    Each level is one semi-join per relationship and is written before the next,
    so a cycle ends when no new row turns up. A relationship that doesn't cascade
    raises if any row still depends on a deleted one.
    """
    gone = {table: doomed}
    frontier = dict(gone)
    for _ in range(DEPTH + 1):
        following: dict[str, DataFrame] = {}
        for r in relationships:
            parent, child = r.parent.lower(), r.child.lower()
            if not r.enforce or parent not in frontier or child not in tables or not has(tables[parent], r.parent_columns) or not has(tables[child], r.child_columns):
                continue
            found = matching(tables[child], r.child_columns, frontier[parent], r.parent_columns, "left_semi")
            for known in (gone.get(child), following.get(child)):
                if known is not None:
                    found = found.join(known.select(*identity), identity, "left_anti")
            found = staged(found)
            n = found.count()
            if not n:
                continue
            if not r.cascade_deletes:
                raise ConstraintError(f"{r.name}: {n} rows of {r.child} depend on the rows to delete")
            following[child] = found if child not in following else following[child].unionByName(found)
        if not following:
            return gone
        for name, rows in following.items():
            gone[name] = rows if name not in gone else gone[name].unionByName(rows)
        frontier = following
    raise ConstraintError(f"a cascade of more than {DEPTH} levels")


def has(df: DataFrame, names: tuple[str, ...]) -> bool:
    held = {c.lower() for c in df.columns}
    return all(n.lower() in held for n in names)


def rekeyed(child: DataFrame, child_columns: tuple[str, ...], changed: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """child with its key columns moved from old to new values; one level only, as grandchildren aren't touched. changed has one row per old key."""
    parts, names = keyed(changed, tuple(old), "o")
    table = changed.select(*parts, *[F.col(n).alias(f"__n{i}") for i, n in enumerate(new)], F.lit(True).alias("__moved"))
    met = F.lit(True)
    for k, n in zip(key(child, list(child_columns)), names, strict=True):
        met = met & (k == F.col(n))
    joined = child.join(table, met, "left")
    held = dict(zip([c.lower() for c in child_columns], range(len(new)), strict=True))
    return joined.select(
        *[F.when(F.col("__moved"), F.col(f"__n{held[c.lower()]}").cast(child.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c.lower() in held else F.col(f"`{c}`") for c in child.columns]
    )
