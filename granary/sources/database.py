"""A database: a folder of Parquet snapshots under versioned manifests.

A manifest names, for each table, the folders that hold its rows, and files of
them that no longer count; a change writes new folders and then publishes the
next manifest in one step, so readers see whole versions and a failed change
leaves nothing behind. Inserts only add a folder. Updates and deletes rewrite
only the files with matching rows; ``compact`` writes a table anew, in order of
its primary key, and ``vacuum`` removes what no kept version names.
"""

from __future__ import annotations

import copy
import dataclasses
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ConstraintError, StoreError, TransactionError, UnknownTable
from granary.functions import convert, types
from granary.functions.types import Column
from granary.operators import constraints, dml, nested, relations, scan
from granary.operators.relations import Relationship
from granary.sources.links import Link, LinkPolicy, odbc_connection
from granary.sources.storage import Storage

MAX_KEY_COLUMNS = 10
FORMATS = ("v3", "v4", "v5")
IDENTITY = ["__file", "__row"]
#: Files that one change may take out of a folder one by one; beyond, the folder's other rows are rewritten too, so that a manifest stays small.
FILES = 2000
SYSTEM = ("sysobjects", "syscolumns", "sysindexes", "sysrelationships", "syscomplexcolumns")


@dataclasses.dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    primary: bool = False
    descending: tuple[str, ...] = ()
    ignore_nulls: bool = False
    required: bool = False

    def to_json(self) -> dict:
        return dataclasses.asdict(self)

    @staticmethod
    def from_json(held: dict) -> Index:
        return Index(**held | {"columns": tuple(held["columns"]), "descending": tuple(held["descending"])})


class Database:
    def __init__(self, spark: SparkSession, path: str, links: LinkPolicy | None = None, strict: bool = True, respect_lock: bool = True, lock_timeout: float = 5.0):
        self.spark, self.storage, self.links, self.strict = spark, Storage(spark, path), links or LinkPolicy(), strict
        self.respect_lock, self.lock_timeout = respect_lock, lock_timeout
        versions = self.storage.versions()
        if not versions:
            raise FileNotFoundError(f"no database at {path}")
        self.version = versions[-1]
        self.manifest = self.storage.manifest(self.version)
        self.draft: dict | None = None
        self.rules: dict[tuple[str, str], Any] = {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, fmt: str = "v5", **options) -> Database:
        if fmt not in FORMATS:
            raise StoreError(f"unknown format {fmt}")
        storage = Storage(spark, path)
        if storage.versions() or not storage.commit(1, {"format": fmt, "tables": {}, "relationships": [], "links": []}):
            raise FileExistsError(path)
        return cls(spark, path, **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Database:
        return cls(spark, path, **options)

    # Catalog

    @property
    def state(self) -> dict:
        return self.draft if self.draft is not None else self.manifest

    def entry(self, name: str, missing: str = "raise") -> dict | None:
        found = self.state["tables"].get(name.lower())
        if found is None and missing == "raise":
            raise UnknownTable(f"no table {name}")
        return found

    def columns(self, name: str) -> list[Column]:
        entry = self.entry(name)
        return [dataclasses.replace(c, rule=self.rules.get((name.lower(), c.name.lower()))) for c in map(Column.from_json, entry["columns"])]

    def list_tables(self) -> list[str]:
        return [t["name"] for t in self.state["tables"].values()]

    def linked_tables(self) -> list[Link]:
        return [Link(**held) for held in self.state["links"]]

    def indexes(self, name: str) -> list[Index]:
        return [Index.from_json(i) for i in self.entry(name)["indexes"]]

    def relationships(self) -> list[Relationship]:
        return [Relationship.from_json(r) for r in self.state["relationships"]]

    def register(self, name: str, path: str, primary: Iterable[str] = ()) -> None:
        """Take an existing Parquet table into the catalog without copying it; its first change writes a snapshot of its own."""
        frame = self.spark.read.parquet(path)
        keys = {k.lower() for k in primary}
        cols = [dataclasses.replace(types.from_spark(f), primary=f.name.lower() in keys) for f in frame.schema.fields]
        with self.change() as m:
            self.free(m, name)
            m["tables"][name.lower()] = {"name": name, "columns": [c.to_json() for c in cols], "indexes": key_index([], cols), "folders": [Storage(self.spark, path).root], "rows": frame.count(), "high": {}, "external": True}

    # Reading

    def table(self, name: str | None = None, missing: str = "empty") -> DataFrame:
        """Typed rows. Without a name the first table; an unknown one falls back to a link, then is empty or raises."""
        if name is None:
            names = self.list_tables()
            return self.table(names[0], missing) if names else self.empty([])
        entry = self.entry(name, "none")
        if entry is None and name.lower() in SYSTEM:
            return self.system_table(name)
        if entry is None:
            link = next((x for x in self.linked_tables() if x.name.lower() == name.lower()), None)
            if link is not None:
                return self.linked(link)
            if missing == "raise":
                raise UnknownTable(f"no table {name}")
            return self.empty([])
        return self.stored(entry, place=False).select(*[f"`{c.name}`" for c in self.columns(name)])

    def empty(self, columns: list[Column]) -> DataFrame:
        return self.spark.createDataFrame([], types.schema(columns))

    def stored(self, entry: dict, folders: list[str] | None = None, place: bool = True) -> DataFrame:
        """Rows of an entry, by default with their place. Columns that a folder was written without read as null."""
        columns = [Column.from_json(c) for c in entry["columns"]]
        folders = entry["folders"] if folders is None else folders
        if not folders:
            return self.empty(columns).withColumns({"__file": F.lit(""), "__row": F.lit(0).cast("long")})
        renamed, frames = entry.get("renames", {}), {}
        for folder in folders:  # folders written under the same column names are one scan
            names = tuple(renamed.get(folder, {}).get(c.name, c.name) for c in columns)
            frames.setdefault(names, []).append(folder)
        out = None
        for names, group in frames.items():
            kinds = T.StructType([T.StructField(n, c.spark) for n, c in zip(names, columns, strict=True)])
            rows = self.spark.read.schema(kinds).parquet(*map(self.storage.qualified, group))
            gone = [uri for f in group for uri in self.gone(entry, f)]
            if gone:  # Spark prunes whole files by this
                rows = rows.filter(~F.col("_metadata.file_path").isin(gone))
            where = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")] if place else []
            rows = rows.select(*[F.col(f"`{n}`").alias(c.name) for n, c in zip(names, columns, strict=True)], *where)
            out = rows if out is None else out.unionByName(rows)
        return out

    def gone(self, entry: dict, folder: str) -> list[str]:
        """The files of a folder that no longer count, as Spark names them."""
        names = entry.get("without", {}).get(folder, [])
        return [f"{self.storage.uri(folder)}/{n}" for n in names] if names else []

    def linked(self, link: Link) -> DataFrame:
        if link.kind == "odbc":
            raise StoreError(f"{link.name}: an ODBC link is a catalog row only; read it with spark.read.format('jdbc')")
        source = self.links.resolve(self.storage.root, link.source)
        if link.kind == "text":
            return self.spark.read.option("header", True).csv(source)
        return Database(self.spark, source, links=self.links).table(link.foreign or link.name, missing="raise")

    def rows(self, name: str, target: type | T.StructType | None = None) -> DataFrame:
        """Typed rows, or rows shaped for a dataclass or a schema."""
        return self.table(name) if target is None else scan.shaped(self.table(name), target)

    def rows_as_strings(self, name: str) -> DataFrame:
        return self.empty([]) if self.entry(name, "none") is None else scan.as_strings(self.table(name), self.columns(name))

    def read(self, name: str | None = None, limit: int | None = None) -> DataFrame:
        found = self.table(name)
        return found if limit is None else found.limit(limit)

    def watched(self, name: str) -> tuple[DataFrame, Observation]:
        """A table's rows and their observation: once an action over them ends, its `rows` says how many were read."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        return self.table(name, missing="raise").observe(seen, F.count(F.lit(1)).alias("rows")), seen

    def first_table(self, limit: int | None = None) -> DataFrame:
        names = self.list_tables()
        found = self.rows_as_strings(names[0]) if names else self.empty([])
        return found if limit is None else found.limit(limit)

    def read_all(self, as_strings: bool = False) -> dict[str, DataFrame]:
        return {n: self.rows_as_strings(n) if as_strings else self.table(n) for n in self.list_tables()}

    # Metadata

    def frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def table_stats(self) -> DataFrame:
        """(table_name, row_count, column_count) from the manifest's counters."""
        return self.frame([(t["name"], t["rows"], len(t["columns"])) for t in self.state["tables"].values()], "table_name string, row_count long, column_count int")

    def real_row_count(self, name: str) -> int:
        return 0 if self.entry(name, "none") is None else self.table(name).count()

    def column_metadata(self, name: str) -> DataFrame:
        schema = "name string, ordinal int, type_code int, type_name string, kind string, size string, precision int, scale int, nullable boolean, auto boolean, primary boolean, default_value string, rule string, rule_message string, description string, allow_empty boolean, element string, expression string"
        rows = []
        for k, c in enumerate(self.columns(name) if self.entry(name, "none") else []):
            code, shown, _ = types.KINDS[c.kind]
            exact = c.kind == "decimal"
            default = None if c.default is None else convert.expression_text(c.default)
            rows.append((c.name, k, code, shown, c.kind, types.size_text(c), c.precision if exact else None, c.scale if exact else None, not c.required, c.auto, c.primary, default, c.rule_text, c.rule_message, c.description, c.allow_empty, c.element, c.expression))
        return self.frame(rows, schema)

    def index_metadata(self, name: str) -> DataFrame:
        fk = {r.name: r for r in self.relationships() if r.child.lower() == name.lower()}
        rows = [(i.name, "primary" if i.primary else "normal", i.unique or i.primary, i.ignore_nulls, i.required or i.primary, False, False, False, [f"{c} {'desc' if c in i.descending else 'asc'}" for c in i.columns]) for i in self.indexes(name)]
        rows += [(r.name, "foreign key", False, False, False, True, r.cascade_updates, r.cascade_deletes, [f"{c} asc" for c in r.child_columns]) for r in fk.values()]
        return self.frame(rows, "name string, kind string, is_unique boolean, ignore_nulls boolean, required boolean, is_foreign_key boolean, cascade_updates boolean, cascade_deletes boolean, key_columns array<string>")

    def complex_columns(self, name: str) -> DataFrame:
        rows = [(c.name, k + 1, c.kind, c.element) for k, c in enumerate(self.columns(name)) if c.kind in ("attachment", "multivalue")]
        return self.frame(rows, "name string, complex_id int, kind string, element string")

    def statistics(self) -> dict[str, Any]:
        tables = self.state["tables"].values()
        return {
            "format": self.state["format"], "version": self.version, "table_count": len(tables), "total_rows": sum(t["rows"] for t in tables), "rows_by_table": {t["name"]: t["rows"] for t in tables},
            "bytes": sum(self.storage.size(f) for t in tables for f in t["folders"]),
        }

    def system_table(self, name: str) -> DataFrame:
        """The manifest as relations: SysObjects, SysColumns, SysIndexes, SysRelationships, SysComplexColumns."""
        kinds = {"database": 6, "odbc": 4, "text": 6}
        if name.lower() == "sysobjects":
            rows = [(t["name"], 1, None, None) for t in self.state["tables"].values()] + [(x.name, kinds[x.kind], x.source, x.connection) for x in self.linked_tables()]
            return self.frame(rows, "name string, type int, source string, connection string")
        if name.lower() == "sysrelationships":
            rows = [(r.name, k, r.child, c, r.parent, p, r.enforce, r.cascade_updates, r.cascade_deletes) for r in self.relationships() for k, (c, p) in enumerate(zip(r.child_columns, r.parent_columns, strict=True))]
            return self.frame(rows, "name string, icolumn int, child string, child_column string, parent string, parent_column string, enforce boolean, cascade_updates boolean, cascade_deletes boolean")
        each = {"syscolumns": self.column_metadata, "sysindexes": self.index_metadata, "syscomplexcolumns": self.complex_columns}.get(name.lower())
        if each is None:
            raise UnknownTable(f"no system table {name}")
        out = None
        for t in self.list_tables():
            rows = each(t).select(F.lit(t).alias("table_name"), "*")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.empty([])

    # Changing

    @contextmanager
    def change(self):
        """A draft of the manifest, published at the end: by the open transaction, or else as a version of its own. After an error it is dropped, with what was written for it."""
        before, self.wrote = self.draft, set()
        self.draft = copy.deepcopy(self.state)
        try:
            yield self.draft
            if before is None:
                self.publish(self.draft)
        except BaseException:
            for folder in self.wrote:
                self.storage.delete(folder)
            self.draft = before
            raise
        if before is None:
            self.draft = None
        else:
            self.pending |= self.wrote

    def publish(self, draft: dict) -> None:
        with self.storage.lock(self.lock_timeout, self.respect_lock):
            if not self.storage.commit(self.version + 1, draft):
                raise TransactionError("another writer has published a version since this one was read")
        self.version, self.manifest = self.version + 1, draft

    def begin(self) -> Transaction:
        if self.draft is not None:
            raise TransactionError("a transaction is open already")
        self.draft, self.pending = copy.deepcopy(self.manifest), set()
        return Transaction(self)

    def write(self, entry: dict, rows: DataFrame) -> tuple[str, int]:
        """A new folder with the rows, and how many there are."""
        folder = self.storage.folder(entry["name"])
        self.wrote.add(folder)
        path = self.storage.qualified(folder)
        names = [Column.from_json(c).name for c in entry["columns"]]
        rows = rows.select(*[f"`{n}`" for n in names])
        key = [f"`{c}`" for i in entry["indexes"] if i["primary"] for c in i["columns"]]
        (rows.sortWithinPartitions(*key) if key else rows).write.parquet(path)
        return folder, self.spark.read.schema(types.schema([Column.from_json(c) for c in entry["columns"]])).parquet(path).count()

    @staticmethod
    def free(m: dict, name: str) -> None:
        if name.lower() in m["tables"] or any(x["name"].lower() == name.lower() for x in m["links"]):
            raise StoreError(f"table {name} exists")

    # Definitions

    def create_table(self, name: str, columns: list[Column], indexes: list[Index] | None = None) -> None:
        if not columns:
            raise StoreError("a table has at least one column")
        lowered = [c.checked().name.lower() for c in columns]
        if len(set(lowered)) < len(lowered):
            raise StoreError("duplicate column names")
        checked = check_indexes(list(indexes or []), columns)
        keys = {c.lower() for i in checked if i["primary"] for c in i["columns"]}
        columns = [dataclasses.replace(c, primary=c.name.lower() in keys) for c in columns]
        with self.change() as m:
            self.free(m, name)
            m["tables"][name.lower()] = {"name": name, "columns": [c.to_json() for c in columns], "indexes": checked, "folders": [], "rows": 0, "high": {}, "external": False}
        self.rules |= {(name.lower(), c.name.lower()): c.rule for c in columns if c.rule is not None}

    def drop_table(self, name: str) -> None:
        with self.change() as m:
            self.entry(name)
            del m["tables"][name.lower()]

    def add_column(self, name: str, column: Column) -> None:
        """Appended last; existing rows are null there, whatever the default."""
        with self.change() as m:
            entry = self.entry(name)
            if any(c["name"].lower() == column.checked().name.lower() for c in entry["columns"]):
                raise StoreError(f"column {column.name} exists")
            taken = {f: {c["name"]: r.get(c["name"], c["name"]) for c in entry["columns"]} | {column.name: f"__none_{self.version}_{len(entry['columns'])}"} for f in entry["folders"] for r in [entry.get("renames", {}).get(f, {})]}
            entry["columns"].append(column.to_json())
            entry["renames"] = taken
            m["tables"][name.lower()] = entry
        if column.rule is not None:
            self.rules[name.lower(), column.name.lower()] = column.rule

    def drop_column(self, name: str, column: str) -> None:
        with self.change():
            entry = self.entry(name)
            gone = dml.find(self.columns(name), column).name
            if len(entry["columns"]) == 1:
                raise StoreError("the last column can't be dropped")
            if any(gone.lower() in (c.lower() for c in r["child_columns"] if r["child"].lower() == name.lower()) or gone.lower() in (c.lower() for c in r["parent_columns"] if r["parent"].lower() == name.lower()) for r in self.state["relationships"]):
                raise StoreError(f"a relationship uses {column}")
            entry["columns"] = [c for c in entry["columns"] if c["name"] != gone]
            entry["high"].pop(gone, None)
            entry["indexes"] = [i for i in entry["indexes"] if gone.lower() not in (c.lower() for c in i["columns"])]
        self.rules.pop((name.lower(), gone.lower()), None)

    def rename_column(self, name: str, old: str, new: str) -> None:
        """The rows aren't rewritten: the manifest keeps each folder's own names."""
        with self.change() as m:
            entry = self.entry(name)
            held = dml.find(self.columns(name), old).name
            if not new or any(c["name"].lower() == new.lower() and c["name"] != held for c in entry["columns"]):
                raise StoreError(f"column {new} exists")
            names = [c["name"] for c in entry["columns"]]
            before = entry.get("renames", {})
            entry["renames"] = {f: {(new if n == held else n): before.get(f, {}).get(n, n) for n in names} for f in entry["folders"]}
            entry["columns"] = [c | {"name": new} if c["name"] == held else c for c in entry["columns"]]
            if held in entry["high"]:
                entry["high"][new] = entry["high"].pop(held)
            swap = lambda cs: [new if c.lower() == held.lower() else c for c in cs]
            entry["indexes"] = [i | {"columns": swap(i["columns"]), "descending": swap(i["descending"])} for i in entry["indexes"]]
            for r in m["relationships"]:
                for side in ("parent", "child"):
                    if r[side].lower() == name.lower():
                        r[f"{side}_columns"] = swap(r[f"{side}_columns"])
        if (rule := self.rules.pop((name.lower(), held.lower()), None)) is not None:
            self.rules[name.lower(), new.lower()] = rule

    def create_relationship(self, r: Relationship) -> None:
        r.checked()
        for table, columns in ((r.parent, r.parent_columns), (r.child, r.child_columns)):
            for c in columns:
                dml.find(self.columns(table), c)
        with self.change() as m:
            if any(x["name"].lower() == r.name.lower() for x in m["relationships"]):
                raise StoreError(f"relationship {r.name} exists")
            m["relationships"].append(r.to_json())

    def drop_relationship(self, name: str) -> None:
        with self.change() as m:
            left = [r for r in m["relationships"] if r["name"].lower() != name.lower()]
            if len(left) == len(m["relationships"]):
                raise StoreError(f"no relationship {name}")
            m["relationships"] = left

    def rename_relationship(self, old: str, new: str) -> None:
        with self.change() as m:
            names = [r["name"].lower() for r in m["relationships"]]
            if old.lower() not in names or new.lower() in names:
                raise StoreError(f"can't rename {old} to {new}")
            m["relationships"][names.index(old.lower())]["name"] = new

    def create_link(self, name: str, source: str, foreign: str = "") -> None:
        self.add_link(Link(name, "database", source, foreign or name))

    def create_odbc_link(self, name: str, connection: str, foreign: str = "") -> None:
        self.add_link(Link(name, "odbc", "", foreign or name, odbc_connection(connection)))

    def create_text_link(self, name: str, source: str) -> None:
        self.add_link(Link(name, "text", source, name, "Text;"))

    def add_link(self, link: Link) -> None:
        with self.change() as m:
            self.free(m, link.name)
            m["links"].append(link.to_json())

    # Rows

    def insert(self, name: str, rows: DataFrame | list[Any]) -> int:
        """Defaults, counters, checks of nulls and rules, relationships and unique keys, then one append; all rows or none."""
        with self.change():
            entry, columns = self.entry(name), self.columns(name)
            if not isinstance(rows, DataFrame):
                rows = self.from_objects(rows, columns)
            self_reference = any(r.enforce and r.parent.lower() == r.child.lower() == name.lower() for r in self.relationships())
            if self_reference:
                rows = rows.withColumn("__order", F.monotonically_increasing_id())
            rows = constraints.with_defaults(constraints.coerced(rows, columns), columns)
            for c in columns:
                if c.auto:
                    rows = constraints.numbered(rows, c.name, self.high(entry, c))
            rows = constraints.staged(rows)
            count = constraints.check_rows(rows, columns)
            if not count:
                return 0
            for r in self.relationships():
                if r.enforce and r.child.lower() == name.lower() and self.resolves(r):
                    parent = constraints.in_range(self.table(r.parent), r.parent_columns, rows, r.child_columns)
                    bad = relations.orphans_in_order(rows, r.child_columns, parent, r.parent_columns, "__order") if r.parent.lower() == name.lower() else relations.orphans(rows, r.child_columns, parent, r.parent_columns)
                    if not bad.isEmpty():
                        raise ConstraintError(f"{r.name}: a row has no parent in {r.parent}")
            for i in self.indexes(name):
                if i.unique or i.primary:
                    constraints.check_unique(rows, constraints.in_range(self.table(name), i.columns, rows, i.columns), list(i.columns), i.name)
            folder, n = self.write(entry, rows)
            entry["folders"].append(folder)
            entry["rows"] += n
            for c in columns:
                if c.auto:
                    entry["high"][c.name] = max(self.high(entry, c), rows.agg(F.max(f"`{c.name}`")).first()[0] or 0)
            return n

    def from_objects(self, rows: list[Any], columns: list[Column]) -> DataFrame:
        """Tuples in column order, dicts or dataclass objects; unmatched properties are null."""
        def of(row: Any) -> tuple:
            if dataclasses.is_dataclass(row):
                row = dataclasses.asdict(row)
            if isinstance(row, dict):
                held = {k.lower(): v for k, v in row.items()}
                return tuple(held.get(c.name.lower()) for c in columns)
            if len(row) != len(columns):
                raise StoreError(f"a row has {len(row)} values for {len(columns)} columns")
            return tuple(row)

        return self.spark.createDataFrame([of(r) for r in rows], types.schema(columns))

    def high(self, entry: dict, column: Column) -> int:
        """The counter's last value: kept after deletes, and never below what the table holds."""
        if column.name not in entry["high"]:
            held = self.stored(entry).agg(F.max(f"`{column.name}`")).first()[0]
            entry["high"][column.name] = held or 0
        return entry["high"][column.name]

    def resolves(self, r: Relationship) -> bool:
        """A relationship whose table or columns are gone is skipped."""
        tables = self.state["tables"]
        held = lambda t: {c["name"].lower() for c in tables[t.lower()]["columns"]} if t.lower() in tables else set()
        return {c.lower() for c in r.parent_columns} <= held(r.parent) and {c.lower() for c in r.child_columns} <= held(r.child)

    def update(self, name: str, column: str, value: Any, changes: dict[str, Any]) -> int:
        """Rows where the column equals the value (null-safe, exact type) get the new values. Returns how many there were."""
        with self.change():
            entry, columns = self.entry(name), self.columns(name)
            match = dml.equals(columns, column, value)
            changed = {dml.find(columns, c).name for c in changes}
            if not changes:
                return 0
            before = self.stored(entry)
            hit = constraints.staged(before.filter(match))
            count = hit.count()
            if not count:
                return 0
            after = constraints.staged(dml.updated(hit, columns, F.lit(True), changes))
            constraints.check_rows(after, columns)
            rest = before.join(hit.select(*IDENTITY), IDENTITY, "left_anti")
            lowered = {c.lower() for c in changed}
            moving = []
            for r in self.relationships():
                if not r.enforce or not self.resolves(r):
                    continue
                if r.child.lower() == name.lower() and lowered & {c.lower() for c in r.child_columns}:
                    parent = rest.unionByName(after) if r.parent.lower() == name.lower() else self.table(r.parent)
                    if not relations.orphans(after, r.child_columns, parent, r.parent_columns).isEmpty():
                        raise ConstraintError(f"{r.name}: a row has no parent in {r.parent}")
                if r.parent.lower() == name.lower() and lowered & {c.lower() for c in r.parent_columns}:
                    moving.append((r, self.moved_keys(r, hit, after)))
            for r, moved in moving:
                old, new = [f"__o{k}" for k in range(len(r.parent_columns))], [f"__w{k}" for k in range(len(r.parent_columns))]
                own = r.child.lower() == name.lower()  # children among the same rows are rewritten together with them
                child = rest.unionByName(after) if own else self.stored(self.entry(r.child))
                found = constraints.staged(relations.matching(child, r.child_columns, moved, tuple(old), "left_semi"))
                dependents = found.count()
                if dependents and not r.cascade_updates:
                    raise ConstraintError(f"{r.name}: {dependents} rows of {r.child} depend on the key")
                if not dependents:
                    continue
                led = constraints.staged(relations.rekeyed(found, r.child_columns, moved, old, new))
                changed_too = {c.lower() for c in r.child_columns}
                if own:
                    hit = constraints.staged(hit.unionByName(before.join(found.select(*IDENTITY), IDENTITY, "left_semi").join(hit.select(*IDENTITY), IDENTITY, "left_anti")))
                    after = constraints.staged(after.join(found.select(*IDENTITY), IDENTITY, "left_anti").unionByName(led))
                    rest = before.join(hit.select(*IDENTITY), IDENTITY, "left_anti")
                    lowered |= changed_too
                else:
                    self.check_keys(r.child, led, child.join(found.select(*IDENTITY), IDENTITY, "left_anti"), changed_too)
                    self.replace(r.child, found, led)
            self.check_keys(name, after, rest, lowered)
            self.replace(name, hit, after)
            return count

    def check_keys(self, name: str, rows: DataFrame, rest: DataFrame, changed: set[str]) -> None:
        """Unique keys of changed rows, where a changed column (lower case) is part of one."""
        for i in self.indexes(name):
            if (i.unique or i.primary) and changed & {c.lower() for c in i.columns}:
                constraints.check_unique(rows, constraints.in_range(rest, i.columns, rows, i.columns), list(i.columns), i.name)

    @staticmethod
    def moved_keys(r: Relationship, hit: DataFrame, after: DataFrame) -> DataFrame:
        """(__o0…, __w0…): the old and new keys of rows whose key changes, a row per old key."""
        pairs = hit.select(*IDENTITY, *[F.col(c).alias(f"__o{k}") for k, c in enumerate(r.parent_columns)]).join(after.select(*IDENTITY, *[F.col(c).alias(f"__w{k}") for k, c in enumerate(r.parent_columns)]), IDENTITY)
        same = F.lit(True)
        for k in range(len(r.parent_columns)):
            same = same & F.col(f"__o{k}").eqNullSafe(F.col(f"__w{k}"))
        n = range(len(r.parent_columns))
        return constraints.staged(pairs.filter(~same).groupBy(*[f"__o{k}" for k in n]).agg(*[F.min(f"__w{k}").alias(f"__w{k}") for k in n]))

    def delete(self, name: str, column: str, value: Any) -> int:
        """Rows where the column equals the value go, with their dependents or not at all. Returns how many matched."""
        with self.change():
            entry = self.entry(name)
            doomed = constraints.staged(self.stored(entry).filter(dml.equals(self.columns(name), column, value)))
            count = doomed.count()
            if not count:
                return 0
            tables = {t: self.stored(e) for t, e in self.state["tables"].items()}
            gone = relations.cascade_deletes(tables, self.relationships(), name.lower(), doomed, IDENTITY)
            for t, rows in gone.items():
                self.replace(t, rows, None)
            return count

    def replace(self, name: str, hit: DataFrame, after: DataFrame | None) -> None:
        """Rewrite only the files that hold rows of hit: without them, then with after's rows."""
        entry = self.entry(name)
        touched = hit.groupBy("__file").agg(F.count("*").alias("n")).collect()  # a row per touched file
        if not touched:
            return
        uris = {f: self.storage.uri(f) for f in entry["folders"]}
        homes: dict[str, list[str]] = {}
        for r in touched:
            home = next((f for f, u in uris.items() if r["__file"] == u or r["__file"].startswith(u + "/")), None)
            if home is None:
                raise StoreError(f"{r['__file']} belongs to no folder of {name}")
            homes.setdefault(home, []).append(r["__file"])
        whole = [f for f, files in homes.items() if len(files) > FILES or files == [uris[f]]]  # a registered table may be a single file
        some = [x for f, files in homes.items() if f not in whole for x in files]
        part = F.col("__file").isin(some) if some else F.lit(False)
        for f in whole:
            part = part | (F.col("__file") == uris[f]) | F.col("__file").startswith(uris[f] + "/")
        rows = self.stored(entry, list(homes)).filter(part).join(hit.select(*IDENTITY), IDENTITY, "left_anti")
        if after is not None:
            rows = rows.unionByName(after.select(*rows.columns))
        folder, _ = self.write(entry, rows)
        entry["rows"] += (0 if after is None else after.count()) - sum(r["n"] for r in touched)
        without = entry.get("without", {})
        for f, files in homes.items():
            left = sorted({*without.get(f, []), *(x.removeprefix(uris[f] + "/") for x in files)})
            if f in whole or len(left) == len(self.spark.read.schema("x int").parquet(self.storage.qualified(f)).inputFiles()):
                entry["folders"].remove(f)
                without.pop(f, None)
            else:
                without[f] = left
        entry["folders"].append(folder)
        entry["without"] = without
        entry["renames"] = {f: r for f, r in entry.get("renames", {}).items() if f in entry["folders"]}
        entry["external"] = any(f in entry["folders"] and not f.startswith("data/") for f in entry["folders"])

    def compact(self, name: str) -> None:
        """Write a table anew: one folder without replaced files, clustered by the primary key, so that a lookup by key reads few files."""
        with self.change():
            entry = self.entry(name)
            if not entry["folders"]:
                return
            key = [f"`{c}`" for i in entry["indexes"] if i["primary"] for c in i["columns"]]
            rows = self.stored(entry)
            folder, n = self.write(entry, rows.repartitionByRange(*key) if key else rows)
            entry |= {"folders": [folder], "without": {}, "renames": {}, "rows": n, "external": False}

    def lookup(self, name: str, **key: Any) -> DataFrame:
        """Rows with these column values: equality on the stored columns, so files whose range lies elsewhere aren't read."""
        rows, met = self.table(name), F.lit(True)
        for c, value in key.items():
            met = met & dml.equals(self.columns(name), c, value)
        return rows.filter(met)

    def vacuum(self, keep: int = 1) -> int:
        """Remove manifests but for the last `keep`, then every folder of rows that none of these names. Returns how many folders went. Readers of older versions lose their files."""
        if keep < 1 or self.draft is not None:
            raise StoreError("vacuum keeps at least one version and needs no open transaction")
        with self.storage.lock(self.lock_timeout, self.respect_lock):
            versions = self.storage.versions()
            held = {f for v in versions[-keep:] for t in self.storage.manifest(v)["tables"].values() for f in t["folders"]}
            for v in versions[:-keep]:
                self.storage.delete(f"manifest-{v}.json")
            loose = [f"data/{n}" for n in self.storage.names("data") if f"data/{n}" not in held]
            for folder in loose:
                self.storage.delete(folder)
        return len(loose)

    # Nested columns

    def keys(self, name: str) -> list[str]:
        primary = [c.name for c in self.columns(name) if c.primary]
        return primary or [c.name for c in self.columns(name) if c.kind not in ("attachment", "multivalue", "hyperlink", "ole")]

    def attachments(self, name: str, column: str) -> DataFrame:
        return nested.flat(self.table(name), self.keys(name), dml.find(self.columns(name), column).name)

    multi_values = attachments

    def add_items(self, name: str, column: str, parent: dict[str, Any], items: list[Any]) -> None:
        """Items for exactly one row, named by values of its columns in text form."""
        with self.change():
            columns = self.columns(name)
            held = {dml.find(columns, c).name: v for c, v in parent.items()}
            rows = self.stored(self.entry(name))
            hit = constraints.staged(rows.filter(dml.same_text(rows, held)))
            if (n := hit.count()) != 1:
                raise StoreError(f"{n} rows match {parent}; one must")
            self.replace(name, hit, nested.appended(hit, dml.find(columns, column).name, F.lit(True), items))


class Transaction:
    """Changes that are published together. As a context manager it commits at the end, and rolls back after an error."""

    def __init__(self, db: Database):
        self.db, self.over = db, False

    def end(self) -> None:
        if self.over:
            raise TransactionError("the transaction is over")
        self.over = True

    def commit(self) -> None:
        self.end()
        draft, self.db.draft = self.db.draft, None
        try:
            self.db.publish(draft)
        except BaseException:
            self.drop()
            raise

    def rollback(self) -> None:
        self.end()
        self.db.draft = None
        self.drop()

    def drop(self) -> None:
        """Remove what was written for the transaction."""
        for folder in self.db.pending:
            self.db.storage.delete(folder)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if not self.over:
            self.rollback() if kind else self.commit()


def key_index(indexes: list[dict], columns: list[Column]) -> list[dict]:
    keys = [c.name for c in columns if c.primary]
    return indexes + ([Index("PrimaryKey", tuple(keys), True, True).to_json()] if keys else [])


def check_indexes(indexes: list[Index], columns: list[Column]) -> list[dict]:
    """The definitions' rules; a primary key stated by columns becomes an index."""
    held = {c.name.lower(): c for c in columns}
    if any(c.primary for c in columns):
        if any(i.primary for i in indexes):
            raise StoreError("a primary key is stated twice")
        indexes = indexes + [Index.from_json(key_index([], columns)[0])]
    names = [i.name.lower() for i in indexes]
    if len(set(names)) < len(names) or sum(i.primary for i in indexes) > 1:
        raise StoreError("index names must differ, and a table has one primary key at most")
    for i in indexes:
        lowered = [c.lower() for c in i.columns]
        if not i.name or not 1 <= len(lowered) <= MAX_KEY_COLUMNS or len(set(lowered)) < len(lowered):
            raise StoreError(f"index {i.name} needs a name and 1 to {MAX_KEY_COLUMNS} different columns")
        if any(c not in held or held[c].kind in types.NOT_INDEXED for c in lowered) or not {d.lower() for d in i.descending} <= set(lowered):
            raise StoreError(f"index {i.name} names a column that it can't hold")
    return [i.to_json() for i in indexes]
