"""Writes a Python module of dataclasses for a database's tables: python -m granary.sources.scaffold PATH [MODULE.py]."""

from __future__ import annotations

import keyword
import sys

from granary.functions.convert import pascal_case
from granary.functions.types import Column

#: Kind -> annotation.
ANNOTATIONS = {
    "bool": "bool", "byte": "int", "int16": "int", "int32": "int", "int64": "int", "currency": "Decimal", "decimal": "Decimal", "single": "float", "double": "float", "datetime": "datetime",
    "binary": "bytes", "ole": "bytes", "text": "str", "memo": "str", "guid": "str", "hyperlink": "str",
}


def distinct(names: list[str]) -> list[str]:
    """Later repeats, whatever their case, get 2, 3, … behind them."""
    taken: set[str] = set()
    out = []
    for name in names:
        name = f"{name}_" if keyword.iskeyword(name) else name
        found, k = name, 2
        while found.lower() in taken:
            found, k = f"{name}{k}", k + 1
        taken.add(found.lower())
        out.append(found)
    return out


def annotation(column: Column) -> str:
    """A yes/no cell is never null; other columns are optional unless required."""
    if column.kind in ("attachment", "multivalue"):
        return "list"
    kind = ANNOTATIONS[column.kind]
    return kind if column.required or column.kind == "bool" else f"{kind} | None"


def source(tables: dict[str, list[Column]]) -> str:
    """The module's text; required fields come first, as dataclasses ask."""
    lines = ["from __future__ import annotations", "", "from dataclasses import dataclass, field", "from datetime import datetime", "from decimal import Decimal", ""]
    for name, (table, columns) in zip(distinct([pascal_case(t) for t in tables]), tables.items(), strict=True):
        lines += ["", "@dataclass", f"class {name}:", f'    """Rows of {table}."""', ""]
        fields = list(zip(distinct([c.name if c.name.isidentifier() else pascal_case(c.name) for c in columns]), columns, strict=True))
        for n, c in sorted(fields, key=lambda x: annotation(x[1]).endswith("None") or annotation(x[1]) == "list"):
            kind = annotation(c)
            lines.append(f"    {n}: {kind}" + (" = None" if kind.endswith("None") else " = field(default_factory=list)" if kind == "list" else ""))
        lines.append("")
    return "\n".join(lines)


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    from granary.sources.database import Database

    db = Database.open(SparkSession.builder.getOrCreate(), args[0])
    text = source({t: db.columns(t) for t in db.list_tables()})
    if len(args) > 1:
        with open(args[1], "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


if __name__ == "__main__":
    main(sys.argv[1:])
