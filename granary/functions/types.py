"""Column definitions: the store's types, their Spark types, and how sizes are shown."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from granary.errors import StoreError

#: Kind -> (type code, display name, fixed bytes or None).
KINDS = {
    "bool": (0x01, "Yes/No", 0),
    "byte": (0x02, "Byte", 1),
    "int16": (0x03, "Integer", 2),
    "int32": (0x04, "Long Integer", 4),
    "currency": (0x05, "Currency", 8),
    "single": (0x06, "Single", 4),
    "double": (0x07, "Double", 8),
    "datetime": (0x08, "Date/Time", 8),
    "binary": (0x09, "Binary", None),
    "text": (0x0A, "Text", None),
    "ole": (0x0B, "OLE Object", None),
    "memo": (0x0C, "Memo", None),
    "guid": (0x0F, "GUID", 16),
    "decimal": (0x10, "Decimal", 17),
    "attachment": (0x11, "Attachment", 4),
    "multivalue": (0x12, "Complex", 4),
    "hyperlink": (0x0C, "Hyperlink", None),
    "int64": (0x13, "Large Number", 8),  # an extension: test keys are 64-bit
}

HYPERLINK = T.StructType([T.StructField(n, T.StringType()) for n in ("display_text", "address", "sub_address", "screen_tip")])
ATTACHMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("file_name", "file_type", "file_url")]
    + [T.StructField("file_time", T.TimestampNTZType()), T.StructField("file_flags", T.IntegerType()), T.StructField("file_data", T.BinaryType())]
)

SIMPLE = {
    "bool": T.BooleanType(), "byte": T.ShortType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "currency": T.DecimalType(19, 4), "single": T.FloatType(), "double": T.DoubleType(),
    "datetime": T.TimestampNTZType(), "binary": T.BinaryType(), "text": T.StringType(), "ole": T.BinaryType(), "memo": T.StringType(), "guid": T.StringType(), "hyperlink": HYPERLINK,
}

#: The Python type that a predicate's value must have, exactly, to match a column of a kind.
EXACT = {
    "bool": bool, "byte": int, "int16": int, "int32": int, "int64": int, "currency": decimal.Decimal, "decimal": decimal.Decimal, "single": float, "double": float, "datetime": datetime.datetime,
    "binary": bytes, "ole": bytes, "text": str, "memo": str, "guid": str,
}

#: Kinds that an index can't hold.
NOT_INDEXED = {"ole", "attachment", "multivalue", "hyperlink"}
MAX_TEXT = 255


@dataclass(frozen=True)
class Column:
    """One column's definition. rule is a function from a Spark column to a boolean one and isn't persisted; everything else is."""

    name: str
    kind: str
    nullable: bool = True
    size: int | None = None
    precision: int = 18
    scale: int = 0
    auto: bool = False
    primary: bool = False
    default: Any = None
    rule: Callable | None = None
    rule_text: str | None = None
    rule_message: str | None = None
    description: str | None = None
    allow_empty: bool = True
    element: str | None = None  # of a multivalue column
    expression: str | None = None  # of a calculated column: read as metadata, never written or evaluated

    def checked(self) -> Column:
        if not self.name or self.kind not in KINDS:
            raise StoreError(f"column {self.name!r} has no name or an unknown kind {self.kind!r}")
        if self.expression is not None:
            raise StoreError(f"calculated column {self.name} can't be written")
        if self.kind in ("text", "binary") and not 1 <= (self.size or MAX_TEXT) <= MAX_TEXT:
            raise StoreError(f"size of {self.name} must be 1 to {MAX_TEXT}")
        if self.kind == "decimal" and not (1 <= self.precision <= 28 and 0 <= self.scale <= self.precision):
            raise StoreError(f"{self.name}: precision must be 1 to 28, and scale 0 to precision")
        if self.auto and self.kind not in ("int16", "int32", "int64"):
            raise StoreError(f"{self.name}: only whole numbers can count up")
        if self.kind == "multivalue" and self.element not in SIMPLE and self.element != "decimal":
            raise StoreError(f"{self.name}: unknown element kind {self.element!r}")
        return self

    @property
    def length(self) -> int | None:
        return (self.size or MAX_TEXT) if self.kind in ("text", "binary") else None

    @property
    def spark(self) -> T.DataType:
        if self.kind == "decimal":
            return T.DecimalType(self.precision, self.scale)
        if self.kind == "attachment":
            return T.ArrayType(ATTACHMENT)
        if self.kind == "multivalue":
            return T.ArrayType(Column("value", self.element, precision=self.precision, scale=self.scale).spark)
        return SIMPLE[self.kind]

    @property
    def required(self) -> bool:
        return self.auto or self.primary or not self.nullable

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.spark, True)

    def to_json(self) -> dict:
        held = {f.name: getattr(self, f.name) for f in dataclasses.fields(self) if f.name != "rule" and getattr(self, f.name) != f.default}
        if "default" in held:
            held["default"] = pack(self.default)
        return held

    @staticmethod
    def from_json(held: dict) -> Column:
        return Column(**held | ({"default": unpack(held["default"])} if "default" in held else {}))


def pack(value: Any) -> list:
    kind = type(value).__name__
    if isinstance(value, datetime.datetime):
        return [kind, value.isoformat()]
    if isinstance(value, bytes):
        return [kind, value.hex()]
    return [kind, str(value) if isinstance(value, decimal.Decimal | uuid.UUID) else value]


def unpack(held: list) -> Any:
    kind, value = held
    read = {"datetime": datetime.datetime.fromisoformat, "bytes": bytes.fromhex, "Decimal": decimal.Decimal, "UUID": uuid.UUID}
    return read[kind](value) if kind in read else value


def schema(columns: list[Column]) -> T.StructType:
    return T.StructType([c.field() for c in columns])


def from_spark(field: T.StructField, primary: bool = False) -> Column:
    """The definition that fits a Spark field of an external table."""
    t = field.dataType
    kinds = {T.BooleanType: "bool", T.ByteType: "int16", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "single", T.DoubleType: "double", T.StringType: "memo", T.BinaryType: "ole", T.TimestampNTZType: "datetime", T.TimestampType: "datetime", T.DateType: "datetime"}
    if isinstance(t, T.DecimalType):
        return Column(field.name, "decimal", precision=t.precision, scale=t.scale)
    if isinstance(t, T.ArrayType):
        return Column(field.name, "attachment") if t.elementType == ATTACHMENT else dataclasses.replace(from_spark(T.StructField(field.name, t.elementType)), kind="multivalue", element=from_spark(T.StructField(field.name, t.elementType)).kind)
    if t == HYPERLINK:
        return Column(field.name, "hyperlink")
    if type(t) not in kinds:
        raise StoreError(f"{field.name}: no kind of column holds {t.simpleString()}")
    return Column(field.name, kinds[type(t)], primary=primary)


def size_text(column: Column) -> str:
    """How a column's size is shown."""
    if column.kind == "bool":
        return "1 bit"
    if column.kind in ("memo", "ole", "hyperlink"):
        return "LVAL"
    if column.kind == "text":
        return f"{column.length} chars"
    fixed = KINDS[column.kind][2]
    if fixed is None:
        return f"{column.length} bytes" if column.length else "variable"
    return f"{fixed} byte{'s' * (fixed != 1)}"


def value_matches(column: Column, value: Any) -> bool:
    """Whether a predicate value can equal cells of the column: null always, else only with exactly the column's type."""
    if value is None:
        return True
    if type(value) is not EXACT.get(column.kind):
        return False
    bounds = {"byte": (0, 255), "int16": (-(1 << 15), (1 << 15) - 1), "int32": (-(1 << 31), (1 << 31) - 1), "int64": (-(1 << 63), (1 << 63) - 1)}.get(column.kind)
    return bounds is None or bounds[0] <= value <= bounds[1]
