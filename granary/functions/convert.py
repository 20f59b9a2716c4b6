"""Scalar conversions as column expressions."""

from __future__ import annotations

import datetime
import decimal
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.errors import StoreError
from granary.functions import types as Y

EPOCH = "1899-12-30"

#: Leading bytes (hexadecimal) of known payloads and their media types.
SIGNATURES = (
    ("FFD8FF", "image/jpeg"),
    ("89504E47", "image/png"),
    ("47494638", "image/gif"),
    ("424D", "image/bmp"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("25504446", "application/pdf"),
    ("504B0304", "application/zip"),
    ("D0CF11E0A1B11AE1", "application/msword"),
    ("7B5C7274", "application/rtf"),
)


def bool_text(x: Column) -> Column:
    return F.initcap(x.cast("string"))


def number_text(x: Column) -> Column:
    """Floating numbers in the shortest form, whole ones without a decimal point."""
    return F.regexp_replace(x.cast("string"), r"[.]0$", "")


def currency_text(x: Column) -> Column:
    return x.cast("decimal(19,4)").cast("string")


def datetime_text(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


def guid_text(x: Column) -> Column:
    return F.concat(F.lit("{"), x, F.lit("}"))


def media_type(x: Column) -> Column:
    head, found = F.hex(F.substring(x, 1, 8)), F.lit("application/octet-stream")
    for signature, name in reversed(SIGNATURES):
        found = F.when(head.startswith(signature), name).otherwise(found)
    return found


def base64_text(x: Column) -> Column:
    """One line, also where Spark breaks base64 into lines of 76 characters (spark.sql.chunkBase64String.enabled)."""
    return F.replace(F.base64(x), F.lit("\r\n"), F.lit(""))


def data_uri(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.lit("data:"), media_type(x), F.lit(";base64,"), base64_text(x)))


def as_text(x: Column, column: Y.Column) -> Column:
    """A cell's culture-free text; null becomes an empty string."""
    by_kind = {
        "bool": bool_text, "single": number_text, "double": number_text, "currency": currency_text, "datetime": datetime_text, "guid": guid_text, "binary": F.hex, "ole": data_uri, "hyperlink": hyperlink_text,
        "attachment": lambda c: F.array_join(F.transform(c, lambda a: a["file_name"]), ";"),
        "multivalue": lambda c: F.array_join(c.cast("array<string>"), ";"),
    }
    return F.coalesce(by_kind.get(column.kind, lambda c: c.cast("string"))(x), F.lit(""))


def oa_days(x: Column) -> Column:
    """Whole days since the epoch of OLE dates."""
    return F.datediff(x.cast("date"), F.lit(EPOCH).cast("date"))


def oa_date(x: Column) -> Column:
    """Days since the epoch with their fraction, to a micro-day's 8 decimals."""
    seconds = F.unix_micros(x.cast("timestamp")).cast("decimal(20,0)") / F.lit(decimal.Decimal(86_400_000_000))
    return (seconds.cast("decimal(28,10)") + F.lit(decimal.Decimal(25569))).cast("decimal(18,8)")


def from_oa_date(x: Column) -> Column:
    """The date and time of an OLE date; microseconds are rounded."""
    return F.timestamp_micros(F.round((x.cast("double") - 25569) * 86_400_000_000).cast("bigint")).cast("timestamp_ntz")


def hyperlink_parse(x: Column) -> Column:
    """display#address#sub address#screen tip as a struct. A single part is the address; a surplus part stays in the screen tip; null or empty gives null."""
    parts = F.split(x, "#", 4)
    part = lambda k: F.replace(F.coalesce(F.get(parts, F.lit(k)), F.lit("")), F.lit("%23"), F.lit("#"))
    one = F.size(parts) == 1
    fields = (F.when(one, "").otherwise(part(0)), F.when(one, part(0)).otherwise(part(1)), part(2), part(3))
    return F.when(F.coalesce(x, F.lit("")) != "", F.struct(*[f.alias(n) for f, n in zip(fields, Y.HYPERLINK.names, strict=True)]))


def hyperlink_text(x: Column) -> Column:
    """The text form; an empty sub address and screen tip at the end are left out."""
    part = lambda n: F.replace(F.coalesce(x[n], F.lit("")), F.lit("#"), F.lit("%23"))
    sub, tip = part("sub_address"), part("screen_tip")
    tail = F.when(tip != "", F.concat(F.lit("#"), sub, F.lit("#"), tip)).when(sub != "", F.concat(F.lit("#"), sub)).otherwise("")
    return F.when(x.isNotNull(), F.concat(part("display_text"), F.lit("#"), part("address"), tail))


def parse_text(x: Column, column: Y.Column, strict: bool = True) -> Column:
    """Typed value of a text. Empty is null; what can't be parsed raises if strict, else is null."""
    full = F.nullif(x, F.lit(""))
    if column.kind in ("binary", "ole"):
        return parse_bytes(full)
    if column.kind == "hyperlink":
        return hyperlink_parse(full)
    if column.kind == "guid":
        full = F.lower(F.regexp_replace(full, "[{}]", ""))
    return full.cast(column.spark) if strict else full.try_cast(column.spark)


def parse_bytes(x: Column) -> Column:
    """Bytes of a base64 data URI, of plain hexadecimal or of hexadecimal with dashes; anything else is empty."""
    bare = F.replace(x, F.lit("-"), F.lit(""))
    is_hex = bare.rlike("^([0-9A-Fa-f]{2})+$")
    uri = x.rlike("^data:[^,]*;base64,")
    return F.when(uri, F.try_to_binary(F.substring_index(x, ",", -1), F.lit("base64"))).when(is_hex, F.unhex(bare)).when(x.isNotNull(), F.lit(b""))


def clipped(x: Column, column: Y.Column) -> Column:
    """Text and binary cells are cut silently to the declared size."""
    return F.substring(x, 1, column.length) if column.length else x


def expression_text(value: Any) -> str:
    """A default value in the stored expression form."""
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, str):
        return '"' + value.replace('"', '""') + '"'
    if isinstance(value, datetime.datetime):
        return f"#{value:%Y-%m-%d %H:%M:%S}#"
    if isinstance(value, uuid.UUID):
        return f"{{guid {{{value}}}}}"
    if isinstance(value, float):
        return re.sub(r"\.0$", "", repr(value))
    if isinstance(value, int | decimal.Decimal):
        return str(value)
    raise StoreError(f"no expression for {type(value).__name__}")


def expression_column(x: Column, kind: str) -> Column:
    """The same for a column's cells."""
    if kind in ("text", "memo"):
        return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    if kind == "datetime":
        return F.concat(F.lit("#"), datetime_text(x), F.lit("#"))
    if kind == "guid":
        return F.concat(F.lit("{guid {"), x, F.lit("}}"))
    return bool_text(x) if kind == "bool" else number_text(x)


#: File types whose contents are stored as they are, being compressed already.
COMPRESSED = ("jpg", "zip", "gz", "bz2", "z", "7z", "cab", "rar", "mp3", "mpg")


#: Bytes after which a worker hands on what it has made of a batch.
PIECE = 1_000_000


def cells(x: pa.Array) -> Iterator[Any]:
    """One at a time; a whole batch as Python objects would be held twice."""
    return (cell.as_py() for cell in x)


def in_pieces(values: Iterable[bytes | None]) -> Iterator[pa.Array]:
    """The values in arrays of about PIECE bytes, so that a worker holds no copy of a batch for every step."""
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value or b"")
        if size >= PIECE:
            yield pa.array(held, pa.binary())
            held, size = [], 0
    if held:
        yield pa.array(held, pa.binary())


def wrap_attachments(df: DataFrame, data: str, kind: str, out: str) -> DataFrame:
    """Adds the stored form of attachments: flag (1: deflated) and length as uint32, then header length, version, type length and type in UTF-16, then the contents."""
    @F.arrow_udf("binary")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, kinds in batches:
            yield from in_pieces(None if c is None else pack_attachment(c, k or "") for c, k in zip(cells(contents), cells(kinds), strict=True))

    return df.withColumn(out, of(F.col(data), F.col(kind)))


def unwrap_attachments(df: DataFrame, data: str, out: str) -> DataFrame:
    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            yield from in_pieces(None if c is None else unpack_attachment(c) for c in cells(contents))

    return df.withColumn(out, of(F.col(data)))


def pack_attachment(contents: bytes, kind: str) -> bytes:
    name = (kind + "\0").encode("utf-16-le")
    body, stored = struct.pack("<III", 12 + len(name), 1, len(name)) + name + contents, kind.lower() in COMPRESSED
    if not stored:
        squeeze = zlib.compressobj(wbits=-15)
        body = squeeze.compress(body) + squeeze.flush()
    return struct.pack("<II", not stored, len(body)) + body


def unpack_attachment(stored: bytes) -> bytes:
    """The contents; bytes that aren't in the stored form come back as they are."""
    if len(stored) < 20:
        return stored
    flag, size = struct.unpack_from("<II", stored)
    body = stored[8 : 8 + size]
    if flag > 1 or not 0 < size <= len(stored) - 8:
        return stored
    try:
        body = zlib.decompress(body, wbits=-15) if flag else body
    except zlib.error:
        return stored
    head, _, name = struct.unpack_from("<III", body) if len(body) >= 12 else (0, 0, 0)
    return body[head:] if 12 + name <= head <= len(body) else stored


def unwrap_packages(df: DataFrame, data: str, out: str) -> DataFrame:
    """Adds the file embedded in each OLE package; other payloads come back as they are."""
    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            yield from in_pieces(None if c is None else unpack_package(c) for c in cells(contents))

    return df.withColumn(out, of(F.col(data)))


def unpack_package(stored: bytes) -> bytes:
    """Fixed layout: a package header, an OLE header with a type name, then a stream with two zero-ended names, a kind, a path and the file."""

    def number(at: int) -> int:
        return struct.unpack_from("<i", stored, at)[0]

    try:
        mark, header = struct.unpack_from("<HH", stored)
        if mark != 0x1C15 or header < 20 or number(header) != 0x0501:
            return stored
        stream = header + 20 + number(header + 8)
        size, at = number(stream), stream + 4
        end = at + size
        if size <= 0 or end > len(stored) or struct.unpack_from("<H", stored, at)[0] != 2:
            return stored
        at += 2
        for _ in range(2):
            at = stored.index(b"\0", at, end) + 1
        if number(at) != 0x030000:
            return stored
        at += 8 + number(at + 4)
        length = number(at)
    except (struct.error, ValueError):
        return stored
    return stored[at + 4 : at + 4 + length] if length > 0 and at + 4 + length <= end else stored


def pascal_case(name: str) -> str:
    """An identifier: words are split at space, dash, dot and underscore; a leading digit gets an underscore; nothing gives Unknown."""
    words = ["".join(ch for ch in w if ch.isalnum()) for w in re.split(r"[ \-._]+", name)]
    found = "".join(w[0].upper() + w[1:] for w in words if w)
    return "Unknown" if not found else f"_{found}" if found[0].isdigit() else found
