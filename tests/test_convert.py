"""Conversions: boundary values."""

import base64
import contextlib
import datetime
import os
import pathlib
import re
import struct
import uuid
import zlib
from decimal import Decimal

import pytest
from granary.errors import StoreError
from granary.functions import convert, types
from granary.functions.types import Column
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text,parts", [("http://x", ("", "http://x", "", "")), ("d#a", ("d", "a", "", "")), ("d#a#s", ("d", "a", "s", "")), ("d#a#s#t", ("d", "a", "s", "t")), ("Click##anchor#", ("Click", "", "anchor", "")), ("##anchor", ("", "", "anchor", "")), ("a%23b#c#d#e#f", ("a#b", "c", "d", "e#f")), ("", None), (None, None)])
def test_hyperlinks(spark, text, parts):
    got = one(spark, convert.hyperlink_parse(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == parts


def test_hyperlinks_round_trip(spark):
    rows = [("a#b", "c", "", ""), ("d", "a", "", "tip"), ("", "x", "s", ""), ("d", "a", "s#", "t")]
    df = spark.createDataFrame([(r,) for r in rows], f"h {types.HYPERLINK.simpleString()}")
    back = df.select("h", convert.hyperlink_parse(convert.hyperlink_text(F.col("h"))).alias("b")).collect()
    assert all(r.h == r.b for r in back)
    assert [r[0] for r in df.select(convert.hyperlink_text(F.col("h"))).collect()][1] == "d#a##tip"


@pytest.mark.parametrize("text,days", [("1899-12-29 00:00:00", -1), ("1899-12-30 00:00:00", 0), ("1899-12-31 12:00:00", 1.5), ("1900-03-01 00:00:00", 61), ("1904-01-01 00:00:00", 1462)])
def test_ole_dates(spark, text, days):
    at = F.lit(text).cast("timestamp_ntz")
    assert float(one(spark, convert.oa_date(at))) == days
    assert one(spark, convert.from_oa_date(convert.oa_date(at))) == datetime.datetime.fromisoformat(text)


def test_parsing(spark):
    whole = Column("a", "int32")
    assert one(spark, convert.parse_text(F.lit(""), whole)) is None and one(spark, convert.parse_text(F.lit("x"), whole, strict=False)) is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, convert.parse_text(F.lit("x"), whole))
    for text, want in (("00FF", b"\0\xff"), ("00-ff", b"\0\xff"), ("data:x/y;base64,aGk=", b"hi"), ("zz", b""), ("0", b"")):
        assert bytes(one(spark, convert.parse_bytes(F.lit(text)))) == want
    assert one(spark, convert.parse_text(F.lit("{ABC}"), Column("g", "guid"))) == "abc"


@pytest.mark.parametrize("chunked", ["true", "false"])
@pytest.mark.parametrize("size", [0, 57, 58, 1000])
def test_data_uris_are_one_line(spark, size, chunked):
    """57 bytes are the most that fit a line of base64."""
    data, name = bytes(k % 251 for k in range(size)), "spark.sql.chunkBase64String.enabled"
    spark.conf.set(name, chunked)
    try:
        uri = one(spark, convert.as_text(F.lit(data), Column("o", "ole")))
        assert uri == "data:application/octet-stream;base64," + base64.b64encode(data).decode()
        assert bytes(one(spark, convert.parse_bytes(F.lit(uri)))) == data
    finally:
        spark.conf.unset(name)


def test_expressions():
    guid = uuid.UUID(int=5)
    values = [(True, "True"), (False, "False"), ('a"b', '"a""b"'), (42, "42"), (1.5, "1.5"), (2.0, "2"), (Decimal("1.50"), "1.50"), (datetime.datetime(2020, 1, 2, 3, 4, 5), "#2020-01-02 03:04:05#"), (guid, f"{{guid {{{guid}}}}}")]
    assert [convert.expression_text(v) for v, _ in values] == [t for _, t in values]
    with pytest.raises(StoreError):
        convert.expression_text(b"x")


def test_attachments_and_packages():
    for kind in ("txt", "zip", ""):
        for data in (b"", b"hello" * 100):
            stored = convert.pack_attachment(data, kind)
            assert convert.unpack_attachment(stored) == data and stored[0] == (kind != "zip")
    for odd in (b"", b"short", b"\x01\0\0\0\x10\0\0\0" + b"x" * 40, b"\x07" * 30):
        assert convert.unpack_attachment(odd) == odd
    assert len(convert.pack_attachment(b"a" * 5000, "txt")) < 200 and zlib is not None
    inner = struct.pack("<H", 2) + b"n\0p\0" + struct.pack("<ii", 0x030000, 2) + b"p\0" + struct.pack("<i", 4) + b"DATA"
    package = struct.pack("<HH", 0x1C15, 20) + b"\0" * 16 + struct.pack("<iii", 0x0501, 2, 3) + b"ab\0" + b"\0" * 8 + struct.pack("<i", len(inner)) + inner
    assert convert.unpack_package(package) == b"DATA"
    for odd in (b"", package[:-1], package[:30], b"\0" + package[1:]):
        assert convert.unpack_package(odd) == odd


@pytest.mark.skipif(not os.path.isdir("/proc/self"), reason="reads the workers' memory from /proc")
def test_attachments_are_handed_on_in_pieces(spark):
    """A worker holds the batch that it was sent, here 60 MB, and not every step's copy of it."""
    spark.sparkContext.environment["ATTACHMENTS"] = "pieces"  # gets workers of its own
    try:
        df = spark.range(0, 6000, 1, 1).select(F.unhex(F.repeat(F.sha2(F.col("id").cast("string"), 256), 313)).alias("raw"), F.lit("zip").alias("kind"))
        back = convert.unwrap_attachments(convert.wrap_attachments(df, "raw", "kind", "stored"), "stored", "file")
        assert back.filter("raw = file").count() == 6000
        peaks = []
        for at in pathlib.Path("/proc").glob("[0-9]*"):
            with contextlib.suppress(OSError):
                if b"ATTACHMENTS=pieces" in (at / "environ").read_bytes():
                    peaks += [int(n) // 1024 for n in re.findall(r"VmHWM:\s+(\d+)", (at / "status").read_text())]
        assert peaks and max(peaks) < 400
    finally:
        del spark.sparkContext.environment["ATTACHMENTS"]


def test_attachments_and_packages_by_rows(spark):
    """Nulls, empty and large cells keep their rows, over several batches and pieces."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        n = F.col("id")
        raw = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.lit("")).when(n % 5 == 2, F.repeat(n.cast("string"), 400_000)).otherwise(n.cast("string")).cast("binary")
        df = spark.range(0, 60, 1, 3).select("id", raw.alias("raw"), F.when(n % 3 == 0, "zip").when(n % 3 == 1, "txt").alias("kind"))
        back = convert.unwrap_packages(convert.unwrap_attachments(convert.wrap_attachments(df, "raw", "kind", "stored"), "stored", "file"), "file", "plain")
        assert back.filter("file <=> raw and plain <=> raw and (stored is null) = (raw is null)").count() == 60
        assert back.select("id", "file").filter("file is null").count() == 12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_definitions():
    for bad in (Column("", "text"), Column("a", "nope"), Column("a", "text", size=256), Column("a", "decimal", precision=29), Column("a", "decimal", precision=5, scale=6), Column("a", "text", auto=True), Column("a", "int32", expression="[b]+1"), Column("a", "multivalue", element="ole?")):
        with pytest.raises(StoreError):
            bad.checked()
    assert [types.size_text(Column("a", k, size=s)) for k, s in (("bool", None), ("int32", None), ("text", 9), ("memo", None), ("byte", None), ("binary", 5))] == ["1 bit", "4 bytes", "9 chars", "LVAL", "1 byte", "5 bytes"]
    for value in (Decimal("1.5"), datetime.datetime(2020, 1, 1), b"x", "s", 3, True, 1.5):
        assert Column.from_json(Column("a", "memo", default=value).to_json()) == Column("a", "memo", default=value)
    assert types.value_matches(Column("a", "int16"), 5) and not types.value_matches(Column("a", "int16"), 40000) and not types.value_matches(Column("a", "int32"), True)


def test_names():
    assert [convert.pascal_case(n) for n in ("order details", "a.b_c-d", "Ünï code", "9x", "", "é", "x!y")] == ["OrderDetails", "ABCD", "ÜnïCode", "_9x", "Unknown", "É", "Xy"]
