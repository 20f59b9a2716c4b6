"""The write pipeline: coercion, defaults, counters, and checks of nulls, rules and unique keys."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ConstraintError
from granary.functions import convert, types
from granary.operators.staging import staged

#: Kinds of keys that have a range which Parquet's statistics know.
RANGED = (T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.TimestampNTZType)


def coerced(df: DataFrame, columns: list[types.Column]) -> DataFrame:
    """df with exactly the columns, by case-insensitive name: missing ones null, each cast (overflow raises), unsigned bytes checked, text and binary clipped, a null yes/no false."""
    held = {c.lower(): c for c in df.columns}

    def of(c: types.Column) -> SparkColumn:
        x = F.col(f"`{held[c.name.lower()]}`") if c.name.lower() in held else F.lit(None)
        if c.kind == "hyperlink" and c.name.lower() in held and df.schema[held[c.name.lower()]].dataType.simpleString() == "string":
            x = convert.hyperlink_parse(x)
        x = convert.clipped(x.cast(c.spark), c)
        if c.kind == "byte":
            x = F.when((x < 0) | (x > 255), F.raise_error(F.lit(f"{c.name}: a byte holds 0 to 255"))).otherwise(x)
        return (F.coalesce(x, F.lit(False)) if c.kind == "bool" and c.default is None else x).alias(c.name)

    return df.select(*[of(c) for c in columns], *[F.col(c) for c in df.columns if c.startswith("__")])


def with_defaults(df: DataFrame, columns: list[types.Column]) -> DataFrame:
    """Defaults replace nulls before any other check."""
    return df.withColumns({c.name: F.coalesce(F.col(f"`{c.name}`"), F.lit(c.default).cast(c.spark)) for c in columns if c.default is not None})


def numbered(df: DataFrame, column: str, high: int, order: list | None = None) -> DataFrame:
    """Null cells of the column get high + 1, high + 2, …, in the given order (by default the order of partitions).

    Partitions count their nulls, and only those counts meet: no window spans the table.
    """
    rows = df.withColumn("__new", F.col(f"`{column}`").isNull())
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    counts = rows.groupBy("__part").agg(F.sum(F.col("__new").cast("long")).alias("__n"))
    base = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__base"))
    rank = F.sum(F.col("__new").cast("long")).over(Window.partitionBy("__part").orderBy("__at"))
    value = F.lit(high) + F.coalesce("__base", F.lit(0)) + rank
    found = rows.join(F.broadcast(base), "__part").withColumn(column, F.coalesce(F.col(f"`{column}`"), value.cast(df.schema[column].dataType)))
    return found.select(*df.columns)


def broken(columns: list[types.Column]) -> list[tuple[str, str, SparkColumn]]:
    """(column, what, condition) of each check, in order of columns; a rule is only asked about values that aren't null."""
    checks = []
    for c in columns:
        x = F.col(f"`{c.name}`")
        if c.required:
            checks.append((c.name, "may not be null", x.isNull()))
        if not c.allow_empty and c.kind in ("text", "memo"):
            checks.append((c.name, "may not be empty", x == ""))
        if c.rule is not None:
            checks.append((c.name, c.rule_message or "breaks its rule", x.isNotNull() & ~c.rule(x)))
    return checks


def check_rows(df: DataFrame, columns: list[types.Column]) -> int:
    """Number of rows; all checks are counted in the same single pass. The first one broken raises."""
    checks = broken(columns)
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.when(bad, 1)).alias(f"c{k}") for k, (_, _, bad) in enumerate(checks)]).first()
    for k, (name, what, _) in enumerate(checks):
        if counts[f"c{k}"]:
            raise ConstraintError(f"{name} {what} ({counts[f'c{k}']} rows)")
    return counts["n"]


def key(df: DataFrame, names: list[str]) -> list[SparkColumn]:
    """Key expressions: texts compare without case."""
    return [F.upper(F.col(f"`{n}`")) if df.schema[n].dataType.simpleString() == "string" else F.col(f"`{n}`") for n in names]


def duplicates(df: DataFrame, names: list[str]) -> DataFrame:
    """Keys held by several rows, with their number; null parts are equal to each other."""
    return df.groupBy(*[k.alias(n) for k, n in zip(key(df, names), names, strict=True)]).agg(F.count("*").alias("rows")).filter("rows > 1")


def in_range(stored: DataFrame, stored_names, rows: DataFrame, names) -> DataFrame:
    """Those stored rows whose key can be among rows' ones: within the range of their first key column, or null. The range reaches the scan, so where files are clustered by key few are read. Texts compare without case, so they have no range."""
    a, b = next(c for c in stored.columns if c.lower() == stored_names[0].lower()), next(c for c in rows.columns if c.lower() == names[0].lower())
    kind = stored.schema[a].dataType
    if kind != rows.schema[b].dataType or not isinstance(kind, RANGED):
        return stored
    low, high, null = rows.agg(F.min(f"`{b}`"), F.max(f"`{b}`"), F.count_if(F.col(f"`{b}`").isNull())).first()
    met = F.col(f"`{a}`").between(low, high) if low is not None else F.lit(False)
    return stored.filter(met | F.col(f"`{a}`").isNull() if null else met)


def check_unique(rows: DataFrame, existing: DataFrame | None, names: list[str], label: str) -> None:
    """Raises if rows repeat a key, or hold one that existing has."""
    if not duplicates(rows, names).isEmpty():
        raise ConstraintError(f"Unique index violation: {label} repeats a key")
    if existing is not None:
        ours = rows.select(*[k.alias(f"k{i}") for i, k in enumerate(key(rows, names))])
        theirs = existing.select(*[k.alias(f"t{i}") for i, k in enumerate(key(existing, names))])
        met = F.lit(True)
        for i in range(len(names)):
            met = met & F.col(f"k{i}").eqNullSafe(F.col(f"t{i}"))
        if not theirs.join(ours, met, "left_semi").isEmpty():
            raise ConstraintError(f"Unique index violation: {label} holds a key already")
