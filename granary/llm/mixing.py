"""Mixing sources to target weights by Poisson replication.

Each source's repetition rate is its share of the target volume over its own
volume. A document's number of copies inverts the Poisson distribution with
that mean at a uniform number hashed from seed and id, so a rerun, a lost
executor or another partitioning gives the same copies. Copies are dealt to
partitions by the leading bits of a hashed key and sorted by it: one global
shuffle, with the sources' rates joined in before it.

Rows: null texts have volume 1 like empty ones, so every row can be drawn; a
null source is a source of its own. Sources without a weight get
default_weight. Repeated rows are drawn alike, each on its own. An empty table
gives an empty result. Columns of the input keep their names and values,
whatever they are; where one is named copy or shuffle_key in any case, the added
column has as many underscores behind its name as make it new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import staged

#: With at most so many sources (counted first), their rates are broadcast; with more, they are joined by a shuffle that Spark splits where it is skewed.
BROADCAST_SOURCES = 10_000
#: A longer distribution is drawn as a sum of independent ones with this mean at most, so exp(-mean) can't underflow.
MEAN = 500.0


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def shuffle_key(key: Column) -> Column:
    """60 bits of a key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 0.0, total: float | None = None, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(src, volume, rate, parts, cdf): per source, from all documents. total: target volume in characters, by default what docs has."""
    volume = F.greatest(F.coalesce(F.char_length(text_col), F.lit(0)), F.lit(1)).cast("bigint")
    by = docs.groupBy(F.col(source_col).alias("src")).agg(F.sum(volume).alias("volume"))
    by = staged(by, "volumes")
    weight = F.lit(float(default_weight))
    if weights:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(F.when(F.col("src").isNotNull(), F.element_at(table, F.col("src"))), weight)
    by = by.withColumn("weight", weight)
    sums = by.agg(F.sum("weight").alias("weights"), F.sum(F.col("volume").cast("double")).alias("all"))
    goal = F.lit(float(total)) if total is not None else F.col("all")
    rate = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights") * goal / F.col("volume")).otherwise(0.0)
    by = by.join(F.broadcast(sums)).withColumn("rate", rate).withColumn("parts", F.ceil(F.col("rate") / MEAN).cast("int"))
    mean = F.col("rate") / F.greatest(F.col("parts"), F.lit(1))
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def more(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return by.select("src", "volume", "rate", "parts", F.aggregate(F.sequence(F.lit(1), last), start, more)["cdf"].alias("cdf"))


def mix(
    docs: DataFrame, weights: dict[str, float], default_weight: float = 0.0, seed: int = 17, total: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """docs' columns with copy (from 1) and shuffle_key: each row as often as it is drawn, in the order of shuffle_key over the partitions and within each."""
    spark, names = docs.sparkSession, docs.columns
    own = {c: f"in{k}" for k, c in enumerate(names)}  # none of the names below
    rows, doc, text, source = docs.toDF(*own.values()), own[id_col], own[text_col], own[source_col]
    table = staged(rates(rows, weights, default_weight, total, text, source).select("src", "parts", "cdf"), "rates")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit("null")))
    draw = lambda j: F.size(F.filter("cdf", lambda c: c <= uniform(F.concat(key, F.lit(":"), j.cast("string")))))
    copies = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, j: n + draw(j))
    drawn = rows.join(table, F.col(source).eqNullSafe(F.col("src"))).withColumn("copies", F.when(F.col("parts") > 0, copies).otherwise(0))
    each = drawn.filter("copies > 0").select(*own.values(), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    dealt = each.withColumn("shuffle_key", shuffle_key(F.concat(key, F.lit(":copy:"), F.col("copy").cast("string"))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slot = (F.shiftright("shuffle_key", 30) * n / (1 << 30)).cast("int")
    found = dealt.repartitionById(n, slot).sortWithinPartitions("shuffle_key", doc, "copy")
    return found.select(*[F.col(x).alias(c) for c, x in own.items()], *[F.col(c).alias(added(c, names)) for c in ("copy", "shuffle_key")])


def added(name: str, names: list[str]) -> str:
    """The name of an added column: with underscores behind it until no input column, in any case, has it."""
    while name in {c.lower() for c in names}:
        name += "_"
    return name
