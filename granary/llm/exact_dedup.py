"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by SHA-256 digest. A batch of
documents is reduced to digests (the texts themselves never move), collapsed to
one row per digest, anti-joined by sort-merge with the index, and what is new
is appended. Which row stays and how many share a text then comes from a join
of the digests with the index, in which rows of heavy groups don't move.

A batch has an id from its caller. Repeating a call with the same id and
documents, after a lost result or a job that broke off, gives the same rows and
appends only what is missing. One batch is appended at a time; if two ran at
once and both brought a text, the one with the smaller id keeps it from then on.

Rows: texts are equal if identical after lower-casing A-Z; null counts as
empty. Of equal texts in a batch the row with the largest id stays; a text that
the index held before keeps the row it held. Rows that repeat both id and text
each get a row and exactly one of them is kept. Null ids stay only where no
other id has the text. An empty batch changes nothing. Only the id and text
columns are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import ascii_lower, spread_join, staged
from granary.sources.storage import Storage


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """Digests seen so far at a path in storage that all executors share; a later session attaches to the same path, with as many buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.buckets, self.storage = spark, path, buckets, Storage(spark, path)
        if not self.storage.create("_buckets", str(buckets)) and (held := int(self.storage.read("_buckets"))) != buckets:
            raise ValueError(f"the index at {path} has {held} buckets, not {buckets}")
        self.name = f"granary_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.name} (digest binary, keep_id {id_type}, batch string) using parquet "
            f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def detach(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"drop table if exists {self.name}")

    def destroy(self) -> None:
        """Forget the table's name and remove its files."""
        self.detach()
        self.storage.delete(self.storage.root)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size (rows of this batch with that text), kept. What is new is appended to the index under the batch's id."""
    marked = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))
    rows = staged(marked.groupBy("digest", "id").agg(F.count("*").alias("copies")), "digests")
    groups = rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("ids"))
    groups = staged(groups, "groups")  # else the anti-join below would be pushed under this aggregation, and a heavy group's rows meet in one task
    index.append(groups.withColumn("batch", F.lit(batch)).hint("merge").join(index.rows(), "digest", "left_anti"))
    held = index.rows().groupBy("digest").agg(F.min(F.struct("batch", "keep_id")).alias("held"))
    classes = groups.drop("keep_id").hint("merge").join(held, "digest").select("digest", "group_size", "ids", F.col("held.keep_id").alias("keep_id"), (F.col("held.batch") == batch).alias("fresh"))
    met = spread_join(rows, staged(classes, "classes"), "digest", "ids").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.col("fresh") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return met.select("id", "digest", "keep_id", "group_size", kept.alias("kept"))
