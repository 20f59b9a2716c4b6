"""The corpus pipeline: stages applied in turn to the documents table, each written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, jaccard, mixing, quality, queries
from granary.llm.common import staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is trained on the labelled ones among docs."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Links are found by SimHash over 5-word shingles and verified at a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=decontaminate.SIMILARITY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document may come several times or not at all."""
    drawn = mixing.mix(docs, queries.WEIGHTS, default_weight=1.0)
    return drawn.select(*[f"`{c}`" for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token segments on disk, in the order that the mix gave the documents; a row for each read back from them."""
    return queries.tokens_of(docs, as_stored=True)


STAGES = [("quality", keep_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed), ("encode", encoded)]

#: Models, fingerprints and binary blocks are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
