"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, packed token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``documents``; the last returns packed sequences.
Null ids, null texts and repeated rows pass through every stage as rows of their
own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, mixing, near_duplicates, packing, quality
from parlance.llm.scratch import Scratch
from parlance.runtime import ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects; it learns from the learnable labelled rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.learnable())
    ship_package(spark)
    return quality.keep_good(docs, quality.fit(quality.training_rows(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    ship_package(spark)
    return near_duplicates.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights; rows are drawn runs of a document's blocks."""
    return mixing.mixed_texts(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, packed into sequences of 2,048."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("token-ID output", pack_tokens),
]

#: Trained scores, sketches, pseudorandom draws and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
