"""A cleaning pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage but the last gives documents with the columns it was given.  Removed text
leaves ``n_chars`` at the length of what is left.  A missing benchmark is an error, not an empty set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from tokenweave.llm.queries import tokenizer_file
from tokenweave.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that consist of them alone."""
    return line_dedup.dedup_lines(docs, words=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that consist of them for the most part."""
    return decontaminate.remove_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, a row per piece."""
    pieces = packing.pack_documents(docs, tokenizer_file())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids"
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Estimates, components and tokens are not for SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
