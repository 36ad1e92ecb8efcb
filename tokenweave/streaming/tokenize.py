"""Tokenizing documents as their files arrive.

The per-document operators keep no state, so they run unchanged on a streaming
source; the checkpoint remembers which files are done, which is the incremental
form of "tokenize what is not tokenized yet".  Splits, offsets and permutations
need the whole corpus and stay batch jobs over the table written here.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tokenweave.functions.ids import token_len


def tokenize_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    out: str,
    checkpoint: str,
    ids: Column,
    key: str = "doc_key",
    text: str = "text",
    format: str = "parquet",
) -> StreamingQuery:
    """Append ``(key, ids, n)`` of all files not seen before, then stop."""
    docs = spark.readStream.schema(schema).format(format).load(source)
    rows = docs.where(F.col(text).isNotNull()).select(key, ids.alias("ids")).withColumn("n", token_len("ids"))
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
