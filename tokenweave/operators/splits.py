"""Train / validation / test assignment: four rules, none of which shuffles texts
except the per-group index."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.operators.order import cut_point, document_index, hash_bucket, hash_order, with_range_bucket
from tokenweave.session import default_buckets

# Fixed values of the split rules.
VAL_FRACTION = 0.0005
SPLIT_SEED = 2357
OFFSET_FRACTION = 0.8
MODULO_TRAIN_LAST = 6
MODULO_VAL_LAST = 8
MODULO = 10

#: Plan nodes that keep the rows where they are.
FIXED = {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "Range"}


def random_split(
    df: DataFrame,
    key: str = "doc_key",
    fraction: float = VAL_FRACTION,
    seed: int = SPLIT_SEED,
    buckets: int | None = None,
) -> DataFrame:
    """Seeded random split; validation gets ``ceil(fraction * rows)`` documents.

    Adds ``order_key``, the seeded shuffle order of the documents, and ``split``.
    The validation documents are the first in that order, so one cut key decides
    every row: the keys are scanned for the cut, the texts only mapped over.

    Rows with equal keys are told apart by their place in the input where the input is read as it is stored; behind a
    shuffle, which leaves no such place, by a hash of all their columns, so that only rows alike in every column stay
    on one side together.
    """
    place = F.monotonically_increasing_id() if has_fixed_rows(df) else F.xxhash64(*_hashable(df))
    keyed = df.withColumns({"order_key": hash_order(F.lit(seed), key), "place__": place})
    order = ["order_key", key, "place__"]
    buckets = buckets or default_buckets(df.sparkSession)
    placed = keyed.withColumn("bucket", hash_bucket("order_key", buckets))
    cut = cut_point(placed, order, F.lit(1), F.ceil(F.lit(float(fraction)) * F.col("total")))
    is_val = F.struct(*order) <= cut.select("key").scalar()
    return keyed.withColumn("split", F.when(is_val, "val").otherwise("train")).drop("place__")


def has_fixed_rows(df: DataFrame) -> bool:
    """Whether each row has the same place in every read: a scan with only projections and filters above it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return set(re.findall(r"^[\s:+-]*(\w+)", plan, re.MULTILINE)) <= FIXED


def _hashable(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]


def modulo_rule(index: Column) -> Column:
    """Split of the document at ``index`` of its group: seven, two and one of ten."""
    digit = index % MODULO
    return (
        F.when(digit <= MODULO_TRAIN_LAST, "train").when(digit <= MODULO_VAL_LAST, "val").otherwise("test")
    )


def modulo_split(df: DataFrame, group: str = "year", order: Sequence[str] = ("doc_key",)) -> DataFrame:
    """Split by the index of the document in its group, in ``order``; adds ``i``, ``split``."""
    return document_index(df, group, order).withColumn("split", modulo_rule(F.col("i")))


def offset_split(
    df: DataFrame,
    order: Sequence[str],
    text: str = "text",
    fraction: float = OFFSET_FRACTION,
    buckets: int | None = None,
) -> DataFrame:
    """Cut the concatenation of all texts at a character offset.

    Rows before the cut go to train, rows after it to val; the row on the cut is
    divided in two.  Adds ``split``; ``text`` holds the piece.
    """
    target = F.floor(F.lit(float(fraction)) * F.col("total"))
    cut = cut_point(with_range_bucket(df, order, buckets), order, F.length(text), target)
    # A cut at offset zero has no row: everything then lies after it.
    at = df.withColumn("cut", cut.select(F.struct("key", "within").alias("cut")).scalar())
    key = F.struct(*order)
    head = F.when(F.col("cut").isNull() | (key > F.col("cut.key")), 0).when(
        key < F.col("cut.key"), F.length(text)
    ).otherwise(F.col("cut.within")).cast("int")
    body = F.col(text)
    sides = F.array(
        F.struct(F.lit("train").alias("split"), F.substring(body, F.lit(1), F.col("head")).alias("piece")),
        F.struct(
            F.lit("val").alias("split"),
            F.substring(body, F.col("head") + 1, F.length(body)).alias("piece"),
        ),
    )
    rest = [c for c in df.columns if c != text]
    return (
        at.withColumn("head", head)
        .select(*rest, F.inline(F.filter(sides, lambda s: F.length(s["piece"]) > 0)))
        .withColumnRenamed("piece", text)
    )


def file_split(df: DataFrame, name: Column, rules: Mapping[str, str]) -> DataFrame:
    """The file decides: ``rules`` maps a suffix of the file name to a split.

    Rows of files without a rule belong to no split and are left out.
    """
    split = F.lit(None).cast("string")
    for suffix, value in rules.items():
        split = F.when(name.endswith(suffix), value).otherwise(split)
    return df.withColumn("split", split).where(F.col("split").isNotNull())
