"""Doing expensive work once: finished outputs are read, unfinished ones rebuilt."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def is_finished(spark: SparkSession, path: str) -> bool:
    """True for a table whose write was committed; a folder alone does not count."""
    return _exists(spark, f"{path}/_SUCCESS")


def materialize_once(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ("split",)
) -> DataFrame:
    """The table at ``path``, built and written first when it is not finished."""
    if not is_finished(spark, path):
        build().write.partitionBy(*partition_by).mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_years(
    spark: SparkSession,
    path: str,
    years: Sequence[int],
    build: Callable[[list[int]], DataFrame],
    column: str = "year",
) -> DataFrame:
    """The wanted years of a table partitioned by year; only missing ones are built.

    Finished years are listed in a small table next to the data, appended to after
    the data is committed.  An unfinished year is overwritten as a whole.
    """
    data, log = f"{path}/data", f"{path}/finished"
    wanted = spark.createDataFrame([(int(y),) for y in sorted(set(years))], f"{column} int")
    missing = wanted
    if is_finished(spark, log):
        missing = wanted.join(spark.read.parquet(log), column, "left_anti")
    todo = [r[0] for r in missing.collect()]  # a subset of the years asked for
    if todo:
        (
            build(todo)
            .write.partitionBy(column)
            .mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .parquet(data)
        )
        wanted.where(F.col(column).isin(todo)).coalesce(1).write.mode("append").parquet(log)
    return spark.read.parquet(data).where(F.col(column).isin(list(years)))


def pin(df: DataFrame) -> DataFrame:
    """Keep a table in memory; partitions that are lost or do not fit are recomputed."""
    return df.persist(StorageLevel.MEMORY_ONLY)
