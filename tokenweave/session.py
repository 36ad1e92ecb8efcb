"""Session defaults and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tokenweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators were tuned for; ``conf`` wins."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a temporary folder; on a
    cluster a machine-local folder would lose data with its machine, so the
    missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tokenweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that go to a Python worker at a time, and how many where each holds two blocks of items.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BLOCK_ROWS = 16


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), batch: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where two later branches would otherwise repeat an expensive step, and
    where a value (a line number) must not change when a lost task is redone.  The shuffle files of
    the write go when it has ended: the table stands for them, so a chain of steps holds one step's at a time.
    ``batch`` rows at most go to a Python worker at a time in this write: for rows so large that thousands do not fit in memory.
    """
    conf, path = df.sparkSession.conf, scratch_path(df.sparkSession, name)
    before, rows = conf.get(SHUFFLE_CLEANUP, "false"), conf.get(BATCH)
    conf.set(SHUFFLE_CLEANUP, "true")
    conf.set(BATCH, str(batch or rows))
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
        conf.set(BATCH, rows)
    staged = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    staged.staged_at = path
    return staged


def release(*staged: DataFrame) -> None:
    """Remove tables that ``stage`` wrote, once everything made of them is written itself.

    Nothing that is still to be computed may read them: the shared folder then holds what is needed, not all that was made.
    """
    for df in staged:
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def default_buckets(spark: SparkSession, per_partition: int = 16, most: int = 1 << 22) -> int:
    """Order buckets for a two-level prefix sum: a multiple of the shuffle partitions.

    The cluster sizes ``spark.sql.shuffle.partitions`` for its data, so buckets
    follow the data; several per partition even out the hash placement.  Results
    never depend on the number.
    """
    return min(most, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def task_count(spark: SparkSession) -> int:
    """Tasks for rows that are small but stand for much work, as the names of files do.

    Given to ``repartition`` as a number: by size alone Spark would put such rows together in a few tasks.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame, *keys: str, most: int = 64) -> DataFrame:
    """Redistribute a source that has fewer input splits than the session has cores.

    A corpus of any size has many splits and passes through untouched; one small
    file would otherwise run its whole tokenizing stage in a single task.
    """
    width = min(most, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(width, *keys) if df.rdd.getNumPartitions() < width else df
