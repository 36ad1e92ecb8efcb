"""Cutting token streams into fixed-length next-token sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.functions.numbers import div

# Fixed value: the default sequence length.
SEQUENCE_LENGTH = 512


def sequence_count(tokens: Column, length: int) -> Column:
    """Sequences in a stream: the last target needs one id more; a remainder is dropped."""
    return F.greatest(F.lit(0).cast("long"), div(tokens - 1, length))


def _joined(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("lo", "piece")))
    return pieces.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda p: p["piece"])).alias("t"))


def pack_windows(
    df: DataFrame,
    length: int = SEQUENCE_LENGTH,
    groups: Sequence[str] = ("split",),
    ids: Column | str = "ids",
) -> DataFrame:
    """Rows ``(groups, seq_id, t)`` with ``t`` the ``length + 1`` ids from ``seq_id * length``.

    ``df`` comes from ``token_offsets`` and so is already partitioned by
    ``(groups, bucket)``.  A sequence inside one bucket is put together there
    without another shuffle; only pieces of sequences that cross a bucket border
    (about one sequence a bucket) are shuffled by sequence.  ``ids`` may be an
    expression: it is evaluated after the offsets' shuffle, so that shuffle can
    carry texts instead of id arrays.
    """
    start, n, low, high = (F.col(c) for c in ("start", "n", "start_lo", "start_hi"))
    zero = F.lit(0).cast("long")
    spans = (
        df.where(n > 0)
        .withColumn("c0", F.greatest(zero, div(start - 1, length)))
        .withColumn("c1", F.least(div(start + n - 1, length), sequence_count(F.col("start_total"), length) - 1))
        .where(F.col("c0") <= F.col("c1"))
        # First and last sequence that lie in the bucket as a whole.
        .withColumn("in0", div(low + (length - 1), length))
        .withColumn("in1", F.when(high > length, div(high - length - 1, length)).otherwise(-1))
    )
    id_col = F.col(ids) if isinstance(ids, str) else ids

    def cut(rows: DataFrame, sequences: Column) -> DataFrame:
        keep = [*groups, "bucket", "start", "n", "ids"]
        seq = rows.withColumn("ids", id_col).select(*keep, F.explode(sequences).alias("seq_id"))
        lo = F.greatest(F.col("start"), F.col("seq_id") * length)
        hi = F.least(F.col("start") + F.col("n"), F.col("seq_id") * length + length + 1)
        piece = F.slice(F.col("ids"), (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
        return seq.select(*groups, "bucket", "seq_id", lo.alias("lo"), piece.alias("piece"))

    c0, c1, in0, in1 = (F.col(c) for c in ("c0", "c1", "in0", "in1"))
    whole_from, whole_to = F.greatest(c0, in0), F.least(c1, in1)
    inner_rows = spans.where(whole_from <= whole_to).select("*", whole_from.alias("s0"), whole_to.alias("s1"))
    inner = _joined(cut(inner_rows, F.sequence("s0", "s1")), [*groups, "bucket", "seq_id"]).drop("bucket")
    crossing = F.filter(F.sequence(c0, c1), lambda c: (c < in0) | (c > in1))
    edge_rows = spans.where((c0 < in0) | (c1 > in1)).withColumn("crossing", crossing)
    edge = _joined(cut(edge_rows, F.col("crossing")), [*groups, "seq_id"])
    return inner.unionByName(edge)


def shift_targets(df: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Replace ``t`` by inputs ``x`` and targets ``y``, which are one position ahead."""
    t = F.col("t")
    return df.withColumns({"x": F.slice(t, 1, length), "y": F.slice(t, 2, length)}).drop("t")


def pack_sequences(df: DataFrame, length: int = SEQUENCE_LENGTH, **kw) -> DataFrame:
    """Rows ``(groups, seq_id, x, y)`` covering each stream up to its remainder."""
    return shift_targets(pack_windows(df, length, **kw), length)
