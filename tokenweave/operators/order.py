"""Global order without a single-task window.

A token stream is ordered, and an un-partitioned ordered window would pull the
whole corpus into one task.  Instead rows fall into many *order buckets* by a
monotone function of their order key.  Bucket totals are a small table; a running
sum over that table gives each bucket its base, and a window inside each bucket
gives the rest.  Buckets are cut from the order key itself, so a redone task puts
every row where it was, and a hot group (year, source, file) spans many buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenweave.functions.numbers import div
from tokenweave.session import default_buckets

#: Branches of a node in the search tree over bucket bounds.
TREE_WIDTH = 16

#: Keys drawn for each bucket, while that is at most as many keys as ``MOST_DRAWN``; then ``FEWEST``.
DRAWN, FEWEST, MOST_DRAWN = 16, 4, 1 << 18


def hash_order(*parts: Column | str | int) -> Column:
    """A seeded pseudo-random order key: the first 60 bits of an md5, as a long."""
    cols = [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p) for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    # Never null, which spares the joins on its bucket a null filter.
    return F.coalesce(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def hash_bucket(order_key: Column | str, buckets: int) -> Column:
    """Order bucket of a :func:`hash_order` key; equal-width ranges hold equal shares."""
    key = F.col(order_key) if isinstance(order_key, str) else order_key
    return F.shiftright(F.shiftright(key, 28) * F.lit(buckets).cast("long"), 32).cast("int")


def range_bounds(df: DataFrame, order: Sequence[str], buckets: int) -> DataFrame:
    """One row ``bounds``: the lower bounds of about equal shares of the natural order.

    The keys whose hash is divisible by some number are drawn and every so many of them is a bound, so the bounds
    follow from the keys alone, however often and wherever they are computed.  Nothing runs before the
    plan does, and only the balance of the buckets depends on what is drawn.
    """
    keys = df.select(*order)
    wanted = max(FEWEST * buckets, min(DRAWN * buckets, MOST_DRAWN))
    every = F.greatest(F.lit(1).cast("long"), div(keys.agg(F.count("*")).scalar(), wanted))
    drawn = keys.where(F.pmod(F.xxhash64(*order), every) == 0)
    listed = drawn.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("drawn"))
    at = F.transform(
        F.sequence(F.lit(1).cast("long"), F.lit(buckets - 1).cast("long")),
        lambda i: F.get("drawn", div(i * F.size("drawn"), buckets).cast("int")),
    )
    return listed.select((at if buckets > 1 else F.array()).alias("bounds"))


def with_range_bucket(
    df: DataFrame, order: Sequence[str], buckets: int | None = None, out: str = "bucket"
) -> DataFrame:
    """Adds the order bucket for natural keys (ids, paths, dates, positions) of any type with an order.

    The bucket is the number of bounds below the key, found by a search tree of short arrays that one scalar
    subquery gives: a row is sorted into one array per level, in the JVM.
    """
    if buckets is None:
        buckets = default_buckets(df.sparkSession, 4)
    spans = [TREE_WIDTH]
    while spans[-1] < buckets:
        spans.append(spans[-1] * TREE_WIDTH)
    bounds = F.col("bounds")

    def nodes(span: int) -> Column:
        """What separates the children of each node of a level."""
        child = span // TREE_WIDTH
        return F.transform(
            F.sequence(F.lit(0), F.lit((buckets - 1) // span)),
            lambda node: F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.lit(TREE_WIDTH - 1)), lambda k: F.get(bounds, node * span + k * child - 1)
                ),
                lambda bound: bound.isNotNull(),
            ),
        )

    tree = range_bounds(df, order, buckets).select(F.struct(*[nodes(s).alias(f"of{s}") for s in spans]).alias("tree"))
    key = F.struct(*order)
    found = df.withColumns({"tree__": tree.scalar(), out: F.lit(0)})
    for span in reversed(spans):
        borders = F.get(F.col(f"tree__.of{span}"), F.col(out))
        # The place of the key once sorted in; a lambda over the borders would be as
        # fast, but its constraints break the optimizer's handling of unions.
        below = F.array_position(F.sort_array(F.concat(borders, F.array(key))), key) - 1
        found = found.withColumn(out, F.coalesce((F.col(out) * TREE_WIDTH + below).cast("int"), F.lit(0)))
    return found.drop("tree__")


def prefix_sum(
    df: DataFrame,
    sums: Mapping[str, Column | str],
    order: Sequence[str],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Exclusive running sums in a global order, per group.

    ``df`` has a column ``bucket``, monotone in the order within a group; it becomes a struct of the groups and the
    bucket.  For each ``name -> value`` adds ``name`` (the sum over earlier rows), ``name_lo`` / ``name_hi`` (the span
    of the row's order bucket) and ``name_total`` (of the group).

    A struct is never null and equal to another with nulls at the same places, so a null group is a group like any
    other, and the rows stay partitioned by one column that is still there afterwards: the join with the bucket totals,
    the window, and whatever is grouped by the bucket later share one shuffle.
    """
    values = {name: F.col(v) if isinstance(v, str) else v for name, v in sums.items()}
    df = df.withColumn("bucket", F.struct(*groups, "bucket"))
    totals = df.groupBy("bucket").agg(*[F.sum(v).cast("long").alias(f"{n}_t") for n, v in values.items()])
    whole = Window.partitionBy(*[F.col("bucket")[g] for g in groups])
    running = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = totals.select(
        "bucket",
        *[
            c
            for n in values
            for c in (
                (F.sum(f"{n}_t").over(running) - F.col(f"{n}_t")).alias(f"{n}_lo"),
                F.sum(f"{n}_t").over(running).alias(f"{n}_hi"),
                F.sum(f"{n}_t").over(whole).alias(f"{n}_total"),
            )
        ],
    )
    spans = spans.hint("shuffle_hash")
    inside = (
        Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    starts = {n: F.col(f"{n}_lo") + F.sum(v).over(inside).cast("long") - v for n, v in values.items()}
    return df.join(spans, "bucket").withColumns(starts)


def ordered_sums(
    df: DataFrame,
    sums: Mapping[str, Column | str],
    order: Sequence[str],
    groups: Sequence[str] = (),
    hashed: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """:func:`prefix_sum` with the bucket chosen for the order.

    ``hashed`` says that ``order[0]`` is a :func:`hash_order` key; otherwise the
    groups and the order columns together are cut into equal shares.
    """
    spark = df.sparkSession
    if hashed:
        buckets = buckets or default_buckets(spark)
        return prefix_sum(df.withColumn("bucket", hash_bucket(order[0], buckets)), sums, order, groups)
    buckets = buckets or default_buckets(spark, 4)
    return prefix_sum(with_range_bucket(df, [*groups, *order], buckets), sums, order, groups)


def token_offsets(df: DataFrame, order: Sequence[str], groups: Sequence[str] = ("split",), **kw) -> DataFrame:
    """Start of each document in the token stream of its split; needs a column ``n``."""
    return ordered_sums(df, {"start": "n"}, order, groups, **kw)


def global_rank(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), out: str = "pos", **kw) -> DataFrame:
    """Zero-based position of each row in a total order, per group."""
    return ordered_sums(df, {out: F.lit(1).cast("long")}, order, groups, **kw)


def document_index(df: DataFrame, group: str, order: Sequence[str], out: str = "i") -> DataFrame:
    """Zero-based index of a document in the sorted listing of its group."""
    ranked = global_rank(df, order, (group,), out)
    return ranked.drop("bucket", f"{out}_lo", f"{out}_hi", f"{out}_total")


def contiguous_shard(rank: Column, rows: Column, shards: int) -> Column:
    """Shard of row ``rank`` when ``rows`` rows are cut into contiguous shards.

    Sizes differ by at most one, the longer ones first; with fewer rows than
    shards every row is a shard of its own.
    """
    k = F.least(F.lit(shards).cast("long"), rows)
    size = div(rows, k)
    longer = rows % k
    edge = longer * (size + 1)
    return (
        F.when(rank < edge, div(rank, size + 1))
        .otherwise(longer + div(rank - edge, size))
        .cast("int")
    )


def cut_point(
    df: DataFrame,
    order: Sequence[str],
    weight: Column,
    target: Column,
) -> DataFrame:
    """The row at which a running sum of ``weight`` reaches ``target`` of the total.

    ``df`` has a column ``bucket``, monotone in the order; ``target`` is written in
    terms of the column ``total``.  Gives at most one row
    ``(key struct<order>, within long)``: the first row, in order, whose running
    sum reaches the target, and how much of its own weight lies before the cut.
    Only bucket totals and the rows of one bucket are sorted, so splitting a
    corpus needs no shuffle of its texts.
    """
    light = df.select(*order, weight.cast("long").alias("w"), "bucket")
    totals = light.groupBy("bucket").agg(F.sum("w").alias("t"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = totals.select(
        "bucket", "t", F.sum("t").over(running).alias("hi"), F.sum("t").over(Window.partitionBy()).alias("total")
    ).withColumn("target", target.cast("long"))
    hit = placed.where((F.col("hi") >= F.col("target")) & (F.col("hi") - F.col("t") < F.col("target"))).select(
        "bucket", (F.col("target") - F.col("hi") + F.col("t")).alias("need")
    )
    inside = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # `hit` is one row by construction, so its broadcast cannot grow.
    rows = light.join(F.broadcast(hit), "bucket").withColumn("upto", F.sum("w").over(inside))
    reached = (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("w") < F.col("need"))
    return rows.where(reached).select(
        F.struct(*order).alias("key"), (F.col("need") - F.col("upto") + F.col("w")).alias("within")
    )


