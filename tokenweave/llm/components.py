"""Connected components by hooking and pointer jumping, one shuffled table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenweave.session import release, stage

#: Links of one node that a task takes as one group; a node with more is dealt out in several.
GROUP = 1 << 16


def _dealt(links: DataFrame, count: int, most: int) -> DataFrame:
    """Adds ``part``: 0, or one of several parts of the links of a node with more than ``most``."""
    if count <= most:
        return links.withColumn("part", F.lit(0).cast("long"))
    heavy = links.groupBy("u").agg(F.ceil(F.count("*") / most).alias("parts")).where("parts > 1")
    return links.join(heavy, "u", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("v"), "parts"))
    )


def _round(links: DataFrame, count: int, most: int) -> DataFrame:
    """Links ``u > v`` with the same components; ``moved`` where they are not yet a node and its least one.

    Of a node's links the least stays, and the others link their ends with it.  Then every link to a node that has
    a link of its own goes to the end of that.
    """
    least = F.min("v").over(Window.partitionBy("u", "part"))
    hooked = _dealt(links.select("u", "v"), count, most).withColumn("m", least).select(
        F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
        F.col("m").alias("v"),
        (F.col("v") == F.col("m")).alias("own"),
        "part",
    )
    up = hooked.where("own and part = 0").select(F.col("u").alias("v"), F.col("v").alias("next"))
    jumped = hooked.join(up, "v", "left")
    return (
        jumped.select(
            "u",
            F.coalesce("next", "v").alias("v"),
            (~F.col("own") | (F.col("part") > 0) | F.col("next").isNotNull()).alias("moved"),
        )
        .groupBy("u", "v")
        .agg(F.max("moved").alias("moved"))
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = GROUP) -> DataFrame:
    """``(node, component)`` of every node that is not the least of its component.

    Nothing is collected but counts.  Self-links and repeated links are allowed; no links give an empty result.
    """
    links = stage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    count = moved = links.count()
    while moved:
        before, links = links, stage(_round(links, count, most), "links")
        release(before)
        count, moved = links.agg(F.count("*"), F.count_if("moved")).first()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def merged_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` components, after ``links`` ``(a, b)`` between their least nodes."""
    roots = connected_components(links)
    higher = found.join(roots.toDF("component", "higher"), "component", "left")
    return higher.select("node", F.coalesce("higher", "component").alias("component")).unionByName(roots)
