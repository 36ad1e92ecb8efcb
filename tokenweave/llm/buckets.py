"""Candidate pairs from buckets of any size, without all pairs of a bucket.

Rows ``(bucket, node)`` are sorted by bucket; one streaming pass holds each
member against the bucket's first, its hub.  What hubs connect is a cluster; members of a
cluster that are still in several components afterwards meet block against block, and a
block pair gives off no more than a spanning forest of the links it finds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.llm.components import connected_components
from tokenweave.session import BLOCK_ROWS, release, stage

#: Members of a block.
BLOCK = 128
#: Pairs of two blocks that are compared one by one, without telling for all at once which are possible.
FEW = 64


def runs_with_hubs(rows: DataFrame) -> DataFrame:
    """``(bucket, hub, node, probe, twice)`` for buckets with two nodes, or one node twice.

    ``rows`` has ``bucket``, ``probe`` (0 or 1) and ``node``.  The hub is the first node with
    ``probe = 0``; a bucket without one gives nothing.  ``twice`` says that
    the node came more than once.
    """
    lined = rows.repartition("bucket").sortWithinPartitions("bucket", "probe", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = (None, None)  # of the bucket that the last batch ended in
        last, waiting = None, None  # its last member, and its hub's own row while it is alone
        for batch in batches:
            bucket, probe, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(bucket):
                continue
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            sizes = np.diff(np.append(first, len(bucket)))
            hubs, valid = np.repeat(node[first], sizes), np.repeat(probe[first] == 0, sizes)
            joined = hub[0] is not None and hub[0] == bucket[0]
            if joined:
                hubs[: sizes[0]], valid[: sizes[0]] = hub[1] if hub[1] is not None else 0, hub[1] is not None
            same = np.append(False, (bucket[1:] == bucket[:-1]) & (node[1:] == node[:-1]) & (probe[1:] == probe[:-1]))
            if joined and last == (probe[0], node[0]):
                same[0] = True
            several = np.repeat(sizes > 1, sizes)
            if joined:
                several[: sizes[0]] = True
            out = valid & several
            parts = [bucket[out], hubs[out], node[out], probe[out], same[out]]
            if joined and waiting is not None and valid[0]:
                parts = [np.append(np.array(w, p.dtype), p) for w, p in zip(waiting, parts)]
            end = first[-1]
            whole = (bucket[end], hubs[end] if valid[end] else None)
            alone = sizes[-1] == 1 and not (joined and len(first) == 1)
            waiting = (whole[0], whole[1], node[-1], probe[-1], False) if alone and valid[end] else None
            hub, last = whole, (probe[-1], node[-1])
            if len(parts[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p) for p in parts], names=["bucket", "hub", "node", "probe", "twice"]
                )

    return lined.select("bucket", "probe", "node").mapInArrow(
        run, "bucket bigint, hub bigint, node bigint, probe int, twice boolean"
    )


def spanning_links(linked: Callable[[object, object], bool], possible: Callable[[list, list], np.ndarray] | None = None):
    """Column function over two blocks: links between components that members of both link.

    Members that links of the same two blocks already join are not compared again.  ``possible``, where
    given, tells for all pairs of two lists of items at once which of them need to be compared.
    """

    @F.arrow_udf("array<struct<a:string,b:string>>")
    def compare(
        c1: pa.Array, x1: pa.Array, c2: pa.Array, x2: pa.Array
    ) -> pa.Array:
        out = []
        for row in zip(c1, x1, c2, x2):
            left_c, left_x, right_c, right_x = (v.as_py() for v in row)
            joined, links = Joined(), []
            open_ = possible(left_x, right_x) if possible and len(left_x) * len(right_x) > FEW else None
            for i, (comp_a, item_a) in enumerate(zip(left_c, left_x)):
                for j in range(len(right_c)) if open_ is None else np.flatnonzero(open_[i]).tolist():
                    comp_b, item_b = right_c[j], right_x[j]
                    if comp_a != comp_b and joined.apart(comp_a, comp_b) and linked(item_a, item_b):
                        joined.join(comp_a, comp_b)
                        links.append({"a": comp_a, "b": comp_b})
            out.append(links)
        return pa.array(out, pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())])))

    return compare


class Joined:
    """Components that links found so far have joined."""

    def __init__(self):
        self.up: dict = {}

    def root(self, c):
        while (above := self.up.get(c, c)) != c:
            c = above
        return c

    def apart(self, a, b) -> bool:
        return self.root(a) != self.root(b)

    def join(self, a, b) -> None:
        self.up[self.root(a)] = self.root(b)


def unsettled_members(edges: DataFrame, found: DataFrame) -> DataFrame | None:
    """``(cluster, node, comp, first, block, blocks)`` of what the hubs left open; None where that is nothing.

    ``edges`` are all (member, hub) pairs ``a, b``; what they connect is a cluster, and any two
    members of a bucket are in one.  A cluster of one component, or of two members, is settled.
    Only edges between different components are followed, from component to component.
    """
    a, b = found.toDF("a", "c_a"), found.toDF("b", "c_b")
    between = edges.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")
    )
    clusters = connected_components(between)
    comps = stage(
        clusters.select(F.col("node").alias("comp"), F.col("component").alias("cluster")).unionByName(
            clusters.select(F.col("component").alias("comp"), F.col("component").alias("cluster")).distinct()
        ),
        "open",
    )
    if comps.isEmpty():
        release(comps)
        return None
    inside = found.withColumnRenamed("component", "comp").join(comps, "comp")
    placed = stage(inside.unionByName(comps.withColumn("node", F.col("comp"))).select("cluster", "node", "comp"), "placed")
    mixed = stage(
        placed.groupBy("cluster")
        .agg(F.min("comp").alias("first"), F.count("*").alias("size"))
        .where("size > 2")
        .select("cluster", "first", F.ceil(F.col("size") / BLOCK).alias("blocks")),
        "mixed",
    )
    release(comps)
    if mixed.isEmpty():
        release(placed, mixed)
        return None
    members = placed.join(mixed, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members.reads = (placed, mixed)  # for those who release them
    return members


def block_pairs(rest: DataFrame, payload: list[str]) -> DataFrame:
    """Blocks ``l`` of the members outside their cluster's first component, with all blocks ``r``; ``rest``, staged, is released."""
    packed = F.collect_list(F.struct("comp", *payload))
    right = rest.groupBy("cluster", "block").agg(packed.alias("r")).drop("block")
    left = rest.where(F.col("comp") != F.col("first")).groupBy("cluster", "block").agg(packed.alias("l")).drop("block")
    left, right = stage(left, "left"), stage(right, "right")
    release(rest)
    return left.join(right, "cluster")


def unsettled_groups(rest: DataFrame, found: DataFrame) -> DataFrame | None:
    """``(cluster, node, comp, first, block, blocks)`` of what the hubs left open of buckets; None where that is nothing.

    ``rest`` are ``(bucket, node)``, each once, and any two members of a bucket that lie in different components have to meet.
    Buckets that components connect are one cluster, as families of items share many buckets.  Where buckets of little in common
    are connected, as they are in ever longer chains the more items there are, each is a cluster of its own:
    of the two ways the one with fewer pairs is taken.
    """
    comp = F.coalesce("component", "node").alias("comp")
    members = stage(rest.join(found, "node", "left").select("bucket", "node", comp), "rest")
    spans = members.groupBy("bucket").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.count("*").alias("size"))
    mixed = stage(members.join(spans.where("first != last").drop("last"), "bucket"), "mixed")
    release(members)
    if mixed.isEmpty():
        release(mixed)
        return None
    chains = connected_components(mixed.where("comp != first").select(F.col("comp").alias("a"), F.col("first").alias("b")))
    chained = mixed.join(chains.toDF("comp", "chain"), "comp", "left").withColumn("chain", F.coalesce("chain", "comp"))
    chained = stage(chained.select("chain", "bucket", "size", "node", "comp"), "chained")
    release(mixed)
    whole = chained.select("chain", "node").distinct().groupBy("chain").agg(F.count("*").cast("double").alias("n"))
    parts = chained.groupBy("chain").agg(F.sum(F.col("size").cast("double")).alias("pairs"))  # a bucket's size for each member
    apart = whole.join(parts, "chain").select("chain", (F.col("pairs") < F.col("n") * F.col("n")).alias("apart"))
    cluster = F.when(F.col("apart"), F.concat("chain", F.lit("/"), F.col("bucket").cast("string"))).otherwise(F.col("chain"))
    placed = stage(chained.join(apart, "chain").select(cluster.alias("cluster"), "node", "comp").distinct(), "placed")
    release(chained)
    sizes = placed.groupBy("cluster").agg(F.min("comp").alias("first"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = placed.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members.reads = (placed,)  # for those who release them
    return members


def unsettled_links(rest: DataFrame, payloads: DataFrame, found: DataFrame, linked, possible=None) -> DataFrame | None:
    """Links ``(a, b)`` of components inside buckets that several components lie in; None where there are none.

    ``payloads`` has ``node`` and ``payload``, which ``linked`` and ``possible`` take.
    """
    open_ = unsettled_groups(rest, found)
    if open_ is None:
        return None
    pairs = block_pairs(stage(open_.join(payloads.select("node", "payload"), "node"), "blocks"), ["payload"])
    release(*open_.reads)
    compare = spanning_links(linked, possible)
    links = pairs.select(F.explode(compare("l.comp", "l.payload", "r.comp", "r.payload")).alias("p"))
    return stage(links.select("p.*").distinct(), "open-links", batch=BLOCK_ROWS)
