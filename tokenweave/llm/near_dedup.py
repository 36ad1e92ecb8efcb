"""MinHash near-duplicate detection over whole documents.

Equal shingle sets form one class, whose first row stands for it.  Minima of
universal hashes are cut into bands; in every bucket of a band the first member is
the hub, and the others are held against it: signatures first, then the full shingle sets.
Components of these links come from hooking and pointer jumping.

What hubs connect is a cluster.  One whose members are then still in several components is
settled by blocks: the members outside the cluster's first component meet all members,
block against block, and no more than a spanning forest of the links leaves a task.
So no link is lost, and a bucket of very many copies costs one comparison a member.

Edge cases: a text without words is linked with nothing; with fewer words than a
shingle, all words are one shingle; repeated rows are copies of each other; null ids
are rows of their own, after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenweave.llm.buckets import Joined, block_pairs, unsettled_members
from tokenweave.llm.components import connected_components, merged_components
from tokenweave.llm.shingles import (
    Minima,
    WordHashes,
    band_keys,
    bands_for,
    equal_minima,
    lists,
    shingle_set,
    shingles_udf,
)
from tokenweave.llm.text import ROW, packed, unpacked, with_row_key
from tokenweave.session import BLOCK_ROWS, release, stage

WORDS = 5
PERCENT = 80
ROWS = 4
#: Chance that banding misses a pair at the threshold.
MISS = 1e-7


def signature_bound(count: int, percent: int) -> int:
    """Equal minima that a link has, but for six standard deviations."""
    p = percent / 100
    return max(0, math.floor(count * p - 6 * math.sqrt(count * p * (1 - p))))


def sketch(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Adds ``n_shingles``, the digest ``d1, d2`` of the set, band ``keys`` and the ``signature``."""
    bands = bands_for(percent / 100, ROWS, MISS)
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL(
        "n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>, signature binary"
    ).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, minima = WordHashes(), Minima(bands * ROWS)
        for batch in batches:
            sizes, high, low, keys, signatures = [], [], [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                found = shingle_set(text, words, table)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                least = minima.of(found)
                sizes.append(len(found))
                high.append(int.from_bytes(digest[:8], "little", signed=True))
                low.append(int.from_bytes(digest[8:], "little", signed=True))
                keys.append(band_keys(least, ROWS))
                signatures.append((least >> np.uint64(32)).astype(np.uint32).tobytes())
            made = [
                pa.array(sizes, pa.int64()),
                pa.array(high, pa.int64()),
                pa.array(low, pa.int64()),
                lists(keys, pa.int64()),
                pa.array(signatures, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], names=[*batch.schema.names, "n_shingles", "d1", "d2", "keys", "signature"]
            )

    return docs.mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both))
        .select("a", "b")
    )


def exact_links(bound: int, percent: int):
    """Column function over two blocks: links between components that members of both link.

    Signatures are compared first, then the full sets; members that links of the same two
    blocks already join are not compared again.
    """

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def compare(
        c1: pa.Array, s1: pa.Array, x1: pa.Array, c2: pa.Array, s2: pa.Array, x2: pa.Array
    ) -> pa.Array:
        out = []
        for row in zip(c1, s1, c2, s2, x1, x2):
            left_c, left_s, right_c, right_s = (v.as_py() for v in row[:4])
            left, right = ([np.asarray(v.values) for v in side.values] for side in row[4:])
            matrix, comps = np.stack([np.frombuffer(s, np.uint32) for s in right_s]), np.array(right_c)
            joined, links = Joined(), []
            for comp, signature, x in zip(left_c, left_s, left):
                same = (matrix == np.frombuffer(signature, np.uint32)).sum(axis=1)
                for k in np.flatnonzero((same >= bound) & (comps != comp)):
                    y, other = right[k], right_c[k]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not joined.apart(comp, other):
                        continue
                    merged = np.concatenate([x, y])
                    merged.sort(kind="stable")
                    both = int((merged[1:] == merged[:-1]).sum())
                    if 100 * both >= percent * (len(merged) - both):
                        joined.join(comp, other)
                        links.append({"a": comp, "b": other})
            out.append(links)
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return compare


def unsettled_links(edges: DataFrame, payloads: DataFrame, found: DataFrame, bound: int, percent: int) -> DataFrame | None:
    """Links ``(a, b)`` of components inside clusters that several components lie in; None where there are none."""
    open_ = unsettled_members(edges, found)
    if open_ is None:
        return None
    pairs = block_pairs(stage(open_.join(payloads, "node"), "blocks"), ["signature", "set"])
    compare = exact_links(bound, percent)
    made = compare("l.comp", "l.signature", "l.set", "r.comp", "r.signature", "r.set")
    links = pairs.select(F.explode(made).alias("p")).select("p.*").distinct()
    return stage(links, "open-links", batch=BLOCK_ROWS)


def near_copies(docs: DataFrame, key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` (the smallest key of its component) and ``kept``.

    ``kept`` marks one row of each component: the smallest key, of equal ones the first row.
    """
    carried = docs.columns
    light = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried if c != "text"]).alias("carried__"),
        F.col(key).alias("key__"),
        F.col("text").cast("string").alias("text"),
    )
    sketched = stage(sketch(with_row_key(light), words, percent), "sketch")
    classes = stage(
        sketched.where(F.col("n_shingles") > 0)
        .groupBy("d1", "d2")
        .agg(
            F.min(ROW).alias("node"),
            F.min(F.struct(F.col("key__").isNull().alias("none"), F.col("key__").alias("key"), F.col(ROW).alias("row"))).alias("first"),
        ),
        "classes",
    )
    reps = stage(
        sketched.select(F.col(ROW).alias("node"), "keys", "signature").join(classes.select("node"), "node", "left_semi"),
        "representatives",
    )
    entries = reps.select("node", F.explode("keys").alias("band"))
    hubs = stage(
        entries.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c"),
        "hubs",
    )
    members = stage(entries.join(hubs, "band"), "members")
    bound = signature_bound(bands_for(percent / 100, ROWS, MISS) * ROWS, percent)
    involved = members.select("node").distinct()
    sets = stage(
        sketched.select(F.col(ROW).alias("node"), "text")
        .join(involved, "node", "left_semi")
        .select("node", shingles_udf(words)("text").alias("set")),
        "sets",
    )
    pairs = stage(
        members.where(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(),
        "pairs",
    )
    marked = stage(reps.select("node", "signature").join(involved, "node", "left_semi"), "signatures")
    release(reps, hubs, members)
    close = (
        pairs.join(marked.toDF("a", "s_a"), "a")
        .join(marked.toDF("b", "s_b"), "b")
        .where(equal_minima("s_a", "s_b") >= bound)
        .select("a", "b")
    )
    links = stage(_verified(close, sets, percent), "links")
    found = connected_components(links)
    more = unsettled_links(pairs, sets.join(marked, "node"), found, bound, percent)
    if more is not None:
        found = merged_components(found, more)
    rooted = classes.join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("best"))
    settled = stage(rooted.join(firsts, "root").select("d1", "d2", "best"), "components")
    release(classes, sets, pairs, marked, links)
    wide = sketched.drop("keys", "signature").join(settled, ["d1", "d2"], "left")
    alone = F.col("n_shingles") == 0
    return wide.select(
        *[F.col("text") if c == "text" else F.col(f"carried__.`{c}`").alias(c) for c in carried],
        "n_shingles",
        F.when(alone, F.col("key__")).otherwise(F.col("best.key")).alias("component_id"),
        (alone | (F.col("best.row") == F.col(ROW))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns of ``docs``, whatever their names."""
    kept = near_copies(packed(docs, key, "text"), key, words, percent).where("kept")
    return unpacked(kept, docs.columns, key, "text")
