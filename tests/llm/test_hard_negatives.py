"""Hard negatives against a scan, the curve against its definition, the bounds against scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenweave.llm import hard_negatives
from tokenweave.llm.hard_negatives import hilbert_keys, mine_negatives, score_bounds

SCHEMA = "vec_id long, embedding array<float>, label int, row__ string, score int, chunk int, place string"


def rows(n, seed, dims=6, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.5) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = r.randrange(labels)
        v = [c + r.gauss(0, 0.2) for c in centres[label]]
        if i % 3 == 0:
            v = [0.25] * dims  # a vector that a third of all rows share
        out.append((i, v, label if i % 17 else r.randrange(labels), "x", 1, 2, "y"))
    return out


def brute(data, every=10):
    part = []
    for place, (i, v, label, *_) in enumerate(data):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((place, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for place, i, label, v in part:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, p, m) for p, j, m, w in part if p != place]
        own = sorted((s for s in scored if s[3] == label), key=order)[:5]
        for ps, pid, *_ in own:
            hard = sorted((s for s in scored if s[3] != label and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:10]
            out += [(i, pid, k + 1, s[1], ps, s[0]) for k, s in enumerate(hard)]
    return sorted(out, key=repr)


def mined(df, every=10):
    found = mine_negatives(df, F.col("vec_id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("sizes", [(512, (2048, 65_536), 256, 256, 256), (8, (20, 50), 4, 2, 3)])
def test_against_a_scan(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK_ROWS", "SHELF_ROWS", "CHUNK_ROWS", "SLICE_CHUNKS", "ZONE_SHELVES"), sizes):
        monkeypatch.setattr(hard_negatives, name, size)
    data = rows(400, 1)
    got = mined(spark.createDataFrame(data, SCHEMA).repartition(4, "vec_id"))
    want = brute(data)
    assert len(want) > 300 and got == want


def test_odd_rows(spark, none):
    nan, inf = float("nan"), float("inf")
    data = rows(60, 2, dims=3)
    data += [(100, None, 1), (110, [1.0, None, 2.0], 1), (120, [nan, 1.0, 1.0], 1), (130, [inf, 0.0, 0.0], 1)]
    data += [(140, [0.5, 0.5, 0.5], None), (None, [0.3, 0.3, 0.3], 1), (None, [0.3, 0.3, 0.3], 2)]
    data += [(150, [], 1), (160, [0.9], 2), (160, [0.9], 2), (170, [0.25, 0.3, 0.3, 0.1, 0.2], 3)]
    data = [(*r, *("x", 1, 2, "y")[: 7 - len(r)]) if len(r) < 7 else r for r in data]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    # Repeated ids: rows are told apart by their place, so ties among them may stand in either order.
    assert sorted(map(repr, mined(df))) == sorted(map(repr, brute(data)))
    assert mined(df.where("vec_id % 10 = 1")) == [] and mined(df.limit(0)) == []
    with pytest.raises(ValueError, match="do not fit"):
        mined(spark.createDataFrame([(0, [1e12], 1, "", 0, 0, "")], SCHEMA))


def test_large_components_stay_exact(spark):
    r = random.Random(4)
    for size in (100.0, 50_000.0, 3e6):
        data = [(i, [r.uniform(-size, size) for _ in range(4)], i % 3, "", 0, 0, "") for i in range(90)]
        assert mined(spark.createDataFrame(data, SCHEMA)) == brute(data)


@pytest.mark.parametrize("bits, dims", [(2, 2), (2, 3), (3, 2), (1, 4), (2, 5)])
def test_curve_visits_neighbours(bits, dims):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert len(set(keys)) == side**dims
    path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(5)
    anchors, block = rng.integers(-50, 50, (40, 8)), rng.integers(-50, 50, (30, 8))
    least, most = score_bounds(anchors, block.min(0)[None], block.max(0)[None])
    scores = block @ anchors.T
    assert (scores.min(0) >= least[0]).all() and (scores.max(0) <= most[0]).all()


def test_blocks_out_of_reach_are_not_read(spark, monkeypatch):
    """Two far groups: chunks of one are not sent to the shelves of the other."""
    monkeypatch.setattr(hard_negatives, "SHELF_ROWS", (20, 20))
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 4)
    r = random.Random(6)
    data = [(i, [(1 if i % 2 else -1) + r.gauss(0, 0.01) for _ in range(4)], i % 2, "", 0, 0, "") for i in range(200)]
    df = spark.createDataFrame(data, SCHEMA)
    mine = hard_negatives.Mine(hard_negatives.vectors(df, "vec_id", F.col("label"), "embedding", 256, F.col("vec_id") % 10 == 0))
    pairs = mine._pairs(mine.chunks, True, 5).count()
    assert 0 < pairs < mine.n_chunks * mine.n_shelves * 0.75
