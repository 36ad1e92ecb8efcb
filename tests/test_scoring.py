import math
from collections import Counter

import pytest

from tokenweave.operators.scoring import (
    batch_metrics,
    batch_pairs,
    bigram_counts,
    eval_metrics,
    next_token_candidates,
    score_pairs,
    token_pairs,
)

TRAIN = [([0, 1, 0, 2], [1, 0, 2, 0]), ([0, 1, 3, 3], [1, 3, 3, 0])]
VAL = [(0, [0, 1], [1, 2]), (0, [3, 3], [3, 0]), (1, [9, 0], [0, 2])]


@pytest.fixture(scope="module")
def counts(spark):
    return bigram_counts(token_pairs(spark.createDataFrame(TRAIN, "x array<int>, y array<int>")))


def test_counts(counts):
    want = Counter(p for x, y in TRAIN for p in zip(x, y))
    assert {(r.x, r.y): r.c for r in counts.collect()} == want


def test_scores_and_metrics(spark, counts):
    vocab = 10
    c = Counter(p for x, y in TRAIN for p in zip(x, y))
    total = Counter(x for xs, _ in TRAIN for x in xs)
    best = {x: min((-n, y) for (a, y), n in c.items() if a == x)[1] for x in total}
    batches = {}
    for b, xs, ys in VAL:
        for x, y in zip(xs, ys):
            nll = -math.log((c[x, y] + 1) / (total[x] + vocab))
            batches.setdefault(b, []).append((nll, best.get(x, 0) == y))
    loss = [sum(v for v, _ in b) / len(b) for b in batches.values()]
    acc = [sum(h for _, h in b) / len(b) for b in batches.values()]
    val = spark.createDataFrame(VAL, "batch_id int, x array<int>, y array<int>")
    scored = score_pairs(batch_pairs(token_pairs(val, "batch_id")), counts, vocab)
    row = eval_metrics(scored).first()
    assert row.n_batches == 2
    # Batches differ in size, so this is not the mean over tokens.
    assert row.loss == pytest.approx(sum(loss) / 2) and row.acc == pytest.approx(sum(acc) / 2)
    assert row.perplexity == pytest.approx(2.71828**row.loss)
    tokens = [v for b in batches.values() for v, _ in b]
    assert row.loss != pytest.approx(sum(tokens) / len(tokens))


def test_ties_take_the_smallest_id(spark):
    pairs = spark.createDataFrame([(0, 5), (0, 3), (1, 2)], "x int, y int")
    val = spark.createDataFrame([(0, 0, 3, 1)], "batch_id int, x int, target int, m long")
    assert score_pairs(val, bigram_counts(pairs), 10).first().pred == 3


def test_ignored_targets(spark):
    rows = [(0, 1, 1, 2.0), (0, -1, 1, 9.0), (1, -1, -1, 7.0)]
    got = {r.batch_id: r for r in batch_metrics(spark.createDataFrame(rows, "batch_id int, target int, pred int, nll double")).collect()}
    assert got[0].loss == 2.0 and got[0].acc == 0.5
    assert got[1].loss is None and got[1].acc == 1.0


def test_candidates(spark):
    rows = [(0, 1, 8), (0, 2, 4), (0, 3, 4), (0, 4, 1), (1, 7, 3)]
    counts = spark.createDataFrame(rows, "x int, y int, c long")
    got = {(r.x, r.y): r.prob for r in next_token_candidates(counts).collect()}
    assert got == pytest.approx({(x, y): c / {0: 17, 1: 3}[x] for x, y, c in rows})
    kept = {(r.x, r.y): r.prob for r in next_token_candidates(counts, 0.5, 2).collect()}
    # The second place is shared, so three successors stay.
    assert kept == pytest.approx({(0, 1): 64 / 96, (0, 2): 16 / 96, (0, 3): 16 / 96, (1, 7): 1.0})
