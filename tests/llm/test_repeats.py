"""Repeated bytes against all windows of all texts."""

import random
from collections import Counter

import pytest
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenweave.llm import repeats
from tokenweave.llm.repeats import maximal_repeats, repeat_groups, without_repeats

LENGTH = 400


def brute(texts, length=LENGTH):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs, i = [], 0
        while i < len(r):
            if gone[i]:
                j = i
                while j < len(r) and gone[j]:
                    j += 1
                runs.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(r), tuple(runs), bytes(c for c, g in zip(r, gone) if not g)))
    return out


def found(df, **kw):
    rows = without_repeats(df, **kw).collect()
    return {r.doc_id: (r.n_bytes, tuple((x.start, x.end) for x in r.removed), bytes(r.kept)) for r in rows}


def corpus(seed, passages=6, docs=60):
    r = random.Random(seed)
    shared = [prose(900 + i, 110 + 25 * i) for i in range(passages)]
    texts = [None, "", "short", "x" * 399, "x" * 400, "y" * 1500, "ab" * 700, "é😀" * 200, "é😀" * 201, prose(5, 3000) + " " + shared[0]]
    for i in range(docs):
        parts = [prose(i, 30 + r.randrange(120))]
        for _ in range(r.randrange(3)):
            p = r.choice(shared)
            at = r.randrange(len(p) - 395)
            parts += [p[at : at + r.randrange(395, len(p) - at + 1)], prose(1000 * i + r.randrange(99), 10 + r.randrange(40))]
        texts.append("".join(parts))
    for i in range(10, 20):
        base = texts[i]
        texts += [base, base[:200] + "#" + base[200:], base[7:], base + "!"]
    return texts


@pytest.mark.parametrize("members, part", [(1000, 1 << 18), (1, 1 << 18), (3, 2000)])
def test_against_all_windows(spark, monkeypatch, members, part):
    monkeypatch.setattr(repeats, "MEMBERS", members)
    monkeypatch.setattr(repeats, "PART", part)
    texts = corpus(members)
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, own__ string, raw int, id int")
    got, want = found(df.repartition(4, "doc_id")), brute(texts)
    assert {i: (g[0], g[1]) for i, g in got.items()} == {i: w[:2] for i, w in enumerate(want)}
    assert got == dict(enumerate(want))
    assert sum(bool(w[1]) for w in want) > 40


def test_odd_rows(spark, edge, none):
    rows = edge.collect()
    df = edge.coalesce(1)
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, bytes(r.kept)) for r in without_repeats(df).collect()))) == sorted(
        map(repr, ((row.doc_id, w[0], w[2]) for row, w in zip(rows, brute([r.text for r in rows]))))
    )
    assert without_repeats(none).count() == 0


def test_groups_have_all_occurrences(spark):
    passage = prose(77, 120)
    texts = [prose(i, 60) + f" {i}<" + passage + f">{i} " + prose(100 + i, 60) for i in range(7)]
    groups = repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    size = max(r["size"] for r in groups)
    assert size >= LENGTH and {r.doc_id for r in groups if r["size"] == size} == set(range(7))
    for r in groups:
        assert texts[r.doc_id][r.start : r.start + r["size"]] in "<" + passage + ">"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", max_size=6)), min_size=2, max_size=7, unique=True), st.integers(1, 8))
def test_maximal_repeats_against_pairs(pairs, length):
    pairs = sorted(((a.encode(), b.encode()) for a, b in pairs), key=lambda p: p[1])
    lefts, rights = [p[0] for p in pairs], [p[1] for p in pairs]

    def shared(i, j):
        x, y = (0, 0)
        while x < min(len(lefts[i]), len(lefts[j])) and lefts[i][-x - 1] == lefts[j][-x - 1]:
            x += 1
        while y < min(len(rights[i]), len(rights[j])) and rights[i][y] == rights[j][y]:
            y += 1
        return x, y

    want = {}
    n = len(pairs)
    for i in range(n):
        for j in range(i):
            x, y = shared(i, j)
            if x + y >= length:
                want[lefts[i][len(lefts[i]) - x :], rights[i][:y]] = {
                    k for k in range(n) if lefts[k].endswith(lefts[i][len(lefts[i]) - x :]) and rights[k].startswith(rights[i][:y])
                }
    got = {}
    for x, y, members in maximal_repeats(lefts, rights, length):
        i = members[0]
        got[lefts[i][len(lefts[i]) - x :], rights[i][:y]] = set(members)
    assert got == want
