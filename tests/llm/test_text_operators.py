"""The native operators against plain loops, and their edge cases."""

import math
import random
import re
from collections import Counter

import pytest
from conftest import prose
from pyspark.sql import functions as F

from tokenweave.llm import decontaminate, license_scan, pii, quality_classifier, quality_rules, secret_scan
from tokenweave.llm.text import covered, span_list


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_hits_against_a_loop(spark, edge, bench):
    grams = {}
    for r in bench.collect():
        w = words(r.text)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(str(r.item_id) if r.item_id is not None else None)
    want = []
    for r in edge.collect():
        w, hit, items = words(r.text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    items |= grams[tuple(w[i : i + n])]
        want.append((r.doc_id, len(w), len(hit), tuple(sorted(x for x in items if x is not None))))
    got = decontaminate.find_hits(edge, bench, keep=("doc_id",)).select("doc_id", "n_words", covered(F.col("hits")).alias("h"), "items")
    assert sorted(((r.doc_id, r.n_words, r.h, tuple(r["items"])) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(x[2] > 0 for x in want) >= 2


def test_hits_are_cut_out(spark, edge, bench, none):
    kept = decontaminate.remove_hits(edge, bench)
    assert kept.columns == edge.columns
    rows = {r.node: r for r in kept.collect()}
    # "one" is an item of its own; the long document holds a passage of an item and goes for the most part.
    assert "n3" not in rows and "n6" not in rows and rows["n0"].text is None and rows["n7"].text == prose(4, 30_000)
    mostly = spark.createDataFrame([(1, f"Kept, start. {prose(2, 12).upper()}! {prose(8, 40)}")], "doc_id long, text string")
    assert decontaminate.remove_hits(mostly, bench).first().text == f"Kept, start. ! {prose(8, 40)}"
    assert decontaminate.remove_hits(none, bench).count() == 0
    assert decontaminate.remove_hits(edge, bench.limit(0)).count() == edge.count()


def junk(i):
    return " ".join(f"{w}{'*#$%'[i % 4] * 3}" for w in prose(i, 80).split())


def test_quality_rejects_outliers_only(spark, edge, none):
    good = [(i, prose(i, 60 + i % 90) + ".", "en", f"s{i % 3}") for i in range(300)]
    bad = [(1000 + i, junk(i), "en", f"s{i % 3}") for i in range(30)]
    bad += [(2000 + i, prose(i, 80).upper(), "en", f"s{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    judged = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    assert sum(judged[i].kept for i, *_ in good) >= 297 and not any(judged[i].kept for i, *_ in bad)
    assert all(not judged[i].base_failed for i, *_ in bad)
    rows = quality_rules.quality_verdicts(edge, carry=("node",)).collect()
    assert len(rows) == edge.count() and {r.node for r in rows if r.n_words < 10} <= {r.node for r in rows if r.base_failed}
    nothing = quality_rules.keep_good(none)
    assert nothing.columns == none.columns and nothing.count() == 0


def test_repeat_counts(spark):
    texts = ["a b c d e f a b c d e", "x " * 30, "l one two\n\n l\nl one two\n" + prose(3, 20), "", None, "#*$%&|<> ok"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.with_statistics(docs).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.split()]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want


def entropy(s):
    def bits(w):
        return -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())

    return max(bits(s[i : i + 20]) for i in range(len(s) - 19))


def test_window_entropy(spark):
    r = random.Random(4)
    values = ["".join(r.choice("abcdefXYZ012345") for _ in range(n)) for n in (20, 21, 40, 200)] + ["a" * 30]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", secret_scan.best_entropy(F.col("v")).alias("e"))
    assert all(abs(x.e - entropy(x.v)) < 1e-9 for x in df.collect())


def test_secrets(spark, edge, none):
    key = "Zx8Kq1Lm4Vt7Bn2Wc5Rd9Fg3"
    texts = [
        f"é😀 {key} end",
        f"TOKEN = \"{'ab12' * 8}\" and secret:abc and AKIA{'A1' * 9} {'0f' * 13}",
        f"example{key} xxxx{key} {'a1b2c3d4' * 0}0123456789abcdefABCDEF123",
        "word" * 20 + " " + "1" * 40,
        "api_key=abcdef apikey: 'abc.d=' password=\"x\"",
        "deadbeef" * 2000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.b, r.s) for r in secret_scan.scan_secrets(docs).select(
        "doc_id", span_list(F.col("base_spans")).alias("b"), span_list(F.col("spans")).alias("s")).collect()}
    assert got[0] == ("", f"entropy:3:{3 + len(key)}")
    assert [x.split(":")[0] for x in got[1][0].split(",")] == ["assign", "hex", "access", "hex"]
    assert got[2][1] == "" and got[3] == ("hex:81:121", "hex:81:121")
    assert got[4][0] == "assign:0:14,assign:15:30" and got[5][0] == "hex:0:16000"
    assert secret_scan.scan_secrets(edge).count() == edge.count() and secret_scan.scan_secrets(none).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@a.bc" for i in range(1500))
    found = pii.scan_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().base_spans
    assert [(s.start, s.end) for s in found] == [m.span() for m in re.finditer(r"\S+", text)]


def test_contexts_find_unseen_identifiers(spark, edge, none):
    seeds = [f"text {prose(i, 5)} reach me at user{i}@mail.example.org today {prose(i + 50, 5)}" for i in range(5)]
    unseen = f"{prose(70, 4)} reach me at handle#7731 today {prose(71, 4)}"
    other = f"{prose(80, 4)} sold for 4500,00 pieces {prose(81, 4)}"
    texts = seeds + [unseen, other, "4111 1111 1111 1111 or 4111 1111 1111 1112 a@b.c_d@e.fg 1.2.3.999 +1 (555) 010-9999", "1 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s.split(",") if r.s else [] for r in pii.scan_personal_data(docs).select("doc_id", span_list(F.col("spans")).alias("s")).collect()}
    at = unseen.index("handle")
    assert got[5] == [f"context:{at}:{at + 11}"] and got[6] == []
    assert [x.split(":")[0] for x in got[7]] == ["email", "email", "card", "phone"]
    rows = pii.scan_personal_data(edge, carry=("node", "bucket"))
    assert rows.count() == edge.count() and pii.scan_personal_data(none).count() == 0


def test_rounds_go_on_until_nothing_is_new(spark):
    # A chain: pattern k shares four instances with pattern k + 1, so every round reaches one pattern more.
    def plain(edges):
        links = {(p, i) for p, i, _ in edges}
        known, score, size = {i: 1.0 for _, i, seed in edges if seed}, {}, -1
        while len(known) > size:
            size, best = len(known), {}
            for p in {p for p, _ in links}:
                own = {i for q, i in links if q == p}
                hits = len(own & set(known))
                if hits >= 3 and hits / len(own) >= 0.8:
                    best.update({i: max(best.get(i, 0), hits / len(own)) for i in own})
            known.update({i: max(known.get(i, 0), x) for i, x in best.items()})
        return known

    chain = [(f"p{k}", f"i{k + j}", k == 0 and j < 4) for k in range(9) for j in range(5)]
    r = random.Random(4)
    noise = [(f"q{r.randrange(12)}", f"j{r.randrange(40)}", r.random() < 0.4) for _ in range(160)]
    edges = chain + noise + chain
    got = pii.confident_instances(spark.createDataFrame(edges, "pattern string, instance string, seed boolean"))
    got = {x.instance: x.score for x in got.collect()}
    assert got == pytest.approx(plain(edges)) and {f"i{k}" for k in range(13)} <= set(got)


def test_classifier_on_held_out_rows(spark, edge, none):
    rows = [(i, prose(i, 60) if i % 3 else junk(i)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(0, 0), (None, 1)], "doc_id long, quality int")
    weights = quality_classifier.learn_weights(docs, labels, F.col("doc_id") < 300, sample=200)
    scored = quality_classifier.score_quality(docs, weights).where("doc_id >= 300").collect()
    assert sum((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in scored) >= 297
    edges = quality_classifier.score_quality(edge, weights)
    assert edges.where("score BETWEEN 0 AND 1").count() == edge.count()
    assert not quality_classifier.learn_weights(docs, labels.limit(0), F.lit(True)).any()
    assert quality_classifier.score_quality(none, weights).count() == 0


def test_licences(spark, edge, none):
    mit = license_scan.TEMPLATES["mit"][1]
    texts = [
        f"{prose(1, 9)} {mit.upper()} {prose(2, 9)}",
        f"x {' '.join(mit.split()[:20])} odd word {' '.join(mit.split()[22:])} y",
        "Licensed under CC BY-NC 4.0. All rights reserved, all rights reserved.",
        "the rights to a copy of the software are free",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[0].labels == ["mit"] and got[0].score == 1.0 and (got[0].spans[0].start, got[0].spans[0].end) == (9, 9 + len(mit.split()))
    assert got[1].labels == ["mit"] and 0.9 < got[1].score < 1
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (3, 2, 10) and "cc-by-nc" in got[2].labels
    assert got[3].labels == [] and got[4].n_words == 0 and got[4].first_word is None
    assert license_scan.scan_licenses(edge).count() == edge.count() and license_scan.scan_licenses(none).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_matching_statistics(seed):
    r = random.Random(seed)
    templates = [[r.randint(1, 3) for _ in range(r.randint(1, 12))] for _ in range(4)]
    automaton = license_scan.SuffixAutomaton(templates)
    import numpy as np

    text = [r.randint(1, 4) for _ in range(40)]
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for end, length, state in automaton.statistics(np.array(text)):
        assert length == max(n for n in range(end + 1) if not n or tuple(text[end - n : end]) in runs)
        if length:
            want = {(t, i + length) for t, x in enumerate(templates) for i in range(len(x)) if x[i : i + length] == text[end - length : end]}
            assert automaton.ends[state] == want
