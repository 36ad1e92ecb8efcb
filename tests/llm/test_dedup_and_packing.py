"""Near copies, lines, passages, packing and the pipeline against plain loops."""

import random
import zlib
from itertools import combinations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from tokenweave.llm import line_dedup, near_dedup, packing, passage_dedup, quality_rules
from tokenweave.llm.buckets import runs_with_hubs
from tokenweave.llm.components import connected_components, merged_components
from tokenweave.llm.edits import probes, segments, within
from tokenweave.llm.queries import registered, tokenizer_file
from tokenweave.llm.shingles import Minima, WordHashes, band_keys, bands_for, windows
from tokenweave.session import stage


def union(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(70, 71), (71, 71), (70, 71)]])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = union({n for e in edges for n in e}, edges)
    assert {r.node: r.component for r in got} == {n: c for n, c in want.items() if n != c}


def test_components_keep_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tokenweave.session.scratch_dir", lambda spark: str(tmp_path))
    edges = [(i, (i * 7) % 300) for i in range(300)] + [(500, i) for i in range(400, 500)]
    want = union({n for e in edges for n in e}, edges)
    frame = spark.createDataFrame(edges, "a long, b long")
    for most in (1 << 16, 5):  # with 5, node 500 is dealt out in parts
        got = {r.node: r.component for r in connected_components(frame, most=most).collect()}
        assert got == {n: c for n, c in want.items() if n != c}
    assert len(list(tmp_path.iterdir())) == 2  # a table of links for each call, whatever the rounds
    found = connected_components(frame)
    more = spark.createDataFrame([(400, want[3]), (700, 701)], "a long, b long")
    got = {r.node: r.component for r in merged_components(found, more).collect()}
    edges += [(400, 3), (700, 701)]
    want = union({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n != c}


def varied(base, seed, changes):
    r = random.Random(seed)
    w = base.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
    return " ".join(w)


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_copies_lose_no_link(spark, words, percent):
    # Variants of variants: most are linked to some, few to the first of their bucket.
    texts = [prose(1, 120), prose(2, 90)]
    for i in range(70):
        texts.append(varied(texts[random.Random(i).randrange(len(texts))], i, i % 4))
    texts += [None, "", "two words", "Two WORDS", prose(1, 120)]
    sets = [shingles(t, words) for t in texts]
    links = [
        (a, b)
        for a, b in combinations(range(len(texts)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = union(range(len(texts)), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = near_dedup.near_copies(docs, words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(sets[i]), c, c == i) for i, c in want.items()
    }
    assert len(set(want.values())) > 6


def test_near_copies_edges(edge, none):
    kept = near_dedup.drop_near_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(r.node or "" for r in kept.collect()) == ["", "n0", "n1", "n2", "n3", "n4", "n6", "n7", "n8"]
    assert near_dedup.drop_near_copies(none).count() == 0


@pytest.mark.parametrize("batch", [1, 2, 3, 10_000])
def test_runs_across_batches(spark, batch):
    r = random.Random(batch)
    rows = [(r.randrange(6), r.randrange(2), r.randrange(5)) for _ in range(60)] + [(99, 1, 1), (99, 1, 2), (98, 0, 3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = runs_with_hubs(spark.createDataFrame(rows, "bucket long, probe int, node long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], None
    for b, p, n in sorted(rows):
        own = sorted((q, m) for c, q, m in rows if c == b)
        if len(own) > 1 and own[0][0] == 0:
            want.append((b, own[0][1], n, p, (b, p, n) == last))
        last = (b, p, n)
    assert sorted(map(tuple, got)) == sorted(want)


def edited(line, seed, edits):
    r = random.Random(seed)
    for _ in range(edits):
        i = r.randrange(len(line))
        line = r.choice([line[:i] + line[i + 1 :], line[:i] + "é" + line[i:], line[:i] + "#" + line[i + 1 :]])
    return line


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_distance_and_segments():
    r = random.Random(1)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        b = edited(a, r.random(), r.randint(0, 4)) if len(a) > 5 else "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
        k = r.randint(1, 3)
        near = within(a, b, k)
        assert near == (plain_distance(a, b) <= k)
        x, y = sorted((a, b), key=len)
        if near and len(x) > k:
            index = {(len(x), i, x[s : s + n]) for i, (s, n) in enumerate(segments(len(x), k))}
            looked = {(o, i, y[s : s + n]) for o, i, s, n in probes(len(y), k)}
            looked |= {(len(y), i, y[s : s + n]) for i, (s, n) in enumerate(segments(len(y), k))}
            assert index & looked


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_against_a_loop(spark, edits):
    base = [prose(i, 8) for i in range(12)]
    r = random.Random(edits)
    texts = ["\n".join(edited(r.choice(base), r.random(), r.randrange(4)) if r.random() < 0.8 else prose(r.randrange(10**6), 7) for _ in range(6)) for _ in range(30)]
    texts += ["short\nshort\n" + base[0], None, "", base[0] + "\n" + base[0]]
    places = [(d, i, line) for d, t in enumerate(texts) for i, line in enumerate((t or "").split("\n")) if len(line) >= 20]
    distinct = sorted({line for *_, line in places})
    want = union(distinct, [(a, b) for a, b in combinations(distinct, 2) if plain_distance(a, b) <= edits])
    first = {}
    for d, i, line in places:
        first.setdefault(want[line], (d, i))
    gone = {(d, i) for d, i, line in places if first[want[line]] != (d, i)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = line_dedup.line_verdicts(docs, edits=edits).collect()
    assert {(r.key__, i) for r in got for i in r.equal + r.near} == gone and len(got) == len(texts)
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, edits=edits).collect()}
    for d, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        emptied = bool(kept is not None and not kept.strip() and any(x == d for x, _ in gone))
        assert (d not in left) if emptied else left[d] == kept


def test_lines_of_any_length_meet_near_ones(spark):
    # One edit for every 20 characters of the shorter line, four at most; edits may change the class.
    lines, r = [], random.Random(3)
    for i in range(160):
        line = "".join(r.choice("abcdefghij klmnop") for _ in range(r.choice([21, 39, 40, 41, 59, 60, 79, 80, 81, 120, 700])))
        lines += [line, edited(line, i, r.randrange(7))]
    distinct = sorted({x for x in lines if len(x) >= 20 and x.strip(" ")})
    assert all(line_dedup.allowed(n, None) == k for n, k in [(20, 1), (39, 1), (40, 2), (60, 3), (80, 4), (2000, 4)])

    def near(a, b):
        most = min(4, min(len(a), len(b)) // 20)
        return abs(len(a) - len(b)) <= most and within(a, b, most)

    want = union(distinct, [(a, b) for a, b in combinations(distinct, 2) if near(a, b)])
    first = {}
    for i, x in enumerate(lines):
        if x in want:
            first.setdefault(want[x], i)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = line_dedup.line_verdicts(docs).collect()
    gone = {x.key__ for x in got if x.equal + x.near}
    assert gone == {i for i, x in enumerate(lines) if x in want and first[want[x]] != i} and len(gone) > 60


def test_short_equal_lines_go_where_they_hold_a_word(spark, tmp_path):
    texts = ["Yes.\n---\n你好\n" + prose(1, 8), "Yes.\n---\nYes!\n你好\n" + prose(2, 8), "7\n \n7", None, "Yes."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registered()["op6_line_dedup"](spark, str(tmp_path)).collect()}
    assert {i: (r.n_lines, r.n_equal, r.n_near, r.removed_lines) for i, r in got.items()} == {
        0: (3, 0, 0, ""), 1: (4, 2, 0, "0,3"), 2: (2, 1, 0, "2"), 3: (0, 0, 0, ""), 4: (1, 1, 0, "0")
    }
    lines = dict(corpus_pipeline.STAGES)["line dedup"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
    assert {r.doc_id: r.text for r in lines.collect()} == {
        0: texts[0], 1: "---\nYes!\n" + prose(2, 8), 2: "7\n ", 3: None
    }


def test_line_and_passage_edges(edge, none):
    for clean in (line_dedup.dedup_lines, passage_dedup.remove_passages):
        kept = clean(edge)
        rows = {r.node: r.text for r in kept.collect()}
        assert kept.columns == edge.columns and rows["n0"] is None and rows["n1"] == "" and rows["n3"] == "one"
        assert clean(none).count() == 0


def test_paragraphs_of_a_group_are_those_of_each_text():
    rng, table, minima = random.Random(5), WordHashes(), Minima(10)
    texts = [None, "", "a " * 8, "a " * 9, "x y " * 900, *(" ".join(rng.choices("abcdefgh", k=k)) for k in range(120))]

    def made(some):
        for tags, sizes, hashes in passage_dedup.grouped(some, table):
            text, *rest, keys = passage_dedup.paragraphs(hashes, sizes, minima)
            yield from zip(np.array(tags)[text].tolist(), *[x.tolist() for x in rest], keys.tolist())

    assert list(made(enumerate(texts))) == [x for one in enumerate(texts) for x in made([one])]
    hashes = table.of("a b c d e f g h i j a b c d e f".encode().split())
    found, counts = passage_dedup.part_sets(np.array([0, 3]), np.array([9, 13]), windows(hashes, 5))
    for k, (a, n) in enumerate([(0, 9), (3, 13)]):
        part = found[counts[:k].sum() : counts[: k + 1].sum()]
        assert part.tolist() == np.unique(windows(hashes[a : a + n], 5)).tolist()


def test_bands_miss_no_paragraph_at_the_threshold():
    # 50 words, one of the middle changed: 41 shingles of 51 in common, 0.804.
    bands = bands_for(passage_dedup.PERCENT / 100, passage_dedup.ROWS, passage_dedup.MISS)
    table, minima, r, missed = WordHashes(), Minima(bands * passage_dedup.ROWS), random.Random(6), 0
    for _ in range(3000):
        words = [b"w%d" % r.randrange(10**9) for _ in range(50)]
        other = [*words[:25], b"x", *words[26:]]
        both = [minima.of(windows(table.of(w), passage_dedup.WORDS)) for w in (words, other)]
        one, two = (band_keys(x, passage_dedup.ROWS) for x in both)
        missed += not (one == two).any()
    assert not missed


def test_passages_inside_other_text(spark):
    passage = prose(500, 70)
    texts = [prose(i, 200) for i in range(12)]
    texts[3] = prose(3, 60) + " " + passage + " " + prose(33, 50)
    texts[7] = prose(7, 90) + " " + passage.upper() + " " + prose(77, 80)
    texts[9] = texts[2]
    texts += [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.key__: r for r in passage_dedup.repeated_passages(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: {7: 3, 9: 2}.get(i, i) for i in range(14)}
    assert {i for i, r in got.items() if r.repeats} == {7, 9} and not got[0].n_links
    assert sum(x.words for x in got[7].repeats) >= 30 and all(90 <= x.start and x.start + x.words <= 160 for x in got[7].repeats)
    left = {r.doc_id: r.text for r in passage_dedup.remove_passages(docs).collect()}
    assert left[3] == texts[3] and left[7].startswith(prose(7, 90)) and left[7].endswith(prose(77, 80)) and len(left[7]) < len(texts[7]) - 100


def test_runs_keep_no_edge(spark):
    # Random distinct words: every passage of 51 words and more has to go whole; a near paragraph may take some words more.
    r = random.Random(8)

    def fresh(n):
        return [f"w{r.randrange(10**9)}" for _ in range(n)]

    texts, want = [], {}
    for i in range(60):
        passage = fresh(r.randint(51, 60))
        for at in (fresh(r.randint(20, 60)), fresh(r.randint(20, 60))):
            texts.append(" ".join(at + passage + fresh(40)))
        want[len(texts) - 1] = [(len(at), len(passage))]
    texts.append("so " * 100)
    want[len(texts) - 1] = [(30, 70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.key__: x for x in passage_dedup.repeated_passages(docs).collect()}
    assert {i for i, x in got.items() if x.repeats} == set(want)
    for i, [(start, words)] in want.items():
        [span] = got[i].repeats
        assert start - 4 <= span.start <= start and start + words <= span.start + span.words <= start + words + 4
    assert all(got[i].component_id == i - 1 and got[i].n_links and got[i - 1].n_links for i in want if i < 120)


def test_edited_paragraphs_go_whole(spark):
    # One changed word in the middle of a paragraph, in other surroundings: as blocks, as lines, as wrapped lines.
    r = random.Random(9)

    def fresh(n):
        return [f"w{r.randrange(10**9)}" for _ in range(n)]

    texts, want = [], {}
    for i in range(30):
        words, gap, wrap = fresh([50, 60, 100][i % 3]), ["\n", "\n\n"][i % 2], i % 4 == 3
        for copy in (0, 1):
            before, behind = fresh(r.randint(10, 40)), fresh(30)
            own = [*words[: len(words) // 2], *fresh(1), *words[len(words) // 2 + 1 :]] if copy else words
            lines = [own[k : k + 12] for k in range(0, len(own), 12)] if wrap else [own]
            texts.append(gap.join([" ".join(before), "\n".join(map(" ".join, lines)), " ".join(behind)]))
            if copy:
                want[len(texts) - 1] = [(len(before), len(own))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.key__: x.repeats for x in passage_dedup.repeated_passages(docs).collect() if x.repeats}
    assert set(got) == set(want)
    for i, [(start, words)] in want.items():
        [span] = got[i]  # a near chunk at the edge may take some words more
        assert start - 4 <= span.start <= start and start + words <= span.start + span.words <= start + words + 4
    assert passage_dedup.standing("a b\n" * 5 + "c " * 9 + "\nd\n\n" + "e " * 10) == [(0, 10), (0, 20), (10, 9), (20, 10)]
    assert passage_dedup.standing(None) == []


def check_packed(rows, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, pieces in [*by_doc.items(), *by_sequence.items()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
    assert {d: sum(n for _, n in p) for d, p in by_doc.items()} == {d: len(x) for d, x in ids.items()}
    fills = [sum(n for _, n in p) for p in by_sequence.values()]
    assert all(n <= 2048 and (n == 2048 or not n & (n - 1)) for n in fills)


def plain_ids(docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_file())
    return {d: np.array(coder.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for d, t in docs}


def test_packing_is_a_round_trip(spark, none):
    texts = [None, "", " ", "a  b \n c", "x  y", "<|endoftext|>", prose(1, 9000)] + [prose(i, 30 * i) for i in range(40)]
    texts += ["\t\t \n", "it's 12 'll  ", "é😀 \x1c b"]
    end = "<|endoftext|>"
    texts += [f"a {end} b", f"a{end} b {end}{end} c", f"  {end}  {end}'s {end}1 {end}", f"{end} x{end}\n {end} \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    pieces = packing.pack_documents(docs, tokenizer_file()).withColumn("ids_crc32", F.crc32("ids"))
    check_packed(pieces.collect(), plain_ids(enumerate(texts)))
    assert packing.pack_documents(none, tokenizer_file(), carry=("doc_id", "start")).count() == 0


def test_levels_take_the_least_sum_of_squares():
    r = random.Random(2)
    levels = packing.Levels(32)
    for _ in range(300):
        size = r.randint(1, 31)
        counts = levels.count.copy()

        def total(level):
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 32
            return (after[1:32] ** 2).sum()

        allowed = [0, *(h for h in range(1, 33 - size) if counts[h])]
        assert total(levels.place(size)) == min(map(total, allowed))
        levels.add(("d", 0, np.zeros(size)), size)


def test_pipeline(spark, bench, tmp_path):
    good = [(i, prose(i, 80) + "\n" + prose(i + 900, 40)) for i in range(60)]
    texts = good + [(100, good[5][1]), (101, varied(good[6][1].replace("\n", " "), 1, 1)), (102, "x$$$ " * 50)]
    texts += [(103, prose(2, 12) + " " + prose(800, 90))]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == docs.columns and out.where("n_chars != length(text)").count() == 0
            ids[name] = {r.doc_id for r in out.select("doc_id").collect()}
        else:
            check_packed(out.collect(), plain_ids((r.doc_id, r.text) for r in docs.collect()))
        docs = out
    clean = {i for i, _ in good}
    assert 102 not in ids["quality rules"] and clean <= ids["quality rules"]
    assert 100 not in ids["line dedup"] and clean <= ids["line dedup"]
    assert 101 not in ids["near dedup"] and clean <= ids["near dedup"]
    assert ids["decontamination"] >= clean - {2} and 103 in ids["decontamination"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_signatures_let_all_near_lines_through():
    from tokenweave.llm.line_dedup import maybe_near, near, signed

    r = random.Random(9)
    base = [prose(i, 3 + i % 30) for i in range(60)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "abababababababababababab"]
    lines = list(base)
    for line in base:
        for _ in range(4):
            cs = list(line)
            for _ in range(r.randrange(1, 5)):
                at = r.randrange(len(cs))
                cs[at : at + r.randrange(2)] = r.choice(["", "x", cs[at], "é"])
            lines.append("".join(cs) or "x")
    items = [signed(line) for line in lines]
    open_ = maybe_near(items, items, None)
    links = [(i, j) for i in range(len(lines)) for j in range(len(lines)) if near(lines[i], lines[j], None)]
    assert len(links) > 2 * len(lines) and all(open_[i, j] for i, j in links)
    assert open_.mean() < 0.1


def test_a_cell_is_one_row_of_a_block():
    r = np.random.Generator(np.random.PCG64(5))
    keys, kinds, refs = r.integers(0, 1 << 64, 4000, np.uint64), r.integers(0, 2, 4000), r.integers(0, 50, 4000)
    made = line_dedup._blocks([(keys, kinds.astype(np.int32), refs)], list(range(50)), 0, 6)
    assert made.num_rows == 64 + 1  # index entries and probes together, and the lines' hashes
    met = {(x, y) for b in [made.slice(0, 64)] for row in b.to_pylist() for x, y in zip(*(line_dedup._met([(0, row["heads"], row["keys"], row["refs"])]).column(i).to_pylist() for i in (0, 1)))}
    short = ((keys >> np.uint64(64 - 6)) << np.uint64(32) | (keys >> np.uint64(32 - 6)) & np.uint64(0xFFFFFFFF)).tolist()
    hubs = {}
    for key, kind, ref in sorted(zip(short, kinds.tolist(), refs.tolist())):
        hubs.setdefault(key, ref) if not kind else None
    assert met == {(hubs[k], x) for k, x in zip(short, refs.tolist()) if k in hubs and hubs[k] != x}


def test_passages_release_what_is_read_no_more(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tokenweave.session.scratch_dir", lambda spark: str(tmp_path))
    texts = [prose(1, 60), prose(1, 60) + " " + prose(2, 40), prose(3, 50), prose(3, 49) + " more"]
    rows = passage_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == 4 and any(r.repeats for r in rows)
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert not left & {"passage-met", "passages", "passage-sets", "passage-places", "passage-anchors", "passage-windows"}
    assert {"passage-judged", "window-judged"} <= left


def test_distance_does_not_step_through_characters():
    steps = [0]

    class Line(str):
        def __getitem__(self, at):
            steps[0] += 1
            return Line(str.__getitem__(self, at))

        def __iter__(self):
            pytest.fail("a character at a time")

    r = random.Random(3)
    for i in range(200):
        a = prose(i, 3 + i % 40)
        b = edited(a, r.random(), r.randint(0, 6))
        b = b if i % 3 else b.replace("a", "", 1) + "x"
        for k in (1, 2, 4):
            assert within(Line(a), Line(b), k) == within(b, a, k) == (plain_distance(a, b) <= k)
    a = prose(7, 5000)
    changed = a[:10] + "#" + a[11:9000] + a[9001:20000] + "##" + a[20000:]
    steps[0] = 0
    assert within(Line(a), Line(changed), 4) and not within(Line(a), Line(changed), 3)
    assert steps[0] < 2000


def test_counts_tell_long_lines_apart():
    from tokenweave.llm.line_dedup import maybe_near, near, signed

    # Long lines over few characters: one with six words changed keeps nearly all bits of its signature.
    lines = []
    for i in range(40):
        words = prose(i, 250).split()
        for at in range(0, 250, 42):
            words[at] = "lonesbadekes"
        lines += [prose(i, 250), " ".join(words), edited(prose(i, 250), i, 4)]
    items = [signed(line) for line in lines]
    open_ = maybe_near(items, items, None)
    links = {(i, j) for i in range(len(lines)) for j in range(len(lines)) if near(lines[i], lines[j], None)}
    assert len(links) == 5 * 40 and all(open_[i, j] for i, j in links)
    assert open_.sum() == len(links)


def test_pipeline_leaves_no_copies_of_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tokenweave.session.scratch_dir", lambda spark: f"{tmp_path}/scratch")
    texts = [(i, prose(i, 80) + "\n" + prose(i % 9, 20), "en", "s", 7) for i in range(40)] + [(100, "x$$$ " * 50, None, "s", 7)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    good, whole = corpus_pipeline.quality(spark, docs, ""), quality_rules.quality_verdicts(docs, carry=tuple(docs.columns))
    assert sorted(good.collect()) == sorted(whole.where("kept").select(docs.columns).collect())
    assert 30 < good.count() < 41
    assert len({r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}) == 41
    names = [p.name.rpartition("-")[0] for p in (tmp_path / "scratch").iterdir()]
    assert names.count("quality") == 1 and "line-input" not in names  # the one is that of the verdicts above


def test_quality_rules_of_the_pipeline_run_no_python(spark):
    rows = [(i, prose(i, 60 + i % 30) if i % 10 else "x", "en", f"s{i % 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    good = quality_rules.keep_good(docs)
    plans = good._jdf.queryExecution()
    made, once = plans.optimizedPlan().toString(), quality_rules.with_statistics(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Arrow" not in plans.executedPlan().toString() and "Python" not in plans.executedPlan().toString()
    assert made.count("regexp_replace(") == once.count("regexp_replace(")  # not again in a condition
    kept = quality_rules.quality_verdicts(docs).where("kept").select("doc_id").collect()
    assert sorted(good.select("doc_id").collect()) == sorted(kept) and 0 < len(kept) < 200


def test_blocks_go_to_python_a_few_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tokenweave.session.scratch_dir", lambda spark: f"{tmp_path}/scratch")

    @F.arrow_udf("long")
    def rows(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int64())

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.range(0, 500, 1, 1).select(rows("id").alias("n"))
    assert stage(df, "few", batch=16).agg(F.max("n")).first()[0] == 16
    assert stage(df, "many").agg(F.max("n")).first()[0] == 500
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_chains_of_buckets_are_not_one_cluster(spark, tmp_path, monkeypatch):
    from tokenweave.llm.buckets import unsettled_groups

    monkeypatch.setattr("tokenweave.session.scratch_dir", lambda spark: f"{tmp_path}/scratch")
    # A chain of buckets with one member in common, a family in many buckets, and a settled bucket.
    rest = [(i, f"c{2 * i + k:04}") for i in range(100) for k in range(3)]
    rest += [(1000 + i, f"f{k:02}") for i in range(40) for k in range(20) if k != i] + [(2000, f"s{k}") for k in range(9)]
    found = [(f"s{k}", "s0") for k in range(1, 9)] + [("c0001", "c0000")]
    rest = spark.createDataFrame(rest, "bucket long, node string")
    found = spark.createDataFrame(found, "node string, component string")
    held = {}
    for x in unsettled_groups(rest, found).collect():
        assert x.first == min(x.first, x.comp) and x.comp == {"c0001": "c0000"}.get(x.node, x.node)
        held.setdefault(x.cluster, set()).add(x.node)
    family = {f"f{k:02}" for k in range(20)}
    chain = [{f"c{2 * i + k:04}" for k in range(3)} for i in range(100)]
    assert sorted(map(sorted, held.values())) == sorted(map(sorted, [*chain, family]))


def test_hubs_and_the_rest_of_a_key_lose_no_pair():
    r = random.Random(4)
    entries = [(key, kind, ref) for key in range(300) for kind in (0, 1) for ref in r.sample(range(90), r.choice([0, 1, 2, 4, 5, 6, 9]))]
    entries = sorted(entries, key=lambda x: (x[1], x[0]))
    heads = sum(kind == 0 for _, kind, _ in entries)
    keys = np.array([x[0] for x in entries], "<u4").tobytes()
    refs = np.ascontiguousarray(np.array([x[2] for x in entries], "<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    met = line_dedup._met([(1000, heads, keys, refs)]).to_pylist()
    pairs = {frozenset((x["hub"] - 1000, x["node"] - 1000)) for x in met if x["kind"] == line_dedup.PAIR}
    buckets, wanted = {}, set()
    for x in met:
        if x["kind"] == line_dedup.REST:
            buckets.setdefault(x["hub"], []).append(x["node"] - 1000)
    for key in range(300):
        first, second = ([ref for k, kind, ref in entries if k == key and kind == n] for n in (0, 1))
        wanted |= {frozenset((a, b)) for a in first for b in first + second if a != b}
    assert wanted <= pairs | {frozenset((a, b)) for some in buckets.values() for a in some for b in some}
    assert pairs <= wanted and len(pairs) < len(wanted) and buckets
