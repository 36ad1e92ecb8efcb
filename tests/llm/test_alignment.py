"""Token alignment against plain loops over every token."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenweave.llm.alignment import Aligner, aligned_blocks, alignment_measures, pair_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a", "a ", "  a  b   ", "x\n\ny\t z", "é😀 é", "a▁b", "▁", "a <|endoftext|> b</s><0x41>", "\x00 \x7f", "ａ　ｂ", "=" * 900]


@pytest.fixture(scope="module")
def aligner():
    return Aligner(open(BYTES).read(), open(PIECES, "rb").read())


def plain_ids(text):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return (a, b), lambda t: (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t))


def piece_bytes(b, i):
    p = b.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()


def token_bytes(a, b, ids_a, ids_b):
    from tokenizers.pre_tokenizers import ByteLevel

    letters = sorted(ByteLevel.alphabet())
    plain = [c for c in range(256) if chr(c) in letters]
    table = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    return [bytes(table[x] for x in a.id_to_token(i)) for i in ids_a], [piece_bytes(b, i) for i in ids_b]


def ranges(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts):
    (a, b), encode = plain_ids(None)
    per, corpus = [], Counter()
    for t in texts:
        if not t:
            per.append((0, 0, 0, [], ""))
            continue
        ids_a, ids_b = encode(t)
        bytes_a, bytes_b = token_bytes(a, b, ids_a, ids_b)
        raw = b" " + t.encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            per.append((0, 0, 0, [], ""))
            continue
        ra, rb = ranges(bytes_a), ranges(bytes_b)
        links, j = [], 0
        for i, (s, e) in enumerate(ra):
            while j and rb[j - 1][1] > s:
                j -= 1
            while j < len(rb) and rb[j][0] < e:
                if rb[j][1] > s:
                    links.append((ids_a[i], ids_b[j]))
                j += 1
        both = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, x, y = [], 0, 0
        for end in both:
            left, right = [], []
            while x < len(ra) and ra[x][1] <= end:
                left.append(str(ids_a[x]))
                x += 1
            while y < len(rb) and rb[y][1] <= end:
                right.append(str(ids_b[y]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        corpus.update(links)
        per.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, y), c in corpus.items():
        most[y] = max(most.get(y, 0), c)
    rows = [
        (n_a, n_b, g, len(links), sum(corpus[p] == most[p[1]] for p in links), sum(corpus[p] for p in links), sha)
        for n_a, n_b, g, links, sha in per
    ]
    return rows, corpus, most


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_measures_against_loops(spark, edge):
    r = random.Random(3)
    texts = [row.text for row in edge.collect()] + ODD + [prose(i % 40, 20 + r.randrange(60)).title() + "é" * (i % 3) for i in range(80)]
    texts += [texts[-1]] * 40
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, key string, n_a int, own int").repartition(5)
    got = {row.doc_id: tuple(row[c] for c in COLUMNS) for row in alignment_measures(docs, BYTES, PIECES).collect()}
    want, corpus, most = brute(texts)
    assert got == dict(enumerate(want))
    counts = {row.pair: (row["count"], row.best) for row in pair_counts(aligned_blocks(docs, BYTES, PIECES)).collect()}
    assert counts == {a << 32 | b: (c, c == most[b]) for (a, b), c in corpus.items()}


def test_blocks_of_any_size(spark, monkeypatch):
    from tokenweave.llm import alignment

    texts = [prose(i, 200) for i in range(30)]
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert aligned_blocks(docs, BYTES, PIECES).count() > 5
    found = alignment_measures(docs, BYTES, PIECES, keep_groups=True).collect()
    want, _, _ = brute(texts)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found} == dict(enumerate(want))
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in found)


def test_no_rows(none):
    assert alignment_measures(none, BYTES, PIECES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tab.é▁<0x41>　１"), max_size=40))
def test_ids_are_the_coders_own(aligner, text):
    import sentencepiece

    whole = aligner.b.coder
    assert isinstance(whole, sentencepiece.SentencePieceProcessor)
    found, own = aligner.b.encode([text])[0].tolist(), whole.encode(text)
    raw = b"".join(aligner.b_bytes[i] for i in own)
    # Texts with the mark itself are not given back and count as texts without tokens either way.
    assert found == own or raw != b" " + text.encode()
    assert aligner.a.encode([" " + text])[0].tolist() == aligner.a.coder.encode(" " + text, add_special_tokens=False).ids
