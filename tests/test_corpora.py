"""Each recipe from files to sequences, against a plain loop over the same files."""

import io
import math
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tokenweave.functions.bpe import EOT_ID, EOT_TEXT
from tokenweave.functions.chars import char_encode
from tokenweave.operators.mix import YEAR_PRESETS, concat_years, mix_corpora, select_years
from tokenweave.operators.order import hash_order, token_offsets
from tokenweave.plans.corpora import CORPORA, ORDER, corpus, stream_order, web_corpus, year_corpus
from tokenweave.plans.prepare import build_sequences, export_shards, tokenize_corpus
from tokenweave.sources.token_shards import read_token_shards
from tests_util import streams

LATEX = "\\documentclass{a}\\begin{document}%s\\end{document}"


def test_unknown_corpus():
    assert set(CORPORA) == {"slimpajama", "openwebtext2", "wikitext", "shakespeare-char", "arxiv", "arxiv2000", "arxiv+wiki"}
    with pytest.raises(ValueError, match="unknown corpus"):
        corpus("other")


def test_web_corpus(spark, coder, plain, tmp_path):
    rows = [(f"d{i}", "s", f"text {i} " * (i % 7)) for i in range(2100)] + [("null", "s", None)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_key string, source string, text string").repartition(4).write.parquet(path)
    tokens = tokenize_corpus(spark, "slimpajama", path, str(tmp_path / "tokens"), coder)
    keys = spark.read.parquet(path).where("text IS NOT NULL").select("doc_key", "text", hash_order(2357, "doc_key").alias("k"))
    docs = [r.text for r in sorted(keys.collect(), key=lambda r: (r.k, r.doc_key))]
    val = math.ceil(0.0005 * len(docs))
    want = {
        s: [i for t in part for i in plain.encode_ordinary(t) + [EOT_ID]]
        for s, part in (("val", docs[:val]), ("train", docs[val:]))
    }
    assert val == 2 and streams(tokens) == want
    # Documents cut into several rows give the same stream.
    assert streams(web_corpus(spark, path, coder, max_chars=30)) == want
    # Sequences and flat files hold the same stream.
    order = stream_order("slimpajama")
    assert order["hashed"] and not stream_order("arxiv")["hashed"]
    sequences = build_sequences(tokens, str(tmp_path / "sequences"), 64, **order).where("split = 'train'").orderBy("seq_id").collect()
    assert [i for r in sequences for i in r.x] == want["train"][: len(sequences) * 64]
    assert len(sequences) == (len(want["train"]) - 1) // 64
    export_shards(tokens, str(tmp_path / "bin"), 6, **order)
    chunks = read_token_shards(spark, str(tmp_path / "bin"), 1000).orderBy("split", "start").collect()
    assert {s: [i for r in chunks if r.split == s for i in r.ids] for s in want} == want


WIKI = {
    "wiki.train.raw": " \n = Title = \n \n Some text , with ünïcode . \n\n\n  more \n" * 40,
    "wiki.valid.raw": "a b \n\n c",
    "wiki.test.raw": "never read",
}


@pytest.mark.parametrize("zipped", [False, True])
def test_wiki_corpus(spark, coder, plain, tmp_path, zipped):
    path = tmp_path / ("wiki.zip" if zipped else "wiki")
    if zipped:
        with zipfile.ZipFile(path, "w") as z:
            for name, text in WIKI.items():
                z.writestr("wikitext/" + name, text)
    else:
        path.mkdir()
        for name, text in WIKI.items():
            (path / name).write_text(text)
    tokens = corpus("wikitext")(spark, str(path), coder)
    assert streams(tokens) == {
        "train": plain.encode_ordinary(WIKI["wiki.train.raw"]),
        "val": plain.encode_ordinary(WIKI["wiki.valid.raw"]),
    }


def test_char_corpus(spark, tmp_path):
    text = "First Citizen:\nBefore we próceed\r\n\r\n hear me speak.\n" * 30 + "end"
    (tmp_path / "input.txt").write_bytes(text.encode())
    got = streams(corpus("shakespeare-char")(spark, str(tmp_path / "input.txt")))
    text = text.replace("\r\n", "\n")
    cut = int(0.8 * len(text))
    pieces = spark.createDataFrame([("train", text[:cut]), ("val", text[cut:])], "split string, text string")
    assert got == {r.split: r.ids for r in pieces.select("split", char_encode("text").alias("ids")).collect()}


def yearly(tmp_path, years):
    """One archive a year; returns the readable texts by year in path order."""
    texts = {}
    for year in years:
        with tarfile.open(tmp_path / f"papers-{year}.tar.gz", "w:gz") as t:
            for i in range(25):
                body = f"Paper {i} of {year}" + (EOT_TEXT if i == 3 else "")
                source = LATEX % body if i != 5 else "\\begin{document}\\end{document}"
                data = source.encode() if i != 7 else b"\xff\xff"
                info = tarfile.TarInfo(f"{year}/{i:03d}")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
                if i not in (5, 7):
                    texts.setdefault(year, []).append(body)
    return texts


def year_streams(plain, texts, years):
    want = {}
    for year in years:
        for i, text in enumerate(texts[year]):
            split = "train" if i % 10 <= 6 else "val" if i % 10 <= 8 else "test"
            if EOT_TEXT not in text:
                want.setdefault(split, []).extend(plain.encode(text))
    return want


def test_year_corpus(spark, coder, plain, tmp_path):
    texts = yearly(tmp_path, [1999, 2000])
    path = f"{tmp_path}/papers-*.tar.gz"
    assert streams(year_corpus(spark, path, coder, [2000, 1999])) == year_streams(plain, texts, [2000, 1999])
    assert streams(corpus("arxiv2000")(spark, path, coder)) == year_streams(plain, texts, [2000])
    with pytest.raises(ValueError, match="unknown years"):
        year_corpus(spark, path, coder, [2004])


def test_year_and_wiki(spark, coder, plain, tmp_path):
    texts = yearly(tmp_path, [1993, 2001])
    (tmp_path / "wiki").mkdir()
    for name, text in WIKI.items():
        (tmp_path / "wiki" / name).write_text(text)
    tokens = corpus("arxiv+wiki")(spark, (f"{tmp_path}/papers-*.tar.gz", str(tmp_path / "wiki")), coder)
    first = year_streams(plain, texts, [1993, 2001])
    got = streams(tokens)
    assert got["train"] == first["train"] + plain.encode_ordinary(WIKI["wiki.train.raw"])
    assert got["val"] == first["val"] + plain.encode_ordinary(WIKI["wiki.valid.raw"])


def test_years_and_mixing(spark):
    df = spark.createDataFrame([(1992, "a"), (1993, "b"), (2003, "c")], "year int, doc string")
    assert select_years(df, [1993, 2003]).count() == 2
    assert select_years(df, YEAR_PRESETS["all"]).count() == 3
    with pytest.raises(ValueError):
        select_years(df, [1991])
    placed = concat_years(df, [2003, 1992, 2003]).collect()
    assert sorted((r.part, r.doc) for r in placed) == [(0, "c"), (1, "a"), (2, "c")]
    mixed = mix_corpora([df, df.select("doc", "year")])
    assert sorted((r.corpus, r.doc) for r in mixed.collect()) == [(i, d) for i in (0, 1) for d in "abc"]


def test_order_of_a_corpus_is_unique(spark, tmp_path):
    (tmp_path / "input.txt").write_text("a\nb\n" * 100)
    tokens = corpus("shakespeare-char")(spark, str(tmp_path / "input.txt"))
    assert tokens.select("split", *ORDER).distinct().count() == tokens.count()
    assert token_offsets(tokens, ORDER).agg(F.sum("n")).first()[0] == 400
