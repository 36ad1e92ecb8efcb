"""Vocabularies, paths, years and keys that differ from the usual."""

import base64

import pytest
from pyspark.sql import functions as F

from test_corpora import yearly, year_streams
from tests_util import streams
from tokenweave.functions.bpe import BytePairCoder
from tokenweave.functions.markup import markup_to_text
from tokenweave.plans.corpora import web_corpus, web_rejects, year_corpus, year_rejects
from tokenweave.sources.documents import read_document_files, read_documents
from tokenweave.sources.files import split_scheme


def rank_file(path, order):
    path.parent.mkdir()
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % i for i, b in enumerate(order)))
    return str(path)


def test_vocabularies_of_one_name_and_size(spark, tmp_path):
    plain = BytePairCoder(spark, rank_file(tmp_path / "a" / "ranks", range(256)))
    turned = BytePairCoder(spark, rank_file(tmp_path / "b" / "ranks", reversed(range(256))))
    for _ in range(3):
        for coder, want in ((plain, [65, 66]), (turned, [190, 189])):
            assert spark.sql("SELECT 'AB' AS t").select(coder.encode("t").alias("i")).first().i == want
    with pytest.raises(ValueError, match="end-of-text"):
        BytePairCoder(spark, str(tmp_path / "a" / "ranks"), eot=65)
    other = BytePairCoder(spark, str(tmp_path / "a" / "ranks"), eot=300)
    text = spark.sql("SELECT 'A<|endoftext|>' AS t").select(other.encode("t", special="allow").alias("i"))
    assert text.first().i == [65, 300]


def test_schemes():
    assert split_scheme("/a/b c") == ("file", "/a/b c") and split_scheme("file:///a") == ("file", "/a")
    assert split_scheme("s3a://bucket/x") == ("s3", "bucket/x") and split_scheme("hdfs://host:1/x") == ("hdfs", "host:1/x")
    assert split_scheme("a:b/c") == ("file", "a:b/c")
    for bad in ("hdfs:/corpus/bin", "dbfs:/x", "hdfs:///x", "odd://x/y"):
        with pytest.raises(ValueError, match="cannot open"):
            split_scheme(bad)


def test_only_wanted_years_are_opened(spark, coder, plain, tmp_path):
    texts = yearly(tmp_path, [1999, 2000])
    (tmp_path / "papers-1999.tar.gz").write_bytes(b"damaged")
    path, cache = f"{tmp_path}/papers-*.tar.gz", str(tmp_path / "cache")
    assert streams(year_corpus(spark, path, coder, [2000], cache)) == year_streams(plain, texts, [2000])
    reasons = {r.doc_key: r.reason for r in year_rejects(spark, path, [2000], cache).collect()}
    assert reasons == {"2000/005": "no text", "2000/007": "no source", "2000/003": "end-of-text literal"}
    assert 25 == len(reasons) + len(texts[2000]) - 1
    # The second time everything comes from the cache.
    (tmp_path / "papers-2000.tar.gz").write_bytes(b"damaged")
    assert streams(year_corpus(spark, path, coder, [2000], cache)) == year_streams(plain, texts, [2000])


def test_folders_that_are_no_years(spark, tmp_path):
    for folder in ("2000", "2001", "misc"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.md").write_text(folder)
        (tmp_path / folder / "empty.md").write_text("")
    got = {(r.year, r.doc_key, r.text) for r in read_document_files(spark, str(tmp_path)).collect()}
    years = {"2000": 2000, "2001": 2001, "misc": None}
    assert got == {x for f, y in years.items() for x in ((y, f"{f}/a.md", f), (y, f"{f}/empty.md", ""))}
    assert {r.doc_key for r in read_document_files(spark, str(tmp_path), [2001]).collect()} == {"2001/a.md", "2001/empty.md"}
    assert read_document_files(spark, str(tmp_path), [1992]).count() == 0


def test_text_only_corpus_and_rejects(spark, coder, tmp_path):
    path = str(tmp_path / "texts")
    spark.range(300).select(F.when(F.col("id") % 10 > 0, F.lit("same text")).alias("text")).repartition(3).write.parquet(path)
    rows = read_documents(spark, path)
    assert rows.select("doc_key").distinct().count() == 300 and rows.where("source IS NULL").count() == 300
    tokens, out = web_corpus(spark, path, coder, fraction=0.1), web_rejects(spark, path)
    assert tokens.count() == 270 and tokens.where("split = 'val'").count() == 27
    assert out.count() == 30 and out.select("reason").distinct().first().reason == "no text"
    with pytest.raises(ValueError, match="key column"):
        read_documents(spark, path, "json", schema="text string")


def test_markup_ends_match_their_begins(spark):
    latex = "a \\begin{figure}\\begin{tabular}x\\end{tabular}\\caption{Cap text}\\end{figure} b"
    html = "<p>a<script>var s = '</style>';</script>b</p>"
    one = spark.createDataFrame([(latex, html)], "l string, h string")
    assert one.select(markup_to_text("l", "latex"), markup_to_text("h")).first() == ("a b", "a b")
