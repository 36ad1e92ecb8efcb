import random
import re

import pytest

from tokenweave.operators.segments import cut_long_texts, safe_segments
from tokenweave.sources.documents import read_text_split

WHOLE = [
    "x \n\n  y",
    " = A = \n \n b",
    "\n\n  leading blank lines\nend  ",
    "one line",
    "a\n",
    "   \n \n",
    "tab\t\nnbsp\u00a0\n\u3000wide \u2003\nlast\n\n\n",
    "",
]


def random_text(r):
    return "".join(r.choice(["a", "bc", " ", "  ", "\n", "\n\n", "\t", "é", "1", "!", "\u00a0", "it's"]) for _ in range(r.randrange(60)))


def cut(spark, texts, partitions=3):
    """Segments of texts given as files of lines with terminators."""
    rows = [(str(f), i, line) for f, t in enumerate(texts) for i, line in enumerate(re.findall("[^\n]*\n|[^\n]+", t))]
    lines = spark.createDataFrame(rows, "file string, line_no int, text string")
    return safe_segments(lines.repartition(partitions))


def by_file(rows, column="text"):
    out = {}
    for r in sorted(rows, key=lambda r: r.segment):
        out.setdefault(r.file, []).append(r[column])
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_segment_ids_are_whole_file_ids(spark, coder, plain, partitions):
    r = random.Random(2)
    texts = WHOLE + [random_text(r) for _ in range(300)]
    segments = cut(spark, texts, partitions)
    rows = segments.withColumn("ids", coder.encode("text")).collect()
    got, ids = by_file(rows), by_file(rows, "ids")
    for f, text in enumerate(texts):
        assert "".join(got.get(str(f), [])) == text
        assert [i for part in ids.get(str(f), []) for i in part] == plain.encode_ordinary(text)
    # Cutting at line ends instead would not do.
    assert any(
        [i for line in t.splitlines(True) for i in plain.encode_ordinary(line)] != plain.encode_ordinary(t) for t in texts
    )


def test_one_hot_file_spans_buckets(spark):
    # Nearly all lines belong to one file; blank lines move to the next segment.
    text = "".join(f"line {i}\n" + "\n" * (i % 3) for i in range(2000))
    got = by_file(cut(spark, [text, "b"], 5).collect())
    assert "".join(got["0"]) == text and got["1"] == ["b"]
    assert len(got["0"]) == 2001


def test_read_text_split(spark, tmp_path):
    texts = {"a.txt": "x \n\n  y", "b.txt": "a\r\nb\rc\n", "c.txt": "one\n\n", "d.txt": "é\n😀", "e.txt": "\n", "f.txt": " "}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    lines = read_text_split(spark, str(tmp_path))
    got = by_file(safe_segments(lines, order=("block", "line_no")).collect())
    read = {name: text.replace("\r\n", "\n").replace("\r", "\n") for name, text in texts.items()}
    assert {f.rsplit("/", 1)[1]: "".join(parts) for f, parts in got.items()} == read


def test_read_text_split_in_blocks(spark, tmp_path):
    text = "".join(f"{i} {'w' * (i % 37)} \n" for i in range(5000)) + "end"
    (tmp_path / "big.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = read_text_split(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 5
        got = by_file(safe_segments(lines, order=("block", "line_no")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ["".join(parts) for parts in got.values()] == [text]


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_long_texts_keep_their_ids(spark, coder, plain, limit):
    r = random.Random(4)
    texts = WHOLE + ["w" * 100, " " * 100, "a" + " " * 60 + "b", "é😀 " * 50] + [random_text(r) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = cut_long_texts(df, limit).withColumn("ids", coder.encode("text")).orderBy("id", "piece").collect()
    for i, text in enumerate(texts):
        mine = [p for p in rows if p.id == i]
        assert "".join(p.text for p in mine) == text
        assert [x for p in mine for x in p.ids] == plain.encode_ordinary(text)
        assert [p.last for p in mine] == [False] * (len(mine) - 1) + [True]
    assert len(rows) > 2 * len(texts) or limit == 40


def test_long_texts_are_cut(spark):
    df = spark.createDataFrame([(0, "word " * 300_000)], "id int, text string")
    pieces = cut_long_texts(df, 10_000).collect()
    assert max(len(p.text) for p in pieces) <= 10_000 and len(pieces) == 151
