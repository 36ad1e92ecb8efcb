"""Files and archives of many members: work that is dealt out, and opened once."""

import gzip
import io
import os
import sys
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import check_oracles  # noqa: E402
from tokenweave.plans import queries  # noqa: E402
from tokenweave.sources import documents  # noqa: E402
from tokenweave.sources.documents import expand_archives, read_document_files, read_text_split  # noqa: E402

from tokenweave.functions.bpe import PART_BYTES, in_parts  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def test_packed_members_open_at_their_header(spark, tmp_path):
    path = tmp_path / "many.zip"
    texts = {f"m{i:04d}": (f"text {i} " * (i % 50)).encode() for i in range(2000)}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in texts.items():
            z.writestr(name, text)
    parts = expand_archives(spark, str(path), part_bytes=1000)
    got = {}
    for r in parts.orderBy("part").collect():
        got[r.member] = got.get(r.member, b"") + bytes(r.content)
    assert got == texts and tasks(parts) > 1
    index = documents._indexed(documents._archives(spark, str(path), None), False).collect()
    data = path.read_bytes()
    without = io.BytesIO(data[: data.rindex(b"m1999") - 46 - 1999 * 40])  # no directory at its end
    for row in index[::100]:
        assert documents._open_packed(without, row.asDict()).read() == texts[row.member]
    with pytest.raises(ValueError, match="encrypted"):
        documents._open_packed(without, {**index[0].asDict(), "flags": 1})


def test_document_files_are_dealt_out(spark, tmp_path):
    (tmp_path / "1999").mkdir()
    for i in range(60):
        (tmp_path / "1999" / f"{i}.md").write_text(f"text {i}\r\n")
    (tmp_path / "1999" / "packed.gz").write_bytes(gzip.compress(b"unpacked"))
    (tmp_path / "1999" / "bad.md").write_bytes(b"a\xffb")
    for hidden in ("_SUCCESS", ".a.crc", "_x.md"):
        (tmp_path / "1999" / hidden).write_text("x" if hidden == "_x.md" else "")
    docs = read_document_files(spark, str(tmp_path))
    got = {r.doc_key: r.text for r in docs.collect()}
    assert got == {f"1999/{i}.md": f"text {i}\n" for i in range(60)} | {"1999/packed.gz": "unpacked", "1999/bad.md": "a�b"}
    assert tasks(docs) > 2


def test_ranges_of_a_file_are_dealt_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line of text\n" * 20000)
    assert tasks(read_text_split(spark, str(tmp_path), 1000)) > 2


@pytest.mark.parametrize("name", ["archive_members", "expand_archives", "read_document_files", "recipe_wiki", "recipe_char"])
def test_corpora_in_several_files(spark, monkeypatch, name):
    monkeypatch.setattr(queries, "SHELF", 50)
    con = check_oracles.connect(SMALL)
    assert check_oracles.compare(spark, con, name, SMALL) is None


def test_batches_are_coded_in_parts(spark, coder):
    batch = pa.array([None, "", *["text " * 1000] * 1500])
    parts = list(in_parts(iter([batch, batch.slice(0, 0)])))
    assert pa.concat_arrays(parts) == batch and len(parts) > 5 and max(p.nbytes for p in parts) < 2 * PART_BYTES
    df = spark.createDataFrame([(t,) for t in batch.to_pylist()], "text string").coalesce(1)
    again = df.withColumn("again", coder.decode(coder.encode("text")))
    assert again.where("NOT text <=> again").count() == 0


@pytest.mark.parametrize(
    "name, mark", [("fetch_batches", "array<smallint>"), ("nested_markup", "RepartitionByExpression"), ("match_targets", "RepartitionByExpression [batch_id")]
)
def test_steps_move_little_and_are_dealt_out(spark, name, mark):
    df = queries.registered()[name](spark, SMALL)
    assert mark in df._jdf.queryExecution().toString()
