import io
import tarfile
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenweave.session import scratch_dir, scratch_path, stage
from tokenweave.sinks.materialize import is_finished, materialize_once, materialize_years, pin
from tokenweave.sinks.token_shards import write_token_shards
from tokenweave.sources import pieces
from tokenweave.sources.documents import (
    archive_members,
    decoded_members,
    expand_archives,
    member_lines,
    read_document_files,
    read_documents,
    read_text_split,
    reject_null_text,
    safe_member,
)
from tokenweave.sources.token_files import read_manifest
from tokenweave.sources.token_shards import fetch_sequences, read_sequences, read_token_shards
from tokenweave.streaming.tokenize import tokenize_new_files


def tokens(spark, docs):
    rows = [(s, i, ids, len(ids)) for i, (s, ids) in enumerate(docs)]
    return spark.createDataFrame(rows, "split string, doc int, ids array<int>, n long")


DOCS = [("train", list(range(i, i + i % 50))) for i in range(200)] + [("val", [65535, 0, 7]), ("val", []), ("test", [1])]


def stream(split):
    return [i for s, ids in DOCS if s == split for i in ids]


@pytest.mark.parametrize("shards,chunk,part", [(1, 64, 128), (8, 7, 21), (16, 4096, 1 << 20)])
def test_shards_round_trip(spark, tmp_path, shards, chunk, part):
    out = str(tmp_path / "tok")
    write_token_shards(tokens(spark, DOCS).repartition(5), out, ["doc"], shards)
    for split in ("train", "val", "test"):
        mine = [m for m in read_manifest(out) if m["split"] == split]
        count = len([1 for s, _ in DOCS if s == split])
        assert [m["shard"] for m in mine] == list(range(min(shards, count)))
        data = b"".join((tmp_path / "tok" / split / f"shard-{m['shard']:05d}.bin").read_bytes() for m in mine)
        assert np.frombuffer(data, "<u2").tolist() == stream(split)
    got = read_token_shards(spark, out, chunk, part).orderBy("split", "start").collect()
    for split in ("train", "val", "test"):
        assert [i for r in got if r.split == split for i in r.ids] == stream(split)
    assert all(len(r.ids) <= chunk for r in got)
    assert not list(tmp_path.glob("tok/_attempt*"))


@pytest.mark.parametrize("length,part", [(1, 300), (7, 21), (64, 1 << 20), (100_000, 1 << 20)])
def test_sequences_from_shards(spark, tmp_path, length, part):
    out = str(tmp_path / "tok")
    write_token_shards(tokens(spark, DOCS), out, ["doc"], 8)
    got = {(r.split, r.seq_id): (r.x, r.y) for r in read_sequences(spark, out, length, part).collect()}
    want = {}
    for split in ("train", "val", "test"):
        ids = stream(split)
        for c in range(max(0, (len(ids) - 1) // length)):
            want[split, c] = (ids[c * length : (c + 1) * length], ids[c * length + 1 : (c + 1) * length + 1])
    assert got == want


def test_plain_token_files(spark, tmp_path):
    """Files of other origin, several to a split, without a manifest."""
    years = {y: np.arange(y, y + 100 * (y % 5), dtype="<u2") for y in (1999, 2000, 2001)}
    for y, ids in years.items():
        ids.tofile(tmp_path / f"{y}.npy")
    files = {"train": [str(tmp_path / f"{y}.npy") for y in (2001, 2000, 1999)], "val": [str(tmp_path / "2001.npy")]}
    want = np.concatenate([years[2001], years[2000], years[1999]]).tolist()
    rows = read_token_shards(spark, files, 64, 128).where("split = 'train'").orderBy("start").collect()
    assert [i for r in rows for i in r.ids] == want
    rows = read_sequences(spark, files, 30, 90).where("split = 'train'").orderBy("seq_id").collect()
    assert [i for r in rows for i in r.x] == want[: (len(want) - 1) // 30 * 30]
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError, match="two-byte"):
        read_token_shards(spark, {"train": [str(tmp_path / "odd.bin")]})


def test_shards_are_written_once(spark, tmp_path):
    out = str(tmp_path / "tok")
    write_token_shards(tokens(spark, DOCS), out, ["doc"], 8)
    with pytest.raises(Exception, match="already holds"):
        write_token_shards(tokens(spark, DOCS[:5]), out, ["doc"], 2)
    assert [i for r in read_token_shards(spark, out).orderBy("split", "start").collect() if r.split == "val" for i in r.ids] == stream("val")
    write_token_shards(tokens(spark, DOCS[:5]), out, ["doc"], 2, overwrite=True)
    assert len(read_manifest(out)) == 2 and len(list(tmp_path.glob("tok/*/*.bin"))) == 2


def test_ids_beyond_two_bytes_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="two bytes"):
        write_token_shards(tokens(spark, [("train", [65536])]), str(tmp_path / "tok"), ["doc"], 1)
    assert read_manifest(str(tmp_path / "tok")) == []


def test_materialize_once(spark, tmp_path):
    out, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return tokens(spark, DOCS)

    for _ in range(2):
        assert materialize_once(spark, out, build).count() == len(DOCS)
    assert len(calls) == 1
    # A folder whose write was not committed is built again.
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert not is_finished(spark, out)
    assert materialize_once(spark, out, build).count() == len(DOCS) and len(calls) == 2


def test_materialize_years(spark, tmp_path):
    asked = []

    def build(years):
        asked.append(sorted(years))
        return spark.createDataFrame([(y, f"d{y}") for y in years], "year int, doc string")

    out = str(tmp_path / "y")
    assert materialize_years(spark, out, [1999, 2000], build).count() == 2
    assert sorted(r.year for r in materialize_years(spark, out, [2000, 2001], build).collect()) == [2000, 2001]
    assert materialize_years(spark, out, [1999, 2000, 2001], build).count() == 3
    assert asked == [[1999, 2000], [2001]]


def test_stage_uses_the_session_folder(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(tokens(spark, DOCS), "x", ("split",))
    assert staged.columns == ["split", "doc", "ids", "n"] and staged.count() == len(DOCS)
    assert scratch_dir(spark) in staged.inputFiles()[0]
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_pin(spark):
    df = pin(spark.range(10))
    assert df.count() == 10 and df.storageLevel.useMemory and not df.storageLevel.useDisk
    df.unpersist()


def test_read_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"id": "a", "text": "x"}\n{"id": "b", "text": null}\n')
    df = read_documents(spark, str(tmp_path), "json", "id", source=None, schema="id string, text string")
    assert df.columns == ["doc_key", "source", "text"]
    kept, rejected = reject_null_text(df)
    assert [r.doc_key for r in kept.collect()] == ["a"] and [r.doc_key for r in rejected.collect()] == ["b"]


def test_read_document_files(spark, tmp_path):
    for year, name, text in [(1999, "a.md", "one\r\ntwo\n"), (1999, "b c%+.md", ""), (2000, "a+%41 x.md", "é")]:
        (tmp_path / str(year)).mkdir(exist_ok=True)
        (tmp_path / str(year) / name).write_bytes(text.encode())
    got = {(r.year, r.doc_key): r.text for r in read_document_files(spark, str(tmp_path)).collect()}
    assert got == {(1999, "1999/a.md"): "one\ntwo\n", (1999, "1999/b c%+.md"): "", (2000, "2000/a+%41 x.md"): "é"}


def tar(path, members):
    with tarfile.open(path, "w:gz") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


MEMBERS = {
    "1999/a": b"x\ny\n",
    "1999/b": "é".encode() * 500,
    "1999/bad": b"\xff\xfe",
    "1999/empty": b"",
    "1999/long": b"".join(b"line %d\r\n" % i for i in range(3000)),
}


def test_archives(spark, tmp_path):
    tar(tmp_path / "papers %41-1999.tar.gz", MEMBERS)
    with zipfile.ZipFile(tmp_path / "papers-2000.zip", "w") as z:
        z.writestr("2000/", "")
        for name, data in MEMBERS.items():
            z.writestr(name, data)
    members = expand_archives(spark, f"{tmp_path}/papers*", part_bytes=1000)
    parts = members.orderBy("part").collect()
    for archive in ("papers %41-1999.tar.gz", "papers-2000.zip"):
        got = {}
        for r in parts:
            if r.archive.endswith(archive):
                got[r.member] = got.get(r.member, b"") + bytes(r.content)
        assert got == MEMBERS
    assert max(r.part for r in parts) > 10
    docs = decoded_members(members, F.regexp_extract("archive", r"(\d{4})[^/]*$", 1).cast("int")).collect()
    texts = {(r.year, r.doc_key): r.markup for r in docs}
    assert texts[1999, "1999/a"] == "x\ny\n" and texts[2000, "1999/b"] == "é" * 500
    assert texts[1999, "1999/bad"] is None and texts[1999, "1999/empty"] == ""
    lines = member_lines(members.where("member = '1999/long' AND archive LIKE '%zip'"))
    text = "".join(r.text for r in lines.orderBy("block", "line_no").collect())
    assert text == MEMBERS["1999/long"].decode().replace("\r\n", "\n")


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x", "C:\\x", "..\\x"])
def test_unsafe_members_are_refused(spark, tmp_path, name):
    assert not safe_member(name) and safe_member("a/b..c")
    tar(tmp_path / "bad.tar.gz", {name: b"x"})
    with pytest.raises(Exception, match="unsafe member"):
        expand_archives(spark, str(tmp_path / "bad.tar.gz")).collect()


def test_streaming_tokenizes_new_files_only(spark, coder, plain, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = "doc_key string, text string"

    def run():
        tokenize_new_files(spark, source, schema, out, state, coder.encode("text")).awaitTermination()
        return {r.doc_key: r.ids for r in spark.read.parquet(out).collect()}

    spark.createDataFrame([("a", "Hello world"), ("n", None)], schema).write.parquet(source)
    assert run() == {"a": [15496, 995]}
    spark.createDataFrame([("b", "x y")], schema).write.mode("append").parquet(source)
    assert run() == {"a": [15496, 995], "b": plain.encode_ordinary("x y")}
    assert spark.read.parquet(out).count() == 2


@pytest.mark.parametrize("near, at_once", [(1 << 14, 1 << 22), (0, 30)])
def test_scheduled_sequences_are_read_by_place(spark, tmp_path, monkeypatch, near, at_once):
    from tokenweave.sources import token_shards

    monkeypatch.setattr(token_shards, "NEAR", near)
    monkeypatch.setattr(token_shards, "AT_ONCE", at_once)
    out = str(tmp_path / "tok")
    write_token_shards(tokens(spark, DOCS).repartition(5), out, ["doc"], 7)
    whole, length = stream("train"), 16
    last = (len(whole) - 1) // length - 1
    wanted = [(i, f"s{i}", s) for i, s in enumerate([3, 0, last, 3, 200, 201, 3, 17])]
    schedule = spark.createDataFrame(wanted, "itr long, slot string, seq_id long").coalesce(2)
    fetched = fetch_sequences(schedule, out, "train", length)
    got = {(r.itr, r.slot): (list(r.x), list(r.y)) for r in fetched.collect()}
    assert got == {
        (i, n): (whole[s * length : (s + 1) * length], whole[s * length + 1 : (s + 1) * length + 1]) for i, n, s in wanted
    }
    assert "Exchange" not in fetched._jdf.queryExecution().executedPlan().toString()
    plain = fetch_sequences(schedule.limit(1), {"v": [f"{out}/train/shard-00000.bin"]}, "v", 4)
    assert list(plain.first().x) == whole[12:16]
    for bad in (-1, last + 1):
        with pytest.raises(Exception, match="holds sequences 0 to"):
            fetch_sequences(spark.createDataFrame([(bad,)], "seq_id long"), out, "train", length).collect()
    assert fetch_sequences(schedule.where("false"), out, "test", length).count() == 0


def test_archive_index(spark, tmp_path):
    with tarfile.open(tmp_path / "plain.tar", "w") as t:
        for name, data in MEMBERS.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "both.zip", "w") as z:
        for i, (name, data) in enumerate(MEMBERS.items()):
            z.writestr(name, data, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    tar(tmp_path / "packed.tar.gz", MEMBERS)
    rows = archive_members(spark, f"{tmp_path}/*").collect()
    for archive, kinds in [("plain.tar", {"stored"}), ("both.zip", {"stored", "packed"}), ("packed.tar.gz", {"stream"})]:
        mine = [r for r in rows if r.archive.endswith(archive)]
        assert {r.member: r["size"] for r in mine} == {n: len(d) for n, d in MEMBERS.items()}
        assert {r.kind for r in mine} == kinds
        data = (tmp_path / archive).read_bytes()
        for r in mine:
            assert r.kind != "stored" or data[r.offset : r.offset + r["size"]] == MEMBERS[r.member]
    # Ranges of stored members are rows of work of their own.
    parts = expand_archives(spark, f"{tmp_path}/*", part_bytes=300).orderBy("part").collect()
    for archive in ("plain.tar", "both.zip", "packed.tar.gz"):
        got = {}
        for r in parts:
            if r.archive.endswith(archive):
                got[r.member] = got.get(r.member, b"") + bytes(r.content)
        assert got == MEMBERS
    long = [r for r in parts if r.member == "1999/long"]
    assert len(long) > 200 and all(bytes(r.content).endswith(b"\n") for r in long)


FILES = {
    "lines.txt": "one\r\ntwo\n\n é three \n" * 400 + "end",
    "words.txt": "no line ends at all é " * 3000,
    "solid.txt": "x" * 9000,
    "mixed.txt": "a b\n" + "long line " * 1500 + "\nlast\n",
    "bom.txt": "\ufeffwith a mark\nand more\n",
    "empty.txt": "",
    "blank.txt": "\n\n \n",
}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab\n \u3000", max_size=60), st.integers(1, 9), st.integers(1, 9), st.integers(1, 9))
def test_ranges_agree_on_their_cuts(text, size, near, block):
    data = text.encode()

    def read(at, count):
        assert 0 <= at and count >= 0
        return data[at : at + count]

    old, pieces.READ_BYTES = pieces.READ_BYTES, block
    try:
        found = [pieces.range_piece(read, len(data), a, size, near) for a in range(0, len(data), size)]
        streamed = list(pieces.stream_pieces(io.BytesIO(data), size))
    finally:
        pieces.READ_BYTES = old
    for parts in ([p for _, p in found], streamed):
        assert b"".join(parts) == data
        at = 0
        for p in parts[:-1]:
            at += len(p)
            ends_line = data[at - 1 : at] == b"\n"
            ends_word = 0x21 <= data[at - 1] <= 0x7E and data[at : at + 1] in (b" ", b"\n") if 0 < at < len(data) else True
            assert at in (0, len(data)) or ends_line or ends_word
    assert all(data[a : a + len(p)] == p for a, p in found)


@pytest.mark.parametrize("size", [8 << 20, 500, 37])
def test_ranges_of_text_files(spark, tmp_path, size):
    import gzip

    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
    rows = read_text_split(spark, str(tmp_path), size).orderBy("block", "line_no").collect()
    for name, text in FILES.items():
        plain = text.removeprefix("\ufeff").replace("\r\n", "\n")
        for file in (name, f"{name}.gz"):
            mine = [r.text for r in rows if r.file.endswith("/" + file)]
            assert "".join(mine) == plain
            if size > 1 << 20:
                assert mine == plain.splitlines(keepends=True)
    many = [r for r in rows if r.file.endswith("/words.txt")]
    assert len(many) > 50 or size > 1 << 20


def test_a_file_without_line_ends_has_many_segments(spark, coder, plain, tmp_path):
    """Encoded piece by piece, the ids are those of the whole."""
    from tokenweave.operators.segments import safe_segments

    text = "".join(f" word{i % 97} and 12{i} things, isn't it?   " for i in range(4000))
    (tmp_path / "one.txt").write_text(text)
    lines = read_text_split(spark, str(tmp_path), 4096)
    assert len(text) < pieces.NEAR and lines.count() > 30
    segments = safe_segments(lines, order=("block", "line_no")).withColumn("ids", coder.encode("text"))
    rows = segments.orderBy("segment").collect()
    assert len(rows) > 30 and [i for r in rows for i in r.ids] == plain.encode_ordinary(text)
