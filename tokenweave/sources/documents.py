"""Reading row-oriented corpora, text files, document files and archives."""

from __future__ import annotations

import itertools
import re
import struct
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenweave.functions.markup import normalize_newlines
from tokenweave.session import task_count
from tokenweave.sources.files import filesystem, plain_path
from tokenweave.sources.pieces import range_piece, stream_pieces

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_key", T.StringType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

#: Members of an archive leave it in pieces of about this size, cut at line ends.
PART_BYTES = 4 << 20

#: Bytes of a text file that one row of work reads.
RANGE_BYTES = 8 << 20

#: Rows of an archive's index, or files, that leave together.
INDEX_ROWS = 10_000

#: Names of files that Arrow unpacks while reading.
COMPRESSED = r"\.(gz|bz2|lz4|zst)$"

LINE = re.compile("[^\n]*\n|[^\n]+")
BOM = b"\xef\xbb\xbf"

MEMBERS = "archive string, member string, part int, content binary"


def read_documents(
    spark: SparkSession,
    path: str | Sequence[str],
    format: str = "parquet",
    key: str | None = "doc_key",
    text: str = "text",
    source: str | None = "source",
    schema: T.StructType | str | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Rows of a corpus with a text field, as ``(doc_key, source, text, *extra)``.

    Give ``schema`` for formats that would otherwise be scanned to infer it.  Without a key
    (None, or no such column), a row of a Parquet corpus is named by its file and its place in it.  A
    corpus without the source column has null sources.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.format(format).load(path)
    origin = F.col(source) if source in rows.columns else F.lit(None).cast("string")
    if key in rows.columns:
        name = F.col(key)
    elif format == "parquet":
        name = F.concat_ws(":", plain_path(F.col("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
    else:
        raise ValueError(f"a corpus in format {format!r} needs a key column")
    return rows.select(name.alias("doc_key"), origin.alias("source"), F.col(text).alias("text"), *extra)


def reject_null_text(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with a text, and the rejected rows without one."""
    return df.where(F.col(text).isNotNull()), df.where(F.col(text).isNull())


def read_text_split(spark: SparkSession, path: str | Sequence[str], range_bytes: int | None = None) -> DataFrame:
    """Lines of text files in file order: ``(file, block, line_no, text)``.

    ``(block, line_no)`` orders the lines of a file; ``text`` ends with the line's terminator, normalized, so the texts
    in order are the file.  Files are read in ranges by many tasks, and a row's place follows from the bytes.  A line that
    goes on far behind the end of its range is several rows, cut at word ends (:mod:`tokenweave.sources.pieces`), so a
    file without line ends is read in parallel as well.  A compressed file is one stream.  What is not UTF-8 becomes
    the replacement character; a byte-order mark is left out.  A range has ``RANGE_BYTES``, or what the session lets
    a split of a file have where that is less.
    """
    if range_bytes is None:
        range_bytes = min(RANGE_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    files = spark.read.format("binaryFile").load(path).select(plain_path(F.col("path")).alias("file"), "length")
    packed = F.lower("file").rlike(COMPRESSED)
    last = F.when(packed, 0).otherwise(F.col("length") - 1)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(range_bytes).cast("long")))
    ranges = files.where("length > 0").select("file", "length", packed.alias("packed"), starts.alias("start"))

    def rows(file: str, block: int, content: bytes) -> pa.RecordBatch:
        lines = LINE.findall(content.removeprefix(BOM if block == 0 else b"").decode("utf-8", "replace"))
        texts = [line.replace("\r\n", "\n").replace("\r", "\n") for line in lines]
        n = len(texts)
        columns = [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "block", "line_no", "text"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, whole, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, inside = filesystem(file)
                if whole:
                    block = 0
                    with store.open_input_stream(inside) as stream:
                        for piece in stream_pieces(stream, range_bytes):
                            yield rows(file, block, piece)
                            block += len(piece)
                else:
                    with store.open_input_file(inside) as f:
                        block, piece = range_piece(lambda at, size: f.read_at(size, at), length, start, range_bytes)
                    yield rows(file, block, piece)

    # A number of tasks, as rows this small would be put together in one.
    spread = ranges.repartition(task_count(spark), "file", "start")
    return spread.mapInArrow(read, "file string, block bigint, line_no bigint, text string")


def _folders(path: str, years: Sequence[int] | None) -> list[str]:
    """Names of the folders of ``path``; of those of the given years, if any are given."""
    from pyarrow import fs

    files, root = filesystem(path)
    found = [f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory]
    return found if years is None else [f for f in found if f in {f"{y:04d}" for y in years}]


def read_document_files(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """One document per file below ``path/<year>/``: ``(year, doc_key, text)``.

    Only the folders of ``years`` are touched, when given; the year of a folder that is not
    named like one is null.  ``doc_key`` is ``<year>/<name>``.  Each folder is listed by one task, and the files are
    dealt out to the tasks by name: a split of a file source is at least some megabytes, so it would be a task for every
    few dozens of small files, behind a list of all of them on the driver.  Files of no length are documents all the
    same; those whose names begin with a dot or an underscore are none.
    """
    folders = _folders(path, years)
    if not folders:
        return spark.createDataFrame([], "year int, doc_key string, text string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(path)
        for batch in batches:
            keys, contents, size = [], [], 0
            for key, length in zip(*(c.to_pylist() for c in batch.columns)):
                content = b""
                if length:
                    with store.open_input_stream(f"{top}/{key}") as f:
                        content = f.read()
                keys.append(key)
                contents.append(content)
                size += len(content)
                if size >= PART_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(contents, pa.binary())], names=["doc_key", "content"])
                    keys, contents, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(contents, pa.binary())], names=["doc_key", "content"])

    dealt = _document_files(spark, path, folders).repartition(task_count(spark), "doc_key")
    return dealt.mapInArrow(read, "doc_key string, content binary").select(
        F.regexp_extract("doc_key", r"^(\d{4})/", 1).try_cast("int").alias("year"),
        "doc_key",
        normalize_newlines(F.col("content").cast("string")).alias("text"),
    )


def _document_files(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """``(doc_key, size)`` of the files in the folders of ``path``."""
    from pyarrow import fs

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{top}/{folder}"))
                for low in range(0, len(found), INDEX_ROWS):
                    some = [f for f in found[low : low + INDEX_ROWS] if f.type == fs.FileType.File and f.base_name[0] not in "._"]
                    names = pa.array([f"{folder}/{f.base_name}" for f in some], pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array([f.size for f in some], pa.int64())], names=["doc_key", "size"])

    listing = spark.createDataFrame([(f,) for f in folders], "folder string")
    return listing.repartition(max(1, len(folders)), "folder").mapInArrow(listed, "doc_key string, size bigint")


def safe_member(name: str) -> bool:
    """False for a member name that would leave the folder it is unpacked into."""
    plain = name.replace("\\", "/")
    return not (plain.startswith("/") or plain[1:2] == ":" or ".." in plain.split("/"))


def archive_members(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """Members of zip and tar archives: ``(archive, member, kind, offset, size)``.

    ``kind`` is "stored" for members whose bytes lie in the archive as they are, from ``offset`` on; "packed" for
    compressed members of a zip, whose header is at ``offset``; "stream" for members of a compressed tar, which only a
    pass over the whole archive reaches.  Of the first two only headers are read.  Unsafe member names are an error.
    """
    return _indexed(_archives(spark, path, wanted), True).select("archive", "member", "kind", "offset", "size")


def _archives(spark: SparkSession, path: str, wanted: Column | None) -> DataFrame:
    archives = spark.read.format("binaryFile").load(path).select("path", "length")
    return (archives if wanted is None else archives.where(wanted)).select("path").repartition(task_count(spark), "path")


def _files_of(t: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """The files of a tar, whose headers are not kept."""
    while (info := t.next()) is not None:
        t.members.clear()
        if info.isfile():
            yield info


#: What the header of a compressed member of a zip may leave to the directory at the end of the archive.
PACKING = (("method", pa.int32()), ("packed", pa.int64()), ("crc", pa.int64()), ("flags", pa.int32()))


def _open_packed(stream, row: dict) -> zipfile.ZipExtFile:
    """A compressed member of a zip at its header, without another look at the archive's directory."""
    if row["flags"] & 1:
        raise ValueError(f"member {row['member']!r} of {row['archive']} is encrypted")
    stream.seek(row["offset"] + 26)
    names = struct.unpack("<HH", stream.read(4))
    stream.seek(row["offset"] + 30 + sum(names))
    info = zipfile.ZipInfo(row["member"])
    info.compress_type, info.compress_size, info.CRC, info.file_size = row["method"], row["packed"], row["crc"], row["size"]
    return zipfile.ZipExtFile(stream, "r", info)


def _indexed(archives: DataFrame, streams: bool) -> DataFrame:
    """The index of archives; without ``streams`` a compressed tar is one row without a member.

    Rows ``(archive, member, kind, offset, size, method, packed, crc, flags)``, the last four of compressed members of a zip.
    """

    def listed(name: str, stream) -> Iterator[tuple]:
        if name.endswith(".zip"):
            with zipfile.ZipFile(stream) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        if info.compress_type != zipfile.ZIP_STORED:
                            packing = info.compress_type, info.compress_size, info.CRC, info.flag_bits
                            yield info.filename, "packed", info.header_offset, info.file_size, *packing
                            continue
                        stream.seek(info.header_offset + 26)
                        names = struct.unpack("<HH", stream.read(4))
                        yield info.filename, "stored", info.header_offset + 30 + sum(names), info.file_size
        elif name.endswith(".tar"):
            with tarfile.open(fileobj=stream, mode="r:") as t:
                for info in _files_of(t):
                    yield info.name, "stored", info.offset_data, info.size
        elif streams:
            with tarfile.open(fileobj=stream, mode="r|*") as t:
                for info in _files_of(t):
                    yield info.name, "stream", None, info.size
        else:
            yield None, "stream", None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("archive", pa.string()), ("member", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]
        schema = pa.schema([*fields, *PACKING])
        for batch in batches:
            for archive in batch.column("path").to_pylist():
                files, inside = filesystem(archive)
                rows = []
                with files.open_input_file(inside) as stream:
                    for found in listed(archive, stream):
                        rows.append(dict(zip(schema.names, (archive, _checked(found[0], archive), *found[1:]))))
                        if len(rows) >= INDEX_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    places = "archive string, member string, kind string, offset bigint, size bigint"
    return archives.mapInArrow(run, f"{places}, method int, packed bigint, crc bigint, flags int")


def _checked(member: str | None, archive: str) -> str | None:
    if member is not None and not safe_member(member):
        raise ValueError(f"unsafe member name {member!r} in {archive}")
    return member


def expand_archives(
    spark: SparkSession, path: str, part_bytes: int = PART_BYTES, wanted: Column | None = None
) -> DataFrame:
    """Members of zip and tar archives as rows ``(archive, member, part, content)``.

    The headers are read first.  Then tasks take ranges of members that are stored as they are, whole members
    that are compressed one by one, and whole archives that are one compressed stream, so a big archive of
    the first two kinds keeps many tasks busy.  A member leaves in pieces that end at cuts
    (:mod:`tokenweave.sources.pieces`), so neither an archive nor a member has to fit in
    memory; unsafe member names are an error.  Archives for whose ``path`` the condition
    ``wanted`` does not hold are not opened.
    """
    index = _indexed(_archives(spark, path, wanted), False)
    last = F.when(F.col("kind") == "stored", F.greatest(F.col("size") - 1, F.lit(0))).otherwise(0)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(part_bytes).cast("long")))
    dealt = index.select("*", starts.alias("start")).repartition(task_count(spark), "archive", "member", "start")
    work = dealt.sortWithinPartitions("archive", "offset", "start")

    def pieces(row: dict, stream) -> Iterator[tuple[str, int, bytes]]:
        if row["kind"] == "stored":

            def read(at: int, size: int) -> bytes:
                return stream.read_at(size, row["offset"] + at)

            _, content = range_piece(read, row["size"], row["start"], part_bytes)
            yield row["member"], row["start"] // part_bytes, content
        elif row["kind"] == "packed":
            with _open_packed(stream, row) as member:
                yield from ((row["member"], i, content) for i, content in enumerate(stream_pieces(member, part_bytes)))
        else:
            with tarfile.open(fileobj=stream, mode="r|*") as t:
                for info in _files_of(t):
                    member = _checked(info.name, row["archive"])
                    parts = stream_pieces(t.extractfile(info), part_bytes)
                    yield from ((member, i, content) for i, content in enumerate(parts))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("archive", pa.string()), ("member", pa.string()), ("part", pa.int32()), ("content", pa.binary())]
        schema = pa.schema(fields)
        for batch in batches:
            rows, size = [], 0
            # Members of an archive follow each other, so it is opened once for them.
            for archive, members in itertools.groupby(batch.to_pylist(), lambda row: row["archive"]):
                files, inside = filesystem(archive)
                with files.open_input_file(inside) as stream:
                    for member, number, content in itertools.chain.from_iterable(pieces(row, stream) for row in members):
                        if content or number == 0:
                            rows.append(dict(zip(schema.names, (archive, member, number, content))))
                            size += len(content)
                        if size >= PART_BYTES or len(rows) >= INDEX_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return work.mapInArrow(unpack, MEMBERS)


def decoded_members(members: DataFrame, year: Column | None = None) -> DataFrame:
    """Whole small members as documents ``(archive, doc_key, markup[, year])``.

    A member that is not valid UTF-8 gets a null text, which the conversion rejects.
    """
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda p: F.hex(p["content"])), ""
    )
    docs = members.groupBy("archive", F.col("member").alias("doc_key")).agg(F.unhex(body).alias("content"))
    text = F.col("content").cast("string")
    docs = docs.select(
        "archive",
        "doc_key",
        F.when(F.is_valid_utf8(text), normalize_newlines(text)).alias("markup"),
    )
    return docs if year is None else docs.withColumn("year", year)


def member_lines(members: DataFrame) -> DataFrame:
    """Lines of large text members in order: ``(file, block, line_no, text)``.

    Pieces end at line ends, so each is cut on its own; terminators stay.
    """
    text = normalize_newlines(F.col("content").cast("string"))
    # Cut after every newline; what follows the last one is a line without a terminator.
    lines = F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+"), F.lit(0))
    return members.select(
        F.col("member").alias("file"),
        F.col("part").alias("block"),
        F.posexplode(lines).alias("line_no", "text"),
    )
