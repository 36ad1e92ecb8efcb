"""Opening files by Spark path inside tasks, for any storage Arrow can reach."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def filesystem(path: str):
    """The file system of a path, and the path inside it."""
    from pyarrow import fs

    scheme, rest = split_scheme(path)
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")


#: Schemes of Spark paths, and what Arrow calls them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def split_scheme(path: str) -> tuple[str, str]:
    """Arrow's scheme of a Spark path, and the rest; a path without a scheme is local.

    Any other scheme, and one without its authority, is refused: read as a local path
    it would end up in a folder of whichever machine opens it.
    """
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(?=/)", path)
    if not found:
        return "file", path
    scheme, rest = found[1].lower(), path[found.end() :]
    if scheme == "file":
        return "file", "/" + rest.lstrip("/")
    if scheme not in SCHEMES or not rest.startswith("//") or rest.startswith("///"):
        raise ValueError(f"cannot open {path!r}: known are {sorted(SCHEMES)}, each with its host or bucket")
    return SCHEMES[scheme], rest[2:]


def plain_path(path: Column) -> Column:
    """A path from file metadata without its percent escapes."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
