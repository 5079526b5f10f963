"""Members of zip archives as rows, and rows as zip archives."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame

MEMBER_BYTES = 64 << 20  #: a member that would unpack to more is named, but not read
CHUNK_BYTES = 8 << 20  #: rows of about so much content are handed on together
COLUMNS = "path string, member string, size long, content binary, status string"


def unsafe(name: str) -> bool:
    """Whether a member's name would leave the folder that it is unpacked to."""
    path = PurePosixPath(name.replace("\\", "/"))
    return path.is_absolute() or ".." in path.parts or ":" in name.split("/")[0]


def _members(path: str, content: bytes, suffixes: tuple[str, ...], most: int | None, most_bytes: int) -> Iterator[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        found = sorted((m for m in archive.infolist() if not m.is_dir() and m.filename.lower().endswith(suffixes)), key=lambda m: m.filename)
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        yield path, None, None, None, "not_an_archive"
        return
    with archive:
        for m in found[:most]:
            if unsafe(m.filename):
                yield path, m.filename, m.file_size, None, "unsafe_name"
                continue
            if m.file_size > most_bytes:
                yield path, m.filename, m.file_size, None, "too_large"
                continue
            try:
                with archive.open(m) as member:
                    data = member.read(most_bytes + 1)  # the declared size may be wrong
                    rest = member.read(1) if len(data) <= most_bytes else b"."
            except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError):
                yield path, m.filename, m.file_size, None, "unreadable"
                continue
            yield (path, m.filename, m.file_size, None, "too_large") if rest or len(data) > most_bytes else (path, m.filename, len(data), data, "ok")


def zip_members(files: DataFrame, suffixes: tuple[str, ...] = ("",), most: int | None = None, most_bytes: int = MEMBER_BYTES) -> DataFrame:
    """files (path, content), as the binaryFile source gives them -> (path, member, size, content, status).

    An archive's members with one of the suffixes come in order of their names, the first `most` of them; each is
    unpacked on its own and handed on before the next ones, so that a task holds the packed archive and some members.
    A member that is too large, damaged or encrypted, or whose name leads out of the folder, has a status and no content; so has, as a
    whole, a file that is no archive.
    """
    suffixes = tuple(s.lower() for s in suffixes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "member", "size", "content", "status"]
        for part in parts:
            held, size = [], 0
            for path, content in zip(part["path"], part["content"]):
                for row in _members(path, b"" if content is None else bytes(content), suffixes, most, most_bytes):
                    held.append(row)
                    size += len(row[3] or b"")
                    if size >= CHUNK_BYTES:
                        yield pd.DataFrame(held, columns=names).astype({"size": "Int64"})
                        held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=names).astype({"size": "Int64"})

    return files.select("path", "content").mapInPandas(run, COLUMNS)


def zipped(rows: DataFrame, archive: str, member: str, content: str) -> DataFrame:
    """(archive, content): one zip for each value of `archive`, members in order of their names; an archive must fit in a task."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in sorted(zip(part["member"], part["content"])):
                z.writestr(zipfile.ZipInfo(name), b"" if data is None else bytes(data), zipfile.ZIP_DEFLATED)  # a fixed date
        return pd.DataFrame({"archive": part["archive"].iloc[:1], "content": [out.getvalue()]})

    kind = rows.schema[archive].dataType.simpleString()
    columns = rows.selectExpr(f"`{archive}` AS archive", f"`{member}` AS member", f"cast(`{content}` AS binary) AS content")
    return columns.groupBy("archive").applyInPandas(pack, f"archive {kind}, content binary")
