"""Archives as a source: every file of zip and tar archives becomes a row, behind guards that are applied before unpacking.

An archive is walked once without keeping anything, where all that would break a limit is found; only then its entries
are unpacked, each in pieces, and handed on in batches of bounded bytes. A broken limit of the whole archive (bytes,
ratio, number of entries) or a damaged archive is one refusal row and nothing else; an entry that is a link, escapes the
folder, is encrypted, damaged or nested too deep is a refusal row of its own, and the others are unpacked.

Edge cases: a null or empty content is not an archive (a refusal row); an archive without files gives no rows; entries of
one name are a row each; a name is taken in POSIX form, with \\ as /.
"""

from __future__ import annotations

import gzip
import io
import stat
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRIES = "path string, entry string, depth int, size long, content binary, refusal string"
#: Bytes that are read at once, and of contents that are handed on at once.
PIECE, BATCH = 1 << 16, 8 << 20


@dataclass(frozen=True)
class Guards:
    # The most that an archive may hold.
    ratio: int = 10
    total_bytes: int = 2 << 30
    entries: int = 10_000
    depth: int = 2


class Refused(Exception):
    """Why a whole archive isn't unpacked."""


@dataclass
class _Left:
    """What may still be unpacked of one outermost archive."""

    bytes: int
    ratio: int
    entries: int

    def take(self, size: int = 0, entries: int = 0) -> None:
        self.bytes, self.ratio, self.entries = self.bytes - size, self.ratio - size, self.entries - entries
        if self.entries < 0:
            raise Refused("too many entries")
        if self.bytes < 0:
            raise Refused("too many bytes")
        if self.ratio < 0:
            raise Refused("expands too far")


def kind_of(head: bytes) -> str | None:
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    return "tar" if head[257:262] == b"ustar" else None


def unsafe(name: str) -> bool:
    """Whether a name leads out of the folder that it is unpacked in."""
    name = name.replace("\\", "/")
    return name.startswith("/") or name[1:2] == ":" or ".." in name.split("/") or "\0" in name


#: An entry: name, declared size (None: unknown), refusal or None, and how to open it.
_Entry = tuple[str, int | None, str | None, Callable[[], Any]]


def _zip(data: bytes) -> Iterator[_Entry]:
    z = zipfile.ZipFile(io.BytesIO(data))
    for x in z.infolist():
        if x.is_dir():
            continue
        mode = x.external_attr >> 16
        odd = "is a link" if stat.S_ISLNK(mode) else "escapes the folder" if unsafe(x.filename) else "is encrypted" if x.flag_bits & 1 else None
        yield x.filename, x.file_size, odd, lambda x=x: z.open(x)


def _tar(data: bytes) -> Iterator[_Entry]:
    t = tarfile.open(fileobj=io.BytesIO(data), mode="r:")
    for x in t:
        if x.isdir():
            continue
        odd = "is a link" if x.issym() or x.islnk() else "escapes the folder" if unsafe(x.name) else None if x.isreg() else "is no file"
        yield x.name, x.size if x.isreg() else 0, odd, lambda x=x: t.extractfile(x)


def _pieces(source: Any) -> Iterator[bytes]:
    while piece := source.read(PIECE):
        yield piece


def _gunzipped(data: bytes, left: _Left) -> bytes:
    """A tar archive inside gzip, bounded while it is unpacked; it is counted again by entry, so here on a copy."""
    own, out = _Left(left.bytes + PIECE * 16, left.ratio + PIECE * 16, 1), bytearray()
    for piece in _pieces(gzip.GzipFile(fileobj=io.BytesIO(data))):
        own.take(len(piece))
        out += piece
    return bytes(out)


_DAMAGE = (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, NotImplementedError, ValueError, RuntimeError)


def _walk(data: bytes, before: str, depth: int, guards: Guards, left: _Left, keep: bool) -> Iterator[tuple[str, int, int, bytes | None, str | None]]:
    """(entry, depth, size, content, refusal); without keep only nested archives are held, and nothing is yielded but refusals."""
    kind = kind_of(data)
    if kind == "gzip":
        data = _gunzipped(data, left)
        kind = kind_of(data)
    if kind not in ("zip", "tar"):
        raise Refused("is no archive")
    for name, declared, odd, opened in (_zip if kind == "zip" else _tar)(data):
        left.take(entries=1)
        shown = before + name
        if odd:
            yield shown, depth, declared or 0, None, odd
            continue
        if declared and declared > left.bytes:
            raise Refused("too many bytes")
        try:
            out, size, head = bytearray(), 0, b""
            with opened() as source:
                for piece in _pieces(source):
                    left.take(len(piece))
                    size += len(piece)
                    head = head or piece[:512]
                    if keep or kind_of(head):
                        out += piece
        except _DAMAGE as e:
            yield shown, depth, 0, None, f"is damaged: {type(e).__name__}"
            continue
        if kind_of(head) is None:
            if keep:
                yield shown, depth, size, bytes(out), None
        elif depth >= guards.depth:
            yield shown, depth, size, None, "is nested too deep"
        else:
            try:
                yield from _walk(bytes(out), f"{shown}!/", depth + 1, guards, left, keep)
            except _DAMAGE as e:
                yield shown, depth, size, None, f"is damaged: {type(e).__name__}"
            except Refused as e:
                if str(e) != "is no archive":
                    raise
                if keep:
                    yield shown, depth, size, bytes(out), None  # a single file in gzip stays as it is


def unpacked(data: bytes | None, guards: Guards = Guards()) -> Iterator[tuple[str | None, int, int, bytes | None, str | None]]:
    """(entry, depth, size, content, refusal) of an archive."""
    data = data or b""

    def left() -> _Left:
        return _Left(guards.total_bytes, guards.ratio * max(1, len(data)), guards.entries)

    try:
        for _ in _walk(data, "", 1, guards, left(), keep=False):
            pass
        yield from _walk(data, "", 1, guards, left(), keep=True)
    except Refused as e:
        yield None, 0, len(data), None, str(e)
    except _DAMAGE as e:
        yield None, 0, len(data), None, f"is damaged: {type(e).__name__}"


def read_archives(files: DataFrame, guards: Guards = Guards()) -> DataFrame:
    """ENTRIES of the archives of a DataFrame with path and content (as Spark's binaryFile source reads them)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def given() -> pa.RecordBatch:
            columns = zip(*held)
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in ENTRIES.split(", ")])

        for part in parts:
            for path, content in zip(part.column("path"), part.column("content")):
                for row in unpacked(content.as_py(), guards):
                    held.append((path.as_py(), *row))
                    size += row[2]
                    if size >= BATCH:
                        yield given()
                        held, size = [], 0
        if held:
            yield given()

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, ENTRIES)
