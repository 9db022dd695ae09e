"""The guards of the archive source, each by an archive that breaks it, and what is unpacked."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile

import pytest

from millrace.sources import archives
from millrace.sources.archives import Guards, unpacked
from millrace.sources.tables import read_files


def _zip(*files, mode=0o100644, kind=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", kind) as z:
        for name, content in files:
            x = zipfile.ZipInfo(name)
            x.compress_type, x.external_attr = kind, mode << 16
            z.writestr(x, content)
    return out.getvalue()


def _tar(*files, mode="w") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, content in files:
            x = tarfile.TarInfo(name)
            if content is None:
                x.type, x.linkname = tarfile.SYMTYPE, "/etc/passwd"
                t.addfile(x)
            else:
                x.size = len(content)
                t.addfile(x, io.BytesIO(content))
    return out.getvalue()


NOISE = os.urandom(20_000)


def _refusals(data, **guards):
    return [(e, why) for e, _, _, content, why in unpacked(data, Guards(**guards)) if why is not None and content is None]


@pytest.mark.parametrize("make", [_zip, _tar, lambda *f: _tar(*f, mode="w:gz")])
def test_entries_in_order(make):
    data = make(("a.txt", b"one" * 50 + NOISE), ("d/b.txt", b""), ("d/b.txt", NOISE))
    assert [(e, n, c) for e, _, n, c, w in unpacked(data) if w is None] == [("a.txt", 20_150, b"one" * 50 + NOISE), ("d/b.txt", 0, b""), ("d/b.txt", 20_000, NOISE)]


def test_ratio():
    bomb = _zip(("zeros", bytes(1 << 20)))
    assert [tuple(x) for x in unpacked(bomb)] == [(None, 0, len(bomb), None, "expands too far")]
    assert _refusals(bomb, ratio=10_000) == []
    assert _refusals(gzip.compress(_tar(("zeros", bytes(4 << 20)))))[0][1] == "expands too far"


def test_bytes_and_entries():
    data = _zip(("a", NOISE), ("b", NOISE))
    assert _refusals(data, total_bytes=30_000) == [(None, "too many bytes")]
    assert _refusals(data, entries=1) == [(None, "too many entries")]
    assert _refusals(data, total_bytes=40_000, entries=2) == []


def test_a_bomb_inside_spoils_the_whole_archive():
    inner = _zip(("zeros", bytes(1 << 22)))
    data = _zip(("good", NOISE), ("inner.zip", inner), kind=zipfile.ZIP_STORED)
    assert [tuple(x) for x in unpacked(data)] == [(None, 0, len(data), None, "expands too far")]


def test_depth():
    deepest = _zip(("leaf", NOISE))
    middle = _zip(("deepest.zip", deepest), ("file", b"x"))
    data = _zip(("middle.zip", middle))
    assert [(e, d, w) for e, d, _, _, w in unpacked(data)] == [("middle.zip!/deepest.zip", 2, "is nested too deep"), ("middle.zip!/file", 2, None)]
    assert [e for e, *_ in unpacked(data, Guards(depth=3))] == ["middle.zip!/deepest.zip!/leaf", "middle.zip!/file"]


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x", "..\\x", "C:/x", "C:\\x"])
def test_names_that_lead_out(name):
    for data in (_zip((name, NOISE), ("ok", NOISE)), _tar((name, NOISE), ("ok", NOISE))):
        rows = list(unpacked(data))
        assert [(w, c is None) for _, _, _, c, w in rows] == [("escapes the folder", True), (None, False)]


def test_links():
    assert [w for *_, w in unpacked(_zip(("link", b"/etc/passwd"), mode=0o120777))] == ["is a link"]
    assert [w for *_, w in unpacked(_tar(("link", None), ("ok", NOISE)))] == ["is a link", None]


def test_damage():
    data = bytearray(_zip(("a", NOISE), ("b", NOISE), kind=zipfile.ZIP_STORED))
    data[100] ^= 255  # inside a's content
    assert [(e, (w or "")[:10]) for e, _, _, _, w in unpacked(bytes(data))] == [("a", "is damaged"), ("b", "")]
    assert [w for *_, w in unpacked(bytes(data[:3000]))] == ["is damaged: BadZipFile"]
    assert [w for *_, w in unpacked(b"plain text")] == [w for *_, w in unpacked(None)] == [w for *_, w in unpacked(b"")] == ["is no archive"]
    assert list(unpacked(_zip())) == []


def test_archives_of_a_folder(spark, folder):
    for name, data in (("a.zip", _zip(("x", NOISE), ("../y", b"no"))), ("b.tar", _tar(("x", b"b"))), ("c.zip", b"?")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    rows = archives.read_archives(read_files(spark, folder, "binary")).collect()
    got = sorted((r.path.rsplit("/", 1)[1], r.entry or "", r.size, r.refusal or "", bytes(r.content or b"")) for r in rows)
    assert got == [("a.zip", "../y", 2, "escapes the folder", b""), ("a.zip", "x", 20_000, "", NOISE), ("b.tar", "x", 1, "", b"b"), ("c.zip", "", 1, "is no archive", b"")]
