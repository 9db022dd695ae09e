"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a single longer text is its own chunk.
CHUNK_BYTES = 1 << 20

_R = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def byte_class(separators: bytes) -> np.ndarray:
    """A table of 256 booleans: whether a byte belongs to a word."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: Words are runs without white space: [^\x20\x09-\x0D]+.
SPACED = byte_class(bytes([32, *range(9, 14)]))
#: Words are runs of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z.
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets of the texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, at, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _R, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words stand before each text (n + 1 numbers)."""
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word, from its bytes only; the same on every machine."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """64 bits for each run of n words; some runs cross texts, which `whole` tells."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * _R + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def whole(counts: np.ndarray, n: int) -> np.ndarray:
    """For each run of n words, whether it lies in one text; counts: words before each text."""
    total = int(counts[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for edge in np.unique(counts[1:-1]):
        ok[max(0, edge - n + 1) : edge] = False
    return ok


def owners(counts: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))
