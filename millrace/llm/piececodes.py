"""Token ids of many texts at once, as numpy arrays, by public vocabulary files.

The byte-level vocabulary file is read by `tokenizers`; where its merges are in the order of their ids (as in the files
that are installed), tiktoken merges by the same table, six times as fast and with the same ids; else `tokenizers` does. Of
the other vocabulary each distinct piece is encoded once a worker: texts are cut where no token can cross, most of a corpus
is a few words again and again, and the ids of a run of texts are gathered by numpy. Where a cut isn't provably safe there
is none, so ids are always those of whole texts.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Callable

import numpy as np

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How byte-level vocabularies cut texts before they merge bytes (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and bytes of pieces that a worker remembers; beyond that it keeps the most frequent half.
MOST_PIECES, MOST_BYTES = 400_000, 32 << 20
#: First bytes of white space beyond ASCII: U+0085, U+00A0; U+1680, U+180E; U+2000 to U+205F; U+3000.
_WIDE_SPACE = [0xC2, 0xE1, 0xE2, 0xE3]

_PLAIN = np.ones(256, bool)
_PLAIN[[*range(9, 14), *range(28, 33), *_WIDE_SPACE]] = False


def place(name: str) -> str:
    """A vocabulary file: a path, or a file's name among the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of all ranges, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = _PLAIN & (np.arange(256) < 127) & ~_LETTER
_MARK[[*range(48, 58), 39]] = False


def before_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where byte-level BPE begins a word: a space followed by a byte of the same text that is surely no white space, or a punctuation mark (but an apostrophe) after a letter."""
    cut = np.zeros(len(data), bool)
    cut[:-1] = (data[:-1] == 32) & _PLAIN[data[1:]]
    cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    cut[ends] = False
    return cut


def before_spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first of each run of spaces: no piece of the vocabulary goes on into one."""
    cut = data == 32
    cut[1:] &= data[:-1] != 32
    return cut


class _Numbers(dict):
    """Numbers pieces as they are first asked for, in order."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class PieceCodes:
    """Ids of pieces, remembered; encode gives the ids of some pieces in a row and how many each has, spelt the bytes of each id."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], spelt: list[bytes], cuts: Callable[[np.ndarray, np.ndarray], np.ndarray], uncut: tuple[bytes, ...] = ()):
        self.encode, self.spelt, self.cuts, self.uncut = encode, spelt, cuts, uncut
        self.lengths = np.array([len(x) for x in spelt], np.int64)
        self.number, self.bytes = _Numbers(), 0
        self.ids, self.at, self.same, self.seen = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def _learn(self) -> None:
        new, self.number.new = self.number.new, []
        ids, many = self.encode(new)
        self.bytes += sum(map(len, new))
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(many)])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        spelt = list(map(self.spelt.__getitem__, ids.tolist()))
        if (np.cumsum(self.lengths[ids])[np.cumsum(many) - 1] == np.cumsum([len(p) for p in new])).all() and many.all() and b"".join(spelt) == b"".join(new):
            same = np.ones(len(new), bool)
        else:
            parts = iter(spelt)
            same = np.fromiter((b"".join(itertools.islice(parts, n)) == p for p, n in zip(new, many.tolist())), bool, len(new))
        self.same = np.concatenate([self.same, same])

    def _forget(self) -> None:
        """Keeps the half that was asked for most often, and of those what was asked for again."""
        most = np.sort(np.argsort(-self.seen, kind="stable")[: max(1, len(self.number) // 2)])
        kept = most[self.seen[most] > 1]
        pieces = list(self.number)
        many = self.at[kept + 1] - self.at[kept]
        self.ids, self.at = self.ids[spread(self.at[kept], many)], np.concatenate([[0], np.cumsum(many)])
        self.same, self.seen = self.same[kept], self.seen[kept] // 2
        self.number = _Numbers()
        self.number.update(zip([pieces[k] for k in kept.tolist()], range(len(kept))))
        self.bytes = sum(map(len, self.number))

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start; texts that hold one of `uncut` are one piece."""
        cut = self.cuts(data, offsets)
        raw = data.tobytes() if self.uncut else b""
        for word in self.uncut:
            k = raw.find(word)
            while k >= 0:
                t = int(np.searchsorted(offsets, k, "right")) - 1
                cut[offsets[t] : offsets[t + 1]] = False
                k = raw.find(word, int(offsets[t + 1]))
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in a row, the n + 1 offsets of the texts among them, and whether each text's ids spell its bytes."""
        if len(self.number) > MOST_PIECES or self.bytes > MOST_BYTES:
            self._forget()
        starts = self.starts(data, offsets)
        raw, edges = data.tobytes(), [*starts.tolist(), len(data)]
        pieces = [raw[i:j] for i, j in zip(edges[:-1], edges[1:])]
        number = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        if self.number.new:
            self._learn()
        self.seen += np.bincount(number, minlength=len(self.seen))
        lengths = self.at[number + 1] - self.at[number]
        ids = self.ids[spread(self.at[number], lengths)]
        first = np.searchsorted(starts, offsets)
        tokens, odd = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(~self.same[number])])
        at = tokens[first]
        same = odd[first[1:]] == odd[first[:-1]]
        for t in np.flatnonzero(~same):  # pieces that differ could still join to the same bytes
            same[t] = b"".join([self.spelt[i] for i in ids[at[t] : at[t + 1]]]) == raw[offsets[t] : offsets[t + 1]]
        return ids, at, same


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the others for U+0100 and on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteCodes:
    """Ids of whole texts by a byte-level vocabulary; special: the strings of special tokens inside texts are such tokens, else plain text."""

    def __init__(self, path: str, special: bool):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = not special
        letters = _byte_letters()
        own = {x.content: k for k, x in t.get_added_tokens_decoder().items()}
        self.spelt = [bytes(letters[c] for c in x) if (x := t.id_to_token(k) or "") not in own else x.encode() for k in range(t.get_vocab_size())]
        self.lengths = np.array([len(x) for x in self.spelt], np.int64)
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if [t.token_to_id(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs))):
            ranks = {x: k for k, x in enumerate(self.spelt[: 256 + len(pairs)])}
            fast = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=own if special else {})
            self._ids = lambda text: fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        else:
            self._ids = lambda text: np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where texts may be cut without a change of ids, if no special token is looked for."""
        cut = before_words(data, offsets)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in a row, the n + 1 offsets of the texts among them, and whether each text's ids spell its bytes."""
        raw = data.tobytes()
        found = [self._ids(raw[i:j].decode("utf-8", "replace")) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        ids = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        spelt = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        same = spelt[at[1:]] - spelt[at[:-1]] == np.diff(offsets)  # every byte has an id, so only what isn't UTF-8 is changed
        return ids, at, same


@functools.cache
def byte_level(name: str = BYTE_BPE, special: bool = False) -> ByteCodes:
    return ByteCodes(place(name), special)


@functools.cache
def piece_level(name: str = PIECE_BPE) -> PieceCodes:
    """A sentencepiece vocabulary with byte fallback; texts begin with the space that it adds of itself."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=place(name))
    mark = "▁"
    names = [s.id_to_piece(k) for k in range(s.get_piece_size())]
    spelt = [bytes([int(x[3:5], 16)]) if s.is_byte(k) else x.replace(mark, " ").encode() for k, x in enumerate(names)]
    crossing = any(mark in x.lstrip(mark) for k, x in enumerate(names) if not s.is_byte(k))

    lone = [s.piece_to_id(mark)]  # a space at a text's end; alone it would be an empty text

    def whole(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.zeros(len(data), bool)

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = [lone if p == b" " else x for p, x in zip(pieces, s.encode([p[1:].decode() for p in pieces], num_threads=1))]
        return np.fromiter(itertools.chain.from_iterable(made), np.int32), np.array([len(x) for x in made], np.int64)

    return PieceCodes(encode, spelt, whole if crossing else before_spaces, (mark.encode(),))
