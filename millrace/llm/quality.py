"""Quality rules: plain counts of words and lines, and compression bands.

A text is compressed with zstandard whole and in chunks of a fixed size (the rest is a chunk too, if it has LEAST_CHUNK
bytes). Each ratio (bytes before over bytes after) must lie in a band that depends on the length of what was compressed:
repetitive or decorated text lies above it, incompressible text (encoded or random) below.

The bands are learned from all distinct labelled good texts: for each half octave
of length the median ratio, and above and below it, by octave, WIDE times the distance from the median line to the
quantiles EDGE and 1 - EDGE of its texts. Quantiles are read off counts of ratios in steps of GRAIN, so that what reaches the driver is bounded by the
steps that occur, whatever the number of texts. An octave of fewer than LEAST_ROWS texts takes the plain limits of WHOLE, which
fit ordinary prose. Letters of two or three bytes hold more bytes for the same words, so upper limits grow with the bytes a
code point beyond those of the learning rows.

Edge cases: a null or empty text has no words and fails the base rules. Repeated rows are judged one by one; a ratio on
a limit is inside. A very long text is one compression and its chunks, in bounded memory. Without good texts the plain limits
hold. Columns of the input that have a result's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared, textnum

#: Bytes of a code point after its first.
REST = bytes(range(0x80, 0xC0))
WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "zstd_ratio", "n_chunks", "n_odd_chunks", "base_failed", "kept"]


#: Plain limits of the ratio by the least length in bytes; a text takes the last row that it reaches.
WHOLE = (
    (0, 0.4, 1.2), (64, 0.7, 1.7), (128, 0.9, 2.4), (256, 1.1, 2.4), (512, 1.2, 2.4), (1024, 1.3, 2.6),
    (2048, 1.35, 2.7), (4096, 1.4, 2.8), (8192, 1.4, 2.9), (16384, 1.4, 3.2), (65536, 1.4, 3.6),
)
#: The steps in which ratios (by their logarithm to 2: 0.017 %) and distances from the median line are counted.
GRAIN = 1 / 4096
LEAST_ROWS = 40
EDGE, WIDE = 0.002, 1.3
LEAST_CHUNK = 512
#: The distance of neighbouring knots, in octaves.
STEP = 0.5


@dataclass(frozen=True)
class Bands:
    """Limits by half octaves of the length: lows and highs at knots; between neighbouring ones they are read off a line."""

    #: log2 of lengths, and the limits there. Lengths further than half a step from a knot, and not between neighbours, have the plain limits.
    knots: tuple[float, ...] = ()
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()
    chunk_bytes: int = 4096
    #: More than this share of chunks outside the band, and more than one, rejects the text.
    odd_share: float = 0.25
    level: int = 3
    #: Upper limits grow by so much for each byte that code points have beyond so many on average.
    wide: tuple[float, float] = (0.4, 1.2)

    def limits(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest ratio for lengths in bytes."""
        row = np.searchsorted([x[0] for x in WHOLE], sizes, "right") - 1
        low, high = np.array([x[1] for x in WHOLE])[row], np.array([x[2] for x in WHOLE])[row]
        if not self.knots:
            return low, high
        at, knots = np.log2(np.maximum(sizes, 1)), np.array(self.knots)
        left = np.clip(np.searchsorted(knots, at, "right") - 1, 0, len(knots) - 1)
        right = np.minimum(left + 1, len(knots) - 1)
        between = (at >= knots[left]) & (at <= knots[right]) & (knots[right] - knots[left] <= STEP)
        near = np.where(np.abs(at - knots[left]) <= np.abs(at - knots[right]), left, right)
        known = between | (np.abs(at - knots[near]) <= STEP / 2)
        learned = [np.where(between, np.interp(at, knots, x), np.array(x)[near]) for x in (self.low, self.high)]
        return np.where(known, learned[0], low), np.where(known, learned[1], high)


@dataclass(frozen=True)
class Base:
    """Plain limits: too few words, or too large a share of them in runs that occur again."""

    least_words: int = 20
    run: int = 8
    repeat_share: float = 0.3


def repeated_words(hashes: np.ndarray, counts: np.ndarray, run: int) -> np.ndarray:
    """For each text, how many of its words lie in a run of words that occurs twice or more in it."""
    n_texts = len(counts) - 1
    keys = textnum.windows(hashes, run)
    at = np.flatnonzero(textnum.whole(counts, run)[: len(keys)])
    text = np.searchsorted(counts, at, "right") - 1
    keys = textnum.mix(keys[at] ^ textnum.mix(text.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + run, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[counts[1:]] - covered[counts[:-1]] if n_texts else np.zeros(0, np.int64)


def _compressor(state: dict, bands: Bands):
    import zstandard

    return state.get("z") or state.setdefault("z", zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False))


def quantile(steps: np.ndarray, counts: np.ndarray, share: float) -> float:
    """The quantile, between neighbours by a line as numpy has it, of values in rising steps that stand so often."""
    ends = np.cumsum(counts)
    at = share * (ends[-1] - 1)
    low, high = (float(steps[np.searchsorted(ends, x, "right")]) for x in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


def fit_bands(good: DataFrame, text: str = "text", bands: Bands = Bands()) -> Bands:
    """The bands of good texts, each distinct one counted once."""
    state: dict = {}

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        raw, z = data.tobytes(), _compressor(state, bands)
        texts = [raw[i:j] for i, j in zip(offsets[:-1], offsets[1:])]
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) / len(z.compress(t)) if t else 1.0 for t in texts])]

    some = good.filter(F.length(text) > 0).select(F.xxhash64(F.lit(3), text).alias("h"), F.xxhash64(F.lit(4), text).alias("i"), shared.text_udf(work, "size long, ratio double")(F.col(text)).alias("m"))
    one = some.select("h", "i", "m.*").groupBy("h", "i", "size").agg(F.min("ratio").alias("ratio"))  # equal texts have equal ratios
    rows = shared.written(one.select(F.log2("size").alias("at"), "ratio"), "ratios")

    def counted(value: Column, knots: np.ndarray, width: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Steps of value, rising, and their counts, of the texts within width of each knot: sums over the rows, of which the driver gets the steps that occur."""
        near = F.filter(F.array(*[F.lit(float(k)) for k in knots]), lambda k: F.abs(F.col("at") - k) <= width)
        found = rows.select(F.explode(near).alias("knot"), value.alias("step")).groupBy("knot", "step").agg(F.count("*").alias("n")).toArrow()
        knot, step, n = (found[c].to_numpy() for c in ("knot", "step", "n"))
        order = np.argsort(step, kind="stable")
        own = [order[knot[order] == k] for k in knots]
        return [(step[x], n[x]) for x in own]

    n, first, last = rows.agg(F.count("*"), F.min("at"), F.max("at")).first()
    if n < LEAST_ROWS:
        return bands
    knots = np.arange(np.floor(first * 2) / 2, last + STEP, STEP)
    near = counted(F.rint(F.log2("ratio") / GRAIN), knots, STEP / 2)
    own = np.array([c.sum() >= LEAST_ROWS // 4 for _, c in near])
    if own.sum() < 2:
        return bands
    knots, middle = knots[own], np.array([2 ** (quantile(x, c, 0.5) * GRAIN) for (x, c), o in zip(near, own) if o])
    low, high = np.full(len(knots), np.nan), np.full(len(knots), np.nan)
    for i, (x, c) in enumerate(counted(F.rint((F.col("ratio") - _line(knots, middle)) / GRAIN), knots, 0.5)):
        if c.sum() >= LEAST_ROWS:
            down, up = quantile(x, c, EDGE) * GRAIN, quantile(x, c, 1 - EDGE) * GRAIN
            low[i], high[i] = middle[i] + WIDE * down, middle[i] + WIDE * up
    told = ~np.isnan(low)
    if not told.any():
        return bands
    return replace(bands, knots=tuple(map(float, knots[told])), low=tuple(map(float, low[told])), high=tuple(map(float, high[told])))


def _line(knots: np.ndarray, values: np.ndarray) -> Column:
    """The values at knots, and between them by a line, of the column at; the first and last value hold beyond."""
    out, at = F.lit(float(values[-1])), F.col("at")
    for k in range(len(knots) - 2, -1, -1):
        slope = float((values[k + 1] - values[k]) / (knots[k + 1] - knots[k]))
        out = F.when(at < float(knots[k + 1]), float(values[k]) + (at - float(knots[k])) * slope).otherwise(out)
    return F.when(at < float(knots[0]), float(values[0])).otherwise(out)


def good_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the labels call good."""
    return shared.with_label(docs.select("doc_id", "text"), labels.select("doc_id", (1 - F.col("quality")).alias("poor")), "poor").filter("poor = 0").select("text")


def measure(bands: Bands, base: Base):
    """The work of quality_columns on one run of texts."""
    state: dict = {}

    def room(text: bytes) -> float:
        """What the upper limits are multiplied by."""
        return 1 + bands.wide[0] * max(0.0, len(text) / max(len(text.translate(None, REST)), 1) - bands.wide[1])

    def ratios(text: bytes) -> tuple[float, int, int]:
        if not text:
            return 1.0, 0, 0
        z = _compressor(state, bands)
        size = bands.chunk_bytes
        chunks = [text[k : k + size] for k in range(0, len(text), size)] if len(text) > size else []
        chunks = [c for c in chunks if len(c) >= LEAST_CHUNK]
        if not chunks:
            return len(text) / len(z.compress(text)), 0, 0
        found = np.array([len(c) / len(z.compress(c)) for c in chunks])
        low, high = bands.limits(np.array([len(c) for c in chunks]))
        odd = (found < low) | (found > high * np.array([room(c) for c in chunks]))
        return len(text) / len(z.compress(text)), len(chunks), int(odd.sum())

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        starts, ends, counts = textnum.words(data, offsets, textnum.SPACED)
        n_words = np.diff(counts)
        repeats = repeated_words(textnum.word_hashes(data, starts, ends), counts, base.run)
        raw, n = data.tobytes(), len(offsets) - 1
        chars, symbols, dup = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        ratio, n_chunks, n_odd, more = np.ones(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n)
        for k in range(n):
            text = raw[offsets[k] : offsets[k + 1]]
            solid = text.translate(None, WHITE)
            chars[k] = len(solid.decode("utf-8", "replace"))
            symbols[k] = len(text) - len(text.translate(None, SYMBOLS))
            lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
            dup[k] = len(lines) - len(set(lines))
            ratio[k], n_chunks[k], n_odd[k] = ratios(text)
            more[k] = room(text)
        low, high = bands.limits(np.diff(offsets))
        failed = (n_words < base.least_words) | (repeats > base.repeat_share * n_words)
        fits = (ratio >= low) & (ratio <= high * more) & ((n_odd < 2) | (n_odd <= bands.odd_share * n_chunks))
        return [pa.array(x) for x in (n_words, chars, symbols, dup, repeats, ratio, n_chunks, n_odd, failed, fits & ~failed)]

    return work


def quality_columns(docs: DataFrame, text: str = "text", bands: Bands = Bands(), base: Base = Base()) -> DataFrame:
    """docs with the counts, the ratios and the verdicts (base_failed, kept) as further columns."""
    ddl = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, n_chunks long, n_odd_chunks long, base_failed boolean, kept boolean"
    return shared.with_fields(docs, shared.text_udf(measure(bands, base), ddl)(F.col(text)), FIELDS)


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = Bands(), base: Base = Base()) -> DataFrame:
    """The rows of docs that pass, with their own columns."""
    ddl = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, n_chunks long, n_odd_chunks long, base_failed boolean, kept boolean"
    name = shared.free_name(docs, "quality")
    made = docs.withColumn(name, shared.text_udf(measure(bands, base), ddl)(F.col(text)))
    return made.filter(f"{name}.kept").select(*shared.columns(docs))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    bands = fit_bands(good_texts(docs, shared.table(spark, sf_dir, "labels")))
    return quality_columns(docs, bands=bands).drop("text")
