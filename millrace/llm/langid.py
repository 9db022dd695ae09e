"""Language identification: multinomial naive Bayes over hashed character trigrams.

Texts are lower-cased, all but letters becomes single spaces, and each trigram falls into one of BUCKETS buckets.
Counts by language and bucket are summed within tasks, then across them; the log-probability matrix
(languages x buckets, so bounded by the parameter) is broadcast, and texts are scored in numpy.

Edge cases: a null text or one without a letter is `und` with score 0; rows without lang or id are not learned from;
with nothing learned (as of an empty table) every text is `und`. Languages that tie are taken in alphabetical order. Repeated
rows are learned from and predicted each. A text of any length is counted whole, in memory that follows the text. More than
MAX_LANGUAGES languages raise ValueError, as the matrix is broadcast. Columns with a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shared, textnum

BUCKETS = 1 << 15
MAX_LANGUAGES = 1024
FIELDS = ["lang_pred", "score"]
_TABLES: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or a space; letters beyond stand for themselves."""
    if not _TABLES:
        table = np.full(0x10000, 32, np.uint32)
        for c in range(0x10000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(table)
    return _TABLES[0]


def trigrams(data: np.ndarray, offsets: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every trigram, and the trigrams before each text (n + 1 numbers); a text without a letter has none."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    table = _folded()
    folded = table[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        folded[points == c] = c if chr(c).isalpha() else 32
    padded = np.insert(folded, before, 32)  # a space before each text and after the last
    begins = before + np.arange(n + 1)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    keep[begins] = True
    fill = np.zeros(len(padded), bool)
    fill[begins[:-1] + 1] = True
    keep &= ~(fill & (padded == 32)) | np.isin(np.arange(len(padded)), begins)
    at = np.concatenate([[0], np.cumsum(keep)])
    line, first = padded[keep].astype(np.uint64), at[begins]
    if len(line) < 3:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    h = textnum.mix((line[:-2] << np.uint64(42)) ^ (line[1:-1] << np.uint64(21)) ^ line[2:])
    own = np.ones(len(h), bool)
    own[first[1:-1] - 1] = False  # a trigram may end in the next text's space, but not begin at the last letter
    middle = line[1:-1] == 32
    own &= ~(middle & (line[:-2] == 32))
    total = np.concatenate([[0], np.cumsum(own)])
    return (h[own] % np.uint64(n_buckets)).astype(np.int64), total[np.minimum(first, len(h))]


def counts_by_language(docs: DataFrame, text: str, lang: str, n_buckets: int) -> DataFrame:
    """lang, bucket, n; bucket -1 has the number of documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for name, c in seen.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at - 1, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])
            seen.clear()

        for part in parts:
            names = part.column(0).to_pylist()
            data, offsets = textnum.utf8(part.column(1))
            for i, j in textnum.chunks(offsets):
                grams, edges = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n_buckets)
                index = {x: k for k, x in enumerate(dict.fromkeys(names[i:j]))}
                code = np.array([index[x] for x in names[i:j]])
                of = np.repeat(code, np.diff(edges))
                for name, k in index.items():
                    own = seen.setdefault(name, np.zeros(n_buckets + 1, np.int64))
                    own[0] += int((code == k).sum())
                    own[1:] += np.bincount(grams[of == k], minlength=n_buckets)
            if len(seen) > 64:
                yield from rows()
        yield from rows()

    made = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, bucket int, n long")
    return made.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", n_buckets: int = BUCKETS, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """The languages in alphabetical order, and for each its log prior and log probabilities of the buckets."""
    counts = counts_by_language(docs.filter(F.col(lang).isNotNull()), text, lang, n_buckets)
    counts = shared.written(counts, "trigrams")
    names = sorted(r.lang for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    matrix = np.zeros((len(names), n_buckets + 1))
    found = counts.toArrow()
    row = np.searchsorted(np.array(names, object), np.array(found["lang"].to_pylist(), object)) if names else []
    if names:
        matrix[row, found["bucket"].to_numpy() + 1] = found["n"].to_numpy()
        matrix[:, 0] /= max(1.0, matrix[:, 0].sum())
        matrix[:, 1:] += smoothing
        matrix[:, 1:] /= matrix[:, 1:].sum(axis=1, keepdims=True)
    return names, np.log(np.maximum(matrix, 1e-300)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior probability of that language."""
    names, matrix = model
    n_buckets = matrix.shape[1] - 1
    sent = docs.sparkSession.sparkContext.broadcast(matrix)

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        grams, edges = trigrams(data, offsets, n_buckets)
        n = len(offsets) - 1
        if not names:
            return [pa.array(["und"] * n), pa.array(np.zeros(n))]
        total = np.empty((len(names), n))
        for k, logs in enumerate(sent.value):
            run = np.concatenate([[0.0], np.cumsum(logs[1:][grams], dtype=np.float64)])
            total[k] = logs[0] + run[edges[1:]] - run[edges[:-1]]
        best = total.argmax(axis=0)
        some = np.diff(edges) > 0
        posterior = 1 / np.exp(np.minimum(total - total.max(axis=0), 0)).sum(axis=0)
        return [pa.array(np.where(some, np.array(names, object)[best], "und").tolist(), pa.string()), pa.array(np.where(some, posterior, 0.0))]

    return shared.with_fields(docs, shared.text_udf(work, "lang_pred string, score double")(F.col(text)), FIELDS)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = shared.crc32_fold(F.col("doc_id"), 4)
    model = fit(docs.filter(fold != 2))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
