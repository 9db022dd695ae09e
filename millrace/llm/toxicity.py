"""Toxicity by class-conditional Kneser-Ney bigram models.

Counts are Kneser-Ney's continuation counts: a bigram counts by the number of different words before it, a word by the
number of different words that it follows, so copies of a passage add nothing. Each class (toxic, ordinary) has

    P_c(w | v) = max(n_c(v, w) - D2, 0) / n_c(v) + B_c(v) * P_c(w)      B_c(v): the mass that the discounts leave
    P_c(w)     = max(n_c(w) - D1, 0) / n_c + G_c * P_shared(w)          G_c: likewise

so an expression that is rare in a class is smoothed away by its discount, down to counts that both classes share.
Toxic text is ordinary text with some toxic expressions in it, so its model is the mixture (1 - M) P_ordinary + M P_toxic.
A text's evidence is the difference of its log-likelihoods under that mixture and under P_ordinary, divided by its number
of words; a logistic curve turns it into a score.

D1, D2, M and the curve are chosen inside the learning rows: at most SAMPLE_ROWS of them (by a hash of the text) are split in
halves by another hash, each half is scored by the model of the other, and the choice of least logistic loss wins.
The model itself counts all learning rows, in Spark.

Words are numbered by BITS bits of their hashes, so the word tables have 2**BITS entries each. Bigrams are two such numbers;
those that outlast their discount are broadcast in blocks of about BLOCK_PAIRS (12 bytes each), one block at a time,
whose evidences add up: any number of them is used.

Edge cases: null or empty texts have no evidence and get the score of evidence 0; rows without label are not learned
from; labels of an id that disagree count as toxic; no labels give every text 0.5, one class gives its share; equal texts
score alike; texts of any length are scored whole, in one pass of arrays. Columns with a result's name are replaced, no other is touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shared, textnum

BITS = 20
#: Bits of the hash of the word before a bigram.
CONTEXT = 21
#: Candidates of D1, D2 and M.
WORD_DISCOUNTS = (0.75, 2.0, 4.0)
PAIR_DISCOUNTS = (4.0, 16.0)
SHARES = (0.0003, 0.003)
#: Learning rows that choose among them.
SAMPLE_ROWS = 10_000
#: Tasks that score them; they are too few for their files to tell.
HALVES_PARTS = 16
BLOCK_PAIRS = 2_000_000
FIELDS = ["score", "predicted"]
_LOW = np.uint64((1 << BITS) - 1)


def _pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the key of (previous word, word) and the hash of the word before both; and the words before each text.

    The key's low BITS bits number the word, the next BITS bits the previous one; the start of a text is a word too.
    """
    data = textnum.ASCII_LOWER[data]
    starts, ends, counts = textnum.words(data, offsets, textnum.ALNUM)
    h = textnum.word_hashes(data, starts, ends)
    first = counts[:-1][np.diff(counts) > 0]
    one = np.concatenate([[np.uint64(0)], h[:-1]]) if len(h) else h
    one[first] = 0
    two = np.concatenate([[np.uint64(0)], one[:-1]]) if len(h) else h
    two[first] = 0
    key = (one & _LOW) << np.uint64(BITS) | (h & _LOW)
    return key, two, counts


def _contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different (bigram, group, context) of each run of texts, in one number: 2 * BITS bits, 2 bits and CONTEXT bits of a hash."""
    for part in parts:
        grp = part.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        data, offsets = textnum.utf8(part.column(1))
        for i, j in textnum.chunks(offsets):
            key, before, counts = _pairs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            own = grp[i:j][textnum.owners(counts)]
            context = textnum.mix(before) >> np.uint64(64 - CONTEXT)
            seen = np.unique(key << np.uint64(CONTEXT + 2) | own << np.uint64(CONTEXT) | context)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64))], ["x"])


def pair_counts(rows: DataFrame, grp: Column, text: str = "text") -> DataFrame:
    """grp (0 to 3), pair, n: in how many contexts each bigram stands, by group, over all texts."""
    seen = rows.select(grp.cast("int").alias("grp"), F.col(text).alias("text")).mapInArrow(_contexts, "x long").distinct()
    counts = seen.groupBy(F.shiftright("x", CONTEXT).alias("k")).agg(F.count("*").alias("n"))
    return counts.select(F.col("k").bitwiseAND(F.lit(3)).cast("int").alias("grp"), F.shiftright("k", 2).alias("pair"), "n")


def summed(pairs: DataFrame) -> DataFrame:
    """kind, grp, id, n, left0..: of words (kind 0) and of previous words (1) the sums over their bigrams, with the sum of what each discount leaves; and the bigrams that outlast the least discount (2)."""
    mask = F.lit((1 << BITS) - 1)
    word, before = F.col("pair").bitwiseAND(mask), F.shiftright("pair", BITS)
    left = [F.greatest(F.col("n") - int(d), F.lit(0)) for d in PAIR_DISCOUNTS]
    name = lambda kind, at: (F.shiftleft(F.lit(kind).cast("long") * 4 + F.col("grp"), 2 * BITS) + at).alias("k")
    fields = [f"left{k}" for k in range(len(left))]
    row = lambda kind, at, n, more: F.struct(name(kind, at), n.cast("long").alias("n"), *[x.cast("long").alias(f) for x, f in zip(more, fields)])
    one = F.array(row(0, word, F.lit(1), [F.lit(0)] * len(left)), row(1, before, F.col("n"), left))
    each = F.when(F.col("n") > min(PAIR_DISCOUNTS), F.concat(one, F.array(row(2, F.col("pair"), F.col("n"), left)))).otherwise(one)
    sums = pairs.select(F.explode(each).alias("x")).select("x.*").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", *fields)])
    top = F.shiftright("k", 2 * BITS)
    return sums.select(F.shiftright(top, 2).cast("int").alias("kind"), top.bitwiseAND(F.lit(3)).cast("int").alias("grp"), F.col("k").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("id"), "n", *fields)


@dataclass
class Words:
    """The word tables of both classes, ordinary first, of one pair discount; they stay on the driver."""

    word: np.ndarray
    backoff: np.ndarray
    total: np.ndarray


@dataclass
class Ratios:
    """What tasks get: P_toxic / P_ordinary of words and of what discounts leave to a previous word, float32 each."""

    word: np.ndarray
    backoff: np.ndarray


@dataclass
class Pairs:
    """A block of bigrams: sorted keys and P_toxic / P_ordinary of each, for each word discount."""

    keys: np.ndarray
    ratio: list[np.ndarray]


@dataclass
class Model:
    words: Words
    #: Blocks of bigrams are read from this table: id, left of the ordinary class, left of the toxic class.
    pairs: DataFrame | None
    n_pairs: int
    share: float
    slope: float
    offset: float
    chosen: dict = field(default_factory=dict)


def word_tables(sums: DataFrame, groups: tuple[int, int], k: int, discounts: tuple[float, ...]) -> list[Words]:
    """For each word discount, from the rows of `summed`; groups: those of the ordinary and of the toxic class; k: which pair discount."""
    n, size = np.zeros((2, 1 << BITS)), 1 << BITS
    before, left = np.zeros((2, size)), np.zeros((2, size))
    found = sums.filter((F.col("kind") < 2) & F.col("grp").isin(*groups)).select("kind", (F.col("grp") == groups[1]).cast("int").alias("c"), F.col("id").cast("int").alias("id"), F.col("n").cast("double").alias("n"), F.col(f"left{k}").cast("double").alias("left")).toArrow()
    kind, c, i, m, kept = (found[x].to_numpy() for x in ("kind", "c", "id", "n", "left"))
    n[c[kind == 0], i[kind == 0]] = m[kind == 0]
    before[c[kind == 1], i[kind == 1]] = m[kind == 1]
    left[c[kind == 1], i[kind == 1]] = kept[kind == 1]
    pooled = n.sum(axis=0) + 0.5
    pooled /= pooled.sum()
    backoff, total, out = 1 - left / np.maximum(before, 1), np.maximum(before, 1), []
    for discount in discounts:
        own = np.maximum(n - discount, 0) / np.maximum(n.sum(axis=1, keepdims=True), 1)
        out.append(Words(own + (1 - own.sum(axis=1, keepdims=True)) * pooled, backoff, total))
    return out


def ratios_of(words: Words) -> Ratios:
    return Ratios(*((x[1] / x[0]).astype(np.float32) for x in (words.word, words.backoff)))


def _blocks(pairs: DataFrame | None, n_pairs: int, words: list[Words]) -> Iterator[Pairs]:
    """Blocks of the bigrams, by their keys; words: the tables of each word discount."""
    if pairs is None or not n_pairs:
        return
    n = -(-n_pairs // max(1, BLOCK_PAIRS))
    for b in range(n):
        part = pairs if n == 1 else pairs.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == b)
        found = part.toArrow()
        keys = found["id"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        left = np.stack([found[f"c{c}"].to_numpy()[order] for c in (0, 1)])
        w, v = (keys & _LOW).astype(np.int64), (keys >> np.uint64(BITS) & _LOW).astype(np.int64)
        whole = [left / x.total[:, v] + x.backoff[:, v] * x.word[:, w] for x in words]
        yield Pairs(keys, [(p[1] / p[0]).astype(np.float32) for p in whole])


def frequent_pairs(sums: DataFrame, groups: tuple[int, int], k: int) -> DataFrame:
    """id, c0, c1: the bigrams that outlast discount k in some class, with what is left in each."""
    some = sums.filter((F.col("kind") == 2) & F.col("grp").isin(*groups) & (F.col(f"left{k}") > 0))
    left = [F.sum(F.when(F.col("grp") == g, F.col(f"left{k}")).otherwise(0)).cast("double").alias(f"c{c}") for c, g in enumerate(groups)]
    return some.groupBy("id").agg(*left)


def ratios(words: Ratios, pairs: Pairs | None, key: np.ndarray, d: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P_toxic / P_ordinary of each word without the block's bigrams; where bigrams of the block are, and the ratio there; d: which word discount."""
    w, v = (key & _LOW).astype(np.int64), (key >> np.uint64(BITS) & _LOW).astype(np.int64)
    plain = words.backoff[v].astype(np.float64) * words.word[w]
    if pairs is None or not len(pairs.keys):
        return plain, np.zeros(0, np.int64), np.zeros(0)
    at = np.searchsorted(pairs.keys, key)
    at[at == len(pairs.keys)] = 0
    hit = np.flatnonzero(pairs.keys[at] == key)
    return plain, hit, pairs.ratio[d][at[hit]].astype(np.float64)


def evidence_of(share: float, plain: np.ndarray, hit: np.ndarray, found: np.ndarray, more_only: bool = False) -> np.ndarray:
    """The evidence of each word; more_only: what the block's bigrams add to the evidence without them."""
    out = np.log1p(share * (plain - 1))
    told = np.log1p(share * (found - 1))
    if more_only:
        told, out = told - out[hit], np.zeros(len(out))
    out[hit] = told
    return out


def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[counts[1:]] - total[counts[:-1]]) / np.maximum(np.diff(counts), 1)


def _feature(e, share: float):
    return np.sign(e) * np.log1p(np.abs(e) / share)


def choose(sample: DataFrame, text: str, toxic: str) -> dict:
    """The discounts, share, slope and offset of the least logistic loss, each half of the sample scored by the other's model."""
    half = F.pmod(F.xxhash64(F.lit(2), F.col(text)), F.lit(2))
    rows = shared.written(sample.select(F.col(text).alias("text"), (F.col(toxic) == 1).cast("int").alias("y"), half.cast("int").alias("half")).repartition(HALVES_PARTS), "halves")
    sums = shared.written(summed(pair_counts(rows, F.col("half") * 2 + F.col("y"))), "sums")
    spark, best = sample.sparkSession, None
    tried = [(d, share) for d in range(len(WORD_DISCOUNTS)) for share in SHARES]
    for k, discount in enumerate(PAIR_DISCOUNTS):
        models = []
        for other in (1, 0):  # the model that scores half 0 is that of half 1
            groups = other * 2, other * 2 + 1
            words = word_tables(sums, groups, k, WORD_DISCOUNTS)
            # a sample's bigrams are as bounded as the sample, so they are one block
            models.append(([ratios_of(x) for x in words], next(_blocks(frequent_pairs(sums, groups, k), 1, words), None)))
        sent = spark.sparkContext.broadcast(models)

        def work(data: np.ndarray, offsets: np.ndarray, sent=sent) -> list[pa.Array]:
            key, _, counts = _pairs(data, offsets)
            each = []
            for words, pairs in sent.value:
                told = [ratios(x, pairs, key, d) for d, x in enumerate(words)]
                each.append([_per_text(evidence_of(share, *told[d]), counts) for d, share in tried])
            return [pa.FixedSizeListArray.from_arrays(pa.array(np.stack(e, axis=1).ravel()), len(tried)).cast(pa.list_(pa.float64())) for e in each]

        made = rows.withColumn("e", shared.text_udf(work, "e0 array<double>, e1 array<double>")(F.col("text")))
        found = made.select("y", F.when(F.col("half") == 0, F.col("e.e0")).otherwise(F.col("e.e1")).alias("x")).toArrow()
        y = found["y"].to_numpy().astype(float)
        x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(tried))
        for at, (d, share) in enumerate(tried):
            slope, offset, loss = shared.logistic_rows(_feature(x[:, at], share), y)
            if best is None or loss < best["loss"] - 1e-9:
                best = {"place": k, "pair_discount": discount, "word_discount": WORD_DISCOUNTS[d], "share": share, "slope": slope, "offset": offset, "loss": loss, "rows": len(y)}
        sent.destroy()  # its files too
    return best


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic") -> Model:
    """labelled: texts with toxic 0 or 1, all of which count."""
    rows = labelled.filter(F.col(toxic).isNotNull()).select(F.col(text).alias("text"), F.col(toxic).alias("toxic"))
    n = rows.count()
    sample = rows if n <= SAMPLE_ROWS else rows.filter(F.pmod(F.xxhash64(F.lit(1), F.col("text")), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_ROWS / n))
    chosen = choose(sample, "text", "toxic")
    k = chosen["place"]
    sums = shared.written(summed(pair_counts(rows, (F.col("toxic") == 1))), "sums")
    words = word_tables(sums, (0, 1), k, (chosen["word_discount"],))[0]
    pairs = shared.written(frequent_pairs(sums, (0, 1), k), "pairs")
    return Model(words, pairs, pairs.count(), chosen["share"], chosen["slope"], chosen["offset"], chosen)


def evidence(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """docs with the evidence as column `name`: one pass for each block of bigrams, each written before the next is broadcast."""
    spark, share, made = docs.sparkSession, model.share, docs
    blocks = _blocks(model.pairs, model.n_pairs, [model.words])
    first = next(blocks, None)
    sent = None
    for k, block in enumerate([first]) if first is None else enumerate(_chain(first, blocks)):
        if sent is not None:
            made = shared.written(made, "evidence")
            sent.destroy()
        sent = spark.sparkContext.broadcast((ratios_of(model.words), block))

        def work(data: np.ndarray, offsets: np.ndarray, sent=sent, k=k) -> list[pa.Array]:
            key, _, counts = _pairs(data, offsets)
            return [pa.array(_per_text(evidence_of(share, *ratios(*sent.value, key), k > 0), counts))]

        told = shared.text_udf(work, "e double")(F.col(text))["e"]
        made = made.withColumn(name, F.col(name) + told if k else told)
    return made


def _chain(first, rest):
    yield first
    yield from rest


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    docs = shared.without(docs, FIELDS)
    name = shared.free_name(docs, "evidence")
    made = evidence(docs, model, text, name)
    e = F.col(name)
    x = F.signum(e) * F.log1p(F.abs(e) / model.share)
    score = F.lit(1.0) / (1 + F.exp(-(x * model.slope + model.offset)))
    return made.select(*shared.columns(docs), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = shared.crc32_fold(F.col("doc_id"), 5)
    model = fit(shared.with_label(docs.filter(fold != 0), shared.table(spark, sf_dir, "labels"), "toxic"))
    return predict(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")
