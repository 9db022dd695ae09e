"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over a corpus.

A text, with the space that the second vocabulary adds, is encoded by both. In each batch the tokens of each side, keyed
by their document, look up the other side's covering token by an as-of join of their starts; both directions together are
all pairs of tokens that overlap. Offsets where both sides end cut the tokens into groups.

`align` gives each document its groups and its distinct id pairs with how often each is linked. `pair_documents` counts
the documents of each pair over the corpus (summed within a batch and a task before the shuffle), and `scored` gives
each document the counts of its pairs. The counts go to the documents and not the documents to the counts: a table of at
most BLOCK_PAIRS pairs (21 bytes each) is broadcast; where there are more pairs, they are dealt by a hash into blocks of
that size, each block is looked up in a pass of its own, and the passes' sums are added by document. There is no limit on
the pairs, and no pair, however frequent, meets its documents in one task.

Texts longer than a batch are aligned in parts that end where both tokenizers must begin anew, so memory follows the
batch and not the text; what a document returns (groups, pairs) is one value each.

Edge cases: a null or empty text, and a text that either vocabulary doesn't give back byte by byte, has no tokens: zeros
and ''. Strings of special tokens are plain text. Repeated rows and ids are documents of their own, so each counts for
a pair. Ties for an A id's highest count are all best. An empty table gives no rows. Other columns of the documents are
kept; those with a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import piececodes, shared

#: Pairs whose counts are broadcast at once: 21 bytes each, 42 MB.
BLOCK_PAIRS = 2_000_000
#: A text of more bytes is aligned in parts.
PART_BYTES = 1 << 20
#: Pairs that a task gathers before it hands their sums on.
GATHERED = 1_000_000
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
FIELDS = [x.split()[0] for x in ALIGNED.split(", ")]


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1, left-aligned with room for one byte more, and how many each has."""
    words = [str(k).encode() for k in range(n)]
    most = max(map(len, words))
    table = np.frombuffer(b"".join(w.ljust(most + 1) for w in words), np.uint8).reshape(n, most + 1).copy()
    return table, np.array([len(w) for w in words])


def _covering(starts: np.ndarray, docs: np.ndarray, others: np.ndarray, other_docs: np.ndarray) -> np.ndarray:
    """The index of the other side's token that covers each start, by an as-of join keyed by document."""
    left = pd.DataFrame({"at": starts, "doc": docs})
    right = pd.DataFrame({"at": others, "doc": other_docs, "k": np.arange(len(others))})
    return pd.merge_asof(left, right, on="at", by="doc")["k"].to_numpy(np.int64)


def links(a_starts: np.ndarray, a_docs: np.ndarray, b_starts: np.ndarray, b_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose bytes overlap, as indexes of both sides; starts are counted over the whole batch, so they rise."""
    for_a, for_b = _covering(a_starts, a_docs, b_starts, b_docs), _covering(b_starts, b_docs, a_starts, a_docs)
    own = a_starts[for_b] != b_starts  # equal starts are in the other direction already
    return np.concatenate([np.arange(len(a_starts)), for_b[own]]), np.concatenate([for_a, np.flatnonzero(own)])


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary value for each range of an array."""
    width = values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(values.tobytes())])


class _Aligner:
    def __init__(self, a_name: str, b_name: str):
        self.a, self.b = piececodes.byte_level(a_name), piececodes.piece_level(b_name)
        self.n_b = len(self.b.spelt)
        self.digits, self.widths = _decimals(max(len(self.a.spelt), self.n_b))

    def parts(self, data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts with the space before them, cut into parts where both vocabularies cut: the bytes, the parts' offsets and each part's text."""
        filled = np.diff(offsets) > 0
        spaced = np.insert(data, offsets[:-1][filled], 32)
        edges = offsets + np.concatenate([[0], np.cumsum(filled)])
        ends, owner = [], []
        for t in np.flatnonzero(filled).tolist():
            i, j = int(edges[t]), int(edges[t + 1])
            mine = self._cuts(spaced[i:j], most) if j - i > most else []
            ends += [*(i + x for x in mine), j]
            owner += [t] * (len(mine) + 1)
        return spaced, np.array([0, *ends]), np.array(owner, np.int64)

    def _cuts(self, text: np.ndarray, most: int) -> list[int]:
        span = np.array([0, len(text)])
        both = np.intersect1d(self.a.starts(text, span), self.b.starts(text, span))
        picked = [0]
        while len(text) - picked[-1] > most:
            k = max(np.searchsorted(both, picked[-1] + most, "right") - 1, np.searchsorted(both, picked[-1], "right"))
            if k >= len(both):
                break
            picked.append(int(both[k]))
        return picked[1:]

    def batch(self, data: np.ndarray, offsets: np.ndarray, most: int) -> list[pa.Array]:
        n = len(offsets) - 1
        spaced, edges, owner = self.parts(data, offsets, most)
        counts, good = np.zeros((4, n), np.int64), np.ones(n, bool)
        keys, times, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [[] for _ in range(n)]
        k = 0
        while k < len(owner):  # runs of parts of bounded bytes
            j = max(k + 1, int(np.searchsorted(edges, edges[k] + most, "right")) - 1)
            key, time = self._run(spaced[edges[k] : edges[j]], edges[k : j + 1] - edges[k], owner[k:j], good, counts, texts)
            keys.append(key)
            times.append(time)
            k = j
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)  # by document, then pair
        time = np.bincount(inverse, weights=np.concatenate(times), minlength=len(key))
        doc, pair = np.divmod(key, len(self.a.spelt) * self.n_b)
        kept = good[doc]
        at = np.searchsorted(doc[kept], np.arange(n + 1))
        counts[:, ~good] = 0
        groups = [";".join(x) if ok else "" for x, ok in zip(texts, good)]
        return [*(pa.array(c) for c in counts), pa.array(groups, pa.large_string()), _binary(pair[kept].astype("<u4"), at), _binary(time[kept].astype("<u4"), at)]

    def _run(self, data, offsets, owner, good, counts, texts) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of some parts, keyed by document, and how often each is linked; the rest is put where it belongs."""
        (a, a_at, a_same), (b, b_at, b_same) = self.a.codes(data, offsets), self.b.codes(data, offsets)
        same = a_same & b_same
        good[owner[~same]] = False
        a, a_at = _kept(a, a_at, same)
        b, b_at = _kept(b, b_at, same)
        parts = np.arange(len(owner))
        a_part, b_part = np.repeat(parts, np.diff(a_at)), np.repeat(parts, np.diff(b_at))
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        i, j = links(a_ends - self.a.lengths[a], a_part, b_ends - self.b.lengths[b], b_part)
        a_shared, b_shared = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
        for row, found in enumerate((a_part, b_part, a_part[a_shared], a_part[i])):
            counts[row] += np.bincount(owner[found], minlength=counts.shape[1])
        whole, edges = self._groups(a, a_part, a_shared, b, b_part, b_shared, len(parts))
        for p in np.flatnonzero(same):
            texts[owner[p]].append(whole[edges[p] : edges[p + 1]].decode())
        return np.unique((owner[a_part[i]] * len(self.a.spelt) + a[i]) * self.n_b + b[j], return_counts=True)

    def _groups(self, a, a_part, a_shared, b, b_part, b_shared, n) -> tuple[bytes, np.ndarray]:
        """The groups of all parts as text, and where each part's text begins; without the mark after a part's last group."""
        a_group, b_group = (np.cumsum(x) - x for x in (a_shared, b_shared))  # groups that ended before each token
        m = int(a_shared.sum())
        a_many, b_many = np.bincount(a_group, minlength=m), np.bincount(b_group, minlength=m)
        a_place = np.arange(len(a)) + (np.cumsum(b_many) - b_many)[a_group]
        b_place = np.arange(len(b)) + np.cumsum(a_many)[b_group]
        order, part = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
        mark = np.empty(len(order), np.uint8)
        for place, ids, parts, last, ends in ((a_place, a, a_part, a_shared, b"|"), (b_place, b, b_part, b_shared, b";")):
            order[place], part[place] = ids, parts
            mark[place] = np.where(last, ends[0], ord(","))
        widths = self.widths[order] + 1
        final = np.flatnonzero(np.concatenate([part[1:] != part[:-1], [True]])) if len(part) else np.zeros(0, np.int64)
        widths[final] -= 1
        rows = self.digits[order]
        rows[np.arange(len(order)), self.widths[order]] = mark
        whole = rows[np.arange(rows.shape[1]) < widths[:, None]].tobytes()
        return whole, np.concatenate([[0], np.cumsum(np.bincount(part, weights=widths, minlength=n))]).astype(np.int64)


def _kept(ids: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    many = np.diff(at)
    return ids[np.repeat(ok, many)], np.concatenate([[0], np.cumsum(np.where(ok, many, 0))])


_aligners: dict[tuple[str, str], _Aligner] = {}


def alignment(text: Column, a_name: str = piececodes.BYTE_BPE, b_name: str = piececodes.PIECE_BPE, most: int = PART_BYTES) -> Column:
    """struct of ALIGNED: groups as `a1,a2|b1;a3|b2`, pairs as rising 32-bit numbers a * (B's vocabulary) + b, times as 32-bit numbers, little-endian."""

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        if (a_name, b_name) not in _aligners:
            _aligners[a_name, b_name] = _Aligner(a_name, b_name)
        return _aligners[a_name, b_name].batch(data, offsets, most)

    return shared.text_udf(work, ALIGNED)(text)


def align(docs: DataFrame, text: str = "text", a_name: str = piececodes.BYTE_BPE, b_name: str = piececodes.PIECE_BPE) -> DataFrame:
    """The documents with the fields of ALIGNED."""
    return shared.with_fields(docs, alignment(F.col(text), a_name, b_name), FIELDS)


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return key, np.bincount(inverse, weights=np.concatenate([x for _, x in held]), minlength=len(key)).astype(np.int64)

    for part in parts:
        own = part.column(0).cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
        keys = np.frombuffer(own.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view("<u4") if at[-1] > at[0] else np.zeros(0, np.uint32)
        held.append(np.unique(keys, return_counts=True))
        if sum(len(x) for x, _ in held) > GATHERED:
            held = [merged()]
            if len(held[0][0]) > GATHERED // 2:
                yield _pair_batch(*held.pop())
    if held:
        yield _pair_batch(*merged())


def _pair_batch(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])


def pair_documents(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, a, b, n_docs (documents that hold the pair linked), best (no pair of this A id is in more); aligned: pairs. n_b: B's vocabulary."""
    sums = aligned.select("pairs").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs"))
    sums = shared.written(sums.select("pair", F.expr(f"pair div {n_b}").alias("a"), F.pmod("pair", F.lit(n_b)).alias("b"), "n_docs"), "pairs")
    top = sums.groupBy("a").agg(F.max("n_docs").alias("top"))  # a row for each A id at most
    return sums.join(F.broadcast(top), "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def _block(pairs: DataFrame):
    """A block's pairs as sorted arrays."""
    t = pairs.select("pair", "n_docs", "best").toArrow()
    key, n, best = (t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n_docs", "best"))
    order = np.argsort(key)
    return key[order].astype(np.uint32), n[order], best[order]


def _looked_up(aligned: DataFrame, block, kept: list[Column]) -> DataFrame:
    sent = aligned.sparkSession.sparkContext.broadcast(block)

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        key, n, best = sent.value
        for pairs, times in parts:
            best_sums, sums = [], []
            for p, t in zip(pairs, times):
                own, many = np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(t.as_buffer(), "<u4")
                at = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
                found = key[at] == own if len(key) else np.zeros(len(own), bool)
                at, many = at[found], many[found].astype(np.int64)
                best_sums.append(int(many[best[at]].sum()))
                sums.append(int((many * n[at]).sum()))
            yield pa.StructArray.from_arrays([pa.array(best_sums, pa.int64()), pa.array(sums, pa.int64())], ["n_best", "count_sum"])

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    name = shared.free_name(aligned, "sums")
    made = F.arrow_udf(run, "n_best long, count_sum long")(F.col("pairs"), F.col("times")).alias(name)
    return aligned.select(*kept, made).select(*kept, f"{name}.n_best", f"{name}.count_sum")


def scored(aligned: DataFrame, pairs: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The documents with n_best and count_sum, without pairs and times; aligned: a written table with both; pairs: of pair_documents."""
    spark = aligned.sparkSession
    aligned = shared.without(aligned, ["n_best", "count_sum"])
    pairs = shared.written(pairs, "counts")
    if (n := pairs.count()) <= block_pairs:
        return _looked_up(aligned, _block(pairs), shared.columns(aligned.drop("pairs", "times")))
    blocks = -(-5 * n // (4 * block_pairs))  # a hash fills blocks evenly: by 0.8 each, give or take a few thousandths
    path, sums, row = shared.shared_folder(spark, "blocks"), shared.shared_folder(spark, "sums"), shared.free_name(aligned, "row")
    dealt = pairs.withColumn("_block", F.pmod(F.xxhash64("pair"), F.lit(blocks)))
    dealt.write.partitionBy("_block").parquet(path)
    numbered = shared.written(aligned.withColumn(row, F.monotonically_increasing_id()), "numbered")
    for k in range(blocks):
        own = spark.read.schema(dealt.schema).parquet(path).filter(F.col("_block") == k)
        _looked_up(numbered, _block(own), [F.col(row)]).write.parquet(f"{sums}/pass={k}")
    each = spark.read.schema(f"{row} long, n_best long, count_sum long").parquet(sums)
    total = each.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return numbered.drop("pairs", "times").join(total, row).drop(row)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    aligned = shared.written(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times"), "aligned")
    found = scored(aligned, pair_documents(aligned, len(piececodes.piece_level().spelt)))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
