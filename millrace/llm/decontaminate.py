"""Benchmark decontamination: a broadcast hash set of the n-grams of test items, against the word windows of all documents.

Words are runs of letters and digits with A-Z lower-cased. A window is n consecutive words of an item; an item of
fewer words is one window. Document windows are looked up by a 64-bit hash, and every hit is verified by its words.

The set of windows is broadcast in blocks of at most BLOCK_WORDS benchmark words (a stated query set against all
rows). One block needs no shuffle. More are worked one after the other: what a block finds is written (a row for each
different text with a hit, so little), its broadcast is taken back, and the finds of all blocks are joined to the
documents by their texts at the end. So memory is that of one block however large the benchmark is.

Edge cases: null or empty texts have no words and no hits; an item without words has no window; items that repeat a
window are all reported; repeated document rows are judged one by one; a text of any length is scanned whole; an empty
benchmark hits nothing. Columns with a result's name are replaced, no other is touched.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shared, textnum

#: Words of benchmark items in one broadcast block (some 200 bytes each once hashed and listed).
BLOCK_WORDS = 200_000
FIELDS = ["n_words", "n_hit", "n_items", "items", "spans"]
DDL = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>"


class Windows:
    """The windows of a block of items: by their number of words, sorted hashes and the items that own them."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = text.encode().translate(textnum.ASCII_LOWER.tobytes()).translate(_SPACES).split()
            size = min(n, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                found[size][b" ".join(words[k : k + size])].add(item)
        self.by_size = []
        for size, table in sorted(found.items()):
            keys = [*table]
            data = np.frombuffer(b"".join(x + b" " for x in keys), np.uint8)
            starts, ends, counts = textnum.words(data, np.array([0, len(data)]), textnum.ALNUM)
            hashes = textnum.windows(textnum.word_hashes(data, starts, ends), size)[::size]
            order = np.argsort(hashes)
            self.by_size.append((size, hashes[order], {k: sorted(v) for k, v in table.items()}))


_SPACES = bytes(x if textnum.ALNUM[x] else 32 for x in range(256))


def scan(block) -> object:
    """The work of one block on a run of texts; block: a broadcast of Windows."""

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        data = textnum.ASCII_LOWER[data]
        starts, ends, counts = textnum.words(data, offsets, textnum.ALNUM)
        hashes = textnum.word_hashes(data, starts, ends)
        raw = data.tobytes()
        n, hit = len(offsets) - 1, np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for size, known, table in block.value.by_size:
            keys = textnum.windows(hashes, size)
            if not len(keys):
                continue
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            for k in np.flatnonzero((known[at] == keys) & textnum.whole(counts, size)):
                own = table.get(b" ".join(raw[starts[j] : ends[j]] for j in range(k, k + size)))
                if own:
                    hit[k] += 1
                    hit[k + size] -= 1
                    items[int(np.searchsorted(counts, k, "right")) - 1].update(own)
        inside = np.cumsum(hit[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(inside)])
        n_hit = total[counts[1:]] - total[counts[:-1]]
        names = [sorted(items[i]) if i in items else [] for i in range(n)]
        spans: list[list[dict]] = [[] for _ in range(n)]
        for i in np.flatnonzero(n_hit):
            spans[i] = _runs(raw, offsets[i], starts[counts[i] : counts[i + 1]], ends[counts[i] : counts[i + 1]], inside[counts[i] : counts[i + 1]])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(np.diff(counts)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, kind)]

    return work


def _runs(raw: bytes, base: int, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the text, from the first word's start to the last word's end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    out, seen, chars = [], int(base), 0
    for a, b in zip(edge[::2], edge[1::2]):
        place = []
        for byte in (int(starts[a]), int(ends[b - 1])):
            chars += len(raw[seen:byte].decode("utf-8", "replace"))
            seen = byte
            place.append(chars)
        out.append({"start": place[0], "end": place[1]})
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, n: int, block_words: int = BLOCK_WORDS):
    """Windows of bounded parts of the items, one part in the driver's memory at a time."""
    rows, words, given = [], 0, False
    for r in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).filter("t is not null").toLocalIterator():
        rows.append((r.i, r.t))
        words += len(r.t) // 4 + 1
        if words >= block_words:
            yield Windows(rows, n)
            rows, words, given = [], 0, True
    if rows or not given:
        yield Windows(rows, n)


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (ids as sorted strings) and spans (code points of runs of hit words)."""
    spark = docs.sparkSession
    docs = shared.without(docs, FIELDS)
    each = blocks(items, item_id, item_text, n, block_words)
    first = next(each)
    second = next(each, None)
    sent = spark.sparkContext.broadcast(first)
    if second is None:
        return shared.with_fields(docs, shared.text_udf(scan(sent), DDL)(F.col(text)), FIELDS)
    found = [_finds(docs, sent, text)]
    while second is not None:
        sent.unpersist()
        sent = spark.sparkContext.broadcast(second)
        found.append(_finds(docs, sent, text))
        second = next(each, None)
    sent.unpersist()
    return _joined(docs, found, text)


def _text_key(text: Column) -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(F.lit(1), text).alias("x"), F.xxhash64(F.lit(2), text, F.lit(3)).alias("y"))


def _finds(docs: DataFrame, block, text: str) -> DataFrame:
    """key, items, spans of each different text with a hit in the block."""
    made = docs.select(_text_key(F.col(text)).alias("key"), shared.text_udf(scan(block), DDL)(F.col(text)).alias("m")).filter("m.n_hit > 0")
    return shared.written(made.select("key", "m.items", "m.spans").dropDuplicates(["key"]), "hits")


def _joined(docs: DataFrame, found: list[DataFrame], text: str) -> DataFrame:
    """docs with the finds of all blocks."""
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    merged = hits.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"))
    key, hit = shared.free_name(docs, "key"), shared.free_name(docs, "hit")
    merged = shared.written(merged.select(F.col("key").alias(key), F.struct("items", "spans").alias(hit)), "hits")
    made = docs.withColumn(key, _text_key(F.col(text))).join(merged, key, "left")
    items = F.coalesce(F.col(hit)["items"], F.expr("cast(array() as array<string>)"))
    spans = F.coalesce(F.col(hit)["spans"], F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))
    inside = F.array_join(F.transform(spans, lambda s: F.substring(F.col(text), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), " ")
    count = shared.text_udf(_count, "n long")
    fields = {"n_words": count(F.col(text))["n"], "n_hit": count(inside)["n"], "n_items": F.size(items).cast("long"), "items": items, "spans": spans}
    return made.select(*shared.columns(docs), *[c.alias(f) for f, c in fields.items()])


def _count(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.diff(textnum.words(textnum.ASCII_LOWER[data], offsets, textnum.ALNUM)[2]))]


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap made one."""
    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), step)


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text", drop_share: float = 0.5, **more) -> DataFrame:
    """docs without benchmark passages: a document of which more than drop_share of the words are hit goes, others lose the hit spans (a space stands for each)."""
    found = contamination(docs.select(*[c.alias(f"_own{k}") for k, c in enumerate(shared.columns(docs))], F.col(text)), items, n, text, **more)
    kept = found.filter(F.col("n_hit") <= drop_share * F.col("n_words"))
    rest = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(" ")).alias("out"), x["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(text))),
    )
    clean = F.when(F.size("spans") > 0, rest).otherwise(F.col(text))
    return kept.select(*[clean.alias(c) if c == text else F.col(f"_own{k}").alias(c) for k, c in enumerate(docs.columns)])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, shared.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
