"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded.

A document's tokens (with the end token) are cut into as many pieces of MOST tokens as they fill, and the rest into
pieces of the powers of two that its length is the sum of, the longest first. Each piece is a sequence of its own,
and sequences of one length make a bucket: a folder of the written table, from which batches of equal length, and so of
an equal number of tokens, are drawn (`batches`).

Texts are encoded in Arrow batches of bounded bytes; a document's pieces leave the worker as a list, so no row holds
more than its own document. The rows are rebalanced by length, so a bucket, however large, is written by as many
tasks as its size asks for (AQE splits large and joins small partitions), into few files.

Edge cases: a null or empty text has only the end token: one sequence of length 1. A text of any length is encoded whole
and its pieces lie in one list. Repeated rows and repeated ids are documents of their own. An empty table gives no rows.
Null ids stay null. Strings of special tokens inside texts become those tokens, as the vocabulary's own default has it.
Other columns of the documents but the text are kept; those with a result's name are replaced.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import piececodes, shared

#: The longest sequence, in tokens: a power of two.
MOST = 2048
END_ID = 1
RESULTS = ["doc_tokens", "start", "length", "ids", "sequence_id", "offset"]
#: Sequences of a bucket are numbered in so many slices at a time.
SLICES = 64


def cut(lengths: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """For documents of so many tokens: how many pieces each has, and the pieces' lengths, one document after the other."""
    bits = most >> np.arange(most.bit_length())
    many = np.concatenate([(lengths // most)[:, None], (lengths[:, None] // bits[1:]) & 1], axis=1)
    return many.sum(axis=1), np.repeat(np.tile(bits, len(lengths)), many.ravel())


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more at the end of each document, and the new offsets."""
    n = len(at) - 1
    out, edges = np.full(len(ids) + n, end, np.int32), at + np.arange(n + 1)
    held = np.ones(len(out), bool)
    held[edges[1:] - 1] = False
    out[held] = ids
    return out, edges


@functools.cache
def id_bytes(vocabulary: str = piececodes.BYTE_BPE) -> int:
    """2 where all ids of the vocabulary, and the end's, fit into two bytes, else 4."""
    return 2 if len(piececodes.byte_level(vocabulary, special=True).spelt) <= 1 << 16 else 4


def pieces(text: Column, most: int = MOST, end: int = END_ID, vocabulary: str = piececodes.BYTE_BPE) -> Column:
    """struct(doc_tokens, pieces array<struct<start, length, ids>>) of a text column; ids: unsigned numbers of id_bytes each, little-endian."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        ids, at, _ = piececodes.byte_level(vocabulary, special=True).codes(data, offsets)
        ids, at = with_end(ids, at, end)
        many, lengths = cut(np.diff(at), most)
        ends = np.cumsum(lengths)
        first = np.concatenate([[0], np.cumsum(many)])
        starts = ends - lengths - np.repeat(at[:-1], many)
        width = id_bytes(vocabulary)
        own = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((width * np.concatenate([[0], ends])).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))])
        rows = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), own], ["start", "length", "ids"])
        return [pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows)]

    return shared.text_udf(work, "doc_tokens long, pieces array<struct<start:bigint,length:bigint,ids:binary>>")(text)


def sequences(docs: DataFrame, text: str = "text", most: int = MOST, end: int = END_ID, vocabulary: str = piececodes.BYTE_BPE) -> DataFrame:
    """A row for each sequence: the document's columns but its text, doc_tokens, start (tokens of the document before it), length, ids (see pieces), sequence_id and offset (0: a sequence holds one piece)."""
    kept = [c for c in shared.columns(shared.without(docs, RESULTS).drop(text))]
    each = docs.select(*kept, pieces(F.col(text), most, end, vocabulary).alias("_made"))
    rows = each.select(*[c for c in shared.columns(each.drop("_made"))], F.col("_made.doc_tokens").alias("doc_tokens"), F.inline("_made.pieces"))
    return rows.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def bucketed(rows: DataFrame) -> DataFrame:
    """The sequences, written with a folder for each length and read again."""
    spark = rows.sparkSession
    path = shared.shared_folder(spark, "sequences")
    rows.hint("rebalance", F.col("length")).write.partitionBy("length").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def batches(rows: DataFrame, tokens: int, seed: int = 0) -> DataFrame:
    """length, sequence_id, batch, slot: batches of so many tokens, each of sequences of one length in random order; a bucket's last batch may hold fewer.

    A bucket is numbered slice by slice, and the slices' sizes are summed up, so no task holds a bucket.
    """
    each = rows.select("length", "sequence_id", F.xxhash64("sequence_id", F.lit(seed)).alias("_at"))
    each = each.withColumn("_slice", F.pmod("_at", F.lit(SLICES)))
    sizes = each.groupBy("length", "_slice").agg(F.count("*").alias("_n"))  # at most SLICES rows a length
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("_at", "sequence_id")) - 1
    found = each.withColumn("_place", place).join(F.broadcast(before), ["length", "_slice"])
    at, many = F.col("_place") + F.col("_before"), F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("length")))
    return found.select("length", "sequence_id", F.floor(at / many).cast("long").alias("batch"), F.pmod(at, many).cast("long").alias("slot"))


def _unpacked(width: int, make, kind: str):
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield make([np.frombuffer(x.as_buffer() if x.is_valid else b"", f"<u{width}") for x in part])

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def as_array(ids: Column, vocabulary: str = piececodes.BYTE_BPE) -> Column:
    """The ids as array<int>."""
    return _unpacked(id_bytes(vocabulary), lambda rows: pa.array(rows, pa.list_(pa.int32())), "array<int>")(ids)


def ids_crc32(ids: Column, vocabulary: str = piececodes.BYTE_BPE) -> Column:
    """crc32 of the ids as unsigned 32-bit numbers, little-endian."""
    return _unpacked(id_bytes(vocabulary), lambda rows: pa.array([zlib.crc32(x.astype("<u4")) for x in rows], pa.int64()), "long")(ids)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bucketed(sequences(shared.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return packed.select("doc_id", "start", "length", ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
