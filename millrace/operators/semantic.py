"""Semantic chunks: sentences are embedded, and a text is cut where the distance between neighbours peaks.

Everything is a plan over rows of sentences: a window by document compares each sentence with the one before it, a
running quantile over the sentences around says what is far, and a chunk is a sum over its sentences. Only the embedding
itself is a function of Arrow batches; any column function from text to array<double> takes its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import slots
from millrace.functions import text as T
from millrace.functions import vectors as V

#: Distances beyond this quantile of those around are peaks; so many sentences on each side count as around.
QUANTILE, AROUND = 0.8, 20


def sentence_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, at (from 0), sentence: the text in order, each sentence with the white space after it, so that together they are the text again."""
    parts = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?s).+?(?:[.!?。！？；]+\s*|\n\s*|\z)"), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("at", "sentence"))


def boundaries(sentences: DataFrame, embed: Callable[[Column], Column], quantile: float = QUANTILE, around: int = AROUND) -> DataFrame:
    """sentences with distance (1 less the cosine to the sentence before; null for the first) and peak."""
    order = Window.partitionBy("doc_id").orderBy("at")
    rows = sentences.withColumn("_v", embed(F.col("sentence")))
    rows = rows.withColumn("distance", F.round(1 - V.cosine(F.lag("_v").over(order), F.col("_v")), 9)).drop("_v")
    near = order.rowsBetween(-around, around)
    rows = rows.withColumn("_far", F.percentile("distance", quantile).over(near))
    top = (F.col("distance") >= F.coalesce(F.lag("distance").over(order), F.lit(0.0))) & (F.col("distance") > F.coalesce(F.lead("distance").over(order), F.lit(0.0)))
    return rows.withColumn("peak", F.coalesce((F.col("distance") > 0) & (F.col("distance") >= F.col("_far")) & top, F.lit(False))).drop("_far")


def semantic_chunks(docs: DataFrame, most: int, doc_id: str = "doc_id", text: str = "text", embed: Callable[[Column], Column] = slots.hashed_embedding, quantile: float = QUANTILE, around: int = AROUND) -> DataFrame:
    """doc_id, ordinal, content, token_count, content_hash: the sentences between two peaks; those of more than `most` tokens are cut where a multiple of it is passed.

    The contents of a document, in order and as they are, are its text again. A null or empty text has no chunks; a text of
    white space is one chunk without tokens.
    """
    order = Window.partitionBy("doc_id").orderBy("at")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = boundaries(sentence_rows(docs, doc_id, text), embed, quantile, around)
    rows = rows.withColumn("_n", T.token_count(F.col("sentence"))).withColumn("_section", F.sum(F.col("peak").cast("int")).over(up_to))
    inside = Window.partitionBy("doc_id", "_section").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum("_n").over(inside)
    rows = rows.withColumn("_part", F.floor(F.greatest(ends - 1, F.lit(0)) / most))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda s: s["sentence"]), "")
    made = rows.groupBy("doc_id", "_section", "_part").agg(own.alias("content"), F.sum("_n").alias("token_count"), F.min("at").alias("_at"))
    return made.select(
        "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")) - 1).alias("ordinal"), "content", "token_count", F.sha2("content", 256).alias("content_hash")
    )
