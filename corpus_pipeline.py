"""The documents of a corpus, from raw rows to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet in the
folder that the cluster shares and read again, so a lost executor repeats at most one stage. All stages but the last
return the columns of documents, with n_chars following the text.

1. quality: rows that the base rules or the compression bands reject go.
2. line_dedup: lines whose key stands in ten documents or more go everywhere; a text may become empty, its row stays.
3. ngram_join: one document (that of the least id) of each group of near copies stays.
4. decontaminate: benchmark passages are cut out of texts; a text that is mostly such passages goes.
5. mix: rates towards the target weights; documents that are drawn no copy go, others say how many they get.

A null text fails the quality rules; repeated rows leave one row after stage 3; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, linededup, mixing, ngramjoin, quality, shared


#: The most of poor and of toxic tokens that the mix may have. Where the documents have less, that is the target: they
#: are thinned out or left as they are, never raised. Mostly good documents carry some of either posterior: where that is
#: more, it is the target, so that no good document has to go for it.
TARGETS = {"good": 0.92, "poor": 0.02, "toxic": 0.06}
#: The documents' files reach the line runs in so many batches.
BATCHES = 4


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bands = quality.fit_bands(quality.good_texts(docs, shared.table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, bands=bands)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches = linededup.arrivals(docs, BATCHES)
    found = linededup.dedup(docs.select(*[c.alias(f"_own{k}") for k, c in enumerate(shared.columns(docs))], "text"), batches)
    own = [F.col("kept_text").alias(c) if c == "text" else F.col(f"_own{k}").alias(c) for k, c in enumerate(docs.columns)]
    return _measured(found.select(*own))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate.remove_spans(docs, shared.table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = mixing.domain_of(shared.table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labels, TARGETS, thin=("poor", "toxic")).filter("n_copies > 0")


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontaminate", decontaminated), ("mix", mix)]

#: Compression ratios and fitted rates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.written(docs, name)
    return docs
