"""The ingestion chain registered, parsed, chunked, embedded, indexed over a TableSet, by stages that can be stopped anywhere.

A stage takes the documents of one state, works on all of them at once, and writes what it made together with their new
state in one change of the tables: a run that was stopped before the change did nothing, one that was stopped after it finds
no documents of that state any more. A document whose stage failed gets the state failed, with the stage and a code; the
others go on. The stream that registers documents carries its batch number into the same change, so each arrives once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import written
from millrace.sources.tableset import BROADCAST_IDS, TableSet

SCHEMAS = {
    "documents": "document_id string, content string, state string, stage string, error string, revision int",
    "chunks": "document_id string, ordinal int, content string, content_hash string, token_count int, is_edited boolean",
    "points": "document_id string, ordinal int, content_hash string, dense array<double>",
}
#: What comes after each state.
NEXT = {"registered": "parsed", "parsed": "chunked", "chunked": "embedded", "embedded": "indexed"}

#: A stage: the documents of its state -> (its own tables, document_id and error of those that failed or None).
Stage = Callable[[DataFrame], tuple[dict[str, DataFrame], DataFrame | None]]


def open_tables(spark: SparkSession, folder: str, buckets: int = 16) -> TableSet:
    return TableSet(spark, folder, SCHEMAS, buckets=buckets)


def register(tables: TableSet, kb: str, version: int, stream: DataFrame, name: str, checkpoint: str, after: Callable[[int], None] | None = None) -> None:
    """A stream of document_id, content into the documents table: all that is there now, each batch once. A document that comes again gets the next revision and starts anew. after: called with each batch number behind its change (tests stop there)."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("document_id").agg(F.max("content").alias("content"))
        had = tables.read("documents", kb, version).select("document_id", F.col("revision").alias("_had"))
        rows = rows.join(had, "document_id", "left").select(
            "document_id", "content", F.lit("registered").alias("state"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error"), (F.coalesce("_had", F.lit(0)) + 1).alias("revision")
        )
        tables.replace(kb, version, rows, (name, number), documents=rows)
        if after:
            after(number)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def advance(tables: TableSet, kb: str, version: int, state: str, stage: Stage, earlier: list[str] | None = None) -> bool:
    """Takes all documents of a state (and of earlier ones that are passed through) one state further; False if there are none."""
    mine = F.col("state").isin([*(earlier or []), state])
    docs = tables.read("documents", kb, version).filter(mine)
    if docs.isEmpty():
        return False
    made, failed = stage(docs)
    if failed is None:
        moved = docs.withColumns({"state": F.lit(NEXT[state]), "stage": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    else:
        bad = written(failed.select("document_id", F.col("error").alias("_error")), "failed")
        few = bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        moved = docs.join(F.broadcast(bad) if few else bad, "document_id", "left")
        wrong = F.col("_error").isNotNull()
        moved = moved.withColumns({"state": F.when(wrong, "failed").otherwise(NEXT[state]), "stage": F.when(wrong, NEXT[state]), "error": F.col("_error")}).drop("_error")
    tables.replace(kb, version, docs, None, ("documents", mine), documents=moved, **made)
    return True


def run_chain(tables: TableSet, kb: str, version: int, stages: dict[str, Stage]) -> None:
    """All stages in order, each over what is in its state; documents of a state without a stage of its own go on with the next stage, or at the end by themselves."""
    passed: list[str] = []
    for state in NEXT:
        if state in stages:
            advance(tables, kb, version, state, stages[state], passed)
            passed = []
        else:
            passed.append(state)
    if passed:
        advance(tables, kb, version, passed[-1], lambda docs: ({}, None), passed[:-1])


def retry(tables: TableSet, kb: str, version: int) -> bool:
    """Failed documents are registered again under their next revision; False if there are none."""
    failed = tables.read("documents", kb, version).filter("state = 'failed'")
    if failed.isEmpty():
        return False
    again = failed.withColumns({"state": F.lit("registered"), "stage": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "revision": F.col("revision") + 1})
    tables.replace(kb, version, failed, documents=again)
    return True
