"""Streams: rate windows, idempotent requests and incremental ingestion over file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tables import rate_windows


def stream_rate(requests: DataFrame, limit: int, seconds: int = 60, late: str = "10 minutes", principal: str = "user_id", at: str = "ts") -> DataFrame:
    """The batch operator on a stream, with a watermark that bounds its state."""
    return rate_windows(requests.withWatermark(at, late), limit, seconds, principal, at)


def once(requests: DataFrame, key: list[str], at: str = "ts", within: str = "24 hours") -> DataFrame:
    """The first request of each key within the time."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, into Parquet."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_new(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, key: str) -> None:
    """Rows of a stream into a Parquet table, each key once: a batch anti-joins what is there, and a batch given again adds nothing."""
    schema = source.schema

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            fresh = fresh.join(batch.sparkSession.read.schema(schema).parquet(path).select(key), key, "left_anti")
        fresh.select(*[F.col(c) for c in schema.names]).write.mode("append").parquet(path)

    source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
