"""Reading the Parquet tables of a directory, and files of other formats."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset and all tasks run on this machine (as in tests), below a temporary folder; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: worked out once, however often they are used."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_files(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """text, csv (with a header), json, parquet, orc; binary gives path, content and length."""
    if kind == "binary":
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    reader = spark.read.format(kind)
    if schema:
        reader = reader.schema(schema)
    if kind == "text":
        return reader.option("wholetext", "true").load(path)
    return reader.option("header", "true").load(path) if kind == "csv" else reader.load(path)


def import_golden(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(items, rejected) of a CSV or JSON lines file of query, relevant_chunk_ids (separated by ;), reviewed."""
    schema = "query string, relevant_chunk_ids string, reviewed boolean, _bad string"
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    rows = reader.option("header", "true").csv(path) if kind == "csv" else reader.json(path)
    ok = F.col("_bad").isNull() & (F.coalesce(F.trim("query"), F.lit("")) != "")
    items = rows.filter(ok).select("query", F.split(F.coalesce("relevant_chunk_ids", F.lit("")), ";").alias("relevant_chunk_ids"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"))
    reason = F.when(F.col("_bad").isNotNull(), "unreadable").otherwise("no query")
    return items, rows.filter(~ok).select("query", reason.alias("reason"))


def export_lines(df: DataFrame, order: list, path: str | None = None) -> DataFrame:
    """The rows as JSON lines in order; written as text if a path is given."""
    lines = df.orderBy(*order).select(F.to_json(F.struct("*")).alias("value"))
    if path:
        lines.write.text(path)
    return lines
