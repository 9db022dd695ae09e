"""Several tables of knowledge bases under one manifest: rows are replaced by document, and all tables change together.

Rows lie in folders by knowledge base, index version and bucket (a hash of the document). A change writes the touched
buckets anew, beside the old ones, and then creates the next numbered manifest, which names the folders of every bucket (documents that are new lie beside older ones, up to MOST_PARTS changes): the
tables change at once or not at all, folders of other buckets stay as they are, and of two writers one is told. Dropping a
version or a knowledge base changes the manifest alone; `vacuum` removes what it no longer names.

A change may carry the name of a stream and a batch number, which go into the same manifest: a batch that is given again
(as Structured Streaming does when it was stopped after the change and before its checkpoint) changes nothing. So a
stream into these tables is exactly-once without a transaction manager.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a knowledge base's version; the manifest names at most so many folders for each of its tables.
BUCKETS = 16
#: A bucket of a table lies in so many folders at most before a change writes it anew as one.
MOST_PARTS = 8
#: Up to so many ids are sent to all tasks.
BROADCAST_IDS = 200_000


class Overtaken(RuntimeError):
    """Another writer has changed the tables meanwhile."""


class TableSet:
    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], document: str = "document_id", buckets: int = BUCKETS):
        """schemas: the columns of each table, of which one is the document's id."""
        self.spark, self.folder, self.schemas, self.document, self.buckets = spark, folder.rstrip("/"), schemas, document, buckets

    # the manifest

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def state(self) -> dict:
        """number; folders: table -> "kb/version/bucket" -> folder; streams: name -> last batch; purges: kb -> steps done."""
        fs, root = self._file(self.folder)
        names = sorted(n for x in fs.listStatus(root) if (n := x.getPath().getName()).startswith("manifest-")) if fs.exists(root) else []
        if not names:
            return {"number": 0, "folders": {t: {} for t in self.schemas}, "streams": {}, "purges": {}}
        fs, p = self._file(f"{self.folder}/{names[-1]}")
        given = fs.open(p)
        try:
            return json.loads(bytes(given.readAllBytes()).decode())
        finally:
            given.close()

    def _commit(self, state: dict, **changed) -> dict:
        new = state | changed | {"number": state["number"] + 1}
        fs, p = self._file(f"{self.folder}/manifest-{new['number']:08d}.json")
        fs.mkdirs(p.getParent())
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Overtaken(self.folder) from e
            raise
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        return new

    # reading

    def _of(self, table: str, folders: list[str]) -> DataFrame:
        schema = f"kb_id string, index_version int, {self.schemas[table]}"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, table: str, kb: str | None = None, version: int | None = None) -> DataFrame:
        """kb_id, index_version and the table's columns; only the folders of the given ones are read."""
        wanted = [path for key, paths in self.state()["folders"][table].items() if self._is(key, kb, version) for path in _each(paths)]
        return self._of(table, sorted(wanted))

    @staticmethod
    def _is(key: str, kb: str | None, version: int | None) -> bool:
        own, number, _ = key.rsplit("/", 2)
        return (kb is None or own == kb) and (version is None or int(number) == version)

    def versions(self, kb: str) -> list[int]:
        """Those that hold rows."""
        return sorted({int(key.rsplit("/", 2)[1]) for table in self.state()["folders"].values() for key in table if self._is(key, kb, None)})

    # changing

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.document).cast("string")), F.lit(self.buckets)).cast("int")

    def replace(self, kb: str, version: int, of: DataFrame, stream: tuple[str, int] | None = None, own: tuple[str, Column] | None = None, /, **rows: DataFrame) -> bool:
        """In each table of rows, the rows of these documents (a column of ids) go and the given rows of the same documents come. False if the stream's batch is in already.

        own: a table and a condition on it, if `of` is what meets it there and all rows are made of `of`: then that table is
        written by the condition and rows stay in the tasks that made them, where else they are met with the ids by shuffles.
        """
        if "/" in kb:
            raise ValueError(f"not a knowledge base's id: {kb!r}")
        state = self.state()
        if stream and state["streams"].get(stream[0], -1) >= stream[1]:
            return False
        ids = of.select(F.col(self.document)).distinct()
        touched = [r[0] for r in of.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets`
        folders = {t: dict(x) for t, x in state["folders"].items()}
        for table, new in rows.items():
            names = [c.split()[0] for c in _columns(self.schemas[table])]
            keys = [key for b in touched if (key := f"{kb}/{version}/{b}") in folders[table]]
            old = self._of(table, [path for key in keys for path in _each(folders[table][key])])
            theirs = own is not None or new is of
            added = False
            if not keys:
                stays = None
            elif own and own[0] == table:
                stays = old.filter(~F.coalesce(own[1], F.lit(False)))
            else:
                again = old.select(self.document).join(ids, self.document, "left_semi").distinct()
                few = again.limit(BROADCAST_IDS + 1).count()
                added = not few and all(len(_each(folders[table][key])) < MOST_PARTS for key in keys)
                stays = None if added else old if not few else old.join(F.broadcast(again) if few <= BROADCAST_IDS else again, self.document, "left_anti")
            comes = new.select(*names) if theirs else new.select(*names).join(ids, self.document, "left_semi")
            path = f"{self.folder}/data/{table}-{uuid.uuid4().hex}"
            whole = (comes if stays is None else stays.select(*names).unionByName(comes)).withColumns({"kb_id": F.lit(kb), "index_version": F.lit(version), "_bucket": self._bucket()})
            (whole if theirs else whole.repartition("_bucket")).write.partitionBy("_bucket").option("compression", "zstd").parquet(path)
            fs, p = self._file(path)
            made = {x.getPath().getName() for x in fs.listStatus(p)}
            for b in touched:
                key = f"{kb}/{version}/{b}"
                had = _each(folders[table].pop(key, []))
                parts = (had if added else []) + ([f"{path}/_bucket={b}"] if f"_bucket={b}" in made else [])
                if parts:
                    folders[table][key] = parts
        streams = state["streams"] | ({stream[0]: stream[1]} if stream else {})
        self._commit(state, folders=folders, streams=streams)
        return True

    def drop(self, kb: str, version: int | None = None, tables: list[str] | None = None) -> None:
        """A version of a knowledge base, or all of it, in the given tables or all."""
        state = self.state()
        kept = {t: {k: p for k, p in x.items() if not ((tables is None or t in tables) and self._is(k, kb, version))} for t, x in state["folders"].items()}
        if kept != state["folders"]:
            self._commit(state, folders=kept)

    def purge(self, kb: str, steps: list[tuple[str, Callable[[], None]]]) -> None:
        """The steps by which a knowledge base goes, in order, each noted when it is done: a purge that was stopped goes on behind the last step noted, so each step must bear being done twice."""
        for name, step in steps:
            done = self.state()["purges"].get(kb, [])
            if name in done:
                continue
            step()
            state = self.state()
            self._commit(state, purges=state["purges"] | {kb: [*state["purges"].get(kb, []), name]})

    def vacuum(self) -> int:
        """Deletes the folders that the newest manifest doesn't name, and older manifests; how many folders. Not while others read or write."""
        state = self.state()
        named = {p.rsplit("/", 2)[-2:][0] + "/" + p.rsplit("/", 1)[-1] for x in state["folders"].values() for paths in x.values() for p in _each(paths)}
        fs, data = self._file(f"{self.folder}/data")
        gone = 0
        for written in fs.listStatus(data) if fs.exists(data) else []:
            own = written.getPath().getName()
            parts = [x.getPath() for x in fs.listStatus(written.getPath()) if x.isDirectory()]
            old = [p for p in parts if f"{own}/{p.getName()}" not in named]
            for p in old:
                fs.delete(p, True)
            if len(old) == len(parts):
                fs.delete(written.getPath(), True)
            gone += len(old)
        fs, root = self._file(self.folder)
        for x in fs.listStatus(root):
            n = x.getPath().getName()
            if n.startswith("manifest-") and int(n[9:-5]) < state["number"]:
                fs.delete(x.getPath(), False)
        return gone


def _each(paths: str | list[str]) -> list[str]:
    """The folders of a bucket; older manifests name one."""
    return [paths] if isinstance(paths, str) else paths


def _columns(ddl: str) -> list[str]:
    """The columns of a DDL text, whose types may hold commas."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def carried(new: DataFrame, old: DataFrame, document: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(chunks, orphans): new chunks with the content of the document's edited old ones of the same ordinal, is_edited; and the edited ones that have no such place any more."""
    edits = old.filter("is_edited").select(document, "ordinal", F.col("content").alias("_content"), F.col("content_hash").alias("_hash"))
    both = new.drop("is_edited").join(edits, [document, "ordinal"], "left")
    edited = F.col("_hash").isNotNull()
    chunks = both.withColumns({"content": F.when(edited, F.col("_content")).otherwise(F.col("content")), "content_hash": F.when(edited, F.col("_hash")).otherwise(F.col("content_hash")), "is_edited": edited})
    return chunks.drop("_content", "_hash"), edits.join(new, [document, "ordinal"], "left_anti").select(document, "ordinal")


def drift(chunks: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """Where the numbers of chunks and of points differ."""
    a, b = chunks.groupBy(*key).agg(F.count("*").alias("n_chunks")), points.groupBy(*key).agg(F.count("*").alias("n_points"))
    both = a.join(b, key, "full_outer").select(*key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_points")])
    return both.filter("n_chunks <> n_points")
