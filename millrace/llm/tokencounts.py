"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes becomes a ledger table of signed rows: +1 for a document that came, -1 (with the counts it had) for
one that went, both for one that was revised. Its sum by key is the batch's delta, and totals are sums of deltas, so
they are additive whatever the order of batches. Each tokenizer version has a store of its own below the folder, so a
recount under a new version gives the same batches again.

Both tables are written to new folders and named by the next manifest, which only one writer can create: a batch is in
or out as a whole, giving it again changes nothing, and tables that no manifest names are never read. A writer that
was overtaken works its batch out anew on what is there then.

Texts are counted once, when they come: deletes and revisions take the old counts from the ledger by a join on the id.
The ledger is laid out in PARTS folders by the id's hash, so a join with few ids reads their parts only; rows are rebalanced by
part, so as many tasks write a part as its size asks for. Ledgers have levels: when FANOUT of one level are there, they are
merged into one of the next (what cancels out goes), and so are deltas, so totals and joins read few tables and a row is
rewritten a logarithmic number of times. `compact` merges all.

Edge cases: null and empty texts have no tokens but count as documents; null keys are keys of their own; each row of a
batch counts; a delete or a revision, or both in one batch, takes back all live rows of its id once; an unknown id, or a
null one, takes back nothing; an empty batch commits with no rows; a text of any length is counted whole. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import uuid
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shared

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary cuts texts before it merges bytes (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id string, source string, lang string, tokenizer string, docs long, tokens long, part int"
#: Folders of a ledger, and ledgers of a level that become one of the next.
PARTS, FANOUT = 32, 4
#: Times that an overtaken writer tries again.
TRIES = 5
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


@functools.cache
def _encoding(path: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(path: str = TOKENIZER):
    """A column function: the tokens of a text under the vocabulary file at path, which every worker has."""

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        raw, encode = data.tobytes(), _encoding(path).encode_ordinary
        return [pa.array([len(encode(raw[i:j].decode("utf-8", "replace"))) for i, j in zip(offsets[:-1], offsets[1:])], pa.int64())]

    return lambda text: shared.text_udf(work, "n long")(text)["n"]


class TokenTotals:
    """The ledgers and the deltas of one corpus, below a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str = TOKENIZER, version: str | None = None):
        self.spark, self.folder, self.path = spark, folder.rstrip("/"), tokenizer
        self.version = version or Path(tokenizer).stem
        self.manifest = shared.Manifest(spark, f"{self.folder}/{self.version}")

    def _state(self, version: str | None = None) -> dict:
        manifest = shared.Manifest(self.spark, f"{self.folder}/{version}") if version else self.manifest
        return {"batches": [], "ledgers": [], "deltas": [], "levels": []} | manifest.load()

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        out = [self.spark.read.schema(schema).parquet(p) for p in paths]  # each has its own parts
        return reduce(DataFrame.unionByName, out)

    def _counted(self, docs: DataFrame) -> DataFrame:
        return docs.select(
            F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            F.lit(self.version).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), token_count(self.path)(F.col("text")).alias("tokens"),
        )

    def _taken_back(self, ids: DataFrame, state: dict) -> DataFrame:
        """What is live of the ids, with the opposite sign; ids: doc_id, each once."""
        keys = ids.withColumn("part", _part())
        had = self._read(state["ledgers"], LEDGER).join(keys, ["part", "doc_id"])
        live = had.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")
        return live.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))

    def _written(self, rows: DataFrame) -> tuple[str, str]:
        """The folders of a ledger and of its sums."""
        ledger, delta = (f"{self.folder}/{self.version}/{kind}-{uuid.uuid4().hex}" for kind in ("ledger", "delta"))
        rows.withColumn("part", _part()).hint("rebalance", F.col("part")).write.partitionBy("part").parquet(ledger)
        mine = self._read([ledger], LEDGER)
        mine.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(delta)
        return ledger, delta

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """inserts, revised: doc_id, text, source, lang; deletes: doc_id. False if the batch was in already."""
        counted = None
        for _ in range(TRIES):
            state = self._state()
            if batch in state["batches"]:
                return False
            rows = [self._counted(x) for x in (inserts, revised) if x is not None]
            gone = [x.select(F.col("doc_id").cast("string").alias("doc_id")) for x in (deletes, revised) if x is not None]
            if gone:
                rows.append(self._taken_back(reduce(DataFrame.union, gone).filter("doc_id IS NOT NULL").distinct(), state))
            counted = self._written(reduce(DataFrame.unionByName, rows or [self.spark.createDataFrame([], LEDGER).drop("part")]))
            if self.manifest.commit(state, batches=[*state["batches"], batch], ledgers=[*state["ledgers"], counted[0]], deltas=[*state["deltas"], counted[1]], levels=[*state["levels"], 0]):
                self._settle()
                return True
            for path in counted:
                shared.delete(self.spark, path)
        raise RuntimeError(f"batch {batch} was overtaken {TRIES} times")

    def _merge(self, state: dict, which: list[int], level: int) -> bool:
        """Some ledgers and their deltas become one; False if another writer was first."""
        rows = self._read([state["ledgers"][k] for k in which], LEDGER)
        live = rows.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")
        made = self._written(live)
        stay = [k for k in range(len(state["ledgers"])) if k not in which]
        new = {name: [*[state[name][k] for k in stay], x] for name, x in (("ledgers", made[0]), ("deltas", made[1]), ("levels", level))}
        if self.manifest.commit(state, **new):
            return True
        for path in made:
            shared.delete(self.spark, path)
        return False

    def _settle(self) -> None:
        """Merges full levels; a writer that is overtaken here leaves it to the next."""
        level = 0
        while True:
            state = self._state()
            which = [k for k, x in enumerate(state["levels"]) if x == level]
            if len(which) < FANOUT or not self._merge(state, which, level + 1):
                return
            level += 1

    def compact(self) -> None:
        """One ledger of the live rows and one delta; what they replace stays on disk for those who read it."""
        state = self._state()
        if state["ledgers"] and not self._merge(state, list(range(len(state["ledgers"]))), max(state["levels"]) + 1):
            raise RuntimeError("another writer has changed this store")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches of all versions; keys without a document left out."""
        deltas = [p for v in shared.names_in(self.spark, self.folder) for p in self._state(v)["deltas"]]
        whole = self._read(deltas, DELTA).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return whole.filter("n_docs <> 0 OR n_tokens <> 0")


def _part():
    return F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).otherwise(F.floor(F.rand(1) * PARTS)).cast("int")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come; later copies of a text go; texts that repeat lines are revised to have each once; a batch is sent twice."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    totals = TokenTotals(spark, shared.shared_folder(spark, "tokens"))
    totals.commit("load", inserts=docs)
    seen = docs.select("doc_id", F.md5("text").alias("m"), F.xxhash64("text").alias("x"))
    first = seen.groupBy("m", "x").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = shared.written(first, "first")  # so both sides of the join are plain, and Spark splits a text with many copies
    copies = shared.written(seen.join(first, ["m", "x"]).filter("doc_id <> first").select("doc_id"), "copies")
    totals.commit("copies", deletes=copies)
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    revised = docs.withColumn("_once", once).filter("_once <> text").join(copies, "doc_id", "left_anti").select("doc_id", F.col("_once").alias("text"), "source", "lang")
    totals.commit("lines", revised=shared.written(revised, "revised"))
    totals.commit("copies", deletes=copies)
    return totals.totals()
