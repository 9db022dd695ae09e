"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys found in least_docs documents or more
lose all their lines.

A run is a table (128-bit key hash a, b; number of documents n; ripe), kept in a fixed number of hash ranges and sorted
within each: a bucketed table, so batches are merged with the runs range by range and only the batch is shuffled.
A new batch is counted by key, merge-anti-joined with the ripe keys of all runs (nothing is left to learn about them),
and merged with the other keys' counts; what is left becomes the batch's own run, in which a key is ripe once its
documents reach least_docs. So a key ripens in one run only, and the keys to drop are the ripe rows of the runs. When a
level has FANOUT runs they are merged into one run of the next level: a key stands in few runs and is rewritten a
logarithmic number of times.

Runs, their levels and the batches that are in are named by numbered manifests, each created once: a lost executor or a
new session finds all, a batch given again changes nothing, and of two writers one is told.

`drop` removes the lines: hashes of ripe keys are broadcast as sorted arrays up to BROADCAST_KEYS (16 bytes each) and
joined by a shuffle beyond that, where the keys that stand in more than 1 / HOT_SHARE of the documents' lines (counted in
the documents), so at most HOT_SHARE keys, are still broadcast and every other key is small. The result is the same.

Edge cases: a null or empty text is one empty line, which is never dropped (its key is empty). A document counts once
for a key, however often the line stands in it; repeated rows count each. A text of any length is one list of lines. A key
in exactly least_docs documents is dropped. An empty table adds an empty run. Columns with a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shared, textnum

WHITE = b" \t\n\r\x0b\x0c"
FANOUT = 4
BROADCAST_KEYS = 1_000_000
HOT_SHARE = 100_000
FIELDS = ["n_lines", "n_dropped", "kept_text"]
DDL = "n_lines long, n_dropped long, kept_text string"
_KEYS = "keys array<struct<a:long,b:long>>"


def _hash(line: bytes) -> int:
    import xxhash

    return xxhash.xxh3_128_intdigest(line)


def _pair(h: int) -> tuple[int, int]:
    a, b = h >> 64, h & (1 << 64) - 1
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def line_keys(least_chars: int = 1):
    """The distinct key hashes of each text."""

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        raw, out = data.tobytes(), []
        for i, j in zip(offsets[:-1], offsets[1:]):
            keys = {x.strip(WHITE).lower() for x in raw[i:j].split(b"\n")}
            out.append([dict(zip("ab", _pair(_hash(k)))) for k in keys if len(k.decode("utf-8", "replace")) >= least_chars])
        return [pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]

    return shared.text_udf(work, _KEYS)


def key_counts(docs: DataFrame, text: str = "text", least_chars: int = 1) -> DataFrame:
    """a, b, n: the hash of each key and the number of documents that hold it; summed within tasks before the shuffle."""
    keys = docs.select(F.explode(line_keys(least_chars)(F.col(text))["keys"]).alias("k"))
    return keys.groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.count("*").alias("n"))


class LineRuns:
    """The runs of one corpus, below a folder."""

    SCHEMA = "a BIGINT, b BIGINT, n BIGINT, ripe BOOLEAN"

    def __init__(self, spark: SparkSession, folder: str | None = None, least_docs: int = 10, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = (folder or shared.shared_folder(spark, "lines")).rstrip("/")
        self.manifest = shared.Manifest(spark, self.folder)
        first = {"least_docs": least_docs, "ranges": int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "batches": []}
        self.state = first | self.manifest.load()
        self.named: set[str] = set()
        if self.state["least_docs"] != least_docs:
            raise ValueError(f"these runs count to {self.state['least_docs']} documents")

    def _commit(self, **changed) -> None:
        state = self.manifest.commit(self.state, **changed)
        if state is None:
            raise RuntimeError("another writer has changed these runs")
        self.state = state

    def _name(self, run: str) -> str:
        """The run's name in the session's catalog, which alone knows of the buckets."""
        name = "lines_" + hashlib.md5(f"{self.folder}/{run}".encode()).hexdigest()
        self.named.add(name)
        return name

    def _table(self, run: str) -> DataFrame:
        name = self._name(run)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (a, b) SORTED BY (a, b) INTO {self.state['ranges']} BUCKETS LOCATION '{self.folder}/{run}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        """A run of rows (a, b, n, ripe) that are dealt by a and b: a file for each range."""
        run = f"run-{self.state['number'] + 1:08d}-{uuid.uuid4().hex}"
        rows.select("a", "b", "n", "ripe").write.bucketBy(self.state["ranges"], "a", "b").sortBy("a", "b").option("path", f"{self.folder}/{run}").saveAsTable(self._name(run))
        return run

    def _all(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        # the projection makes the union one of rows: a union of column batches straight from the files puts ranges side by
        # side although Spark takes them for merged (4.1), and groups would come out in parts
        each = [self._table(r).select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ripe", F.lit(False)).alias("ripe")) for r in runs]
        out = each[0]
        for more in each[1:]:
            out = out.unionAll(more)
        return out

    @property
    def levels(self) -> list[int]:
        return [level for level, _ in self.state["runs"]]

    def _counted(self, batch: DataFrame, text: str, least_chars: int) -> DataFrame:
        counts = key_counts(batch, text, least_chars)
        return counts if int(self.spark.conf.get("spark.sql.shuffle.partitions")) == self.state["ranges"] else counts.repartition(self.state["ranges"], "a", "b")

    def add(self, batch: DataFrame, text: str = "text", least_chars: int = 1, batch_id: str | None = None) -> bool:
        """Merges the batch into the runs; then full levels are compacted. False if a batch of that id is in."""
        if batch_id is not None and batch_id in self.state["batches"]:
            return False
        rows = self._counted(batch, text, least_chars)
        runs = [self._table(r) for _, r in self.state["runs"]]
        for run in runs:
            rows = rows.join(run.filter("ripe").select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        total = F.col("n")
        for k, run in enumerate(runs):
            rows = rows.join(run.filter("NOT ripe").select("a", "b", F.col("n").alias(f"n{k}")).hint("merge"), ["a", "b"], "left")
            total = total + F.coalesce(f"n{k}", F.lit(0))
        made = self._write(rows.withColumn("ripe", total >= self.state["least_docs"]))
        self._commit(runs=[*self.state["runs"], [0, made]], batches=[*self.state["batches"], *([batch_id] if batch_id is not None else [])])
        level = 0
        while len(full := [r for at, r in self.state["runs"] if at == level]) >= self.fanout:
            merged = self._all(full).groupBy("a", "b").agg(F.sum("n").alias("n"), F.bool_or("ripe").alias("ripe"))
            made = self._write(merged)
            self._commit(runs=[*[x for x in self.state["runs"] if x[0] != level], [level + 1, made]])
            level += 1
        return True

    def forget(self) -> None:
        """Takes the runs' names out of the catalog; their files stay, and a later use names them again."""
        while self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop()}")

    def novel(self, batch: DataFrame, text: str = "text", least_chars: int = 1) -> DataFrame:
        """The batch's keys (a, b, n) that no run holds."""
        rows = self._counted(batch, text, least_chars)
        for _, run in self.state["runs"]:
            rows = rows.join(self._table(run).select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        return rows

    def frequent(self) -> DataFrame:
        """a, b, n: the keys of least_docs documents or more, and the documents that made them ripe or came with that batch."""
        return self._all([r for _, r in self.state["runs"]]).filter("ripe").select("a", "b", "n")


def _cut_all(data: np.ndarray, offsets: np.ndarray, known: list[np.ndarray], own: list[set] | None = None) -> list[pa.Array]:
    """n_lines, n_dropped, kept_text of each text; known: the hashes to drop as sorted high halves with their low halves; own: more hashes for each text."""
    raw, lines, hashes, edges = data.tobytes(), [], [], [0]
    for i, j in zip(offsets[:-1], offsets[1:]):
        each = raw[i:j].split(b"\n")
        lines.append(each)
        hashes += [_hash(k) if (k := x.strip(WHITE).lower()) else None for x in each]
        edges.append(len(hashes))
    some = np.array([h is not None for h in hashes], bool)
    high = np.array([0 if h is None else h >> 64 for h in hashes], np.uint64)
    low = np.array([0 if h is None else h & (1 << 64) - 1 for h in hashes], np.uint64)
    hit = np.zeros(len(hashes), bool)
    if len(known[0]):
        at = np.searchsorted(known[0], high)
        while True:  # keys of one high half stand side by side
            inside = at < len(known[0])
            inside[inside] = known[0][at[inside]] == high[inside]
            hit[inside] |= known[1][at[inside]] == low[inside]
            inside &= ~hit
            if not inside.any():
                break
            at = at + inside
            at[~inside] = len(known[0])
    hit &= some
    n_lines, n_dropped, kept = [], [], []
    for k, each in enumerate(lines):
        gone = hit[edges[k] : edges[k + 1]]
        if own and own[k]:
            gone = gone | np.array([h in own[k] for h in hashes[edges[k] : edges[k + 1]]])
        n_lines.append(len(each))
        n_dropped.append(int(gone.sum()))
        kept.append(b"\n".join([x for x, g in zip(each, gone) if not g]) if n_dropped[-1] else raw[offsets[k] : offsets[k + 1]])
    return [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]


def _sorted_halves(keys: DataFrame) -> list[np.ndarray]:
    found = keys.select("a", "b").toArrow()
    high, low = (found[c].to_numpy().astype(np.int64).view(np.uint64) for c in "ab")
    order = np.lexsort((low, high))
    return [high[order], low[order]]


def drop(docs: DataFrame, frequent: DataFrame, text: str = "text", broadcast_keys: int = BROADCAST_KEYS, hot_share: int = HOT_SHARE) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (the other lines, joined by \\n); frequent: a, b, n."""
    docs = shared.without(docs, FIELDS)
    spark = docs.sparkSession
    if frequent.limit(broadcast_keys + 1).count() <= broadcast_keys:
        hot = spark.sparkContext.broadcast(_sorted_halves(frequent))
        return shared.with_fields(docs, shared.text_udf(lambda data, offsets: _cut_all(data, offsets, hot.value), DDL)(F.col(text)), FIELDS)
    # the runs stop counting a key when it is ripe, so what is hot is counted in the documents
    counted = shared.written(key_counts(docs, text).join(frequent.select("a", "b"), ["a", "b"], "left_semi"), "counted")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    largest = F.col("n") * hot_share > total
    hot = spark.sparkContext.broadcast(_sorted_halves(counted.filter(largest)))
    return _drop_joined(docs, counted.filter(~largest).select("a", "b"), hot, text)


def _drop_joined(docs: DataFrame, frequent: DataFrame, hot, text: str) -> DataFrame:
    """The same by joins: what goes from a text depends on the text alone, so texts are the key and equal ones meet once."""
    body = F.coalesce(F.col(text), F.lit(""))
    key, found = shared.free_name(docs, "key"), shared.free_name(docs, "found")
    keyed = docs.withColumn(key, F.struct(F.md5(body).alias("m"), F.xxhash64(body).alias("x")))
    lines = keyed.select(F.col(key).alias("t"), F.explode(line_keys()(F.col(text))["keys"]).alias("k")).select("t", "k.a", "k.b").distinct()
    told = lines.join(frequent, ["a", "b"]).groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias(found))
    told = shared.written(told.withColumnRenamed("t", key), "found")

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in parts:
            data, offsets = textnum.utf8(texts)
            own = [{((k["a"] % (1 << 64)) << 64) | (k["b"] % (1 << 64)) for k in x or []} for x in keys.to_pylist()]
            yield pa.StructArray.from_arrays(_cut_all(data, offsets, hot.value, own), FIELDS)

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    joined = keyed.join(told, key, "left")
    made = F.arrow_udf(run, DDL).asNondeterministic()(F.col(text), F.col(found))
    return shared.with_fields(joined, made, FIELDS).select(*shared.columns(docs), *FIELDS)


def arrivals(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs as n tables: of some of its files each, if it is a table as read from n files or more (perhaps of some columns only); of some of its texts each, by their hash, if it is read from fewer; anything that is worked out from such a table as it is."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project" and all(plan.projectList().apply(k).getClass().getSimpleName() == "AttributeReference" for k in range(plan.projectList().size())):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return [docs]
    files = sorted(docs.inputFiles())
    if len(files) < n:
        return [docs.filter(F.pmod(F.xxhash64(F.col("text")), F.lit(n)) == k) for k in range(n)]
    reader = docs.sparkSession.read.schema(docs.sparkSession.read.parquet(files[0]).schema)
    return [reader.parquet(*files[k::n]).select(*shared.columns(docs)) for k in range(n)]


def dedup(docs: DataFrame, batches: list[DataFrame] | None = None, least_docs: int = 10, text: str = "text") -> DataFrame:
    """Each batch (all of docs at once if not given) is merged into the runs; then the lines of keys in least_docs documents or more are dropped everywhere."""
    runs = LineRuns(docs.sparkSession, least_docs=least_docs)
    for batch in batches or [docs]:
        runs.add(batch, text)
    frequent = shared.written(runs.frequent(), "frequent")
    runs.forget()
    return drop(docs, frequent, text)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, arrivals(docs, 4)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
