"""Point stores: namespaces of Parquet generations below a folder, with a manifest that names the live files of each bucket.

Tables aren't changed in place. Points lie in BUCKETS buckets by a hash of their id; an upsert or delete writes the buckets
that it touches anew, beside the old ones, and then creates the next numbered manifest, so readers see all of it or nothing
and other buckets stay as they are; of two writers at once the second is told.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.filters import compile_filter
from millrace.operators import search

_NAME = re.compile(r"[a-z0-9_]{1,63}\Z")
#: A change of one point rewrites one of so many buckets.
BUCKETS = 16
SCHEMA = "id string, dense array<float>, document_id string, created_at timestamp, payload variant"
CAPABILITIES = {"dense": True, "lexical": True, "sparse": True, "filter": True, "max_top_k": search.MAX_TOP_K, "metrics": ["cosine", "dot", "l2"]}


class NamespaceNotFound(LookupError):
    pass


class DimensionError(ValueError):
    pass


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def _touched(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS


class PointStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # the manifest

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _root(self, ns: str) -> str:
        if not _NAME.match(ns):
            raise ValueError(f"not a namespace name: {ns!r}")
        return f"{self.folder}/{ns}"

    def _latest(self, ns: str) -> int:
        """The number of the newest manifest, 0 if there is none."""
        fs, root = self._fs(self._root(ns))
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def _manifest(self, ns: str) -> dict[str, Any]:
        number = self._latest(ns)
        if not number:
            raise NamespaceNotFound(ns)
        path = f"{self._root(ns)}/manifest-{number:08d}.json"
        return json.loads(self.spark.read.option("wholetext", "true").text(path).first()[0]) | {"number": number}

    def _put(self, ns: str, manifest: dict[str, Any]) -> None:
        """The next manifest, created by its number and never overwritten; a number that is taken means another writer."""
        number = manifest.get("number", 0) + 1
        fs, target = self._fs(f"{self._root(ns)}/manifest-{number:08d}.json")
        fs.mkdirs(target.getParent())
        try:
            out = fs.create(target, False)
        except Exception as e:
            if fs.exists(target):
                raise RuntimeError(f"{ns} was changed by another writer") from e
            raise
        out.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "number"}).encode()))
        out.close()

    # namespaces

    def ensure(self, ns: str, dim: int, metric: str = "cosine", **options) -> None:
        """Creates the namespace if it isn't there; a namespace keeps its dimension and metric."""
        try:
            had = self._manifest(ns)
        except NamespaceNotFound:
            self._put(ns, {"dim": dim, "metric": metric, "options": options, "live": {}, "generations": 0})
            return
        if (had["dim"], had["metric"]) != (dim, metric):
            raise ValueError(f"{ns} has dimension {had['dim']} and metric {had['metric']}")

    def exists(self, ns: str) -> bool:
        return self._latest(ns) > 0

    def spec(self, ns: str) -> dict[str, Any]:
        return {k: v for k, v in self._manifest(ns).items() if k in ("dim", "metric", "options")}

    def drop(self, ns: str) -> None:
        fs, p = self._fs(self._root(ns))
        fs.delete(p, True)

    # points

    def _read(self, ns: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self._root(ns)}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], SCHEMA)

    def points(self, ns: str) -> DataFrame:
        return self._read(ns, sorted(self._manifest(ns)["live"].values()))

    def _replace(self, ns: str, touched: list[int], new: Callable[[DataFrame], DataFrame]) -> None:
        """The touched buckets with the rows that new makes of theirs."""
        manifest = self._manifest(ns)
        live, number = dict(manifest["live"]), manifest["generations"] + 1
        name = f"generation-{number:06d}-{uuid.uuid4().hex[:8]}"
        rows = new(self._read(ns, sorted({live[str(b)] for b in touched if str(b) in live})))
        rows.withColumn("_bucket", _bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self._root(ns)}/{name}")
        fs, p = self._fs(f"{self._root(ns)}/{name}")
        made = {f.getPath().getName() for f in fs.listStatus(p)}
        for b in touched:
            live.pop(str(b), None)
            if f"_bucket={b}" in made:
                live[str(b)] = f"{name}/_bucket={b}"
        self._put(ns, manifest | {"live": live, "generations": number})

    def upsert(self, ns: str, new: DataFrame) -> int:
        """Inserts or replaces by id (new: id, dense, payload as JSON text); of rows that repeat an id the one of the greatest payload, then vector, stays. Nothing is written if any vector has another dimension. Returns the rows given."""
        dim = self._manifest(ns)["dim"]
        n, bad = new.agg(F.count("*"), F.count_if(F.coalesce(F.size("dense") != dim, F.lit(True)))).first()
        if bad:
            raise DimensionError(f"{bad} of {n} vectors haven't dimension {dim}")
        if not n:
            return 0
        v = F.parse_json("payload")
        one = new.groupBy("id").agg(F.max(F.struct("payload", "dense")).alias("one"))
        rows = one.select("id", "one.*").select("id", "dense", F.try_variant_get(v, "$.document_id", "string").alias("document_id"), F.timestamp_seconds(F.try_variant_get(v, "$.created_at", "double")).alias("created_at"), v.alias("payload"))
        self._replace(ns, _touched(rows), lambda old: old.join(rows.select("id"), "id", "left_anti").unionByName(rows))
        return n

    def _condition(self, where: Mapping[str, Any] | None) -> Column:
        return compile_filter(where, F.col("payload"), {"document_id": (F.col("document_id"), "string"), "created_at": (F.col("created_at"), "time")})

    def delete(self, ns: str, ids: list[str] | None = None, where: Mapping[str, Any] | None = None) -> int:
        """Points that have one of the ids and meet the condition, whichever are given."""
        if ids is None and where is None:
            raise ValueError("delete needs ids or a condition")
        gone = F.lit(True)
        if ids is not None:
            gone = gone & (F.col("id").isin(ids) if ids else F.lit(False))
        if where is not None:
            gone = gone & self._condition(where)
        gone = F.coalesce(gone, F.lit(False))
        hits = self.points(ns).filter(gone)
        n = hits.count()
        if n:
            self._replace(ns, _touched(hits), lambda old: old.filter(~gone))
        return n

    def fetch(self, ns: str, ids: list[str]) -> DataFrame:
        """The points of the ids in the order asked for, with score 0; unknown ids are left out."""
        if not ids:
            return self.points(ns).limit(0).withColumn("score", F.lit(0.0))
        asked = self.spark.createDataFrame(list(enumerate(ids)), "place int, id string")
        return self.points(ns).join(F.broadcast(asked), "id").orderBy("place").drop("place").withColumn("score", F.lit(0.0))

    def count(self, ns: str, where: Mapping[str, Any] | None = None) -> int:
        return self.points(ns).filter(self._condition(where)).count()

    def search(self, ns: str, query=None, text: str | None = None, k: int = 10, where: Mapping[str, Any] | None = None, with_payload: bool = True, threshold: float | None = None) -> DataFrame:
        """Hits (id, score, payload, content) of a vector, or of all the words of a text."""
        spec, rows = self._manifest(ns), self.points(ns).filter(self._condition(where))
        content = F.coalesce(F.when(F.schema_of_variant(F.variant_get("payload", "$.content", "variant")) == "STRING", F.try_variant_get("payload", "$.content", "string")), F.lit(""))
        rows = rows.withColumn("content", content)
        if query is not None:
            if len(query) != spec["dim"]:
                raise DimensionError(f"the query hasn't dimension {spec['dim']}")
            hits = search.dense(rows, query, k, spec["metric"], threshold=threshold, id_col="id", vector="dense")
        elif text is not None:
            found = search.lexical_all(rows, text.split(), k, "id", "content")
            hits = found.join(rows, "id").orderBy(F.col("score").desc(), "id")
            hits = hits if threshold is None else hits.filter(F.col("score") >= threshold)
        else:
            raise ValueError("search needs a vector or a text")
        keep = ["id", "score", "content"]
        return hits.select(*keep, "payload") if with_payload else hits.select(*keep)


def require(capability: str) -> None:
    """Raises for what the store can't do, never falls back."""
    if not CAPABILITIES.get(capability):
        raise NotImplementedError(capability)
