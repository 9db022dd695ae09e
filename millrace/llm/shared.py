"""What several operators need: text columns worked on in Arrow batches, and tables in the folder that the cluster shares."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textnum


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="millrace-")  # one machine runs all tasks, so its own folder is shared
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the application ends; where that is unset and all tasks run on this machine (as in tests), below a temporary folder."""
    mine = f"{_base(spark)}/millrace/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(mine)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{mine}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder: a lost executor costs no earlier stage again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one: of several writers one is told True. (HDFS and local folders create exclusively; a store must do so too.)"""
    fs, p = _file(spark, path)
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    given = fs.open(p)
    try:
        return bytes(given.readAllBytes()).decode()
    finally:
        given.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The files and folders of a folder, in order; none if there is no such folder."""
    fs, p = _file(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


class Manifest:
    """What a store holds, as numbered small files of which each is created once: a change is in as a whole, and of two writers of one number one is told."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def load(self) -> dict:
        names = [x for x in names_in(self.spark, self.folder) if x.startswith("manifest-")]
        return json.loads(read_text(self.spark, f"{self.folder}/{names[-1]}")) if names else {"number": 0}

    def commit(self, state: dict, **changed) -> dict | None:
        """The new state, or None if another writer was first."""
        new = state | changed | {"number": state["number"] + 1}
        return new if create_new(self.spark, f"{self.folder}/manifest-{new['number']:08d}.json", json.dumps(new)) else None


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that a result column of an operator replaces."""
    taken = {x.lower() for x in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def columns(df: DataFrame) -> list[Column]:
    """All columns by their names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """A column name like name that df has not."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def with_fields(df: DataFrame, made: Column, fields: list[str]) -> DataFrame:
    """df with the fields of a struct column as columns; columns of those names are replaced."""
    kept, name = without(df, fields), free_name(df, "made")
    return kept.withColumn(name, made).select(*columns(kept), *[F.col(f"{name}.{f}").alias(f) for f in fields])


def text_udf(work: Callable[[np.ndarray, np.ndarray], list[pa.Array]], ddl: str, most: int = textnum.CHUNK_BYTES):
    """A column function of a text column: work gets the bytes and offsets of a bounded run of texts and gives an Arrow array for each field of ddl.

    It is evaluated once for each row, whatever filters follow.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(ddl)
    assert isinstance(kind, StructType)
    arrow = to_arrow_type(kind)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            data, offsets = textnum.utf8(texts)
            out: list[list[pa.Array]] = [[] for _ in range(arrow.num_fields)]
            for i, j in textnum.chunks(offsets, most):
                made = work(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, a in enumerate(made):
                    out[k].append(a.cast(arrow.field(k).type))
            columns = [pa.concat_arrays(x) if x else pa.array([], arrow.field(k).type) for k, x in enumerate(out)]
            yield pa.StructArray.from_arrays(columns, fields=list(arrow))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def logistic(rows: DataFrame, x: Column, y: Column, ridge: float = 1e-3, steps: int = 25) -> tuple[float, float]:
    """Slope and offset by Newton's method; each step sums five numbers over the rows."""
    rows = written(rows.select(x.alias("x"), y.cast("double").alias("y")), "calibration")
    n, mean = rows.agg(F.count("*"), F.avg("y")).first()
    if not n:
        return 0.0, 0.0
    if mean in (0.0, 1.0):
        return 0.0, float(np.log((mean * n + 1) / ((1 - mean) * n + 1)))
    a, b = 0.0, float(np.log(mean / (1 - mean)))
    for _ in range(steps):
        p = F.lit(1.0) / (1 + F.exp(-(F.col("x") * a + b)))
        v = p * (1 - p)
        g = rows.agg(F.avg((p - F.col("y")) * F.col("x")), F.avg(p - F.col("y")), F.avg(v * F.col("x") * F.col("x")), F.avg(v * F.col("x")), F.avg(v)).first()
        m = np.array([[g[2] + ridge, g[3]], [g[3], g[4] + 1e-9]])
        step = np.linalg.solve(m, np.array([g[0] + ridge * a, g[1]]))
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def logistic_rows(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float, float]:
    """Slope, offset and mean loss by Newton's method, of a bounded sample in memory."""
    n = len(y)
    if not n:
        return 0.0, 0.0, 0.0
    if y.min() == y.max():
        return 0.0, float(np.log((y.sum() + 1) / (n - y.sum() + 1))), 0.0
    a, b = 0.0, float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        v = p * (1 - p)
        m = np.array([[(v * x * x).mean() + ridge, (v * x).mean()], [(v * x).mean(), v.mean() + 1e-9]])
        step = np.clip(np.linalg.solve(m, np.array([((p - y) * x).mean() + ridge * a, (p - y).mean()])), -5, 5)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-7:
            break
    z = np.clip(a * x + b, -40, 40)
    return a, b, float((np.logaddexp(0, z) - y * z).mean())


def crc32_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, mod n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


#: Up to so many labels (an id and a number, 16 bytes: 16 MB) are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def with_label(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """The documents that have the label, with it; an id's greatest label counts."""
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    small = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.drop(label).join(F.broadcast(one) if small else one, key)


#: Keys of one or two numbers: up to so many are broadcast (some 50 MB), more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast in a join if there are few."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
