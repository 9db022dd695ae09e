"""Models as plug-ins: loaded once a worker, given batches of a stated size, with limits on each batch.

A model is a function that loads it and returns another, from a batch of texts to vectors (or scores). A batch that is late,
fails or returns something else is an error in each of its rows, and other batches go on. Equal texts are embedded once:
`embedded` works on distinct keys (model, normal form of the text), less those that a cache has.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from millrace.functions import text as T
from millrace.functions.batches import by_pieces
from millrace.functions.published import OUT_OF_MEMORY, OUTPUT_INVALID, RUNTIME_ERROR, TIMEOUT, Late, Limits, limited

_MADE = StructType([StructField("vector", ArrayType(DoubleType())), StructField("error", StringType())])


@dataclass(frozen=True)
class Model:
    """load gives predict: a list of texts -> rows of `dimension` numbers. prefix goes before queries; longer texts are cut at max_tokens."""

    name: str
    load: Callable[[], Callable[[list[str]], object]]
    dimension: int
    batch: int = 64
    normalize: bool = True
    prefix: str = ""
    max_tokens: int | None = None
    limits: Limits = field(default_factory=Limits)


def _settled(made: object, n: int, model: Model) -> np.ndarray:
    x = np.asarray(made, float)
    if x.shape != (n, model.dimension):
        raise ValueError(f"shape {x.shape}, not {(n, model.dimension)}")
    if not np.isfinite(x).all():
        raise ValueError("a number isn't finite")
    if x.nbytes > model.limits.output_bytes:
        raise ValueError(f"{x.nbytes} bytes, more than {model.limits.output_bytes}")
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=x.copy(), where=size > 0) if model.normalize else x


#: Models that a worker holds, by the call of `vectors` that they are for; the oldest go.
_LOADED: OrderedDict[str, Callable[[list[str]], object]] = OrderedDict()
MOST_LOADED = 3


def _loaded(key: str, model: Model) -> Callable[[list[str]], object]:
    if key not in _LOADED:
        _LOADED[key] = model.load()
        while len(_LOADED) > MOST_LOADED:
            _LOADED.popitem(last=False)
    return _LOADED[key]


def _rows(x: np.ndarray, error: str) -> pa.Array:
    n, dimension = x.shape
    flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dimension, np.ascontiguousarray(x, float).ravel())
    return pa.StructArray.from_arrays([flat, pa.array([error] * n, pa.string())], ["vector", "error"])


def vectors(model: Model, text: Column, query: bool = False) -> Column:
    """struct(vector, error) of a text; a null text is an empty one."""

    key = uuid.uuid4().hex

    @by_pieces(_MADE, model.batch)
    def made(texts: list) -> pa.Array:
        given, predict = [t or "" for t in texts], _loaded(key, model)
        try:
            with limited(model.limits):
                found = predict(given)
            return _rows(_settled(found, len(given), model), "")
        except Late:
            error = f"{TIMEOUT}: more than {model.limits.seconds:g} s"
        except MemoryError:
            error = f"{OUT_OF_MEMORY}: more than {model.limits.memory_mb} MB"
        except (ValueError, TypeError) as e:
            error = f"{OUTPUT_INVALID}: {e}"
        except Exception as e:  # noqa: BLE001  a model may fail in any way
            error = f"{RUNTIME_ERROR}: {type(e).__name__}: {e}"
        return _rows(np.zeros((len(given), model.dimension)), error)

    given = F.coalesce(text, F.lit(""))
    if model.max_tokens:
        given = T.truncated(given, model.max_tokens)
    if query and model.prefix:
        given = F.concat(F.lit(model.prefix), given)
    found = made(given)
    good = found["error"] == ""
    return F.struct(F.when(good, found["vector"]).alias("vector"), F.when(~good, found["error"]).alias("error"))


def embedded(rows: DataFrame, model: Model, text: str = "content", cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with embedding and error, new cache entries: key, vector); cache: key, vector of earlier calls. Each distinct key is embedded once."""
    keyed = rows.withColumn("_key", T.embed_key(model.name, F.coalesce(F.col(text), F.lit(""))))
    each = keyed.groupBy("_key").agg(F.min(text).alias("_text"))
    if cache is not None:
        each = each.join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    made = each.select(F.col("_key").alias("key"), vectors(model, F.col("_text")).alias("_made")).select("key", "_made.vector", "_made.error")
    fresh = made.filter("error IS NULL").select("key", "vector")
    known = made if cache is None else made.unionByName(cache.select("key", "vector", F.lit(None).cast("string").alias("error")))
    out = keyed.join(known.select(F.col("key").alias("_key"), F.col("vector").alias("embedding"), "error"), "_key", "left").drop("_key")
    return out, fresh
