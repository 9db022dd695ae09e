"""User functions in five slots (parse, chunk, enrich, filter, rerank): checks before use, and batches with errors kept by row.

There is no sandbox: only trusted functions may be published.
"""

from __future__ import annotations

import ast
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from millrace.functions.batches import by_pieces

ARITY = {"parse": 2, "chunk": 2, "enrich": 2, "filter": 2, "rerank": 2}
ALLOWED = {"re", "json", "math", "datetime", "unicodedata", "string", "collections", "itertools", "html"}
MOST_BYTES = 256 * 1024
_TOKEN = re.compile(r"[^\W_]+")


def problems(slot: str, source: str) -> list[str]:
    """Why a source can't be published."""
    if slot not in ARITY:
        return [f"no slot {slot!r}"]
    if len(source.encode()) > MOST_BYTES:
        return ["the source is too long"]
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [f"line {e.lineno}: {e.msg}"]
    out = []
    runs = [n for n in tree.body if isinstance(n, ast.FunctionDef) and n.name == "run"]
    if len(runs) != 1:
        out.append("there must be one function run")
    elif len(runs[0].args.args) != ARITY[slot]:
        out.append(f"run must take {ARITY[slot]} arguments")
    for n in ast.walk(tree):
        names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
        out += [f"import of {m}" for m in names if m.split(".")[0] not in ALLOWED]
    return out


def enrich(source: str, context: dict | None = None):
    """A column function string -> struct(value, error) of a published run(text, context)."""
    if wrong := problems("enrich", source):
        raise ValueError("; ".join(wrong))

    @F.pandas_udf("struct<value:string,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        space: dict = {}
        exec(compile(source, "slot", "exec"), space)  # noqa: S102  published by a trusted author

        def one(t):
            try:
                return {"value": space["run"](t, context or {}), "error": None}
            except Exception as e:  # noqa: BLE001  a failure is this row's
                return {"value": None, "error": f"{type(e).__name__}: {e}"}

        return pd.DataFrame([one(t) for t in texts], columns=["value", "error"])

    return lambda text: run(text)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """The default embedder: signed counts of hashed tokens, of length 1. It knows words, not meanings."""

    @by_pieces(ArrayType(DoubleType()))
    def run(texts: list) -> pa.Array:
        words = [set(_TOKEN.findall((t or "").lower())) for t in texts]
        h = np.fromiter((zlib.crc32(w.encode()) for own in words for w in own), np.int64)
        row = np.repeat(np.arange(len(words)), [len(own) for own in words])
        v = np.bincount(row * dim + h % dim, np.where(h >> 16 & 1, 1.0, -1.0), len(words) * dim).astype(float).reshape(len(words), dim)  # whole numbers where no text has a word
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, size, out=v, where=size > 0)
        return pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * dim, v.ravel())

    return run(text)
