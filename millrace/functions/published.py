"""Published functions in the slots parse, chunk, filter and rerank, run by Spark with a failure kept where it belongs.

parse and chunk are table functions that rows are joined to laterally: a document in, its blocks or chunks out, and one
error row for a document whose function fails. filter and rerank see the hits of one query at a time, at most the
candidates that the search keeps; a query whose function fails keeps its hits in the old order, with a notice.

Every call gets a fresh namespace, so nothing is carried from one to the next, and limits on time, memory and output. It
is no sandbox: a trusted author publishes, as functions/slots.py says.
"""

from __future__ import annotations

import io
import json
import resource
import signal
import sys
import threading
import traceback
from collections.abc import Callable, Iterator
from contextlib import contextmanager, redirect_stdout
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions import slots
from millrace.functions import text as T

# The codes by which a failed call is told.
RUNTIME_ERROR = "FUNCTION_RUNTIME_ERROR"
TIMEOUT = "FUNCTION_TIMEOUT"
OUT_OF_MEMORY = "FUNCTION_OOM"
OUTPUT_INVALID = "FUNCTION_OUTPUT_INVALID"

_NAME = "<slot>"
BLOCKS = "ordinal int, kind string, content string, page int, title string, error string"
CHUNKS = "ordinal int, content string, heading string, page int, parent int, error string"


@dataclass(frozen=True)
class Limits:
    seconds: float = 30.0
    memory_mb: int = 512
    output_bytes: int = 8 << 20


class Rejected(ValueError):
    """A result that isn't what the slot returns."""


class Late(BaseException):
    """Not an Exception, so a function that catches all of these is still stopped."""


@contextmanager
def limited(limits: Limits) -> Iterator[None]:
    """Time by a repeated alarm, memory by the address space beyond what the worker has; only the main thread can have alarms."""
    timed = threading.current_thread() is threading.main_thread()

    def late(*_: Any) -> None:
        raise Late

    with open("/proc/self/statm") as f:
        now = int(f.read().split()[0]) * resource.getpagesize()
    had = resource.getrlimit(resource.RLIMIT_AS)
    most = now + (limits.memory_mb << 20)
    if had[1] == resource.RLIM_INFINITY or most < had[1]:
        resource.setrlimit(resource.RLIMIT_AS, (most, had[1]))
    before = signal.signal(signal.SIGALRM, late) if timed else None
    try:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, limits.seconds, 0.05)
        yield
    finally:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
        resource.setrlimit(resource.RLIMIT_AS, had)


def _own_frames(e: BaseException) -> str:
    lines = [f.lineno for f in traceback.extract_tb(e.__traceback__) if f.filename == _NAME]
    return f" (line {lines[-1]})" if lines else ""


class Call:
    """A published function; a call gives (its result as settled by check, None) or (None, code: what went wrong)."""

    def __init__(self, slot: str, source: str, check: Callable[[Any], Any], limits: Limits = Limits()):
        if wrong := slots.problems(slot, source):
            raise ValueError("; ".join(wrong))
        self.source, self.check, self.limits = source, check, limits

    def __call__(self, *given: Any) -> tuple[Any, str | None]:
        space: dict[str, Any] = {}
        try:
            try:
                with redirect_stdout(io.StringIO()), limited(self.limits):
                    exec(compile(self.source, _NAME, "exec"), space)  # noqa: S102  published by a trusted author
                    made = space["run"](*given)
            except Late:
                return None, f"{TIMEOUT}: more than {self.limits.seconds:g} s"
            except MemoryError:
                return None, f"{OUT_OF_MEMORY}: more than {self.limits.memory_mb} MB"
            except Exception as e:  # noqa: BLE001  a failure is this call's
                return None, f"{RUNTIME_ERROR}: {type(e).__name__}: {e}{_own_frames(e)}"
            size = len(json.dumps(made, default=str, ensure_ascii=False).encode("utf-8", "replace"))
            if size > self.limits.output_bytes:
                return None, f"{OUTPUT_INVALID}: {size} bytes, more than {self.limits.output_bytes}"
            return self.check(made), None
        except Rejected as e:
            return None, f"{OUTPUT_INVALID}: {e}"
        except (TypeError, ValueError, RecursionError) as e:
            return None, f"{OUTPUT_INVALID}: {type(e).__name__}: {e}"


def _text(x: Any, what: str) -> str:
    if not isinstance(x, str):
        raise Rejected(f"{what} is {type(x).__name__}, not a string")
    return x


def _number(x: Any, what: str) -> int | None:
    if x is not None and (not isinstance(x, int) or isinstance(x, bool)):
        raise Rejected(f"{what} is {type(x).__name__}, not a number")
    return x


def _blocks(made: Any) -> list[tuple]:
    """A parsed document: a text, or {title, blocks: [text or {content, kind, page}]}."""
    if isinstance(made, str):
        made = {"blocks": [made]}
    if not isinstance(made, dict) or not isinstance(made.get("blocks"), list):
        raise Rejected("a parsed document is a text or has blocks")
    title = None if made.get("title") is None else _text(made["title"], "title")
    each = [{"content": b} if isinstance(b, str) else b for b in made["blocks"]]
    if not all(isinstance(b, dict) for b in each):
        raise Rejected("a block is a text or an object")
    return [(k, _text(b.get("kind", "text"), "kind"), _text(b.get("content"), "content"), _number(b.get("page"), "page"), title) for k, b in enumerate(each)]


def _chunks(made: Any) -> list[tuple]:
    """A list of texts or of {content, heading_path, page, parent}; parent is the place of a chunk before it."""
    if not isinstance(made, list):
        raise Rejected("chunks are a list")
    out = []
    for k, c in enumerate(made):
        c = {"content": c} if isinstance(c, str) else c
        if not isinstance(c, dict) or not _text(c.get("content"), "content").strip():
            raise Rejected(f"chunk {k} has no content")
        parent = _number(c.get("parent"), "parent")
        if parent is not None and not 0 <= parent < k:
            raise Rejected(f"chunk {k} has no parent {parent} before it")
        heading = c.get("heading_path")
        out.append((k, c["content"], None if heading is None else _text(heading, "heading_path"), _number(c.get("page"), "page"), parent))
    return out


def _table(call: Call, given: Callable[..., tuple], ddl: str):
    """The table function of a call: its rows with a null error, or one row that has only the error."""
    empty = (None,) * (ddl.count(",") or 0)

    class Rows:
        def eval(self, *row):
            made, error = call(*given(*row))
            if error is not None:
                yield (*empty, error)
            for x in made or []:
                yield (*x, None)

    return F.udtf(Rows, returnType=ddl, useArrow=False)  # rows come and go by 100, not by an Arrow batch of 10 000


def parsed(docs: DataFrame, source: str, data: str, mime: str | None = None, context: dict | None = None, limits: Limits = Limits()) -> DataFrame:
    """The documents joined to the blocks of a published run(data: bytes, context): BLOCKS; a null document has empty data."""
    made = _table(Call("parse", source, _blocks, limits), lambda d, m: (bytes(d or b""), (context or {}) | {"mime": m}), BLOCKS)
    kind = F.col(mime) if mime else F.lit(None).cast("string")
    row = docs.withColumn("_data", F.col(data).cast("binary")).withColumn("_mime", kind)
    return row.lateralJoin(made(F.col("_data").outer(), F.col("_mime").outer())).drop("_data", "_mime")


def chunked(docs: DataFrame, source: str, text: str = "text", title: str | None = None, config: dict | None = None, limits: Limits = Limits()) -> DataFrame:
    """The documents joined to the chunks of a published run(document {text, title}, config): CHUNKS, token_count, content_hash."""
    made = _table(Call("chunk", source, _chunks, limits), lambda t, h: ({"text": t or "", "title": h}, dict(config or {})), CHUNKS)
    row = docs.withColumn("_text", F.col(text)).withColumn("_title", F.col(title) if title else F.lit(None).cast("string"))
    rows = row.lateralJoin(made(F.col("_text").outer(), F.col("_title").outer())).drop("_text", "_title")
    return rows.withColumn("token_count", F.when(F.col("content").isNotNull(), T.token_count(F.col("content")))).withColumn("content_hash", F.sha2("content", 256))


def _per_query(hits: DataFrame, order: Callable[[list[dict]], tuple[list[tuple[int, float]], str | None]], query_id: str, candidates: int, kept: list[str]) -> DataFrame:
    """Each query's hits as `order` chooses them: (index, score) in their new order, or all as they are with a notice."""
    bounded = hits.filter(F.col("rank") <= candidates)
    schema = StructType([f for f in bounded.schema.fields if f.name != "notice"] + [StructField("notice", StringType())])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.select([f.name for f in arrow if f.name != "notice"]).sort_by("rank")
        chosen, notice = order(table.select(kept).to_pylist())
        if notice is not None:
            chosen = list(enumerate(table["score"].to_pylist()))
        out = table.take(pa.array([i for i, _ in chosen], pa.int64()))
        new = {"score": [s for _, s in chosen], "rank": list(range(1, len(chosen) + 1)), "notice": [notice] * len(chosen)}
        return pa.table([pa.array(new[f.name], f.type) if f.name in new else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return bounded.groupBy(query_id).applyInArrow(run, schema)


def _hits(made: Any, given: list[dict], id_col: str) -> list[tuple[int, float]]:
    place = {h[id_col]: i for i, h in enumerate(given)}
    if not isinstance(made, list) or not all(isinstance(h, dict) and id_col in h for h in made):
        raise Rejected("hits are a list of what was given")
    ids = [h[id_col] for h in made]
    if unknown := [i for i in ids if i not in place]:
        raise Rejected(f"hit {unknown[0]!r} wasn't given")
    if len(set(ids)) < len(ids):
        raise Rejected("a hit is returned twice")
    scores = [h.get("score") for h in made]
    if not all(isinstance(s, (int, float)) and not isinstance(s, bool) and s == s for s in scores):
        raise Rejected("a score isn't a number")
    return [(place[i], float(s)) for i, s in zip(ids, scores)]


def filter_hits(hits: DataFrame, source: str, id_col: str, query_id: str = "query_id", candidates: int = 100, context: dict | None = None, limits: Limits = Limits()) -> DataFrame:
    """The hits that a published run(hits, context) returns, in the old order, ranked anew, and notice; hits: query_id, id, score, rank and others, of which the function sees all."""
    Call("filter", source, list, limits)

    def order(given: list[dict]) -> tuple[list[tuple[int, float]], str | None]:
        made, error = Call("filter", source, lambda m: _hits(m, given, id_col), limits)([dict(h) for h in given], dict(context or {}))
        return sorted((i, given[i]["score"]) for i, _ in made or []), error

    return _per_query(hits, order, query_id, candidates, [c for c in hits.columns if c != "notice"])


def rerank_hits(hits: DataFrame, queries: DataFrame, source: str, id_col: str, query_id: str = "query_id", candidates: int = 100, limits: Limits = Limits()) -> DataFrame:
    """The hits by the scores that a published run(query, hits) gives them (ties in its order), ranked anew, and notice; a hit that isn't returned is a failure. queries: query_id, query."""
    Call("rerank", source, list, limits)
    asked = hits.join(queries.select(query_id, F.col("query").alias("_query")), query_id, "left")
    seen = [c for c in hits.columns if c not in ("notice", query_id)]

    def order(given: list[dict]) -> tuple[list[tuple[int, float]], str | None]:
        def check(made: Any) -> list[tuple[int, float]]:
            found = _hits(made, given, id_col)
            if len(found) != len(given):
                raise Rejected(f"{len(found)} of {len(given)} hits were returned")
            return sorted(found, key=lambda x: -x[1])

        query = given[0].get("_query") if given else None
        made, error = Call("rerank", source, check, limits)(query or "", [{k: h[k] for k in seen} for h in given])
        return made or [], error

    return _per_query(asked, order, query_id, candidates, [*seen, "_query"]).drop("_query")


def notices(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The queries whose function failed."""
    return hits.filter("notice IS NOT NULL").select(query_id, "notice").distinct()
