"""Pipeline graphs: named nodes of typed transforms, validated and composed into one lazy plan.

An edge is (from, to, port) or (from, to, port, out): a branch has an output for each of its conditions and one for the
rest. What a branch splits is worked out once and written by output, so each of its branches reads its own rows only, and
the source is scanned once. A map makes the items of a collection documents of their own, runs its subgraph over all
items of all rows as one plan, and gives the rows back with the row and the place they came from.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import published, slots
from millrace.functions import text as T
from millrace.operators import ingest, search, semantic
from millrace.sources.tables import shared_folder

#: name -> (input port types, output type, transform of (inputs, options)); types may depend on the node's options
NODES: dict[str, tuple[tuple[str, ...] | Callable[[dict], tuple[str, ...]], str | Callable[[dict], str], Callable[..., DataFrame]]] = {}
#: Nodes whose rows are given to `run`.
SOURCES = {"source": "docs", "query.input": "queries", "points.input": "points"}


def node(name: str, takes: tuple[str, ...] | Callable[[dict], tuple[str, ...]], gives: str | Callable[[dict], str]):
    def add(f):
        NODES[name] = (takes, gives, f)
        return f

    return add


def _takes(x: dict) -> tuple[str, ...]:
    takes = NODES[x["type"]][0]
    return takes(x) if callable(takes) else takes


def _gives(x: dict) -> str:
    gives = NODES[x["type"]][1]
    return gives(x) if callable(gives) else gives


def _outputs(x: dict) -> int:
    return len(x.get("when", [])) + 1 if x["type"] == "branch.condition" else 1


@dataclass
class Graph:
    nodes: dict[str, dict]
    edges: list[tuple] = field(default_factory=list)  # from, to, port and, of a branch, the output

    def to_json(self) -> str:
        return json.dumps({"nodes": self.nodes, "edges": self.edges}, sort_keys=True)

    @staticmethod
    def from_dict(made: dict) -> Graph:
        return Graph(made.get("nodes", {}), [tuple(e) for e in made.get("edges", [])])

    @staticmethod
    def from_json(text: str) -> Graph:
        return Graph.from_dict(json.loads(text))

    def ends(self) -> list[str]:
        return [n for n in self.nodes if not any(e[0] == n for e in self.edges)]

    def problems(self) -> list[str]:
        """What forbids a run; nodes that nothing leads to and that lead nowhere are named too."""
        out = [f"{n}: no node type {x.get('type')!r}" for n, x in self.nodes.items() if x.get("type") not in NODES]
        if out:
            return out
        for n, x in self.nodes.items():
            if x["type"] == "map":
                out += [f"{n}: {p}" for p in Graph.from_dict(x.get("graph", {})).problems()]
        if out:
            return out
        for a, b, port, *rest in self.edges:
            if a not in self.nodes or b not in self.nodes:
                out.append(f"edge {a} -> {b}: no such node")
                continue
            takes, gives = _takes(self.nodes[b]), _gives(self.nodes[a])
            if (rest[0] if rest else 0) >= _outputs(self.nodes[a]):
                out.append(f"{a}: no output {rest[0]}")
            if port >= len(takes):
                out.append(f"{b}: no port {port}")
            elif takes[port] != gives:
                out.append(f"edge {a} -> {b}: {gives} isn't {takes[port]}")
        for n, x in self.nodes.items():
            bound = [e[2] for e in self.edges if e[1] == n]
            missing = set(range(len(_takes(x)))) - set(bound)
            if missing:
                out.append(f"{n}: ports {sorted(missing)} aren't bound")
            if len(bound) != len(set(bound)):
                out.append(f"{n}: a port is bound twice")
        ends = self.ends()
        if len(ends) != 1:
            out.append(f"there must be one end, not {len(ends)}")
        if cycle := self._cycle():
            out.append("cycle: " + " -> ".join(cycle))
        return out

    def _cycle(self) -> list[str]:
        state: dict[str, int] = {}

        def visit(n: str, path: list[str]) -> list[str]:
            if state.get(n) == 1:
                return [*path[path.index(n) :], n]
            if state.get(n) == 2:
                return []
            state[n] = 1
            for a, b, *_ in self.edges:
                if a == n and (found := visit(b, [*path, n])):
                    return found
            state[n] = 2
            return []

        return next((c for n in self.nodes if (c := visit(n, []))), [])

    def run(self, **sources: DataFrame) -> DataFrame:
        """The end's DataFrame; nodes of type source take their rows from sources by name."""
        if wrong := self.problems():
            raise ValueError("; ".join(wrong))
        done: dict[tuple[str, int], DataFrame] = {}

        def make(n: str, output: int = 0) -> DataFrame:
            if (n, output) not in done:
                x = self.nodes[n]
                inputs = [] if x["type"] in SOURCES else [make(a, *rest) for a, b, _, *rest in sorted(self.edges, key=lambda e: e[2]) if b == n]
                options = {k: v for k, v in x.items() if k != "type"}
                if x["type"] in SOURCES:
                    done[n, 0] = sources[n]
                elif x["type"] == "branch.condition":
                    for k, part in enumerate(split(inputs[0], x.get("when", []))):
                        done[n, k] = part
                else:
                    done[n, 0] = NODES[x["type"]][2](*inputs, **options)
            return done[n, output]

        return make(self.ends()[0])


def split(df: DataFrame, conditions: list[str]) -> list[DataFrame]:
    """The rows for which each condition is the first that holds, and the rest: worked out once, and written by condition."""
    case = F.lit(len(conditions))
    for k in reversed(range(len(conditions))):
        case = F.when(F.coalesce(F.expr(conditions[k]), F.lit(False)), k).otherwise(case)
    path = shared_folder(df.sparkSession, "branch")
    df.withColumn("_case", case).write.partitionBy("_case").parquet(path)
    rows = df.sparkSession.read.schema(f"{df.schema.toDDL()}, _case int").parquet(path)
    return [rows.filter(F.col("_case") == k).drop("_case") for k in range(len(conditions) + 1)]


def mapped(docs: DataFrame, graph: dict, items: str, doc_id: str = "doc_id") -> DataFrame:
    """What the subgraph makes of the items (an expression: array<string>) of each row, with the row's id as doc_id and the item's place as item."""
    each = docs.select(F.col(doc_id).cast("string").alias("_row"), F.posexplode(F.expr(items)).alias("_item", "text"))
    sub = Graph.from_dict(graph)
    start = [n for n, x in sub.nodes.items() if x["type"] == "source"]
    made = sub.run(**{start[0]: each.select(F.concat_ws("/", "_row", F.col("_item").cast("string")).alias("doc_id"), "text")})
    row = F.regexp_extract("doc_id", "(?s)^(.*)/([0-9]+)$", 1).cast(docs.schema[doc_id].dataType)
    return made.withColumns({"item": F.regexp_extract("doc_id", "/([0-9]+)$", 1).cast("int"), "doc_id": row})


def assembled(hits: DataFrame, k: int) -> DataFrame:
    """query_id and its k best hits, in order."""
    best = hits.filter(F.col("rank") <= k)
    return best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("hits"))


def _sparse(queries: DataFrame, docs: DataFrame, k: int = 50) -> DataFrame:
    """BM25 of the words of each query: a stated set of queries, part of the plan."""
    asked = {r.query_id: r.words for r in queries.select("query_id", T.tokens(F.col("query")).alias("words")).toLocalIterator()}
    return search.bm25(docs, asked, k)


def _fused(*lists: DataFrame) -> DataFrame:
    return search.rrf(reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", "rank") for x in lists]), "doc_id")


def _enriched(chunks: DataFrame, source: str, context: dict | None = None) -> DataFrame:
    """Chunks with the content that a published function gives; where it fails, the old one and the error."""
    made = chunks.withColumn("_new", slots.enrich(source, context)(F.col("content")))
    rows = made.withColumns({"content": F.coalesce("_new.value", "content"), "error": F.col("_new.error")}).drop("_new")
    return rows.withColumns({"token_count": T.token_count(F.col("content")), "content_hash": F.sha2("content", 256)})


def _chunks(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    return ingest.fixed_chunks(docs, size, overlap)


def _once(chunks: DataFrame) -> DataFrame:
    """One chunk of each content."""
    least = chunks.groupBy("content_hash").agg(F.min(F.struct("doc_id", "ordinal")).alias("k"), F.first("content").alias("content"), F.first("token_count").alias("token_count"))
    return least.select("k.doc_id", "k.ordinal", "content", "token_count", "content_hash")


def _register() -> None:
    of = lambda x: x.get("of", "docs")  # noqa: E731  the type of what a branch splits
    for name, kind in SOURCES.items():
        node(name, (), kind)(lambda: None)
    node("chunk", ("docs",), "chunks")(_chunks)
    node("chunk.semantic", ("docs",), "chunks")(lambda docs, most: semantic.semantic_chunks(docs, most))
    node("chunk.function", ("docs",), "chunks")(lambda docs, source, config=None: published.chunked(docs.select("doc_id", "text"), source, config=config).filter("error IS NULL").select("doc_id", "ordinal", "content", "token_count", "content_hash"))
    node("parse.function", ("docs",), "docs")(lambda docs, source, data, context=None: published.parsed(docs.select("doc_id", data), source, data, context=context).filter("error IS NULL").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda b: b["content"]), "\n\n").alias("text")))
    node("enrich.function", ("chunks",), "chunks")(_enriched)
    node("filter", ("docs",), "docs")(lambda docs, where: docs.filter(where))
    node("filter_chunks", ("chunks",), "chunks")(lambda chunks, where: chunks.filter(where))
    node("dedupe", ("chunks",), "chunks")(_once)
    node("merge", lambda x: (of(x) if "of" in x else "chunks",) * 2, lambda x: of(x) if "of" in x else "chunks")(lambda a, b, of=None: a.unionByName(b))
    node("embed", ("chunks",), "points")(lambda chunks, dim=64: chunks.withColumn("embedding", slots.hashed_embedding(F.col("content"), dim)))
    node("branch.condition", lambda x: (of(x),), of)(lambda rows: rows)
    node("map", ("docs",), lambda x: _gives(x["graph"]["nodes"][Graph.from_dict(x["graph"]).ends()[0]]))(mapped)
    node("search.dense", ("queries", "points"), "hits")(lambda queries, points, k=50, metric="cosine": search.dense_batch(points, queries, k, metric, id_col="doc_id"))
    node("search.sparse", ("queries", "docs"), "hits")(_sparse)
    node("search.hybrid", ("queries", "points", "docs"), "hits")(lambda queries, points, docs, k=50: _fused(search.dense_batch(points, queries, k, id_col="doc_id"), _sparse(queries, docs, k)))
    node("fuse", ("hits", "hits"), "hits")(_fused)
    node("filter.function", ("hits",), "hits")(lambda hits, source, context=None, candidates=100: published.filter_hits(hits, source, "doc_id", candidates=candidates, context=context).drop("notice"))
    node("rerank.function", ("queries", "hits"), "hits")(lambda queries, hits, source, candidates=100: published.rerank_hits(hits, queries, source, "doc_id", candidates=candidates).drop("notice"))
    node("assemble.output", ("hits",), "result")(assembled)


_register()
