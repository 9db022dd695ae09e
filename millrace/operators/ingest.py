"""Ingestion: chunking, merging of small chunks, parsing, crawling, deduplicating."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from millrace.functions import text as T
from millrace.functions.batches import by_pieces
from millrace.sources.tables import written

SEPARATORS = ["\n\n", "\n", ". ", " "]
#: Documents whose chunks a worker holds at once.
CHUNK_DOCS = 64
_SCHEMA = "ordinal int, content string, heading string, parent int"


def fixed_chunks(docs: DataFrame, size: int, overlap: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of `size` tokens, each `overlap` tokens into the one before: doc_id, ordinal, content, token_count, content_hash."""
    step = size - overlap
    words = docs.select(doc_id, T.tokens(F.col(text)).alias("w"))  # a filter on their number would have texts cut twice
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - overlap - 1), F.lit(step)))
    each = words.select(doc_id, "w", F.posexplode(starts).alias("ordinal", "_at"))
    part = F.slice("w", F.col("_at") + 1, F.lit(size))
    made = each.select(doc_id, "ordinal", F.array_join(part, " ").alias("content"), F.size(part).alias("token_count"))
    return made.withColumn("content_hash", F.sha2("content", 256))


def _split(text: str, most: int, separators: list[str]) -> list[str]:
    """Pieces of at most `most` words: the coarsest separator that serves, finer ones for pieces that are too long."""
    if len(text.split()) <= most:
        return [text] if text.strip() else []
    if not separators:
        words = text.split()
        return [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
    mark = separators[0].rstrip()  # a full stop stays with what it ends
    glue = separators[0][len(mark) :]
    pieces = text.split(separators[0])
    pieces = [p + mark for p in pieces[:-1]] + pieces[-1:]
    out: list[str] = []
    held: list[str] = []

    def give() -> None:
        out.extend(_split(held[0], most, separators[1:]) if len(held) == 1 else [glue.join(held)])
        held.clear()

    for piece in pieces:
        if held and sum(len(p.split()) for p in held) + len(piece.split()) > most:
            give()
        held.append(piece)
    if held:
        give()
    return [x for x in out if x.strip()]


def _recursive(text: str, most: int) -> list[tuple]:
    return [(k, x, None, None) for k, x in enumerate(_split(text, most, SEPARATORS))]


def _markdown(text: str, most: int) -> list[tuple]:
    """Sections below their headings; the heading path goes with each chunk."""
    path: list[tuple[int, str]] = []
    out: list[tuple] = []
    held: list[str] = []

    def flush() -> None:
        heading = " > ".join(h for _, h in path) or None
        for x in _split("\n".join(held), most, SEPARATORS):
            out.append((len(out), x, heading, None))
        held.clear()

    for line in text.split("\n"):
        m = re.match(r"(#{1,6})\s+(.*)", line)
        if m:
            flush()
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), m[2].strip()))
        else:
            held.append(line)
    flush()
    return out


def _parent_child(text: str, most: int) -> list[tuple]:
    """Parents of up to `most` words, each followed by its children of a quarter of that."""
    out: list[tuple] = []
    for p in _split(text, most, SEPARATORS):
        own = len(out)
        out.append((own, p, None, None))
        out += [(own + 1 + k, c, None, own) for k, c in enumerate(_split(p, max(1, most // 4), SEPARATORS))]
    return out


CHUNKERS = {"recursive": _recursive, "markdown": _markdown, "parent_child": _parent_child}


def chunk(docs: DataFrame, kind: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ordinal, content, heading, parent, token_count, content_hash by one of CHUNKERS."""
    work = CHUNKERS[kind]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, CHUNK_DOCS):
                some = part.slice(i, CHUNK_DOCS)
                made = [work(t or "", most) for t in some.column(1).to_pylist()]
                owner = pa.array([k for k, own in enumerate(made) for _ in own], pa.int64())
                fields = [pa.array([c[j] for own in made for c in own], kind) for j, kind in enumerate((pa.int32(), pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([some.column(0).take(owner), *fields], ["id", "ordinal", "content", "heading", "parent"])

    made = docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, {_SCHEMA}")
    return made.withColumn("token_count", T.token_count(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))


def merge_forward(chunks: DataFrame, least: int, doc_id: str = "doc_id") -> DataFrame:
    """Chunks of fewer than `least` tokens join the one after them (the last one, the one before); doc_id, ordinal, content, token_count.

    A document's chunks are one row here, as its text was one row before.
    """
    row = F.array_sort(F.collect_list(F.struct("ordinal", "content", "token_count")))
    docs = chunks.groupBy(doc_id).agg(row.alias("c"))
    zero = F.expr("named_struct('done', cast(array() as array<struct<content:string,token_count:bigint>>), 'text', '', 'n', 0L)")

    def step(s: Column, c: Column) -> Column:
        text = F.when(s["text"] == "", c["content"]).otherwise(F.concat(s["text"], F.lit("\n"), c["content"]))
        n = s["n"] + c["token_count"].cast("long")
        full = n >= least
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.struct(text.alias("content"), n.alias("token_count"))))).otherwise(s["done"]).alias("done"),
            F.when(full, "").otherwise(text).alias("text"), F.when(full, F.lit(0).cast("long")).otherwise(n).alias("n"),
        )

    def finish(s: Column) -> Column:
        rest = F.struct(s["text"].alias("content"), s["n"].alias("token_count"))
        last = F.element_at(s["done"], -1)
        joined = F.struct(F.concat(last["content"], F.lit("\n"), s["text"]).alias("content"), (last["token_count"] + s["n"]).alias("token_count"))
        return F.when(s["text"] == "", s["done"]).when(F.size(s["done"]) == 0, F.array(rest)).otherwise(F.concat(F.slice(s["done"], F.lit(1), F.size(s["done"]) - 1), F.array(joined)))

    merged = docs.select(doc_id, F.posexplode(F.aggregate("c", zero, step, finish)).alias("ordinal", "c"))
    return merged.select(doc_id, "ordinal", "c.content", "c.token_count")


_DROP = re.compile(r"<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_BLOCK = re.compile(r"</?(p|div|li|h[1-6]|br|tr|article|section|ul|ol|table|header|footer|nav)\b[^>]*>", re.I)
_LINK = re.compile(r"<a\b[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)", re.I)


@by_pieces(StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("links", ArrayType(StringType()))]))
def parse_html(pages: list) -> list:
    """Title, visible text (a line for each block) and link targets of a page."""

    def one(page):
        page = page or ""
        title = re.search(r"<title[^>]*>(.*?)</title>", page, re.S | re.I)
        body = re.sub(r"<[^>]*>", "", _BLOCK.sub("\n", _DROP.sub(" ", page)))
        lines = [" ".join(x.split()) for x in html.unescape(body).split("\n")]
        return {"title": html.unescape(title[1]).strip() if title else None, "text": "\n".join(x for x in lines if x), "links": _LINK.findall(page)}

    return [one(p) for p in pages]


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def url_hash(url: Column) -> Column:
    return F.sha2(normal_url(url), 256)


def frontier(seeds: DataFrame, links: DataFrame, scope: str, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """url, depth of what a breadth-first crawl reaches: seeds (url), links (url, to); one join a level, new urls only. Each layer is written, so the plan of a level is one join however deep it lies."""
    seen = layer = written(seeds.select(normal_url(F.col("url")).alias("url")).filter(F.col("url").rlike(scope)).distinct().withColumn("depth", F.lit(0)), "layer")
    edge = written(links.select(normal_url(F.col("url")).alias("url"), normal_url(F.col("to")).alias("to")).filter(F.col("to").rlike(scope)).distinct(), "edges")
    for depth in range(1, max_depth + 1):
        new = layer.select("url").join(edge, "url").select(F.col("to").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        layer = written(new.withColumn("depth", F.lit(depth)), "layer")
        if layer.isEmpty():
            break
        seen = seen.unionByName(layer)
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def recrawl(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """url_hash, outcome: added, updated, unchanged or gone, by content hash."""
    both = known.select("url_hash", F.col("content_hash").alias("_old")).join(fetched.select("url_hash", F.col("content_hash").alias("_new")), "url_hash", "full_outer")
    outcome = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "gone").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return both.select("url_hash", outcome.alias("outcome"))
