"""Published functions in their slots, and archives as a source, over documents, pages and embeddings."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import published
from millrace.operators import search
from millrace.plans.base import query
from millrace.sources import archives
from millrace.sources.tables import table

PARSE = """
import re

def run(data, context):
    page = data.decode("utf-8", "replace")
    title = re.search("<title>([^<]*)</title>", page)
    if context["mime"] != "text/html":
        raise ValueError("no page")
    return {"title": title[1] if title else None, "blocks": [{"kind": "p", "content": p} for p in re.findall("<p>([^<]*)</p>", page)]}
"""


@query("slot_parse", r"""
WITH p AS (SELECT page_id, page_id % 10 <> 0 AS good, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS b, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages)
SELECT page_id, (k - 1)::INTEGER AS ordinal, 'p' AS kind, b[k] AS content, title, NULL::VARCHAR AS error FROM (SELECT *, unnest(range(1, len(b) + 1)) AS k FROM p WHERE good)
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, 'FUNCTION_RUNTIME_ERROR: ValueError: no page (line 8)' FROM p WHERE NOT good
""")
def slot_parse(spark, d):
    """A published parser of pages; every tenth page comes as another kind of file, on which it fails."""
    pages = table(spark, d, "pages").select("page_id", "html", F.when(F.col("page_id") % 10 == 0, "application/pdf").otherwise("text/html").alias("mime"))
    return published.parsed(pages, PARSE, "html", "mime").select("page_id", "ordinal", "kind", "content", "title", "error")


CHUNK = """
def run(document, config):
    words = document["text"].split(" ")
    if len(words) > config["most"]:
        raise ValueError("too long")
    step = config["size"] - config["overlap"]
    starts = range(0, max(1, len(words) - config["overlap"]), step)
    return [{"content": "w " + " ".join(words[i:i + config["size"]]), "heading_path": document["title"]} for i in starts]
"""


@query("slot_chunk", r"""
WITH w AS (SELECT doc_id, lang, string_split(text, ' ') AS w FROM documents),
c AS (SELECT doc_id, lang, i AS k, array_to_string(w[i * 40 + 1 : i * 40 + 50], ' ') AS p FROM (SELECT *, unnest(range(0, (greatest(1, len(w) - 10) - 1) // 40 + 1)) AS i FROM w WHERE len(w) <= 2000))
SELECT doc_id, k::INTEGER AS ordinal, lang AS heading, sha256('w ' || p) AS content_hash, NULL::VARCHAR AS error FROM c
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'FUNCTION_RUNTIME_ERROR: ValueError: too long (line 5)' FROM w WHERE len(w) > 2000
""")
def slot_chunk(spark, d):
    """A published chunker of overlapping windows of words; it fails on long documents."""
    made = published.chunked(table(spark, d, "documents"), CHUNK, title="lang", config={"size": 50, "overlap": 10, "most": 2000})
    return made.select("doc_id", "ordinal", "heading", "content_hash", "error")


def _searched(spark, d):
    """The 20 nearest of all points for every point whose id is a multiple of 50."""
    points = table(spark, d, "embeddings")
    asked = points.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = search.dense_batch(points, asked, 20)
    return hits.join(points.select("vec_id", "label"), "vec_id")


_SEARCHED = """
WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20)
"""

FILTER = """
def run(hits, context):
    if any(h["query_id"] % 200 == 0 for h in hits):
        raise KeyError("access")
    return [h for h in hits if h["label"] in context["labels"]]
"""


@query("slot_filter", _SEARCHED + """
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank, CASE WHEN query_id % 200 = 0 THEN 'FUNCTION_RUNTIME_ERROR: KeyError: ''access'' (line 4)' END AS notice
FROM h WHERE query_id % 200 = 0 OR label IN (1, 3, 5)
""")
def slot_filter(spark, d):
    """A published filter of hits; queries on which it fails keep theirs, with a notice."""
    return published.filter_hits(_searched(spark, d), FILTER, "vec_id", context={"labels": [1, 3, 5]}).select("query_id", "vec_id", "rank", "notice")


RERANK = """
def run(query, hits):
    if query.endswith("50"):
        return hits[1:]
    return [dict(h, score=h["score"] if h["label"] % 2 else 2 * h["score"]) for h in hits]
"""


@query("slot_rerank", _SEARCHED + """
, n AS (SELECT *, query_id::VARCHAR LIKE '%50' AS bad, CASE WHEN query_id::VARCHAR NOT LIKE '%50' AND label % 2 = 0 THEN 2 * score ELSE score END AS new FROM h)
SELECT query_id, vec_id, round(new, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY new DESC, rank)::INTEGER AS rank, CASE WHEN bad THEN 'FUNCTION_OUTPUT_INVALID: 19 of 20 hits were returned' END AS notice
FROM n
""")
def slot_rerank(spark, d):
    """A published reranker that doubles the scores of even labels; queries for which it loses a hit keep the old order, with a notice."""
    hits = _searched(spark, d)
    queries = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")).distinct().select("query_id", F.concat(F.lit("points near "), F.col("query_id").cast("string")).alias("query"))
    return published.rerank_hits(hits, queries, RERANK, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank", "notice")


def _zipped(rows: pa.Table) -> pa.Table:
    """One archive of a bounded range of documents: each a file, named by its id; a link and a name that leads out among them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, text in sorted(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist())):
            x = zipfile.ZipInfo(f"../{k}.txt" if k % 40 == 7 else f"docs/{k}.txt")
            x.compress_type = zipfile.ZIP_DEFLATED
            x.external_attr = (0o120777 if k % 40 == 11 else 0o100644) << 16
            z.writestr(x, text or "")
    path = f"box-{rows['box'][0].as_py()}.zip"
    return pa.table({"path": [path], "content": [out.getvalue()]}, pa.schema([("path", pa.string()), ("content", pa.binary())]))


@query("src_archive", """
SELECT 'box-' || (doc_id // 100) || '.zip' AS path, CASE WHEN doc_id % 40 = 7 THEN '../' ELSE 'docs/' END || doc_id || '.txt' AS entry,
  CASE WHEN doc_id % 40 NOT IN (7, 11) THEN sha256(text) END AS sha256, CASE doc_id % 40 WHEN 7 THEN 'escapes the folder' WHEN 11 THEN 'is a link' END AS refusal
FROM documents
""")
def src_archive(spark, d):
    """Archives of a hundred documents each, unpacked: a row for each file or refusal."""
    boxes = table(spark, d, "documents").select(F.expr("doc_id div 100").alias("box"), "doc_id", "text").groupBy("box").applyInArrow(_zipped, "path string, content binary")
    made = archives.read_archives(boxes)
    return made.select("path", "entry", F.sha2("content", 256).alias("sha256"), "refusal")
