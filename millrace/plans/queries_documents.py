"""Ingestion, content, crawling and store queries over documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions import slots
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import ingest
from millrace.operators import tables as O
from millrace.plans.base import query
from millrace.plans.graph import Graph
from millrace.sources.store import PointStore
from millrace.sources.tables import import_golden, read_files, shared_folder, table
from millrace.streaming.windows import ingest_new, run_available, stream_rate

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# content and hashing

@query("hash_map", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def hash_map(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("dedupe_hash", "SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1 THEN 'accepted' ELSE 'skipped' END AS status FROM documents")
def dedupe_hash(spark, d):
    """One document of a source and content hash is accepted; by least id, so that a group of copies is an aggregate, not a window."""
    docs = _docs(spark, d).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    return docs.join(first, "doc_id", "left").select("doc_id", "source", F.when(F.col("first"), "accepted").otherwise("skipped").alias("status"))


@query("register_docs", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 1 AND sha256(o.text) = sha256(documents.text)) THEN 'known' ELSE 'new' END AS status FROM documents WHERE doc_id % 2 = 0")
def register_docs(spark, d):
    docs = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("h"))
    known = docs.filter("doc_id % 2 = 1").select("h").distinct().withColumn("known", F.lit(True))
    return docs.filter("doc_id % 2 = 0").join(known, "h", "left").select("doc_id", F.when(F.col("known"), "known").otherwise("new").alias("status"))


@query("agg_sum_tokens", f"SELECT lang, count(*) AS docs, sum(len({_TOK}))::BIGINT AS tokens FROM documents GROUP BY 1")
def agg_sum_tokens(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("docs"), F.sum(T.token_count(F.col("text"))).alias("tokens"))


_CHUNKS_SQL = f"""WITH w AS (SELECT doc_id, {_TOK} AS w FROM documents), c AS (SELECT doc_id, i AS ordinal, w[i * 80 + 1 : i * 80 + 100] AS p FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 20 - 1) // 80 + 1)) AS i FROM w WHERE len(w) > 0))"""


@query("agg_count_chunks", _CHUNKS_SQL + " SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum(len(p))::BIGINT AS tokens FROM c JOIN documents USING (doc_id) GROUP BY 1")
def agg_count_chunks(spark, d):
    """Documents, chunks and tokens of each source."""
    chunks = ingest.fixed_chunks(_docs(spark, d), 100, 20).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"))
    return chunks.join(_docs(spark, d).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"), F.sum("t").alias("tokens"))


@query("chunk_fixed", _CHUNKS_SQL + " SELECT doc_id, ordinal, len(p) AS token_count, sha256(array_to_string(p, ' ')) AS content_hash FROM c")
def chunk_fixed(spark, d):
    return ingest.fixed_chunks(_docs(spark, d), 100, 20).select("doc_id", "ordinal", "token_count", "content_hash")


@query("inherit_meta", _CHUNKS_SQL + " SELECT c.doc_id, ordinal, lang, source FROM c JOIN documents USING (doc_id)")
def inherit_meta(spark, d):
    docs = _docs(spark, d)
    return ingest.fixed_chunks(docs, 100, 20).select("doc_id", "ordinal").join(docs.select("doc_id", "lang", "source"), "doc_id")


@query("win_prev_chunk", _CHUNKS_SQL + " SELECT doc_id, ordinal, lag(len(p)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS previous FROM c")
def win_prev_chunk(spark, d):
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return ingest.fixed_chunks(_docs(spark, d), 100, 20).select("doc_id", "ordinal", F.lag("token_count").over(w).alias("previous"))


def _chunker(kind: str):
    def run(spark, d):
        return ingest.chunk(_docs(spark, d), kind, 120).select("doc_id", "ordinal", "heading", "parent", "token_count", "content_hash")

    return run


for _kind in ingest.CHUNKERS:
    query(f"chunk_{_kind}")(_chunker(_kind))


@query("chunk_merge_forward")
def chunk_merge_forward(spark, d):
    chunks = ingest.chunk(_docs(spark, d), "recursive", 60)
    return ingest.merge_forward(chunks, 40).select("doc_id", "ordinal", "token_count", F.sha2("content", 256).alias("content_hash"))


@query("fn_sentences", "SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?。！？；])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS n FROM documents")
def fn_sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query("fn_nfkc")
def fn_nfkc(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.nfkc(F.col("text")), 256).alias("h"))


@query("fn_truncate", f"SELECT doc_id, least(50, len({_TOK})) AS n FROM documents")
def fn_truncate(spark, d):
    return _docs(spark, d).select("doc_id", T.token_count(T.truncated(F.col("text"), 50)).alias("n"))


@query("fn_redact", """SELECT event_id, '{"a":{"X-Api-Key":"[redacted]","list":[{"Session Id":"[redacted]","k":' || event_id || '}]},"passwd":"[redacted]","n":1}' AS detail FROM events""")
def fn_redact(spark, d):
    n = F.col("event_id").cast("string")
    made = F.concat(F.lit('{"a":{"X-Api-Key":"x'), n, F.lit('","list":[{"Session Id":7,"k":'), n, F.lit('}]},"passwd":{"b":1},"n":1}'))
    return table(spark, d, "events").select("event_id", S.redacted(made).alias("detail"))


@query("fn_scanned", "SELECT doc_id, n_chars < 100 * (1 + doc_id % 30) AS scanned FROM documents")
def fn_scanned(spark, d):
    """Documents as if they had so many pages: fewer than a hundred letters a page are a scan."""
    return _docs(spark, d).select("doc_id", T.scanned(F.col("n_chars"), 1 + F.col("doc_id") % 30).alias("scanned"))


@query("fn_uuid7", """
WITH m AS (SELECT event_id, lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') AS t, md5(event_id::VARCHAR) AS r FROM events)
SELECT event_id, t[1:8] || '-' || t[9:12] || '-7' || r[1:3] || '-' || ['8', '9', 'a', 'b'][(instr('0123456789abcdef', r[4:4]) - 1) % 4 + 1] || r[5:7] || '-' || r[8:19] AS id FROM m
""")
def fn_uuid7(spark, d):
    """Time-ordered ids of events, the same whenever they are worked out."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", S.uuid7(ms, F.col("event_id")).alias("id"))


@query("fn_public_id", """
SELECT doc_id, 'doc_' || array_to_string(list_transform(range(25, -1, -1), lambda k: '0123456789abcdefghjkmnpqrstvwxyz'[(((28672::UHUGEINT << 64) + (1::UHUGEINT << 63) + doc_id::UHUGEINT >> (5 * k)::UHUGEINT) & 31::UHUGEINT)::INT + 1]), '') AS public, TRUE AS round_trip FROM documents
""")
def fn_public_id(spark, d):
    made = F.concat(F.lit("00000000-0000-7000-8000-"), F.lpad(F.hex("doc_id"), 12, "0"))
    public = _docs(spark, d).select("doc_id", F.lower(made).alias("u")).withColumn("public", S.public_id("doc")(F.col("u")))
    return public.select("doc_id", "public", (S.internal_id("doc")(F.col("public")) == F.col("u")).alias("round_trip"))


@query("fn_blocked_address", """
WITH a AS (SELECT event_id, (event_id % 256) * 16777216 + (user_id % 256) * 65536 + 1 AS n FROM events),
b AS (SELECT unnest([[0, 8], [167772160, 8], [1681915904, 10], [2130706432, 8], [2851995648, 16], [2886729728, 12], [3221225472, 24], [3232235520, 16], [3323068416, 15], [3758096384, 4], [4026531840, 4]]) AS x)
SELECT event_id, EXISTS (SELECT 1 FROM b WHERE n >= x[1] AND n < x[1] + pow(2, 32 - x[2])) AS blocked, n >= 268435456 AND n < 536870912 AS allowed FROM a
""")
def fn_blocked_address(spark, d):
    ip = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("0"), F.lit("1"))
    return table(spark, d, "events").select("event_id", S.blocked_address(ip).alias("blocked"), S.allowed_address(ip, ["16.0.0.0/4"]).alias("allowed"))


_PASSWORD_SQL = "(SELECT c_custkey, c_name, CASE c_custkey % 4 WHEN 0 THEN c_name || '!' WHEN 1 THEN 'short1' WHEN 2 THEN '12Letmein99!' ELSE repeat('aB3', 60) END AS p FROM customer)"


@query("fn_password_rules", f"""SELECT c_custkey, concat_ws(',',
    CASE WHEN length(p) < 12 THEN 'TOO_SHORT' END, CASE WHEN length(p) > 128 THEN 'TOO_LONG' END,
    CASE WHEN regexp_matches(p, '[a-z]')::INT + regexp_matches(p, '[A-Z]')::INT + regexp_matches(p, '[0-9]')::INT + regexp_matches(p, '[^A-Za-z0-9]')::INT < 3 THEN 'INSUFFICIENT_CHARACTER_CLASSES' END,
    CASE WHEN regexp_replace(lower(p), '^[^a-z]+|[^a-z]+$', '', 'g') IN ('letmein', 'password') OR lower(p) IN ('letmein', 'password') THEN 'COMMON_PASSWORD' END,
    CASE WHEN length(c_name) >= 3 AND contains(lower(p), lower(c_name)) THEN 'CONTAINS_USERNAME' END) AS broken FROM {_PASSWORD_SQL}""")
def fn_password_rules(spark, d):
    k = F.col("c_custkey") % 4
    p = F.when(k == 0, F.concat("c_name", F.lit("!"))).when(k == 1, "short1").when(k == 2, "12Letmein99!").otherwise("aB3" * 60)
    return table(spark, d, "customer").select("c_custkey", F.array_join(S.password_report(p, F.col("c_name"), ["letmein", "password"]), ",").alias("broken"))


# incremental change

@query("antijoin_incremental", "SELECT coalesce(a.h, b.h) AS content_hash, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 <> 1) b ON a.h = b.h")
def antijoin_incremental(spark, d):
    docs = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return O.hash_diff(docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 <> 1"), ["content_hash"])


@query("set_diff_hash", "SELECT DISTINCT sha256(text) AS content_hash FROM documents a WHERE doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 3 <> 0 AND sha256(b.text) = sha256(a.text))")
def set_diff_hash(spark, d):
    docs = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.filter("doc_id % 3 = 0").join(docs.filter("doc_id % 3 <> 0").select("content_hash").distinct(), "content_hash", "left_anti").select("content_hash").distinct()


_TURNS = "SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'edited ' || conv_id ELSE coalesce(text, '') END AS content, turn % 4 = 1 AS is_edited FROM conversations"


def _edits(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations").filter("turn % 4 = 1").select("conv_id", "turn", F.concat(F.lit("edited "), F.col("conv_id").cast("string")).alias("content"))
    lost = rows.select("conv_id").distinct().select("conv_id", F.lit(99).cast("long").alias("turn"), F.lit("lost").alias("content"))
    return rows.unionByName(lost)


@query("carry_edits_join", _TURNS)
def carry_edits_join(spark, d):
    new = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("content"))
    return O.carry_edits(new, _edits(spark, d), ["conv_id", "turn"])[0].select("conv_id", "turn", "content", "is_edited")


@query("agg_orphans", "SELECT count(*) AS orphans FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn % 4 = 1)")
def agg_orphans(spark, d):
    new = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    return O.carry_edits(new, _edits(spark, d), ["conv_id", "turn"])[1].agg(F.count("*").alias("orphans"))


@query("edited_rows", f"SELECT conv_id, turn FROM ({_TURNS}) WHERE is_edited")
def edited_rows(spark, d):
    return carry_edits_join(spark, d).filter("is_edited").select("conv_id", "turn")


@query("chunk_edit", f"SELECT conv_id, turn, sha256(content) AS content_hash FROM ({_TURNS}) WHERE is_edited")
def chunk_edit(spark, d):
    return carry_edits_join(spark, d).filter("is_edited").select("conv_id", "turn", F.sha2("content", 256).alias("content_hash"))


@query("bulk_insert", "SELECT conv_id, turn, role FROM conversations WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id, turn + 1000, 'replaced' FROM conversations WHERE conv_id % 5 = 0")
def bulk_insert(spark, d):
    old = table(spark, d, "conversations").select("conv_id", "turn", "role")
    new = old.filter("conv_id % 5 = 0").select("conv_id", (F.col("turn") + 1000).alias("turn"), F.lit("replaced").alias("role"))
    return old.join(new.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(new)


@query("mcp_get_doc", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def mcp_get_doc(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("content"))


@query("chunk_split_merge", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, half) - 1 AS ordinal, length(part) AS n FROM (SELECT conv_id, turn, unnest([0, 1]) AS half, unnest([left(text, length(text) // 2), substr(text, length(text) // 2 + 1)]) AS part FROM conversations)")
def chunk_split_merge(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.array(F.substring(F.col("text"), F.lit(1), half), F.substr(F.col("text"), half + 1))).alias("half", "part"))
    return rows.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "half")) - 1).alias("ordinal"), F.length("part").alias("n"))


# pages

_NORMAL = "lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || substr(u, length(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) + 1)"
_URLS = f"(SELECT page_id, html, {_NORMAL} AS url FROM (SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS u FROM pages))"


@query("url_hash", f"SELECT page_id, url, sha256(url) AS url_hash FROM {_URLS}")
def url_hash(spark, d):
    return table(spark, d, "pages").select("page_id", ingest.normal_url(F.col("url")).alias("url"), ingest.url_hash(F.col("url")).alias("url_hash"))


@query("set_union_frontier", f"SELECT DISTINCT sha256(url) AS url_hash FROM {_URLS} WHERE url LIKE 'https://%'")
def set_union_frontier(spark, d):
    pages = table(spark, d, "pages").filter(F.lower("url").startswith("https://"))
    seeds, sitemap = pages.filter("page_id % 2 = 0").select("url"), pages.filter("page_id % 2 = 1").select("url")
    return seeds.unionByName(sitemap).select(ingest.url_hash(F.col("url")).alias("url_hash")).distinct()


@query("crawl_recrawl", f"SELECT url_hash, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'gone' WHEN o = n THEN 'unchanged' ELSE 'updated' END AS outcome FROM (SELECT sha256(url) AS url_hash, max(sha256(html)) AS o FROM {_URLS} WHERE page_id % 4 <> 0 GROUP BY 1) a FULL JOIN (SELECT sha256(url) AS url_hash, max(CASE WHEN page_id % 4 = 2 THEN sha256(html || 'x') ELSE sha256(html) END) AS n FROM {_URLS} WHERE page_id % 4 <> 1 GROUP BY 1) b USING (url_hash)")
def crawl_recrawl(spark, d):
    p = table(spark, d, "pages").withColumn("url_hash", ingest.url_hash(F.col("url")))
    known = p.filter("page_id % 4 <> 0").groupBy("url_hash").agg(F.max(F.sha2("html", 256)).alias("content_hash"))
    new = F.when(F.col("page_id") % 4 == 2, F.sha2(F.concat("html", F.lit("x")), 256)).otherwise(F.sha2("html", 256))
    return ingest.recrawl(known, p.filter("page_id % 4 <> 1").groupBy("url_hash").agg(F.max(new).alias("content_hash")))


@query("agg_crawl_report", f"SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'gone' WHEN o = n THEN 'unchanged' ELSE 'updated' END AS outcome FROM (SELECT sha256(url) AS url_hash, max(sha256(html)) AS o FROM {_URLS} WHERE page_id % 4 <> 0 GROUP BY 1) a FULL JOIN (SELECT sha256(url) AS url_hash, max(CASE WHEN page_id % 4 = 2 THEN sha256(html || 'x') ELSE sha256(html) END) AS n FROM {_URLS} WHERE page_id % 4 <> 1 GROUP BY 1) b USING (url_hash)) GROUP BY 1")
def agg_crawl_report(spark, d):
    return crawl_recrawl(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query("antijoin_gone", f"SELECT DISTINCT sha256(url) AS url_hash FROM {_URLS} WHERE sha256(url) NOT IN (SELECT sha256(url) FROM {_URLS} WHERE page_id % 4 <> 1)")
def antijoin_gone(spark, d):
    return crawl_recrawl(spark, d).filter("outcome = 'gone'").select("url_hash")


@query("src_crawl", f"""
WITH RECURSIVE e AS (SELECT DISTINCT a.url, b.url AS "to" FROM {_URLS} a JOIN {_URLS} b ON b.page_id BETWEEN a.page_id + 1 AND a.page_id + 3),
w(url, depth) AS (SELECT DISTINCT url, 0 FROM {_URLS} WHERE page_id % 50 = 0 UNION SELECT e."to", depth + 1 FROM w JOIN e ON e.url = w.url WHERE depth < 4)
SELECT url, min(depth)::INTEGER AS depth FROM w GROUP BY 1
""")
def src_crawl(spark, d):
    """A crawl over the pages' own hosts, from every fiftieth page on: every page links to the pages with the next ids."""
    p = table(spark, d, "pages").select("page_id", "url")
    links = p.select("url", F.explode(F.sequence(F.col("page_id") + 1, F.col("page_id") + 3)).alias("next")).join(p.select(F.col("page_id").alias("next"), F.col("url").alias("to")), "next").select("url", "to")
    return ingest.frontier(p.filter("page_id % 50 = 0"), links, "^https?://", 4)


@query("parse_html")
def parse_html(spark, d):
    return table(spark, d, "pages").select("page_id", ingest.parse_html(F.col("html")).alias("p")).select("page_id", "p.title", F.length("p.text").alias("chars"), F.size("p.links").alias("links"))


# embedding

@query("embed_docs")
def embed_docs(spark, d):
    """The embedding of each document, with its length: 1, or 0 of a text without words."""
    made = _docs(spark, d).select("doc_id", slots.hashed_embedding(F.col("text"), 16).alias("embedding"))
    return made.select("doc_id", "embedding", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("embed_cache")
def embed_cache(spark, d):
    """hit where another document with a lower id has the same key: each key is embedded once."""
    keys = _docs(spark, d).select("doc_id", T.embed_key("hashed-16", F.col("text")).alias("k"))
    first = keys.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(False).alias("hit"))
    return keys.join(first, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(True)).alias("hit"))


@query("slot_enrich", "SELECT doc_id, lower(left(text, 20)) AS value, NULL::VARCHAR AS error FROM documents")
def slot_enrich(spark, d):
    run = slots.enrich("def run(text, context):\n    return text[:context['n']].lower()\n", {"n": 20})
    return _docs(spark, d).select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.value", "r.error")


@query("pipeline_graph", _CHUNKS_SQL.replace("i * 80 + 1 : i * 80 + 100", "i * 50 + 1 : i * 50 + 50").replace("greatest(0, len(w) - 20 - 1) // 80", "greatest(0, len(w) - 0 - 1) // 50").replace("FROM documents)", "FROM documents WHERE lang = 'en')", 1) + " SELECT sha256(array_to_string(p, ' ')) AS content_hash, min(len(p)) AS token_count FROM c GROUP BY 1 HAVING min(len(p)) >= 10")
def pipeline_graph(spark, d):
    graph = Graph(
        {"docs": {"type": "source"}, "en": {"type": "filter", "where": "lang = 'en'"}, "cut": {"type": "chunk", "size": 50}, "long": {"type": "filter_chunks", "where": "token_count >= 10"}, "once": {"type": "dedupe"}},
        [("docs", "en", 0), ("en", "cut", 0), ("cut", "long", 0), ("long", "once", 0)],
    )
    return Graph.from_json(graph.to_json()).run(docs=_docs(spark, d)).select("content_hash", "token_count")


# stores, files and streams

@query("ns_roundtrip", "SELECT vec_id::VARCHAR AS id, label, round(score, 6) AS score FROM (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS score FROM embeddings WHERE label >= 5 AND label <> 7) ORDER BY score DESC, id LIMIT 20")
def ns_roundtrip(spark, d):
    """A namespace is made, filled twice with the same points, thinned out by a condition and searched."""
    points = table(spark, d, "embeddings")
    store = PointStore(spark, shared_folder(spark, "store"))
    store.ensure("vectors", 64)
    rows = points.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("dense"), F.to_json(F.struct(F.col("label"))).alias("payload"))
    store.upsert("vectors", rows)
    store.upsert("vectors", rows.filter("id % 2 = 0"))
    store.delete("vectors", where={"label": 7})
    hits = store.search("vectors", list(points.filter("vec_id = 1").first().embedding), k=20, where={"label": {"$gte": 5}})
    return hits.select("id", F.try_variant_get("payload", "$.label", "int").alias("label"), "score")


@query("obj_list", "SELECT lang || '.json' AS name, count(*) AS n FROM documents GROUP BY lang")
def obj_list(spark, d):
    """Objects by key: one JSON file for each language, listed and counted again."""
    folder = shared_folder(spark, "objects")
    docs = _docs(spark, d).select("doc_id", "lang")
    docs.repartition("lang").withColumn("key", F.col("lang")).write.partitionBy("key").json(folder)
    back = spark.read.schema("doc_id long, lang string, key string").json(folder)
    return back.groupBy(F.concat("lang", F.lit(".json")).alias("name")).agg(F.count("*").alias("n"))


@query("obj_head", "SELECT lang, count(*) > 0 AS there FROM documents GROUP BY lang")
def obj_head(spark, d):
    folder = shared_folder(spark, "heads")
    _docs(spark, d).select("lang", "doc_id").repartition("lang").write.partitionBy("lang").json(folder)
    files = read_files(spark, folder, "binary").select("path", "length").filter("path LIKE '%lang=%'")
    return files.groupBy(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")).agg((F.sum("length") > 0).alias("there"))


@query("src_upload_formats", "SELECT 'csv' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'json', count(*) FROM customer UNION ALL SELECT 'orc', count(*) FROM customer")
def src_upload_formats(spark, d):
    rows, out = table(spark, d, "customer").select("c_custkey", "c_name"), None
    for kind in ("csv", "json", "orc"):
        path = shared_folder(spark, kind)
        rows.write.format(kind).option("header", "true").save(path)
        one = read_files(spark, path, kind, "c_custkey long, c_name string").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("import_golden", "SELECT text AS query, item_id % 2 = 0 AS reviewed FROM benchmark")
def import_golden_items(spark, d):
    path = shared_folder(spark, "golden")
    table(spark, d, "benchmark").select(F.col("text").alias("query"), F.lit("a;b").alias("relevant_chunk_ids"), (F.col("item_id") % 2 == 0).alias("reviewed")).write.json(path)
    return import_golden(spark, path, "json")[0].select("query", "reviewed")


@query("stream_rate_window", "SELECT user_id, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS used, greatest(0, 2 - count(*)) AS remaining, count(*) > 2 AS over FROM events GROUP BY 1, 2")
def stream_rate_window(spark, d):
    """The stream over all events there are; complete mode, so its last result is the batch's."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    staged = shared_folder(spark, "events")
    events.select("user_id", "ts").write.parquet(staged)
    out = shared_folder(spark, "rates")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(staged)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    rates = stream_rate(stream, 2)
    rates.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", shared_folder(spark, "rates-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_ingest", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def stream_ingest(spark, d):
    """Documents as a stream, each content hash once, the second half given again."""
    docs = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    staged, out, state = shared_folder(spark, "docs"), shared_folder(spark, "ingested"), shared_folder(spark, "ingest-state")
    docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")).write.parquet(staged)
    docs.filter("doc_id % 2 = 0").groupBy("content_hash").agg(F.max("doc_id").alias("doc_id")).select("content_hash", "doc_id").write.mode("append").parquet(f"{staged}-again")
    schema = "content_hash string, doc_id long"
    ingest_new(spark, spark.readStream.schema(schema).parquet(staged), out, state, "content_hash")
    ingest_new(spark, spark.readStream.schema(schema).parquet(f"{staged}-again"), out, f"{state}-again", "content_hash")
    return spark.read.schema(schema).parquet(out).select("doc_id")


@query("stream_append", "SELECT event_id FROM events WHERE event_type = 'click'")
def stream_append(spark, d):
    staged, out = shared_folder(spark, "clicks"), shared_folder(spark, "clicks-out")
    table(spark, d, "events").select("event_id", "event_type").write.parquet(staged)
    stream = spark.readStream.schema("event_id long, event_type string").parquet(staged).filter("event_type = 'click'").select("event_id")
    run_available(stream, out, shared_folder(spark, "clicks-state"))
    return spark.read.schema("event_id long").parquet(out)
