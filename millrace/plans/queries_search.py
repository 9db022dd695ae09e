"""Search, fusion and ranking over the embeddings and documents tables; vec_id is taken for doc_id where both meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import evaluation, retrieval, search
from millrace.plans.base import query
from millrace.sources.tables import table, written

_DOUBLES = "embedding::DOUBLE[]"
_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(_points(spark, d).filter(F.col("vec_id") == vec_id).first()["embedding"])


def _dense_sql(score: str, where: str = "TRUE", k: int = 10) -> str:
    return f"SELECT vec_id, label, round({score}, 6) AS score FROM embeddings WHERE {where} ORDER BY round({score}, 6) DESC, vec_id LIMIT {k}"


_COS = f"list_cosine_similarity({_DOUBLES}, {_Q0})"
_DOT = f"list_inner_product({_DOUBLES}, {_Q0})"
_L2 = f"-list_distance({_DOUBLES}, {_Q0})"


@query("dense_cosine", _dense_sql(_COS))
def dense_cosine(spark, d):
    return search.dense(_points(spark, d), _vector(spark, d))


@query("dense_dot", _dense_sql(_DOT))
def dense_dot(spark, d):
    return search.dense(_points(spark, d), _vector(spark, d), metric="dot")


@query("dense_l2", _dense_sql(_L2))
def dense_l2(spark, d):
    return search.dense(_points(spark, d), _vector(spark, d), metric="l2")


@query("dense_filtered", _dense_sql(_COS, "label IN (3, 7)"))
def dense_filtered(spark, d):
    return search.dense(_points(spark, d), _vector(spark, d), where=F.col("label").isin(3, 7))


@query("f_threshold", f"SELECT vec_id, label, score FROM ({_dense_sql(_COS, k=100)}) WHERE score >= 0.3")
def f_threshold(spark, d):
    return search.dense(_points(spark, d), _vector(spark, d), k=100, threshold=0.3)


@query("topk", _dense_sql(_COS, k=1000))
def topk(spark, d):
    return search.dense(_points(spark, d), _vector(spark, d), k=5000)


@query("payload_toggle", f"SELECT vec_id, score FROM ({_dense_sql(_COS)})")
def payload_toggle(spark, d):
    return search.dense(_points(spark, d).select("vec_id", "embedding"), _vector(spark, d))


@query("byo_vector", _dense_sql(f"list_cosine_similarity({_DOUBLES}, [CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END FOR i IN range(64)]::DOUBLE[])", k=20))
def byo_vector(spark, d):
    return search.dense(_points(spark, d), [1.0 if i % 2 == 0 else -1.0 for i in range(64)], k=20)


_BATCH_SQL = """
SELECT query_id, vec_id, score, rank FROM (
  SELECT q.vec_id AS query_id, p.vec_id, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) DESC, p.vec_id) AS rank
  FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0)
WHERE rank <= {k}
"""


def _batch(spark, d, k: int) -> DataFrame:
    points = _points(spark, d)
    queries = points.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.dense_batch(points, queries, k, digits=5)


@query("search_batch", _BATCH_SQL.format(k=5))
def search_batch(spark, d):
    return _batch(spark, d, 5)


@query("win_topk_per_query", _BATCH_SQL.format(k=3))
def win_topk_per_query(spark, d):
    return _batch(spark, d, 3)


@query("candidate_k", f"SELECT vec_id, label, score FROM ({_dense_sql(_COS, k=100)}) ORDER BY score DESC, vec_id LIMIT 5")
def candidate_k(spark, d):
    return search.top_k(search.dense(_points(spark, d), _vector(spark, d), k=100), 5, "vec_id")


@query("normalize_vec", f"SELECT vec_id, round(sqrt(list_inner_product({_DOUBLES}, {_DOUBLES})), 4) AS norm, TRUE AS unit FROM embeddings")
def normalize_vec(spark, d):
    v = _points(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"), V.normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", "norm", (F.abs(V.norm(F.col("v")) - 1) < 1e-6).alias("unit"))


@query("quantize", _dense_sql(_COS))
def quantize(spark, d):
    return search.quantized(_points(spark, d), _vector(spark, d), k=10)


#: Cells that a query of ann_index reads, of 32; README has the recall.
_PROBES = 24


@query("ann_index")
def ann_index(spark, d):
    """Inverted lists: every point is in the index, every 50th is a query; the hits of all queries."""
    points = _points(spark, d)
    queries = points.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.IvfIndex(points).search_batch(queries, 10, _PROBES)


@query("fetch_by_ids", "SELECT vec_id, label, 0.0 AS score FROM embeddings WHERE vec_id IN (1, 5, 17, 99)")
def fetch_by_ids(spark, d):
    ids = spark.createDataFrame([(1,), (5,), (17,), (99,), (-1,)], "vec_id long")
    return _points(spark, d).join(F.broadcast(ids), "vec_id", "left_semi").select("vec_id", "label", F.lit(0.0).alias("score"))


@query("count_points", "SELECT label, count(*) AS n FROM embeddings WHERE label >= 3 GROUP BY label")
def count_points(spark, d):
    return _points(spark, d).filter("label >= 3").groupBy("label").agg(F.count("*").alias("n"))


@query("sparse_dot", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN abs(q[i]) >= 0.2 AND abs(embedding[i]) >= 0.1 THEN q[i] * embedding[i]::DOUBLE ELSE 0 END)), 6) AS score FROM embeddings, q)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
""")
def sparse_dot(spark, d):
    """Sparse vectors (the large entries of all dimensions): the queries' terms go to the points, weights are summed by pair."""
    each = _points(spark, d).select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda c, i: F.struct(i.alias("term"), c.alias("weight"))).alias("t"))
    terms = each.select("vec_id", F.filter("t", lambda x: F.abs(x["weight"]) >= 0.1).alias("t")).select("vec_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    asked = each.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.explode("t").alias("x")).select("query_id", "x.term", F.col("x.weight").alias("asked")).filter(F.abs("asked") >= 0.2)
    return search.sparse_points(terms, asked, 20).select("query_id", "vec_id", "score")


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


@query("lexical_and", f"""
SELECT doc_id, score FROM (SELECT doc_id, round(len(list_filter(w, lambda x: x IN ('the', 'of', 'idiot')))::DOUBLE / len(w), 6) AS score FROM (SELECT doc_id, {_TOK} AS w FROM documents)
  WHERE list_contains(w, 'the') AND list_contains(w, 'of') AND list_contains(w, 'idiot')) ORDER BY score DESC, doc_id LIMIT 25""")
def lexical_and(spark, d):
    return search.lexical_all(table(spark, d, "documents"), ["the", "of", "idiot"], 25)


@query("lexical_overlap", """
SELECT doc_id, round(((contains(lower(text), 'idiot'))::INT + (contains(lower(text), 'clown'))::INT + (contains(lower(text), 'der'))::INT) / 3.0, 6) AS score
FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'clown') OR contains(lower(text), 'der') ORDER BY score DESC, doc_id LIMIT 30""")
def lexical_overlap(spark, d):
    return search.lexical_overlap(table(spark, d, "documents"), ["idiot", "clown", "der"], 30)


_QUERIES = {1: ["the", "idiot"], 2: ["der", "und"], 3: ["pathetic", "clown"]}
_BM25_SQL = f"""
WITH q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'idiot'), (2, 'der'), (2, 'und'), (3, 'pathetic'), (3, 'clown')) AS t(query_id, term)),
d AS (SELECT doc_id, {_TOK} AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM d),
f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT term FROM q) JOIN d ON list_contains(w, term) GROUP BY term),
x AS (SELECT query_id, doc_id, len(w) AS l, len(list_filter(w, lambda y: y = term)) AS tf, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf, avg_len FROM d, q LEFT JOIN f USING (term), s),
r AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / avg_len))), 6) AS score FROM x GROUP BY ALL)
"""


@query("bm25", _BM25_SQL + "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10")
def bm25(spark, d):
    return search.bm25(table(spark, d, "documents"), _QUERIES, 10)


@query("agg_corpus_stats", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK})) AS term FROM documents) GROUP BY term HAVING count(*) >= 20")
def agg_corpus_stats(spark, d):
    return search.corpus_stats(table(spark, d, "documents"))[0].filter("df >= 20")


_HYBRID_SQL = _BM25_SQL.replace("q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'idiot'), (2, 'der'), (2, 'und'), (3, 'pathetic'), (3, 'clown')) AS t(query_id, term))", "q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'idiot')) AS t(query_id, term))") + f""",
lists AS (
  SELECT 'dense' AS list, 1 AS query_id, vec_id AS doc_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({_dense_sql(_COS, k=50)})
  UNION ALL SELECT 'lexical', query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50)
"""


def _lists(spark, d) -> DataFrame:
    dense = search.dense(_points(spark, d), _vector(spark, d), k=50).select(F.lit("dense").alias("list"), F.lit(1).alias("query_id"), F.col("vec_id").alias("doc_id"), "score")
    dense = search.rank_by(dense, "query_id", "doc_id")
    lexical = search.bm25(table(spark, d, "documents"), {1: ["the", "idiot"]}, 50).select(F.lit("lexical").alias("list"), "query_id", "doc_id", "score", "rank")
    return dense.unionByName(lexical)


@query("win_rank_list", _HYBRID_SQL + "SELECT list, query_id, doc_id, score, rank FROM lists")
def win_rank_list(spark, d):
    return _lists(spark, d)


_FUSED = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum({w} / (60.0 + rank)), 6) AS score FROM lists GROUP BY ALL)"


@query("rrf", _HYBRID_SQL + _FUSED.format(w="1.0"))
def rrf(spark, d):
    return search.rrf(_lists(spark, d), "doc_id")


@query("hybrid_parallel", _HYBRID_SQL + "SELECT query_id, doc_id, score, rank FROM (" + _FUSED.format(w="1.0") + ") WHERE rank <= 10")
def hybrid_parallel(spark, d):
    return search.rrf(_lists(spark, d), "doc_id").filter("rank <= 10")


@query("federated", _HYBRID_SQL + _FUSED.format(w="(CASE list WHEN 'dense' THEN 2.0 ELSE 0.5 END)"))
def federated(spark, d):
    lists = _lists(spark, d)
    weights = spark.createDataFrame([("dense", 2.0), ("lexical", 0.5)], "list string, weight double")
    return search.rrf(lists.join(F.broadcast(weights), "list"), "doc_id", weight="weight")


@query("weighted_fuse", _HYBRID_SQL + """, m AS (SELECT *, min(score) OVER (PARTITION BY query_id, list) AS lo, max(score) OVER (PARTITION BY query_id, list) AS hi FROM lists)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum((CASE list WHEN 'dense' THEN 0.7 ELSE 0.3 END) * (CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END)), 6) AS score FROM m GROUP BY ALL)""")
def weighted_fuse(spark, d):
    return search.weighted(_lists(spark, d), {"dense": 0.7, "lexical": 0.3}, "doc_id")


@query("mode_switch", _HYBRID_SQL + "SELECT 'vector' AS mode, doc_id, rank FROM lists WHERE list = 'dense' AND rank <= 5 UNION ALL SELECT 'fulltext', doc_id, rank FROM lists WHERE list = 'lexical' AND rank <= 5")
def mode_switch(spark, d):
    mode = F.when(F.col("list") == "dense", "vector").otherwise("fulltext")
    return _lists(spark, d).filter("rank <= 5").select(mode.alias("mode"), "doc_id", "rank")


# stages after search, on the hits of one BM25 batch

_HITS_SQL = _BM25_SQL + ", h AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50)\n"


def _hits(spark, d) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), _QUERIES, 50)


def _with_docs(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", T.token_count(F.col("text")).alias("token_count"))
    return docs.join(F.broadcast(_hits(spark, d)), "doc_id")


_BEST = "SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT h.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS n FROM h JOIN documents USING (doc_id)) WHERE n = 1"


@query("dedupe_mode", _HITS_SQL + _BEST)
def dedupe_mode(spark, d):
    return retrieval.best_per(_with_docs(spark, d).select("query_id", "doc_id", "source", "score", "rank"), "source", "doc_id")


@query("win_best_per_doc", _HITS_SQL + "SELECT query_id, doc_id, source, score FROM (" + _BEST + ") WHERE rank <= 3")
def win_best_per_doc(spark, d):
    return retrieval.best_per(_with_docs(spark, d).select("query_id", "doc_id", "source", "score", "rank"), "source", "doc_id").filter("rank <= 3").drop("rank")


@query("parent_expand", _HITS_SQL + """, p AS (SELECT query_id, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id - doc_id % 3 END AS doc_id, max(score) AS score, list_sort(list_distinct(list(doc_id) FILTER (WHERE doc_id % 3 <> 0))) AS c FROM h GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, coalesce(array_to_string(c, ','), '') AS children FROM p""")
def parent_expand(spark, d):
    hits = _hits(spark, d).withColumn("parent_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") - F.col("doc_id") % 3))
    made = retrieval.expand_parents(hits, "parent_id", "doc_id")
    return made.select("query_id", "doc_id", "score", "rank", F.array_join(F.col("matched_child_ids").cast("array<string>"), ",").alias("children"))


_TOKENS = f", t AS (SELECT h.*, len({_TOK}) AS token_count FROM h JOIN documents USING (doc_id)), c AS (SELECT *, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank) AS total_tokens, sum(token_count) OVER (PARTITION BY query_id) > 3000 AS truncated FROM t)\n"


@query("token_budget", _HITS_SQL + _TOKENS + "SELECT query_id, doc_id, rank, token_count, total_tokens::BIGINT AS total_tokens, truncated FROM c WHERE total_tokens <= 3000")
def token_budget(spark, d):
    return retrieval.token_budget(_with_docs(spark, d), 3000).select("query_id", "doc_id", "rank", "token_count", "total_tokens", "truncated")


@query("win_running_tokens", _HITS_SQL + _TOKENS + "SELECT query_id, doc_id, total_tokens::BIGINT AS total_tokens FROM c")
def win_running_tokens(spark, d):
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _with_docs(spark, d).select("query_id", "doc_id", F.sum("token_count").over(w).alias("total_tokens"))


@query("rerank", _HITS_SQL + "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(h.score / ln(2 + n_chars), 6) AS score FROM h JOIN documents USING (doc_id))")
def rerank(spark, d):
    hits, _ = retrieval.rerank(_with_docs(spark, d), lambda: F.round(F.col("score") / F.log(2 + F.col("n_chars")), 6), "doc_id")
    return hits.select("query_id", "doc_id", "score", "rank")


_CHANGES = """, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(h.score / ln(2 + n_chars), 6) AS s FROM h JOIN documents USING (doc_id)))
SELECT query_id, doc_id, h.rank AS rank_before, x.rank AS rank_after, h.rank - x.rank AS change FROM h FULL JOIN (SELECT * FROM a WHERE rank <= 20) x USING (query_id, doc_id)"""


@query("explain", _HYBRID_SQL + f""",
fu AS ({_FUSED.format(w="1.0")}),
re AS (SELECT fu.query_id, fu.doc_id, round(fu.score / ln(2 + n_chars), 6) AS score, len({_TOK}) AS tokens FROM fu JOIN documents USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM re),
t AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM k WHERE score >= 0.001)
SELECT fu.query_id, fu.doc_id, d.rank AS dense, l.rank AS sparse, fu.rank AS fused, k.rank AS reranked, t.rank AS kept, CASE WHEN b.rank IS NOT NULL THEN b.rank END AS "returned",
  CASE WHEN k.rank IS NULL THEN 'rerank' WHEN t.rank IS NULL THEN 'threshold' WHEN b.rank IS NULL THEN 'budget' END AS dropped_by
FROM fu LEFT JOIN lists d ON d.list = 'dense' AND d.doc_id = fu.doc_id LEFT JOIN lists l ON l.list = 'lexical' AND l.doc_id = fu.doc_id LEFT JOIN k ON k.doc_id = fu.doc_id
LEFT JOIN t ON t.doc_id = fu.doc_id LEFT JOIN (SELECT * FROM t WHERE total <= 20000) b ON b.doc_id = fu.doc_id
""")
def explain(spark, d):
    """The rank of every candidate in each stage, and the stage that dropped it."""
    lists = written(_lists(spark, d), "lists")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", T.token_count(F.col("text")).alias("token_count"))
    trace = retrieval.Trace()
    trace.keep("dense", lists.filter("list = 'dense'"))
    trace.keep("sparse", lists.filter("list = 'lexical'"))
    fused = trace.keep("fused", search.rrf(lists, "doc_id"))
    ranked = trace.keep("reranked", retrieval.rerank(docs.join(F.broadcast(fused), "doc_id"), lambda: F.round(F.col("score") / F.log(2 + F.col("n_chars")), 6), "doc_id")[0])
    kept = trace.keep("kept", retrieval.threshold(ranked, 0.001))
    trace.keep("returned", retrieval.token_budget(kept, 20_000))
    return trace.explained("doc_id", {"reranked": "rerank", "kept": "threshold", "returned": "budget"})


@query("win_rank_change", _HITS_SQL + "SELECT query_id, doc_id, change FROM (" + _CHANGES.split("SELECT query_id, doc_id, h.rank", 1)[0].lstrip(", ").replace("a AS (", "SELECT query_id, doc_id, h.rank - a.rank AS change FROM h JOIN (", 1).rstrip().removesuffix(")") + ") a USING (query_id, doc_id))")
def win_rank_change(spark, d):
    after, _ = retrieval.rerank(_with_docs(spark, d), lambda: F.round(F.col("score") / F.log(2 + F.col("n_chars")), 6), "doc_id")
    return retrieval.rank_changes(_hits(spark, d), after, "doc_id").select("query_id", "doc_id", "change")


@query("mcp_search", _HITS_SQL + "SELECT query_id, doc_id, rank, '[' || rank || ']' AS citation, lang FROM h JOIN documents USING (doc_id) WHERE rank <= 20 AND lang = 'en'")
def mcp_search(spark, d):
    return retrieval.citations(_with_docs(spark, d).filter("rank <= 20 AND lang = 'en'")).select("query_id", "doc_id", "rank", "citation", "lang")


@query("dify_shape", _HITS_SQL + """
SELECT query_id, list(doc_id ORDER BY rank) AS doc_ids, list(sha256(text) ORDER BY rank) AS contents, list(source ORDER BY rank) AS titles, list(score ORDER BY rank) AS scores FROM h JOIN documents USING (doc_id) GROUP BY query_id
""")
def dify_shape(spark, d):
    """records of each query, all hits, best first: id, content (whole; its digest here), title and score."""
    docs = table(spark, d, "documents").join(F.broadcast(_hits(spark, d)), "doc_id")
    record = F.struct("rank", "doc_id", F.sha2("text", 256).alias("content"), F.col("source").alias("title"), "score")
    made = docs.groupBy("query_id").agg(F.array_sort(F.collect_list(record)).alias("records"))
    return made.select("query_id", F.col("records.doc_id").alias("doc_ids"), F.col("records.content").alias("contents"), F.col("records.title").alias("titles"), F.col("records.score").alias("scores"))


@query("highlights", "SELECT doc_id, term, instr(lower(text), term) - 1 AS start_at, instr(lower(text), term) - 1 + length(term) AS end_at FROM documents, (VALUES ('idiot'), ('clown')) AS t(term) WHERE contains(lower(text), term)")
def highlights(spark, d):
    spans = table(spark, d, "documents").select("doc_id", F.explode(T.highlights(F.col("text"), ["idiot", "clown"])).alias("s"))
    return spans.select("doc_id", "s.term", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@query("mmr")
def mmr(spark, d):
    points = _points(spark, d)
    hits = _batch(spark, d, 50).join(points.select("vec_id", "embedding"), "vec_id")
    return retrieval.mmr(hits, 10, "vec_id")


# evaluation: the benchmark's passages as queries, the documents that hold them as relevant, overlap of rare words as the run

_REL_SQL = "rel AS (SELECT b.item_id AS query_id, d.doc_id, 1 + coalesce(l.quality, 0) AS gain FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l USING (doc_id))"


#: Inner words of a passage that find the documents which may hold it.
_WINDOW = 6
#: Up to so many pairs of a passage and a document that may hold it are sent to all tasks.
BROADCAST_PAIRS = 100_000


def _window(at: Column) -> Column:
    """The key of the words from number `at` on, word by word: no text is joined for it."""
    return F.xxhash64(*[F.get("w", at + k) for k in range(_WINDOW)])


def _holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, doc_id of passages and the documents that hold them: by a window of inner words that both have, then verified.

    The first and last word of a passage may be parts of longer words, so the window leaves them out; passages that
    are too short for one are looked for as they are.
    """
    words = items.withColumn("w", T.tokens(F.col("passage")))
    keyed = words.filter(F.size("w") >= _WINDOW + 2).select("query_id", "passage", _window(F.lit(1)).alias("key"))
    places = F.when(F.size("w") >= _WINDOW, F.sequence(F.lit(0), F.size("w") - _WINDOW))  # a filter would have texts cut twice
    windows = docs.select("doc_id", T.tokens(F.col("text")).alias("w")).select("doc_id", "w", F.explode(places).alias("at")).select("doc_id", _window(F.col("at")).alias("key"))
    found = _verified(docs, windows.join(keyed, "key").select("doc_id", "query_id", "passage").distinct())
    few = words.filter((F.size("w") > 2) & (F.size("w") < _WINDOW + 2)).select("query_id", "passage", F.element_at("w", 2).alias("key"))
    if not few.isEmpty():
        single = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("key"))
        found = found.unionByName(_verified(docs, single.join(few, "key").select("doc_id", "query_id", "passage")))
    least = [F.when(F.contains("text", F.lit(r.passage)), F.lit(r.query_id)) for r in words.filter(F.size("w") < 3).select("query_id", "passage").toLocalIterator()]
    if least:  # one or two words: there is no whole word to find them by
        found = found.unionByName(docs.select(F.explode(F.array_compact(F.array(*least))).alias("query_id"), "doc_id"))
    return found


def _verified(docs: DataFrame, met: DataFrame) -> DataFrame:
    """query_id, doc_id of pairs whose text holds the passage. Pairs are written; few are sent to the texts, which then aren't shuffled."""
    pairs = written(met, "met")
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    return docs.join(F.broadcast(pairs) if few else pairs, "doc_id").filter(F.contains("text", "passage")).select("query_id", "doc_id")


def _relevant(spark, d) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    pairs = _holders(table(spark, d, "documents").select("doc_id", "text"), items)
    graded = pairs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return written(graded.select("query_id", "doc_id", (1 + F.coalesce("quality", F.lit(0))).alias("gain")), "relevant")


@query("join_golden", f"WITH {_REL_SQL} SELECT query_id, doc_id, gain FROM rel")
def join_golden(spark, d):
    return _relevant(spark, d)


_RUN_SQL = _REL_SQL + """,
run AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (doc_id * 7919) % 10007, doc_id) AS rank FROM (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, doc_id FROM rel UNION ALL SELECT query_id, doc_id + 1 FROM rel UNION ALL SELECT query_id, doc_id + 2 FROM rel)))"""


def _run(rel: DataFrame) -> DataFrame:
    near = rel.select("query_id", F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") + 2)).alias("doc_id")).distinct()
    w = Window.partitionBy("query_id").orderBy((F.col("doc_id") * 7919) % 10007, "doc_id")
    return near.withColumn("rank", F.row_number().over(w))


@query("agg_hit_metrics", f"""
WITH {_RUN_SQL}, ks AS (SELECT unnest([1, 3, 5, 10, 20]) AS k),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS n FROM rel),
b AS (SELECT query_id, k, (SELECT count(*) FROM rel r WHERE r.query_id = i.query_id) AS n, sum(CASE WHEN i.n <= k THEN (pow(2, gain) - 1) / log2(i.n + 1) ELSE 0 END) AS ideal FROM i, ks GROUP BY query_id, k),
h AS (SELECT query_id, k, count(*) AS hits, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg, min(rank) AS first FROM run JOIN rel USING (query_id, doc_id), ks WHERE rank <= k GROUP BY query_id, k)
SELECT query_id, k, round(coalesce(hits, 0)::DOUBLE / n, 6) AS recall, round(coalesce(hits, 0)::DOUBLE / k, 6) AS precision, (coalesce(hits, 0) > 0)::INT::DOUBLE AS hit_rate, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg
FROM b LEFT JOIN h USING (query_id, k)""")
def agg_hit_metrics(spark, d):
    rel = _relevant(spark, d)
    return evaluation.metrics(_run(rel), rel, [1, 3, 5, 10, 20])


@query("win_first_relevant", f"WITH {_RUN_SQL} SELECT query_id, min(rank) AS first_rank FROM run JOIN rel USING (query_id, doc_id) GROUP BY query_id")
def win_first_relevant(spark, d):
    rel = _relevant(spark, d)
    return _run(rel).join(rel, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))


@query("win_ideal_dcg", f"WITH {_REL_SQL} SELECT query_id, round(sum((pow(2, gain) - 1) / log2(n + 1)), 6) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS n FROM rel) WHERE n <= 10 GROUP BY query_id")
def win_ideal_dcg(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "doc_id")
    ranked = _relevant(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 10")
    return ranked.groupBy("query_id").agg(F.round(F.sum((F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("n") + 1)), 6).alias("ideal"))


@query("eval_compare", f"""
WITH {_RUN_SQL}, other AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM run),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS n FROM rel), ideal AS (SELECT query_id, sum((pow(2, gain) - 1) / log2(n + 1)) AS ideal FROM i WHERE n <= 5 GROUP BY 1),
x AS (SELECT 'a' AS w, * FROM run UNION ALL SELECT 'b' AS w, * FROM other), g AS (SELECT w, query_id, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg FROM x JOIN rel USING (query_id, doc_id) WHERE rank <= 5 GROUP BY 1, 2),
m AS (SELECT query_id, round(coalesce(a.dcg / ideal, 0), 6) AS before, round(coalesce(b.dcg / ideal, 0), 6) AS after FROM ideal LEFT JOIN (SELECT * FROM g WHERE w = 'a') a USING (query_id) LEFT JOIN (SELECT * FROM g WHERE w = 'b') b USING (query_id))
SELECT query_id, before, after, round(after - before, 6) AS delta, CASE WHEN before <> 0 THEN round(round(after - before, 6) / before, 6) END AS relative,
  CASE WHEN round(after - before, 6) > 1e-9 THEN 'improved' WHEN round(after - before, 6) < -1e-9 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM m
""")
def eval_compare(spark, d):
    """The run against one that ranks by id."""
    rel = _relevant(spark, d)
    run = _run(rel)
    other = run.drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return evaluation.compare(evaluation.metrics(run, rel, [5]), evaluation.metrics(other, rel, [5]), "ndcg", ["query_id"])


@query("agg_bootstrap")
def agg_bootstrap(spark, d):
    return evaluation.bootstrap(eval_compare(spark, d))


_SENTENCE = "(?s)[^.!?。！？；]*[.!?。！？；]|[^.!?。！？；]+$"


@query("compress", _HITS_SQL + f""",
cs AS (SELECT query_id, doc_id, text, unnest(regexp_extract_all(text, '{_SENTENCE}')) AS s, generate_subscripts(regexp_extract_all(text, '{_SENTENCE}'), 1) AS k FROM h JOIN documents USING (doc_id)),
ct AS (SELECT query_id, doc_id, text, k, trim(CASE WHEN k > 1 THEN regexp_replace(s, '^\\s+', '') ELSE s END) AS s FROM cs),
ch AS (SELECT ct.*, list_has_any(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+'), (SELECT list(term) FROM q WHERE q.query_id = ct.query_id)) AS hit FROM ct WHERE s <> '')
SELECT query_id, doc_id, sha256(coalesce(string_agg(s, ' ' ORDER BY k) FILTER (WHERE hit), any_value(text))) AS content FROM ch GROUP BY 1, 2
""")
def compress(spark, d):
    """Of each hit the sentences that hold a term of its query."""
    terms = spark.createDataFrame([*_QUERIES.items()], "query_id int, terms array<string>")
    hits = table(spark, d, "documents").select("doc_id", F.col("text").alias("content")).join(F.broadcast(_hits(spark, d)), "doc_id")
    return retrieval.compress(hits, terms).select("query_id", "doc_id", F.sha2("content", 256).alias("content"))


_PROFILE_SQL = f"p AS (SELECT lang AS target, term, round(count(*)::DOUBLE / any_value(n), 6) AS weight FROM (SELECT lang, unnest(list_distinct({_TOK})) AS term FROM documents) JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) USING (lang) GROUP BY 1, 2 HAVING count(*) >= 20)"


def _profiles(docs: DataFrame) -> DataFrame:
    """target (a language), term, weight: the share of its documents that hold the term, for terms in twenty documents or more."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    held = docs.select("lang", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("held")).filter("held >= 20")
    return held.join(F.broadcast(sizes), "lang").select(F.col("lang").alias("target"), "term", F.round(F.col("held") / F.col("n"), 6).alias("weight"))


@query("route", f"""
WITH {_PROFILE_SQL}, w AS (SELECT item_id AS query_id, unnest(list_distinct({_TOK})) AS term FROM benchmark),
s AS (SELECT query_id, target, round(sum(weight), 6) AS score FROM w JOIN p USING (term) GROUP BY 1, 2)
SELECT query_id, target, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target) AS rank FROM s) WHERE rank <= 2
""")
def route(spark, d):
    """The two bases (one a language) whose usual words weigh most in each benchmark passage."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.route(queries, _profiles(table(spark, d, "documents")), 2).select("query_id", "target", "rank")


@query("union_targets", _BM25_SQL + """, d2 AS (SELECT query_id, doc_id, score, lang, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id) AS rank FROM r JOIN documents USING (doc_id) WHERE score > 0)
SELECT lang AS list, query_id, doc_id, rank, ['broken'] AS failed FROM d2 WHERE rank <= 5 AND lang IN ('de', 'en')""")
def union_targets(spark, d):
    """Two bases and one that fails: the hits of the two, and the failure is told. The whole corpus' statistics weigh the terms of each."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    hits = written(search.bm25(table(spark, d, "documents"), _QUERIES, 1_000_000).join(docs, "doc_id"), "all")

    def best(lang: str):
        return lambda: search.rank_by(hits.filter(F.col("lang") == lang).select("query_id", "doc_id", "score"), "query_id", "doc_id").filter("rank <= 5")

    found, failed = retrieval.union_targets({"en": best("en"), "broken": lambda: hits.select(F.raise_error(F.lit("down")).cast("int").alias("query_id"), "doc_id", "score", F.lit(1).alias("rank")), "de": best("de")})
    return found.select("list", "query_id", "doc_id", "rank", F.array(*map(F.lit, sorted(failed))).alias("failed"))


@query("rewrite_multi", _BM25_SQL.replace("q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'idiot'), (2, 'der'), (2, 'und'), (3, 'pathetic'), (3, 'clown')) AS t(query_id, term))", "q AS (SELECT * FROM (VALUES (10, 'the'), (10, 'idiot'), (11, 'idiot'), (20, 'pathetic'), (20, 'clown'), (21, 'clown')) AS t(query_id, term))") + """,
l AS (SELECT query_id // 10 AS query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0),
z AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM l WHERE rank <= 30 GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z""")
def rewrite_multi(spark, d):
    """Each query also without its commonest word; the lists of the rewritings are fused."""
    forms = {10: ["the", "idiot"], 11: ["idiot"], 20: ["pathetic", "clown"], 21: ["clown"]}
    lists = search.bm25(table(spark, d, "documents"), forms, 30)
    return search.rrf(lists.select(F.floor(F.col("query_id") / 10).cast("int").alias("query_id"), F.col("query_id").cast("string").alias("list"), "doc_id", "rank"), "doc_id")


@query("fn_language", f"""
WITH {_PROFILE_SQL}, w AS (SELECT doc_id AS query_id, unnest(list_distinct({_TOK})) AS term FROM documents),
s AS (SELECT query_id, target, round(sum(weight), 6) AS score FROM w JOIN p USING (term) GROUP BY 1, 2)
SELECT query_id AS doc_id, target AS language FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target) AS rank FROM s) WHERE rank = 1
""")
def fn_language(spark, d):
    """The language whose usual words weigh most in a document, by profiles that are a table, so any others may take their place."""
    docs = table(spark, d, "documents")
    return retrieval.route(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), _profiles(docs)).select(F.col("query_id").alias("doc_id"), F.col("target").alias("language"))


@query("golden_generate", f"""
WITH d AS (SELECT doc_id, text FROM documents WHERE regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]') ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100),
cs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SENTENCE}')) AS s, generate_subscripts(regexp_extract_all(text, '{_SENTENCE}'), 1) AS k FROM d),
ct AS (SELECT doc_id, k, trim(CASE WHEN k > 1 THEN regexp_replace(s, '^\\s+', '') ELSE s END) AS s FROM cs),
cn AS (SELECT *, len(list_distinct(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+'))) AS n FROM ct WHERE s <> '')
SELECT doc_id, s AS query, FALSE AS reviewed FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS o FROM cn) WHERE o = 1
""")
def golden_generate(spark, d):
    """For a sample of a hundred documents the sentence of the most different words as a query that should find it; none counts until it is reviewed."""
    docs = table(spark, d, "documents").select("doc_id", "text").filter(F.coalesce("text", F.lit("")).rlike(T.TOKEN))
    some = docs.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(100)
    each = some.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("k", "s"))
    best = each.groupBy("doc_id").agg(F.min_by(F.trim("s"), F.struct(-F.size(F.array_distinct(T.tokens(F.col("s")))), F.col("k"))).alias("query"))
    return best.select("doc_id", "query", F.lit(False).alias("reviewed"))
