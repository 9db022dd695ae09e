"""Functions of Arrow batches make Python objects of few rows at once, and words of a query stay with it."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.util import PythonEvalType

from millrace.functions import batches, models, published, slots
from millrace.functions import text as T
from millrace.operators import ingest, retrieval


def test_html_is_parsed_in_pieces(spark):
    sizes = batches.by_pieces(LongType())(lambda x: [len(x)] * len(x))
    assert sorted({r.n for r in spark.range(200, numPartitions=1).select(sizes(F.col("id")).alias("n")).collect()}) == [8, 64]
    assert ingest.parse_html.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
    pages = spark.createDataFrame([(k, f'<title>t{k}</title><p>a {k}</p><a href="u{k}">b</a>' if k % 7 else None) for k in range(150)], "page_id int, html string").coalesce(1)
    for r in pages.select("page_id", ingest.parse_html(F.col("html")).alias("p")).collect():
        assert tuple(r.p) == ((f"t{r.page_id}", f"t{r.page_id}\na {r.page_id}\nb", [f"u{r.page_id}"]) if r.page_id % 7 else (None, "", []))


def test_a_model_is_given_pieces_of_its_batch(spark):
    model = models.Model("sizes", lambda: lambda texts: [[float(len(texts)), 1.0] for _ in texts], 2, batch=7, normalize=False)
    rows = spark.range(100, numPartitions=1).select(models.vectors(model, F.col("id").cast("string")).alias("m"))
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted({tuple(r.m.vector) for r in rows.collect()}) == [(2.0, 1.0), (7.0, 1.0)]


def test_normal_forms_are_made_in_pieces(spark):
    assert T.nfkc.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else f" ﬁ\t{k} ") for k in range(150)], "k int, t string").coalesce(1)
    assert {r.k: r.x for r in rows.select("k", T.nfkc(F.col("t")).alias("x")).collect()} == {k: None if k % 5 == 0 else f"fi {k}" for k in range(150)}


def test_embeddings_are_made_in_pieces_as_one_by_one(spark):
    texts = [None, "", "!?", "One two two THREE", *(" ".join(f"w{j}" for j in range(k)) for k in range(150))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1).select("k", slots.hashed_embedding(F.col("t"), 16).alias("v"))
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString() and f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in rows._jdf.queryExecution().executedPlan().toString()
    for r in rows.collect():
        v = np.zeros(16)
        for w in set(slots._TOKEN.findall((texts[r.k] or "").lower())):
            v[zlib.crc32(w.encode()) % 16] += 1.0 if zlib.crc32(w.encode()) >> 16 & 1 else -1.0
        size = np.sqrt((v * v).sum())
        assert r.v == list(v / size if size else v)


def test_words_are_summed_with_their_query(spark, monkeypatch):
    queries = spark.createDataFrame([(k, f"a b{k % 3} c") for k in range(50)], "query_id int, query string")
    profiles = spark.createDataFrame([("x", "a", 0.5), ("x", "b1", 0.25), ("y", "b2", 0.9), ("y", "b1", 0.2)], "target string, term string, weight double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (500_000, 0):
            monkeypatch.setattr(retrieval, "BROADCAST_TERMS", most)
            made = retrieval.route(queries, profiles)
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (most > 0) and ("REPARTITION_BY_COL" in plan) == (most == 0)
            assert {r.query_id: (r.target, r.score) for r in made.collect()} == {k: (("x", 0.5), ("x", 0.75), ("y", 0.9))[k % 3] for k in range(50)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_table_functions_get_rows_by_the_hundred(spark):
    docs = spark.createDataFrame([(k, f"a{k} b") for k in range(300)], "doc_id int, text string").coalesce(1)
    made = published.chunked(docs, "def run(document, config):\n    return document['text'].split(' ')\n")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
    assert {(r.doc_id, r.ordinal, r.content) for r in made.collect()} == {x for k in range(300) for x in ((k, 0, f"a{k}"), (k, 1, "b"))}
