"""Branches, maps and retrieval nodes of pipeline graphs; model plug-ins; A/B runs over temporary versions; the distributed bootstrap and batch search."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.models import Model, embedded, vectors
from millrace.functions.published import Limits
from millrace.operators import evaluation, search
from millrace.plans.graph import Graph, split
from millrace.sources.tableset import TableSet

BRANCHED = {
    "nodes": {
        "docs": {"type": "source"}, "cut": {"type": "branch.condition", "when": ["lang = 'en'", "length(text) > 8"]},
        "a": {"type": "chunk", "size": 2}, "b": {"type": "chunk", "size": 3}, "c": {"type": "chunk", "size": 1}, "ab": {"type": "merge"}, "abc": {"type": "merge"},
    },
    "edges": [["docs", "cut", 0], ["cut", "a", 0, 0], ["cut", "b", 0, 1], ["cut", "c", 0, 2], ["a", "ab", 0], ["b", "ab", 1], ["ab", "abc", 0], ["c", "abc", 1]],
}


def test_a_branch_is_worked_out_once_and_loses_nothing(spark):
    docs = spark.createDataFrame([(1, "en", "a b c"), (2, "de", "aa bb cc dd"), (3, "de", "x y"), (4, None, "x y"), (5, "en", "long enough too")], "doc_id int, lang string, text string")
    counted = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            counted.add(p.num_rows)
            yield p

    graph = Graph.from_dict(BRANCHED)
    assert Graph.from_json(graph.to_json()).problems() == []
    got = sorted((r.doc_id, r.content) for r in graph.run(docs=docs.mapInArrow(count, docs.schema)).collect())
    assert got == [(1, "a b"), (1, "c"), (2, "aa bb cc"), (2, "dd"), (3, "x"), (3, "y"), (4, "x"), (4, "y"), (5, "long enough"), (5, "too")]
    assert counted.value == 5
    parts = split(docs, ["doc_id > 1", "doc_id > 0"])
    assert [p.count() for p in parts] == [4, 1, 0] and parts[0].columns == docs.columns


def test_what_is_wrong_with_a_branch_or_map():
    wrong = Graph.from_dict(BRANCHED | {"edges": [*BRANCHED["edges"][:3], ["cut", "c", 0, 3], *BRANCHED["edges"][4:]]})
    assert "cut: no output 3" in wrong.problems()
    inner = {"nodes": {"in": {"type": "source"}, "x": {"type": "chunk", "size": 2}}, "edges": [["in", "x", 1]]}
    mapped = Graph.from_dict({"nodes": {"docs": {"type": "source"}, "m": {"type": "map", "items": "split(text, ' ')", "graph": inner}}, "edges": [["docs", "m", 0]]})
    assert "m: x: no port 1" in mapped.problems()


def test_a_map_runs_its_graph_over_all_items(spark):
    inner = {"nodes": {"in": {"type": "source"}, "x": {"type": "chunk", "size": 2}}, "edges": [["in", "x", 0]]}
    graph = Graph.from_dict({"nodes": {"docs": {"type": "source"}, "m": {"type": "map", "items": "split(text, ';')", "graph": inner}}, "edges": [["docs", "m", 0]]})
    docs = spark.createDataFrame([("a/1", "p q r;s"), ("b", None), ("c", ";t")], "doc_id string, text string")
    got = sorted((r.doc_id, r.item, r.ordinal, r.content) for r in graph.run(docs=docs).collect())
    assert got == [("a/1", 0, 0, "p q"), ("a/1", 0, 1, "r"), ("a/1", 1, 0, "s"), ("c", 1, 0, "t")]


def test_a_retrieval_graph(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["red fox", "red dog", "blue fox", "green hen"])], "doc_id int, text string")
    points = docs.select("doc_id", F.array(*[F.contains("text", F.lit(w)).cast("double") for w in ("red", "fox", "hen")]).alias("embedding"))
    queries = spark.createDataFrame([(1, "red fox", [1.0, 1.0, 0.0]), (2, "hen", [0.0, 0.0, 1.0])], "query_id int, query string, embedding array<double>")
    graph = Graph.from_dict({
        "nodes": {
            "q": {"type": "query.input"}, "p": {"type": "points.input"}, "d": {"type": "source"}, "dense": {"type": "search.dense", "k": 3}, "sparse": {"type": "search.sparse", "k": 3}, "both": {"type": "fuse"},
            "kept": {"type": "filter.function", "source": "def run(hits, context):\n    return [h for h in hits if h['doc_id'] != context['not']]", "context": {"not": 1}},
            "again": {"type": "rerank.function", "source": "def run(query, hits):\n    return [dict(h, score=-h['doc_id'] if query == 'red fox' else h['score']) for h in hits]"},
            "out": {"type": "assemble.output", "k": 2},
        },
        "edges": [["q", "dense", 0], ["p", "dense", 1], ["q", "sparse", 0], ["d", "sparse", 1], ["dense", "both", 0], ["sparse", "both", 1], ["both", "kept", 0], ["q", "again", 0], ["kept", "again", 1], ["again", "out", 0]],
    })
    assert graph.problems() == []
    got = {r.query_id: [h.doc_id for h in r.hits] for r in graph.run(q=queries, p=points, d=docs).collect()}
    assert got[1] == [0, 2] and got[2][0] == 3
    assert Graph({"q": {"type": "query.input"}, "c": {"type": "chunk", "size": 1}}, [("q", "c", 0)]).problems() == ["edge q -> c: queries isn't docs"]


def _loads(texts):
    return [[float(len(t)), float(len(texts)), float("q:" in t)] for t in texts]


def test_a_model_gets_batches_and_is_loaded_once(spark):
    def load():
        loaded = []

        def predict(texts):
            loaded.append(1)
            return [[len(t), len(texts), len(loaded)] for t in texts]

        return predict

    model = Model("m", load, 3, batch=10, normalize=False)
    docs = spark.range(35, numPartitions=1).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"))
    rows = docs.select("id", vectors(model, F.col("t")).alias("v")).orderBy("id").collect()
    assert [r.v.vector[0] for r in rows] == [float(k) for k in range(35)]
    assert [r.v.vector[1] for r in rows] == [10.0] * 30 + [5.0] * 5  # batches
    assert [r.v.vector[2] for r in rows] == [float(1 + k // 10) for k in range(35)]  # of one load


def test_a_failing_batch_is_an_error_in_its_rows(spark):
    def load():
        def predict(texts):
            if "slow" in texts:
                time.sleep(20)
            if "odd" in texts:
                return [[1.0]] * len(texts)
            if "bad" in texts:
                raise KeyError("bad")
            return [[3.0, 4.0]] * len(texts)

        return predict

    model = Model("m", load, 2, batch=1, limits=Limits(seconds=0.3))
    rows = spark.createDataFrame([("ok",), ("slow",), ("odd",), ("bad",), (None,)], "t string").coalesce(1).select("t", vectors(model, F.col("t")).alias("v")).collect()
    got = {r.t: (r.v.vector, r.v.error) for r in rows}
    assert got["ok"] == got[None] == ([0.6, 0.8], None)
    assert [got[t][1][:21] for t in ("slow", "odd", "bad")] == ["FUNCTION_TIMEOUT: mor", "FUNCTION_OUTPUT_INVAL", "FUNCTION_RUNTIME_ERRO"] and got["slow"][0] is None


def test_equal_texts_are_embedded_once_and_cached(spark):
    model = Model("m", lambda: _loads, 3, normalize=False, prefix="q: ", max_tokens=2)
    rows = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (4, None)], "id int, content string")
    first, fresh = embedded(rows, model)
    assert fresh.count() == 3
    cache = fresh.withColumn("vector", F.array(F.lit(9.0), F.lit(9.0), F.lit(9.0)))
    more, new = embedded(rows.union(spark.createDataFrame([(5, "new")], rows.schema)), model, cache=cache)
    assert {r.id: r.embedding[0] for r in more.collect()} == {1: 9.0, 2: 9.0, 3: 9.0, 4: 9.0, 5: 3.0} and new.count() == 1
    assert {r.id: r.embedding[0] for r in first.collect()}[3] == 1.0
    asked = rows.select("id", vectors(model, F.col("content"), query=True).alias("v")).collect()
    assert all(r.v.vector[2] == 1.0 for r in asked)


def test_a_trial_is_dropped_whatever_happens(spark, folder):
    t = TableSet(spark, folder, {"points": "document_id string, rank int"}, buckets=2)
    rel = spark.createDataFrame([(1, "x", 1)], "query_id int, doc_id string, gain int")

    def fill(version, rank):
        rows = spark.createDataFrame([("x", rank)], "document_id string, rank int")
        t.replace("kb", version, rows, points=rows)

    fill(1, 2)
    run = lambda v: t.read("points", "kb", v).select(F.lit(1).alias("query_id"), F.col("document_id").alias("doc_id"), "rank")
    before, after = evaluation.ab_run(t, "kb", 1, run, rel, [1, 3], build=lambda v: fill(v, 1))
    assert t.versions("kb") == [1]
    assert [(r.k, r.before, r.after, r.verdict) for r in evaluation.compare(before, after, "mrr", ["k"]).orderBy("k").collect()] == [(1, 0.0, 1.0, "improved"), (3, 0.5, 1.0, "improved")]

    def broken(version):
        fill(version, 1)
        assert t.versions("kb") == [1, version]
        raise OSError("no provider")

    with pytest.raises(OSError):
        evaluation.ab_run(t, "kb", 1, run, rel, [1], build=broken)
    assert t.versions("kb") == [1]
    number = t.state()["number"]
    evaluation.ab_run(t, "kb", 1, run, rel, [1], trial=run)
    assert t.state()["number"] == number  # nothing is built for a change of the search alone
    fill(evaluation.TEMPORARY + 3, 1)
    assert evaluation.sweep(t, "kb") == [evaluation.TEMPORARY + 3] and t.versions("kb") == [1]


def test_bootstrap_is_distributed_and_tells_better_from_worse(spark):
    rng = np.random.default_rng(4)
    for shift, low, high in ((0.2, 0.0, 0.02), (-0.2, 0.98, 1.0), (0.0, 0.02, 0.98)):
        x = [(k, float(v)) for k, v in enumerate(rng.normal(shift, 0.5, 300))]
        df = spark.createDataFrame(x, "query_id int, delta double")
        one = evaluation.bootstrap(df.repartition(3)).first()
        plain = np.array([np.mean(rng.choice([v for _, v in x], 300)) for _ in range(1000)])
        assert low <= one.p_value <= high and abs(one.p_value - (plain <= 0).mean()) < 0.06 and one.rounds == 1000
        assert evaluation.bootstrap(df.coalesce(1)).first() == one  # whatever the partitions


@pytest.mark.parametrize("names", ["int", "string"])
def test_batch_search_in_tiles_is_exact(spark, monkeypatch, names):
    rng = np.random.default_rng(9)
    x = rng.integers(-2, 3, (400, 3)).astype(float)  # many ties
    points = spark.createDataFrame([(int(i), v) for i, v in zip(rng.permutation(400), x.tolist())], "vec_id int, embedding array<double>").withColumn("vec_id", F.col("vec_id").cast(names))
    queries = points.limit(7).select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(search, "TILE_SCORES", 70)
    for metric in ("cosine", "dot", "l2"):
        got = {}
        for r in search.dense_batch(points.repartition(3), queries, 12, metric, block=4).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q, v in queries.collect():
            want = [(r.vec_id, r.score) for r in search.dense(points, v, 12, metric).collect()]
            assert [(i, s) for _, i, s in sorted(got[q])] == want
    assert search.dense_batch(points.limit(2), queries, 12).count() == 14
