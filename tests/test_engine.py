"""Search, stages, stores, tables, versions, scalars, ingestion, graphs and streams."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars, slots
from millrace.functions import text as T
from millrace.operators import evaluation, ingest, retrieval, search, tables
from millrace.plans import queries_search
from millrace.plans.graph import Graph
from millrace.sources import versions
from millrace.sources.store import DimensionError, NamespaceNotFound, PointStore, require
from millrace.streaming.windows import ingest_new


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8).astype("float32")], k % 3) for k in range(120)] + [(500, [0.0] * 8, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_a_batch_is_its_searches(spark, points, metric):
    queries = points.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in search.dense_batch(points, queries, 7, metric, block=2, digits=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in queries.collect():
        one = search.dense(points, q.embedding, 7, metric, digits=5).collect()
        assert [(i, s) for _, i, s in sorted(got[q.query_id])] == [(r.vec_id, r.score) for r in one]


def test_zero_vectors_score_zero(spark, points):
    assert search.dense(points.filter("vec_id = 500"), [1.0] * 8).first().score == 0.0


def test_inverted_lists_find_most_neighbours(spark, points):
    index = search.IvfIndex(points, n_cells=8)
    queries = points.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = {(r.query_id, r.vec_id) for r in index.search_batch(queries, 5, 5).collect()}
    exact = {(r.query_id, r.vec_id) for r in search.dense_batch(points, queries, 5).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_the_registered_index_finds_nine_of_ten_neighbours(spark, folder):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(1000, 64)).astype("float32"))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    stored = spark.read.parquet(f"{folder}/embeddings.parquet")
    near = {(r.query_id, r.vec_id) for r in queries_search.ann_index(spark, folder).collect()}
    exact = {(r.query_id, r.vec_id) for r in search.dense_batch(stored, stored.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, digits=5).collect()}
    assert len(exact) == 200 and len(near & exact) >= 0.9 * len(exact)


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, doc_id long, score double, rank int")


def test_fusion(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 9.0, 1), (1, "a", 2, 5.0, 2), (1, "b", 2, 0.9, 1), (1, "b", 3, 0.1, 2)], "query_id int, list string, doc_id int, score double, rank int")
    rrf = {r.doc_id: r.score for r in search.rrf(ranked, "doc_id").collect()}
    assert rrf == {1: round(1 / 61, 6), 2: round(1 / 61 + 1 / 62, 6), 3: round(1 / 62, 6)}
    mixed = {r.doc_id: r.score for r in search.weighted(ranked, {"a": 0.7, "b": 0.3}, "doc_id").collect()}
    assert mixed == {1: 0.7, 2: 0.3, 3: 0.0}


def test_mmr(spark, points):
    h = search.dense_batch(points, points.filter("vec_id < 2").select(F.col("vec_id").alias("query_id"), "embedding"), 20).join(points.select("vec_id", "embedding"), "vec_id")
    plain = retrieval.mmr(h, 6, "vec_id", weight=1.0).collect()
    want = h.filter("rank <= 6").collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in plain} == {(r.query_id, r.rank, r.vec_id) for r in want}
    assert {(r.query_id, r.rank) for r in retrieval.mmr(h, 6, "vec_id", weight=0.3).collect()} == {(q, k) for q in (0, 1) for k in range(1, 7)}


def test_budget_parents_and_best(spark):
    h = hits(spark, [(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3)]).withColumn("token_count", F.lit(40))
    cut = retrieval.token_budget(h, 100).collect()
    assert [(r.doc_id, r.total_tokens, r.truncated) for r in cut] == [(10, 40, True), (11, 80, True)]
    up = retrieval.expand_parents(h.withColumn("parent_id", F.when(F.col("doc_id") > 10, F.lit(7).cast("long"))), "parent_id", "doc_id").orderBy("rank").collect()
    assert [(r.doc_id, r.score, r.matched_child_ids) for r in up] == [(10, 0.9, []), (7, 0.8, [11, 12])]


def test_rerank_falls_back(spark):
    h = hits(spark, [(1, 10, 0.9, 1)])
    same, notes = retrieval.rerank(h, lambda: 1 / 0, "doc_id")
    assert same.collect() == h.collect() and notes == ["rerank skipped: ZeroDivisionError"]


def test_policies():
    assert retrieval.load_policy(100) == {"rerank": True, "candidate_k": 100}
    assert retrieval.load_policy(130) == {"rerank": False, "candidate_k": 100}
    assert retrieval.load_policy(300) == {"rerank": False, "candidate_k": 50}
    assert retrieval.settle({"k": None, "a": 1}, {"k": 5}, {"k": 9, "a": 2, "b": 3}) == {"k": 5, "a": 1, "b": 3}


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id int, doc_id int, rank int")
    relevant = spark.createDataFrame([(1, 6, 2), (1, 9, 1), (2, 1, 1), (3, 1, 0)], "query_id int, doc_id int, gain int")
    got = {(r.query_id, r.k): r for r in evaluation.metrics(ranked, relevant, [1, 3]).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 1), (2, 3)}
    r = got[1, 3]
    ideal = 3 / np.log2(2) + 1 / np.log2(3)
    assert (r.recall, r.precision, r.hit_rate, r.mrr, r.ndcg) == (0.5, 0.333333, 1.0, 0.5, round(3 / np.log2(3) / ideal, 6)) and got[2, 3].ndcg == 0


def store_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, dense array<float>, payload string")


def test_store(spark, folder):
    s = PointStore(spark, folder)
    with pytest.raises(NamespaceNotFound):
        s.spec("a")
    s.ensure("a", 2, "l2")
    s.ensure("a", 2, "l2")
    with pytest.raises(ValueError):
        s.ensure("a", 3, "l2")
    assert s.exists("a") and s.spec("a")["metric"] == "l2" and not s.exists("b") and s.count("a") == 0
    rows = store_rows(spark, [("x", [1.0, 0.0], '{"document_id": "d1", "created_at": 100, "content": "alpha one", "lang": "en"}'), ("y", [0.0, 1.0], '{"content": "bravo two", "lang": "fr"}'), ("z", [0.9, 0.1], '{"content": 5}')])
    assert s.upsert("a", rows) == 3 and s.upsert("a", rows) == 3 and s.count("a") == 3 and s.upsert("a", rows.limit(0)) == 0
    with pytest.raises(DimensionError):
        s.upsert("a", store_rows(spark, [("w", [1.0, 2.0], "{}"), ("v", [1.0], "{}")]))
    assert s.count("a") == 3
    assert [(r.id, r.content) for r in s.search("a", [1.0, 0.0], k=2).collect()] == [("x", "alpha one"), ("z", "")]
    assert [r.id for r in s.search("a", text="BRAVO two").collect()] == ["y"]
    assert s.search("a", [1.0, 0.0], with_payload=False).columns == ["id", "score", "content"]
    assert s.search("a", [1.0, 0.0], threshold=-0.5).count() == 2
    assert [r.id for r in s.fetch("a", ["z", "nope", "x"]).collect()] == ["z", "x"] and s.fetch("a", []).count() == 0
    assert s.count("a", {"document_id": "d1"}) == 1 and s.count("a", {"lang": {"$ne": "en"}}) == 2
    s.ensure("b", 2)
    s.upsert("b", rows.filter("id = 'x'"))
    with pytest.raises(ValueError):
        s.delete("a")
    assert s.delete("a", ids=["x", "y"], where={"lang": "fr"}) == 1 and s.delete("a", ids=["gone"]) == 0 and s.delete("a", ids=[]) == 0
    assert s.count("a") == 2 and s.count("b") == 1
    s.drop("a")
    s.drop("a")
    assert not s.exists("a") and s.count("b") == 1
    with pytest.raises(NotImplementedError):
        require("rerank")


def test_fair_claim(spark):
    now = datetime(2024, 1, 2)
    rows = [(k, 1, 0, "ready", datetime(2024, 1, 1)) for k in range(50)] + [(99, 2, 0, "ready", datetime(2024, 1, 1)), (100, 2, 9, "ready", datetime(2025, 1, 1)), (101, 3, 5, "ready", datetime(2024, 1, 1))]
    t = spark.createDataFrame(rows, "id long, workspace_id int, priority int, state string, run_after timestamp")
    limits = spark.createDataFrame([(1, 0, 2), (2, 0, 2), (3, 2, 2)], "workspace_id int, running int, concurrency_limit int")
    assert [r.id for r in tables.claim(t, limits, F.lit(now), 10).collect()] == [0, 1, 99]


def test_pages(spark):
    rows = spark.createDataFrame([(k // 3, k) for k in range(10)], "at int, id int")
    order = [("at", True), ("id", True)]
    seen, after = [], None
    while True:
        page = [(r.at, r.id) for r in tables.page_after(rows, order, after, 4).collect()]
        seen += page[:4]
        if len(page) <= 4:
            break
        after = page[3]
    assert [i for _, i in seen] == list(range(9, -1, -1))


def test_versions():
    now = datetime(2024, 1, 1)
    v = versions.start([], now)
    with pytest.raises(ValueError):
        versions.start(v, now)
    v = versions.activate(v, 1, now)
    v = versions.fail(versions.start(v, now), 2, "boom", now)
    assert versions.active(v) == 1
    v = versions.activate(versions.start(v, now), 3, now)
    assert versions.active(v) == 3 and versions.expired(v, now) == [] and versions.expired(v, now + timedelta(hours=25)) == [1]


def test_ids_and_cursors():
    u = "01890a5d-ac96-774b-bcce-b302099a8057"
    p = scalars.encode_id("kb", u)
    assert len(p) == 29 and scalars.decode_id("kb", p) == u and scalars.decode_id("kb", p.upper().replace("KB_", "kb_")) == u
    assert [scalars.decode_id(*x) for x in (("doc", p), ("kb", p[:-1]), ("kb", p[:-1] + "u"))] == [None] * 3
    c = scalars.encode_cursor(at=5, id="x")
    assert scalars.decode_cursor(c) == {"at": 5, "id": "x"} and "=" not in c
    for bad in ("!!", "e30", c[:-3]):
        with pytest.raises(ValueError):
            scalars.decode_cursor(bad)
    assert scalars.page_size(None) == 50 and scalars.page_size(200) == 200
    with pytest.raises(ValueError):
        scalars.page_size(201)


def test_text_functions(spark):
    df = spark.createDataFrame([("Héllo  Wörld!  A_b",), (None,), ("",)], "t string")
    got = df.select(T.slug(F.col("t")).alias("s"), T.token_count(F.col("t")).alias("n"), T.nfkc(F.col("t")).alias("k"), T.truncated(F.col("t"), 1).alias("x")).collect()
    assert [(r.s, r.n, r.k, r.x) for r in got] == [("h-llo-w-rld-a-b", 4, "Héllo Wörld! A_b", "Héllo"), ("kb", 0, None, ""), ("kb", 0, "", "")]
    ips = spark.createDataFrame([("10.1.2.3",), ("8.8.8.8",), ("::ffff:127.0.0.1",), ("x",)], "ip string")
    assert [r[0] for r in ips.select(scalars.blocked_address(F.col("ip"))).collect()] == [True, False, True, False]


def test_chunkers(spark):
    text = "# One\n\n" + "word " * 30 + "\n\n## Two\n\nshort. " + "tail " * 25
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    md = ingest.chunk(docs, "markdown", 20).orderBy("ordinal").collect()
    assert {r.heading for r in md} == {"One", "One > Two"} and all(r.token_count <= 20 for r in md)
    assert " ".join(r.content for r in md).split() == [w for w in text.split() if w not in ("#", "##", "One", "Two")]
    pc = ingest.chunk(docs, "parent_child", 20).collect()
    assert {r.parent for r in pc if r.parent is not None} == {r.ordinal for r in pc if r.parent is None}
    merged = ingest.merge_forward(ingest.chunk(docs, "recursive", 8), 15).orderBy("ordinal").collect()
    assert all(r.token_count >= 15 for r in merged) and [r.ordinal for r in merged] == list(range(len(merged)))
    fixed = ingest.fixed_chunks(docs, 10, 2).orderBy("ordinal").collect()
    assert all(a.content.split()[-2:] == b.content.split()[:2] for a, b in zip(fixed, fixed[1:]))


def test_crawl(spark):
    links = spark.createDataFrame([("http://a/1", "http://a/2"), ("http://a/2", "http://A/3#x"), ("http://a/3", "http://a/1/"), ("http://a/2", "http://other/")], "url string, to string")
    seeds = spark.createDataFrame([("http://a/1/",)], "url string")
    got = [(r.url, r.depth) for r in ingest.frontier(seeds, links, r"^(?i)https?://a/", 5, 10).collect()]
    assert got == [("http://a/1", 0), ("http://a/2", 1), ("http://a/3", 2)]


def test_graphs(spark):
    bad = Graph({"a": {"type": "source"}, "b": {"type": "chunk"}, "c": {"type": "filter"}}, [("b", "c", 0), ("c", "b", 0)])
    wrong = bad.problems()
    assert any("isn't docs" in w for w in wrong) and any(w.startswith("cycle") for w in wrong)
    assert Graph({"x": {"type": "nope"}}).problems() == ["x: no node type 'nope'"]
    with pytest.raises(ValueError):
        bad.run()


def test_slots(spark):
    assert slots.problems("enrich", "def run(t, c):\n  return t") == []
    assert slots.problems("enrich", "import os\ndef run(t):\n  return t") == ["run must take 2 arguments", "import of os"]
    assert slots.problems("enrich", "def run(") != [] and slots.problems("x", "") == ["no slot 'x'"]
    run = slots.enrich("def run(t, c):\n    return t[5]\n")
    got = spark.createDataFrame([("abcdefg",), ("ab",)], "t string").select(run(F.col("t")).alias("r")).select("r.*").collect()
    assert got[0].value == "f" and got[1].value is None and got[1].error.startswith("IndexError")


def test_stream_ingest_is_idempotent(spark, folder):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v long")
    rows.write.parquet(f"{folder}/in")
    for n in range(2):  # a lost checkpoint gives everything again
        ingest_new(spark, spark.readStream.schema("k string, v long").parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state{n}", "k")
    assert sorted(r.k for r in spark.read.parquet(f"{folder}/out").collect()) == ["a", "b"]


def test_small_operators(spark):
    rng = random.Random(0)
    old = spark.createDataFrame([(k, "old") for k in range(5)], "id int, v string")
    new = spark.createDataFrame([(3, "new"), (9, "new")], "id int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"]).collect())) == [(0, "old"), (1, "old"), (2, "old"), (3, "new"), (4, "old"), (9, "new")]
    fails = spark.createDataFrame([(rng.randrange(2),) for _ in range(20)] + [(7,)], "user_id int")
    locks = {r.user_id: r.lock_seconds for r in tables.lockout(fails, [(3, 60), (5, 300)]).collect()}
    assert locks[7] == 0 and locks[0] in (60, 300)
    found = tables.dedupe_new(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, h string"), spark.createDataFrame([("b",)], "h string"), ["h"], "id")
    assert {r.id: r.status for r in found.collect()} == {1: "accepted", 2: "skipped", 3: "skipped", 4: "accepted"}
