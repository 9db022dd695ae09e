"""Tables under one manifest: what a change touches, what a stopped writer leaves, and the ingestion chain over them."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions import slots
from millrace.operators import tables as O
from millrace.sources.tableset import Overtaken, TableSet, carried, drift
from millrace.streaming import stages

SCHEMAS = {"chunks": "document_id string, ordinal int, content string, payload map<string,int>", "points": "document_id string, ordinal int, dense array<double>"}


def _tables(spark, folder):
    return TableSet(spark, f"{folder}/set", SCHEMAS, buckets=8)


def _docs(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "document_id string")


def _fill(spark, t, ids, mark, kb="a", version=1, **how):
    docs = _docs(spark, ids)
    rows = docs.withColumns({"ordinal": F.lit(0), "content": F.lit(mark), "payload": F.create_map(F.lit("k"), F.lit(1))})
    return t.replace(kb, version, docs, chunks=rows, points=rows.select("document_id", "ordinal", F.array(F.lit(1.0)).alias("dense")), **how)


def _files(folder):
    return {str(p) for p in Path(folder, "set", "data").rglob("*.parquet")}


def _content(t, *at):
    return {r.document_id: r.content for r in t.read("chunks", *at).collect()}


def test_only_touched_buckets_are_written(spark, folder):
    t = _tables(spark, folder)
    _fill(spark, t, [f"d{k}" for k in range(40)], "old")
    before = t.state()["folders"]["chunks"]
    _fill(spark, t, ["d3", "new"], "two")
    after = t.state()["folders"]["chunks"]
    changed = {k for k in after if after[k] != before.get(k)}
    assert 1 <= len(changed) <= 2 and len(after) >= 7
    assert _content(t) == {f"d{k}": "old" for k in range(40)} | {"d3": "two", "new": "two"}
    t.replace("a", 1, _docs(spark, ["d3", "d4"]), chunks=t.read("chunks").limit(0).drop("kb_id", "index_version"))  # no rows given: they go
    assert "d3" not in _content(t) and len(_content(t)) == 39 and t.read("points").count() == 41


def test_versions_and_bases_are_apart(spark, folder):
    t = _tables(spark, folder)
    for kb in ("a", "b"):
        for v in (1, 2):
            _fill(spark, t, ["x", "y"], f"{kb}{v}", kb, v)
    assert _content(t, "a", 2) == {"x": "a2", "y": "a2"} and t.versions("a") == [1, 2]
    files = _files(folder)
    t.drop("a", 1)
    assert _files(folder) == files and t.versions("a") == [2] and t.read("points").count() == 6
    gone = t.vacuum()
    assert gone and len(_files(folder)) < len(files) and t.read("points").count() == 6
    assert sorted(_content(t, "b")) == ["x", "y"] and t.vacuum() == 0
    with pytest.raises(ValueError):
        _fill(spark, t, ["x"], "no", kb="a/b")


def test_a_writer_that_was_overtaken_is_told(spark, folder, monkeypatch):
    t = _tables(spark, folder)
    _fill(spark, t, ["x"], "one")
    stale = t.state()
    _fill(spark, t, ["x"], "two")
    monkeypatch.setattr(t, "state", lambda: stale)
    with pytest.raises(Overtaken):
        _fill(spark, t, ["x"], "three")
    monkeypatch.undo()
    assert _content(t) == {"x": "two"}


def test_a_purge_goes_on_where_it_was_stopped(spark, folder):
    t, done, fail_at = _tables(spark, folder), [], {"chunks": 1}
    _fill(spark, t, ["x", "y"], "one")
    _fill(spark, t, ["x"], "kept", kb="b")

    def step(name):
        def run():
            t.drop("a", None, [name])
            done.append(name)
            if fail_at.pop(name, None):
                raise OSError("stopped behind the deletion, before it is noted")
        return name, run

    steps = [step("points"), step("chunks")]
    with pytest.raises(OSError):
        t.purge("a", steps)
    assert t.state()["purges"] == {"a": ["points"]}
    t.purge("a", steps)
    assert done == ["points", "chunks", "chunks"] and t.state()["purges"] == {"a": ["points", "chunks"]}
    assert t.versions("a") == [] and _content(t) == {"x": "kept"}
    t.purge("a", steps)
    assert len(done) == 3


def test_edits_are_carried_by_ordinal(spark):
    ddl = "document_id string, ordinal int, content string, content_hash string, is_edited boolean"
    old = spark.createDataFrame([("x", 0, "mine", "h0", True), ("x", 1, "b", "h1", False), ("x", 5, "lost", "h5", True)], ddl)
    new = spark.createDataFrame([("x", 0, "a", "n0", False), ("x", 1, "bb", "n1", False)], ddl)
    chunks, orphans = carried(new, old)
    assert sorted(chunks.select("ordinal", "content", "content_hash", "is_edited").collect()) == [(0, "mine", "h0", True), (1, "bb", "n1", False)]
    assert [tuple(r) for r in orphans.collect()] == [("x", 5)]


class Stop(Exception):
    pass


def test_each_batch_arrives_once_whenever_the_stream_stops(spark, folder):
    """Stopped behind the change and before the stream's own checkpoint: the batch is given again."""
    source, at = f"{folder}/in", f"{folder}/checkpoint"
    tables = stages.open_tables(spark, f"{folder}/set", buckets=4)
    schema = "document_id string, content string"
    for k in range(3):
        spark.createDataFrame([(f"d{k}{j}", f"text {j}. more {k}") for j in range(4)], schema).coalesce(1).write.mode("append").parquet(source)
        stopped = []

        def stop(number):
            stopped.append(number)
            raise Stop

        for after in (stop, None, None):
            stream = spark.readStream.schema(schema).parquet(source)
            try:
                stages.register(tables, "kb", 1, stream, "in", at, after)
            except Exception as e:
                assert "Stop" in str(e)
        assert stopped == [k] and tables.state()["streams"] == {"in": k}
        docs = tables.read("documents").collect()
        assert len(docs) == 4 * (k + 1) and {r.revision for r in docs} == {1}


def _chunk(docs):
    parts = docs.select("document_id", F.posexplode(F.split("content", r"\. ")).alias("ordinal", "content"))
    made = parts.select("*", F.sha2("content", 256).alias("content_hash"), F.size(F.split("content", " ")).alias("token_count"), F.lit(False).alias("is_edited"))
    bad = docs.filter("content = ''").select("document_id", F.lit("NO_TEXT").alias("error"))
    return {"chunks": made.join(bad, "document_id", "left_anti")}, bad


def test_the_chain_stops_and_goes_on_at_any_stage(spark, folder):
    tables = stages.open_tables(spark, folder, buckets=4)
    rows = spark.createDataFrame([("a", "one. two", "registered", None, None, 1), ("b", "", "registered", None, None, 1)], stages.SCHEMAS["documents"])
    tables.replace("kb", 1, rows, documents=rows)
    calls = []

    def embed(docs):
        calls.append(1)
        if len(calls) == 1:
            raise Stop
        own = tables.read("chunks", "kb", 1).join(docs.select("document_id"), "document_id")
        return {"points": own.select("document_id", "ordinal", "content_hash", slots.hashed_embedding(F.col("content"), 4).alias("dense"))}, None

    own = {"parsed": _chunk, "chunked": embed}
    with pytest.raises(Stop):
        stages.run_chain(tables, "kb", 1, own)
    assert {r.document_id: (r.state, r.stage, r.error) for r in tables.read("documents").collect()} == {"a": ("chunked", None, None), "b": ("failed", "chunked", "NO_TEXT")}
    number = tables.state()["number"]
    stages.run_chain(tables, "kb", 1, own)
    assert tables.state()["number"] == number + 2
    assert {r.document_id: r.state for r in tables.read("documents").collect()} == {"a": "indexed", "b": "failed"}
    assert drift(tables.read("chunks"), tables.read("points"), ["document_id"]).count() == 0 and tables.read("points").count() == 2
    assert stages.retry(tables, "kb", 1) and not stages.retry(tables, "kb", 1)
    assert {r.document_id: (r.state, r.revision) for r in tables.read("documents").collect()}["b"] == ("registered", 2)


def test_upsert_takes_any_type(spark):
    ddl = "id int, at int, payload variant, tags map<string,int>"
    old = spark.sql("SELECT 1 AS id, 1 AS at, parse_json('{\"a\":1}') AS payload, map('x', 1) AS tags UNION ALL SELECT 2, 1, parse_json('[1]'), NULL")
    new = spark.sql("SELECT 2 AS id, 5 AS at, parse_json('{\"b\":{\"c\":[1,2]}}') AS payload, map('y', 2) AS tags UNION ALL SELECT 2, 4, parse_json('\"z\"'), map() UNION ALL SELECT 3, 1, parse_json('null'), NULL UNION ALL SELECT 3, 1, parse_json('7'), NULL")
    got = O.upsert(old, new, ["id"], "at").select("id", "at", F.to_json("payload").alias("p"), "tags").collect()
    assert sorted((r.id, r.at, r.p, r.tags) for r in got) == [(1, 1, '{"a":1}', {"x": 1}), (2, 5, '{"b":{"c":[1,2]}}', {"y": 2}), (3, 1, "null", None)]
    assert ddl.count(",") and os.sep


def test_claims_of_two_queues(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    tasks = spark.createDataFrame([(k, 1, "parse" if k % 2 else "embed" if k % 3 else "crawl", "ready", k, "2023-01-01") for k in range(12)], "id int, workspace_id int, queue string, state string, priority int, run_after string")
    limits = spark.createDataFrame([(1, 0, 4)], "workspace_id int, running int, concurrency_limit int")
    some = O.claim(tasks, limits, now, 10, queues=["embed", "crawl"]).collect()
    assert [r.id for r in some] == [10, 8, 6, 4]
    assert O.claim(tasks, limits, now, 10, queues=[]).collect() == []


def test_a_point_rewrites_its_bucket_alone(spark, folder):
    from millrace.sources.store import PointStore

    store = PointStore(spark, folder)
    store.ensure("ns", 2)
    rows = spark.createDataFrame([(f"p{k}", [1.0, float(k)], '{"k":%d}' % k) for k in range(80)], "id string, dense array<float>, payload string")
    store.upsert("ns", rows)
    before = store._manifest("ns")["live"]
    store.upsert("ns", rows.filter("id = 'p7'").withColumn("payload", F.lit('{"k":-7}')))
    after = store._manifest("ns")["live"]
    assert len(before) == len(after) > 10 and sum(before[b] != after[b] for b in before) == 1
    assert store.count("ns") == 80 and store.count("ns", {"k": -7}) == 1
    assert store.delete("ns", ids=["p1", "none"]) == 1 and store.delete("ns", where={"k": {"$gte": 40}}) == 40 and store.count("ns") == 39
    assert store.delete("ns", where={}) == 39 and store.points("ns").count() == 0 and store._manifest("ns")["live"] == {}
