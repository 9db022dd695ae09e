"""Published functions in their slots: rows of failures, limits, and hits that survive a failing function."""

from __future__ import annotations

import pytest

from millrace.functions import published
from millrace.functions.published import Call, Limits


def _run(body: str, *given, **limits):
    source = "def run(a, b):\n" + "\n".join("    " + x for x in body.split("\n"))
    return Call("enrich", source, lambda x: x, Limits(**limits))(*(given or (1, 2)))


def test_a_call_keeps_its_failure():
    assert _run("return a + b") == (3, None)
    assert _run("return a / 0") == (None, "FUNCTION_RUNTIME_ERROR: ZeroDivisionError: division by zero (line 2)")
    assert _run("print('x' * 1000)\nreturn a") == (1, None)


def test_a_call_is_stopped_when_it_is_late():
    assert _run("while True: pass", seconds=0.2)[1].startswith("FUNCTION_TIMEOUT")
    stubborn = "while True:\n    try:\n        while True: pass\n    except Exception:\n        pass"
    assert _run(stubborn, seconds=0.2)[1].startswith("FUNCTION_TIMEOUT")
    assert _run("return a") == (1, None)


def test_a_call_is_stopped_when_it_grows():
    assert _run("return len(bytearray(900 << 20))", memory_mb=300)[1].startswith("FUNCTION_OOM")
    assert _run("return len(bytearray(90 << 20))", memory_mb=300) == (90 << 20, None)
    assert _run("return 'x' * 1000", output_bytes=900)[1] == "FUNCTION_OUTPUT_INVALID: 1002 bytes, more than 900"


def test_nothing_is_carried_to_the_next_call():
    call = Call("enrich", "seen = []\ndef run(a, b):\n    seen.append(a)\n    return len(seen)", lambda x: x)
    assert [call(1, 2)[0], call(1, 2)[0]] == [1, 1]


@pytest.mark.parametrize("source", ["def run(a): pass", "import os\ndef run(a, b): pass", "def go(a, b): pass", "def run(a, b:\n"])
def test_what_cannot_be_published(source):
    with pytest.raises(ValueError):
        Call("chunk", source, list)


def test_parsed_rows_and_errors(spark):
    source = """
def run(data, context):
    if data == b"bad":
        raise ValueError("bad")
    if data == b"odd":
        return 7
    if not data:
        return {"blocks": []}
    return {"title": context["mime"], "blocks": [data.decode(), {"content": "two", "kind": "table", "page": 3}]}
"""
    docs = spark.createDataFrame([(1, b"one", "a/b"), (2, b"bad", None), (3, b"odd", "x"), (4, None, "x")], "id int, data binary, mime string")
    got = sorted(tuple(r) for r in published.parsed(docs, source, "data", "mime").drop("data", "mime").fillna("-").fillna(-1).collect())
    assert got == [
        (1, 0, "text", "one", -1, "a/b", "-"), (1, 1, "table", "two", 3, "a/b", "-"),
        (2, -1, "-", "-", -1, "-", "FUNCTION_RUNTIME_ERROR: ValueError: bad (line 4)"), (3, -1, "-", "-", -1, "-", "FUNCTION_OUTPUT_INVALID: a parsed document is a text or has blocks"),
    ]


def test_chunked_rows_and_errors(spark):
    source = """
def run(document, config):
    if document["text"] == "orphan":
        return [{"content": "a", "parent": 1}]
    parts = document["text"].split("|")
    return [{"content": p, "parent": 0 if k else None, "page": config["page"]} for k, p in enumerate(parts)]
"""
    docs = spark.createDataFrame([(1, "a b|c"), (2, "orphan"), (3, None), (4, "x| ")], "doc_id int, text string")
    got = published.chunked(docs, source, config={"page": 9}).collect()
    assert sorted((r.doc_id, r.ordinal, r.content, r.parent, r.page, r.token_count) for r in got if r.error is None) == [(1, 0, "a b", None, 9, 2), (1, 1, "c", 0, 9, 1)]
    assert {r.doc_id: r.error for r in got if r.error} == {
        2: "FUNCTION_OUTPUT_INVALID: chunk 0 has no parent 1 before it", 3: "FUNCTION_OUTPUT_INVALID: chunk 0 has no content", 4: "FUNCTION_OUTPUT_INVALID: chunk 1 has no content",
    }
    assert all(r.content is None and r.content_hash is None and r.text is not None or r.doc_id == 3 for r in got if r.error)


HITS = [(q, f"d{k}", 1.0 - k / 10, k + 1, k % 2) for q in (1, 2, 3) for k in range(4)]


def _hits(spark):
    return spark.createDataFrame(HITS, "query_id int, id string, score double, rank int, kind int")


def test_filtered_hits(spark):
    source = """
def run(hits, context):
    if hits[0]["query_id"] == 2:
        return [{"id": "other", "score": 1.0}]
    if hits[0]["query_id"] == 3:
        return []
    return [h for h in reversed(hits) if h["kind"] == context["kind"]]
"""
    got = published.filter_hits(_hits(spark), source, "id", candidates=3, context={"kind": 0})
    rows = sorted((r.query_id, r.rank, r.id, r.score, r.notice) for r in got.collect())
    bad = "FUNCTION_OUTPUT_INVALID: hit 'other' wasn't given"
    assert rows == [(1, 1, "d0", 1.0, None), (1, 2, "d2", 0.8, None), (2, 1, "d0", 1.0, bad), (2, 2, "d1", 0.9, bad), (2, 3, "d2", 0.8, bad)]
    assert [tuple(r) for r in published.notices(got).collect()] == [(2, bad)]


def test_reranked_hits(spark):
    source = """
def run(query, hits):
    if query == "slow":
        while True: pass
    return [{"id": h["id"], "score": -h["score"] if query == "turn" else 1} for h in hits]
"""
    queries = spark.createDataFrame([(1, "turn"), (2, "slow")], "query_id int, query string")
    got = published.rerank_hits(_hits(spark), queries, source, "id", limits=Limits(seconds=0.3))
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.id, round(r.score, 3), r.notice))
    assert by[1] == [("d3", -0.7, None), ("d2", -0.8, None), ("d1", -0.9, None), ("d0", -1.0, None)]
    assert [x[:2] for x in by[2]] == [("d0", 1.0), ("d1", 0.9), ("d2", 0.8), ("d3", 0.7)] and by[2][0][2].startswith("FUNCTION_TIMEOUT")
    assert [x[0] for x in by[3]] == ["d0", "d1", "d2", "d3"]  # no query text: empty, and all tie
    assert got.columns == ["query_id", "id", "score", "rank", "kind", "notice"]
