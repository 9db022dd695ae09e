"""The n-gram join meets whole texts with few keys, not with one for each text."""

from __future__ import annotations

import pytest

from millrace.llm import ngramjoin, shared

WORDS = [f"w{k}" for k in range(60)]


@pytest.mark.parametrize("most", [500_000, 0])
def test_texts_stay_where_they_are_unless_keys_are_many(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_KEYS", most)
    near = " ".join(WORDS)
    rows = [(k, " ".join(f"x{k}y{j}" for j in range(20))) for k in range(30)]
    rows += [(40, near), (41, near + " end"), (42, near), (42, near), (43, "?!"), (43, "?!"), (44, None), (45, ""), (None, "lone text of null id here"), (None, "lone text of null id here"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngramjoin.keep_one(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan) == (most == 0)
        got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = [(str(k), t) for k, t in rows[:31]] + [("43", "?!"), ("43", "?!"), ("44", ""), ("45", ""), ("None", "lone text of null id here")]
    assert got == sorted(expected)
