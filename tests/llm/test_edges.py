"""Very long texts, clashing names, ties, repeated rows and empty tables of the older operators."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from millrace.llm import chatformat, htmlmain, langid, mixing, ngramjoin, tokencounts
from tests.llm.test_texts import prose

LONG = "word other, third. " * 60_000


def test_long_and_clashing_conversations(spark):
    rows = [(1, 0, "user", LONG, "x", 1), (1, 1, "assistant", LONG + "<|end|>", "x", 1), (2, None, None, None, "x", 1), (2, None, None, None, "x", 1)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, example int")
    got = {(r.conv_id, r.example): r for r in chatformat.examples(talks).collect()}
    one = got[1, 2]
    assert one.trainable and one.formatted[one.loss_start : one.loss_start + one.loss_chars].replace("<\\|", "<|") == LONG + "<|end|>"
    assert len(got[2, 2].formatted) == 2 * len("<|turn|><|says|><|end|>\n") and not got[2, 2].trainable
    assert chatformat.examples(talks.limit(0)).count() == 0


def test_long_and_clashing_documents_are_mixed(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 60) if k % 2 else "idiot clown " * 20, "a", 7, 8, 9) for k in range(60)] + [(60, LONG, "a", 7, 8, 9), (61, None, "a", 7, 8, 9), (61, None, "a", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _b int, _x1 int, _top int")
    labels = spark.createDataFrame([(k, (k + 1) % 2) for k in range(60)], "doc_id long, domain int")
    out = mixing.mix(docs, labels, {"good": 0.9, "toxic": 0.1}).collect()
    assert len(out) == 63 and all((r._b, r._x1, r._top) == (7, 8, 9) for r in out)
    assert next(r for r in out if r.doc_id == 60).n_tokens > 100_000


def test_long_and_clashing_documents_are_counted(spark, folder):
    docs = spark.createDataFrame([(1, LONG, "s", "en", 5, 6), (2, None, "s", "en", 5, 6)], "doc_id long, text string, source string, lang string, docs int, part int")
    store = tokencounts.TokenTotals(spark, folder, version="v")
    store.commit("1", inserts=docs)
    assert [(r.n_docs, r.n_tokens) for r in store.totals().collect()] == [(2, len(tokencounts._encoding(tokencounts.TOKENIZER).encode_ordinary(LONG)))]
    store.commit("2", revised=docs.withColumn("text", F.lit("one")))
    assert [(r.n_docs, r.n_tokens) for r in store.totals().collect()] == [(2, 2)]


def test_long_clashing_and_repeated_pages(spark):
    page = "<html><body><nav><a href=x>menu</a></nav><article><p>" + LONG + "</p></article><footer>end</footer></body></html>"
    pages = spark.createDataFrame([(1, page, "t", 1), (1, page, "t", 1), (2, None, "t", 1), (3, "", "t", 1), (4, "<p>cut <b", "t", 1)], "page_id long, html string, text string, _made int")
    got = htmlmain.extract(pages, htmlmain.fit(pages)).collect()
    assert len(got) == 5 and all(r._made == 1 for r in got)
    assert [r.n_chars for r in got if r.page_id in (2, 3)] == [0, 0] and [r.text for r in got if r.page_id == 2] == [""]
    assert {r.text for r in got if r.page_id == 1} == {LONG.strip()}
    assert htmlmain.extract(pages.limit(0), htmlmain.Trees()).count() == 0


def test_long_and_clashing_near_copies(spark):
    rng = random.Random(6)
    base = prose(rng, 30_000)
    rows = [(1, base, 1, 2), (2, base + " and one more", 1, 2), (3, base, 1, 2), (4, prose(rng, 400), 1, 2), (5, None, 1, 2), (6, "", 1, 2), (6, "", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, _key int")
    kept = ngramjoin.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id < 5) == [1, 4] and all((r.class_id, r._key) == (1, 2) for r in kept)
    assert ngramjoin.keep_one(docs.limit(0)).count() == 0


def test_long_clashing_and_tied_languages(spark):
    rows = [(1, "abc abc", "xx"), (2, "abc abc", "aa"), (3, LONG, "en"), (4, LONG, "en")]
    docs = spark.createDataFrame([(*r, "old", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, _made int")
    tied = langid.predict(docs.filter("doc_id < 3"), langid.fit(docs.filter("doc_id < 3"))).collect()
    assert [(r.lang_pred, round(r.score, 6), r._made) for r in tied] == [("aa", 0.5, 1)] * 2  # in alphabetical order
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).filter("doc_id > 2").collect()} == {"en"}
    assert langid.predict(docs.limit(0), langid.fit(docs)).count() == 0
