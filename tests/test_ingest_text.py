"""Semantic chunks against plain Python over all documents, and pages as Markdown by cases and over all pages."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import markdown, slots
from millrace.operators import semantic

SF = "/root/testdata/sf0.001"
SENTENCE = re.compile(r".+?(?:[.!?。！？；]+[ \t-\r]*|\n[ \t-\r]*|\Z)", re.S)
WORD = re.compile(r"[^\W_]+")


def _plain_chunks(parts, vectors, most, quantile, around):
    """The chunks of one document, sentence by sentence."""
    d = [None] * len(parts)
    for k in range(1, len(parts)):
        a, b = vectors[k - 1], vectors[k]
        size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
        d[k] = round(1 - (float((a * b).sum() / size) if size else 0.0), 9)
    out, held, total = [], [], 0
    for k, s in enumerate(parts):
        near = [x for x in d[max(0, k - around) : k + around + 1] if x is not None]
        left = d[k - 1] if k and d[k - 1] is not None else 0.0
        right = d[k + 1] if k + 1 < len(parts) else 0.0
        if d[k] and d[k] >= np.quantile(near, quantile) - 1e-12 and d[k] >= left and d[k] > right:
            out.append(held)
            held, total = [], 0
        total += len(WORD.findall(s))
        held.append((s, max(total - 1, 0) // most))
    out.append(held)
    chunks = []
    for section in out:
        for part in sorted({p for _, p in section}):
            chunks.append("".join(s for s, p in section if p == part))
    return [c for c in chunks if c]


def test_semantic_chunks_are_what_plain_python_makes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = semantic.sentence_rows(docs).withColumn("v", slots.hashed_embedding(F.col("sentence"))).orderBy("doc_id", "at").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    made = {}
    for r in semantic.semantic_chunks(docs, 120).orderBy("doc_id", "ordinal").collect():
        made.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    several = 0
    for doc, text in texts.items():
        parts = [r.sentence for r in by.get(doc, [])]
        assert parts == SENTENCE.findall(text)
        got = made.get(doc, [])
        assert "".join(r.content for r in got) == text  # no sentence is lost or moved
        assert [r.ordinal for r in got] == list(range(len(got)))
        assert [r.content for r in got] == _plain_chunks(parts, [np.array(r.v) for r in by.get(doc, [])], 120, semantic.QUANTILE, semantic.AROUND)
        several += len(got) > 1
    assert several > 20


def test_semantic_chunks_edges(spark):
    topic = "The cat sat. The cat ran. The cat ate. Stars shine far. Stars shine bright. Stars shine on."
    docs = spark.createDataFrame([(1, topic), (2, None), (3, ""), (4, "  \n "), (5, "one " * 50), (6, "猫。犬。")], "doc_id int, text string")
    got = {}
    for r in semantic.semantic_chunks(docs, 20).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append((r.content, r.token_count))
    assert got[1] == [("The cat sat. The cat ran. The cat ate. ", 9), ("Stars shine far. Stars shine bright. Stars shine on.", 9)]
    assert 2 not in got and 3 not in got and got[4] == [("  \n ", 0)]
    assert got[5] == [("one " * 50, 50)]  # a sentence stays whole
    assert "".join(c for c, _ in got[6]) == "猫。犬。"


CASES = {
    "<h2>A <b>b</b></h2><p>x  y\nz": "## A **b**\n\nx y z",
    "<p>a<p>b<div>c</div>d": "a\n\nb\n\nc\n\nd",
    "<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x</li></ol>": "- a\n- b\n  - c\n\n3. x",
    "<table><tr><th>a<th>b<tr><td>1|2</table>": "| a | b |\n| --- | --- |\n| 1\\|2 |  |",
    "<pre>if x:\n    y</pre>": "```\nif x:\n    y\n```",
    "<pre>```</pre>": "````\n```\n````",
    "<p>use <code>a`b</code> and <code>c</code>": "use `` a`b `` and `c`",
    '<p>see <a href="/x y">here</a>, <a>there</a> <em>now </em>.': "see [here](/x%20y), there *now* .",
    "<blockquote><p>a<p>b</blockquote>": "> a\n>\n> b",
    "<p># no<br>- no<br>1. no *x* [y]": "\\# no\n\\- no\n1\\. no \\*x\\* \\[y\\]",
    "<nav>n</nav><main><p>m</p><aside>s</aside></main><footer>f</footer>": "m",
    "<header>h</header><article><p>t &amp; u</p><form>f</form></article><div>rest</div>": "t & u",
    "<article><p>one</article><article><p>two</article>": "one\n\ntwo",
    "<div><a href=1>a</a> <a href=2>b</a></div><p><a href=3>kept</a>": "[kept](3)",
    "<p>a<script>var x='<p>no</p>'</script><style>p{}</style><!-- c -->b": "ab",
    "": "", "plain": "plain", "<p>  </p>": "", "<hr>": "---", "a<img src=i alt=x>b": "a![x](i)b",
}


@pytest.mark.parametrize("page", CASES)
def test_markdown(page):
    assert markdown.page_markdown(page)[1] == CASES[page]


def test_titles_and_broken_pages():
    assert markdown.page_markdown("<title> a\n b </title>x") == ("a b", "x")
    assert markdown.page_markdown(None) == (None, "")
    assert markdown.page_markdown("<b>" * 5000 + "deep" + "<div>" * 5000 + "er")[1].count("e") >= 3
    assert markdown.page_markdown("</p></div><p>a</b></i>b")[1] == "ab"


def test_every_word_of_an_article_is_kept(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html", markdown.normalised(F.col("html")).alias("m")).collect()
    for r in pages:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if article and r.html.count("<article>") == 1 and "<main" not in r.html:
            plain = [x for x in WORD.findall(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<(script|style|aside|nav|form|header|footer)\b.*?</\1>|<!--.*?-->", " ", article[1]))))][:40]
            words = WORD.findall(re.sub(r"\\", "", r.m.markdown))
            assert sum(w in set(words) for w in plain) >= 0.9 * len(plain)
    assert all(r.m.markdown for r in pages)
