"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded over the whole tree.

The trees are fitted by Spark ML on the nodes of at most SAMPLE_PAGES pages (chosen by a hash of their id), a bounded
sample of labelled rows. Their labels are distant: a page's <article> or <main> is content, all else isn't. Pages are
fitted as they are and in several other dresses of the same text: without semantic tags, with other class names, with
menus, notices, forms, related links and reader comments in and around the article, whose text comes from other pages.
Every page of the table is then scored whole, in bounded runs of pages, without a shuffle.

Edge cases: a null or empty html gives an empty text; markup that is cut off or never closed is read as far as it goes;
repeated rows are read one by one; with no page to learn from, texts inside <article> or <main> are taken. Columns
with a result's name are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import htmltree, shared

SAMPLE_PAGES = 300
TREES, DEPTH, STEP = 20, 4, 0.3
FIELDS = ["text", "n_chars"]
_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*?)(</\1\s*>|<footer\b|\Z)", re.S | re.I)
_TAGS = re.compile(r"<[^>]*>")
_GOOD = ["post-content", "entry-content", "article-body", "story", "main-content", "page-content", "text", "prose"]
_BAD = ["sidebar", "menu", "ad-banner", "promo", "related-posts", "share-bar", "cookie-notice", "newsletter-form", "breadcrumbs", "site-footer", "site-header", "widget"]


def _links(words: list[str]) -> str:
    return "<ul>" + "".join(f'<li><a href="#">{w}</a></li>' for w in words) + "</ul>"


def dressed(source: str, other: str, k: int) -> list[str]:
    """The page with its labels, and the same article in other dresses; other: text of another page."""
    m = _ARTICLE.search(source)
    if not m:
        return []
    body, words = m.group(2), _TAGS.sub(" ", other).split()[:400]
    good, bad, more = _GOOD[k % len(_GOOD)], _BAD[k % len(_BAD)], _BAD[(k // 2 + 5) % len(_BAD)]
    some, say = (lambda a, b: words[a % 97 : a % 97 + b]), (lambda a, b: " ".join(words[a % 89 : a % 89 + b]))
    nav = f'<nav data-y="0">{_links(some(k, 6))}</nav>'
    talk = "".join(f'<div class="comment" data-y="0"><b>{say(k + j, 1)}</b><p>{say(k + 7 * j, 12 + 9 * j)}</p></div>' for j in range(1 + k % 4))
    form = f'<form data-y="0"><label>{say(k, 2)}</label><input name="q"><button>{say(k, 1)}</button><p>{say(k + 3, 8)}</p></form>'
    inner = body
    cut = body.find("</p>")
    if cut > 0 and k % 2:
        inner = body[: cut + 4] + f'<div class="{more}" data-y="0"><p>{say(k + 11, 5 + k % 20)}</p></div>' + body[cut + 4 :]
    page = lambda x: f'<html><body data-y="0">{x}</body></html>'
    return [
        source[: m.start()] + f'<article data-y="1">{body}</article>' + source[m.end() - len(m.group(3)) :],
        page(f'<header data-y="0"><a href="/">{say(k, 3)}</a></header>{nav}<div class="wrap"><div class="{good}" data-y="1">{inner}</div><div class="{bad}" data-y="0"><p>{say(k + 5, 8 + k % 30)}</p>{_links(some(k + 9, 5))}</div></div><footer data-y="0"><p>{say(k, 6)}</p></footer>'),
        page(f'<div class="{bad}" data-y="0">{say(k + 2, 9)}</div><main data-y="1">{inner}<section class="comments" data-y="0"><h3>{say(k, 2)}</h3>{talk}</section></main><aside data-y="0"><h4>{say(k, 2)}</h4><p>{say(k + 4, 15)}</p></aside>'),
        page(f'<div>{_links(some(k, 7))}</div><div><div data-y="1">{body}</div><div>{_links(some(k + 20, 4))}</div></div><div>{say(k + 8, 7)}</div>'),
        page(f'{nav}<article data-y="1">{inner}<div class="{more}" data-y="0">{_links(some(k + 4, 3))}</div>{form}<div id="comments" data-y="0">{talk}</div></article><div class="{bad}" data-y="0"><p>{say(k, 12)}</p></div>'),
    ]


def node_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """features, label of the nodes of the pages and their other dresses."""
    for part in parts:
        pages = [x or "" for x in part.column(0).to_pylist()]
        for k, source in enumerate(pages):
            rows, labels = [], []
            for made in dressed(source, pages[(k + 1) % len(pages)], k):
                page = htmltree.parse(made)
                rows.append(htmltree.features(page))
                labels += [float(y == 1) for y in page.given]
            if rows:
                table = np.concatenate(rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, table.shape[1]), pa.int32()), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([flat, pa.array(labels)], ["features", "label"])


class Trees:
    """Boosted trees as arrays; a leaf leads to itself."""

    def __init__(self, model=None):
        feature, limit, left, right, value = [], [], [], [], []

        def grow(node) -> int:
            k = len(feature)
            leaf = node.getClass().getSimpleName() == "LeafNode"
            feature.append(0 if leaf else node.split().featureIndex())
            limit.append(0.0 if leaf else node.split().threshold())
            value.append(node.prediction())
            left.append(k)
            right.append(k)
            if not leaf:
                left[k], right[k] = grow(node.leftChild()), grow(node.rightChild())
            return k

        self.roots = [grow(t._call_java("rootNode")) for t in model.trees] if model else []
        self.weights = list(model.treeWeights) if model else []
        self.feature, self.limit, self.value = np.array(feature, int), np.array(limit), np.array(value)
        self.left, self.right = np.array(left, int), np.array(right, int)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.roots:
            return np.clip(x[:, 0] + x[:, htmltree.N_TAGS], 0, 1)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            total += weight * self.value[at]
        return 1 / (1 + np.exp(-2 * total))


def fit(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample_pages: int = SAMPLE_PAGES) -> Trees:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    ids = [r[0] for r in pages.select(page_id).filter(F.col(page_id).isNotNull()).distinct().orderBy(F.xxhash64(page_id), page_id).limit(sample_pages).collect()]
    sample = pages.filter(F.col(page_id).isin(ids)).orderBy(F.xxhash64(page_id), html).limit(sample_pages).select(html)
    rows = shared.written(sample.mapInArrow(node_rows, "features array<double>, label double"), "nodes")
    if rows.agg(F.countDistinct("label")).first()[0] < 2:
        return Trees()
    data = rows.select(array_to_vector("features").alias("features"), "label").coalesce(4)
    return Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=48, seed=7).fit(data))


def extract(pages: DataFrame, trees: Trees, html: str = "html") -> DataFrame:
    """pages with text and n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(trees)

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        raw = data.tobytes()
        read = [htmltree.parse(raw[i:j].decode("utf-8", "replace")) for i, j in zip(offsets[:-1], offsets[1:])]
        tables = [htmltree.features(p) for p in read]
        found = sent.value.probability(np.concatenate(tables)) if tables else np.zeros(0)
        edges = np.cumsum([0, *map(len, tables)])
        texts = [htmltree.text_of(p, htmltree.decode(p.parent, found[a:b])) for p, a, b in zip(read, edges[:-1], edges[1:])]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return shared.with_fields(pages, shared.text_udf(work, "text string, n_chars long")(F.col(html)), FIELDS)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
