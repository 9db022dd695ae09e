"""Toxicity against a plain Kneser-Ney model, and on held-out rows."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return ALNUM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def toxic_rows(n=240):
    rng = random.Random(3)
    words = [f"plain{k}" for k in range(200)]
    rows = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten"]))
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def brute_evidence(rows, texts, d1, d2, share):
    """The docstring's formulas over dictionaries."""
    contexts = [defaultdict(set), defaultdict(set)]
    for text, y in rows:
        w = words_of(text)
        for k, x in enumerate(w):
            contexts[y][w[k - 1] if k else None, x].add((w[k - 2] if k > 1 else None))
    pair = [{k: len(v) for k, v in c.items()} for c in contexts]
    word, before = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for c in (0, 1):
        for (v, x), n in pair[c].items():
            word[c][x] += 1
            before[c][v] += n
    size = 1 << toxicity.BITS
    everything = sum(word[0].values()) + sum(word[1].values()) + 0.5 * size

    def p_word(c, x):
        total = max(sum(word[c].values()), 1)
        rest = 1 - sum(max(n - d1, 0) for n in word[c].values()) / total
        return max(word[c].get(x, 0) - d1, 0) / total + rest * (word[0].get(x, 0) + word[1].get(x, 0) + 0.5) / everything

    def p(c, v, x):
        total = max(before[c].get(v, 0), 1)
        rest = 1 - sum(max(n - d2, 0) for (a, _), n in pair[c].items() if a == v) / total
        return max(pair[c].get((v, x), 0) - d2, 0) / total + rest * p_word(c, x)

    out = []
    for text in texts:
        w = words_of(text)
        told = [math.log1p(share * (p(1, w[k - 1] if k else None, x) / p(0, w[k - 1] if k else None, x) - 1)) for k, x in enumerate(w)]
        out.append(sum(told) / max(len(w), 1))
    return out


@pytest.mark.parametrize("block", [1_000_000, 2])
def test_evidence_is_that_of_the_formulas(spark, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK_PAIRS", block)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    rows = [(t, int(k % 3 == 0)) for k, t in enumerate(texts)] + [(texts[0], 1), (None, 0), ("", 1)]
    pairs = toxicity.pair_counts(spark.createDataFrame(rows, "text string, y int"), F.col("y"))
    sums = toxicity.summed(pairs).cache()
    words = toxicity.word_tables(sums, (0, 1), 0, (2.0,))[0]
    frequent = toxicity.frequent_pairs(sums, (0, 1), 0)
    model = toxicity.Model(words, frequent, frequent.count(), 0.01, 1.0, 0.0)
    assert model.n_pairs > 5
    asked = texts[:10] + ["a zz b", "A, b!", None, ""]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r.e for r in toxicity.evidence(docs, model, "text", "e").collect()}
    want = brute_evidence(rows, asked, 2.0, toxicity.PAIR_DISCOUNTS[0], 0.01)
    assert all(abs(got[k] - e) < 1e-5 for k, e in enumerate(want)) and any(abs(e) > 1e-4 for e in want)


def test_copies_add_no_counts(spark):
    rows = [("a b a b", 0), ("c b", 0), ("A b", 1), (None, 1), ("", 0)]
    count = lambda r: sorted((x.grp, x.pair, x.n) for x in toxicity.pair_counts(spark.createDataFrame(r, "text string, y int"), F.col("y")).collect())
    once = count(rows)
    assert once == count(rows * 3) and sorted(n for _, _, n in once) == [1, 1, 1, 1, 1, 1, 2]


def test_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(k, t, y, 0.5, "own") for k, t, y in rows], "doc_id long, text string, toxic int, _evidence double, Score string")
    model = toxicity.fit(docs.filter("doc_id % 3 <> 0"))
    assert model.chosen["rows"] == 160
    extra = spark.createDataFrame([(1000, None, 0.5, "own"), (1001, "", 0.5, "own"), (1002, rows[0][1], 0.5, "own"), (1003, rows[4][1] + " word" * 30_000, 0.5, "own")], "doc_id long, text string, _evidence double, Score string")
    got = {r.doc_id: r for r in toxicity.predict(docs.drop("toxic").unionByName(extra), model).collect()}
    held = [(got[k].predicted, t) for k, _, t in rows if k % 3 == 0]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r._evidence == 0.5 for r in got.values())
    assert got[1000].predicted == 0 and got[1000].score == got[1001].score and got[1002].score == got[0].score


def test_without_labels_or_of_one_class(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert [r.score for r in toxicity.predict(docs, model).collect()] == [0.5, 0.5]
    one = toxicity.fit(spark.createDataFrame([(1, "x y", 0)], "doc_id long, text string, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.predict(docs, one).collect())
    assert toxicity.predict(docs.limit(0), one).count() == 0
