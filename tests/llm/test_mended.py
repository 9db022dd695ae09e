"""Bands beside holes of the learned lengths, batches of line dedup, hot lines, levelled ledgers, and language identification against a plain naive Bayes."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, linededup, quality, shared, tokencounts
from tests.llm.test_texts import brute_lines, prose

SF = "/root/testdata/sf0.001"


def test_bands_hold_only_near_what_was_learned(spark):
    rng = random.Random(5)

    def of(size):
        return prose(rng, size)[:size]

    bands = quality.fit_bands(spark.createDataFrame([(of(rng.randrange(90, 110)),) for _ in range(100)] + [(of(rng.randrange(10_000, 12_000)),) for _ in range(100)], "text string"))
    assert bands.knots and max(bands.knots) > 13 and min(bands.knots) < 7
    sizes = np.array([100, 300, 1000, 3000, 5500, 11_000, 40_000])
    plain, learned = quality.Bands().limits(sizes), bands.limits(sizes)
    same = [(a, b) == (c, d) for a, b, c, d in zip(*plain, *learned)]
    assert same == [False, True, True, True, True, False, True]
    text = of(1000).encode()
    import zstandard

    ratio = len(text) / len(zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False).compress(text))
    assert learned[0][2] <= ratio <= learned[1][2]


def test_bands_between_neighbours_and_beside_the_last():
    bands = quality.Bands(knots=(8.0, 8.5, 10.0), low=(1.0, 2.0, 3.0), high=(4.0, 6.0, 8.0))
    low, high = bands.limits(2.0 ** np.array([8.0, 8.25, 8.5, 8.74, 9.0, 9.76, 10.2, 10.3, 7.8]))
    plain = quality.Bands().limits(2.0 ** np.array([9.0, 10.3]))
    assert low.tolist() == [1.0, 1.5, 2.0, 2.0, plain[0][0], 3.0, 3.0, plain[0][1], 1.0]
    assert high.tolist() == [4.0, 5.0, 6.0, 6.0, plain[1][0], 8.0, 8.0, plain[1][1], 4.0]


@pytest.fixture
def lines(spark, tmp_path):
    rows = [(k, f"Shared one\nown {k}\nrare {k % 40}\n\nShared two" if k % 3 else f"own {k}", 7) for k in range(80)] + [(80, None, 7), (81, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    for files, name in ((1, "one"), (6, "six")):
        docs.repartition(files).write.parquet(str(tmp_path / f"{name}.parquet"))
    return {n: spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("one", "six")}, [r[1] for r in rows]


def _rows(df):
    return [(r.n_lines, r.n_dropped, r.kept_text) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", ["one", "six"])
def test_every_table_comes_in_batches(spark, lines, name):
    tables, texts = lines
    docs = tables[name]
    parts = linededup.arrivals(docs, 4)
    assert len(parts) == 4 and sum(p.count() for p in parts) == 82 and all(p.columns == docs.columns for p in parts)
    assert len(linededup.arrivals(docs.select("text", "doc_id"), 4)) == 4
    assert _rows(linededup.dedup(docs, parts)) == _rows(linededup.dedup(docs)) == brute_lines(texts, 10)


@pytest.mark.parametrize("name", ["one", "six"])
def test_what_is_worked_out_is_not_read_anew(spark, lines, name):
    tables, texts = lines
    new = tables[name].withColumn("text", F.concat(F.lit("new\n"), "text"))
    assert linededup.arrivals(new, 4) == [new]
    assert linededup.arrivals(tables[name].filter("doc_id > 3"), 4)[0].count() == 78
    assert _rows(linededup.dedup(new, linededup.arrivals(new, 4))) == brute_lines(["new\n" + t if t is not None else None for t in texts], 10)


def test_op7_merges_batches_of_a_single_file(spark, monkeypatch):
    seen = []
    plain = linededup.LineRuns.add

    def add(self, batch, *a, **b):
        runs = len(self.state["runs"])
        seen.append(runs)
        return plain(self, batch, *a, **b)

    monkeypatch.setattr(linededup.LineRuns, "add", add)
    docs = shared.table(spark, SF, "documents")
    assert len(docs.inputFiles()) == 1
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.op7(spark, SF).collect()}
    assert seen == [0, 1, 2, 3]  # each batch is merged with the runs before it
    rows = docs.select("doc_id", "text").collect()
    assert got == {r.doc_id: x[:2] for r, x in zip(rows, brute_lines([r.text for r in rows], 10))}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_a_line_that_was_ripe_early_is_hot_by_all_its_documents(spark, monkeypatch):
    rows = [(k, f"hottest\nsecond {k % 20}\nown {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = linededup.LineRuns(spark, least_docs=3)
    for part in (docs.filter("doc_id < 30"), docs.filter("doc_id >= 30")):
        runs.add(part)
    a, b = linededup._pair(linededup._hash(b"hottest"))
    assert [r.n for r in runs.frequent().filter((F.col("a") == a) & (F.col("b") == b)).collect()] == [30]  # the run knows no more
    joined, plain = [], linededup._drop_joined
    monkeypatch.setattr(linededup, "_drop_joined", lambda d, small, hot, text: joined.append(({(r.a, r.b) for r in small.collect()}, len(hot.value[0]))) or plain(d, small, hot, text))
    got = linededup.drop(docs, runs.frequent(), broadcast_keys=1, hot_share=3)
    assert len(joined[0][0]) == 20 and (a, b) not in joined[0][0] and joined[0][1] == 1
    assert _rows(got) == brute_lines([t for _, t in rows], 3)


def test_ledgers_are_merged_by_level(spark, folder):
    schema = "doc_id long, text string, source string, lang string"
    store = tokencounts.TokenTotals(spark, folder, version="v")
    have: dict[int, int] = {}
    for k in range(10):
        rows = [(10 * k + j, "w " * (k + j), f"s{j % 2}", None) for j in range(4)]
        gone = spark.createDataFrame([(10 * (k - 1) + 1,), (None,)], "doc_id long")
        store.commit(str(k), inserts=spark.createDataFrame(rows, schema), deletes=gone)
        have.update({r[0]: (k + r[0] % 10) for r in rows})
        have.pop(10 * (k - 1) + 1, None)
        levels = store._state()["levels"]
        assert max(Counter(levels).values()) < tokencounts.FANOUT and len(levels) == len(store._state()["ledgers"]) == len(store._state()["deltas"])
    got = {r.source: r.n_docs for r in store.totals().collect()}
    want = Counter(f"s{d % 10 % 2}" for d in have)
    assert got == dict(want)
    assert not store.commit("3", inserts=spark.createDataFrame([(1, "x", "s", None)], schema))
    store.commit("none", inserts=spark.createDataFrame([], schema), deletes=spark.createDataFrame([], "doc_id long"))
    store.compact()
    assert {r.source: r.n_docs for r in store.totals().collect()} == got and len(store._state()["ledgers"]) == 1


def test_language_id_is_a_plain_naive_bayes(spark):
    n_buckets, smoothing = 1 << 10, 0.1
    docs = shared.table(spark, SF, "documents")
    learned = docs.filter(F.col("doc_id") % 3 != 0)
    model = langid.fit(learned, n_buckets=n_buckets, smoothing=smoothing)

    def grams(text):
        data = (text or "").encode()
        return langid.trigrams(np.frombuffer(data, np.uint8), np.array([0, len(data)]), n_buckets)[0].tolist()

    counts, prior = {}, Counter()
    for r in learned.filter("lang IS NOT NULL").collect():
        counts.setdefault(r.lang, Counter()).update(grams(r.text))
        prior[r.lang] += 1
    names = sorted(counts)
    totals = {x: sum(counts[x].values()) + smoothing * n_buckets for x in names}
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert model[0] == names
    checked = 0
    for r in docs.collect():
        own = grams(r.text)
        if not own:
            assert got[r.doc_id].lang_pred == "und"
            continue
        logs = [math.log(prior[x] / sum(prior.values())) + sum(math.log((counts[x][g] + smoothing) / totals[x]) for g in own) for x in names]
        best = max(range(len(names)), key=lambda k: logs[k])
        second = sorted(logs)[-2] if len(logs) > 1 else -math.inf
        if logs[best] - second > 0.05:  # float32 sums
            assert got[r.doc_id].lang_pred == names[best]
            checked += 1
    assert checked > 150
