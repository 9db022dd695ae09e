"""The similarity join against all pairs."""

import random
import re

import numpy as np
import pytest

from millrace.llm import ngramjoin
from millrace.llm.components import components

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, n=5):
    w = ALNUM.findall((text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, threshold=0.8):
    classes = {}
    for i, t in rows:
        s = shingles(t)
        classes.setdefault(s or ("none", i), []).append(i)
    keys = [k for k in classes if isinstance(k, frozenset)]
    links = {k: 0 for k in keys}
    parent = {k: k for k in keys}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if len(x & y) >= threshold * len(x | y):
                links[x] += 1
                links[y] += 1
                parent[top(x)] = top(y)
    groups = {}
    for k in keys:
        groups.setdefault(top(k), []).extend(classes[k])
    out = {}
    for k, ids in classes.items():
        for i in ids:
            out[i] = (min(ids), min(groups[top(k)]), links[k]) if isinstance(k, frozenset) else (i, i, 0)
    return out


def table(n_groups=12, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.randrange(6, 160))]
        for c in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 4) if c else 0):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rows += [None, "", "  ", "one two", "One, two!", "three"]
    return [(k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("blocks", [(1024, 256), (4, 3)])
def test_all_links_are_found(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngramjoin, "BLOCK", blocks[0])
    monkeypatch.setattr(ngramjoin, "SET_BLOCK", blocks[1])
    rows = table()
    got = ngramjoin.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in got.collect()} == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = table(8, 9)
    names = ["doc_id", "text", "_cls", "_one", "_two", "_id", "root", "a.b"]
    docs = spark.createDataFrame([(i, t, *"xxxxxx") for i, t in rows] + [rows[0] + tuple("xxxxxx")], names)
    want = brute(rows)
    kept = ngramjoin.keep_one(docs)
    found = kept.collect()
    assert sorted(r.doc_id for r in found) == sorted({v[1] for v in want.values()}) and kept.columns == names
    assert all(r[2:] == tuple("xxxxxx") for r in found)


def test_copies_without_ids_meet_no_cross_join(spark):
    text, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(30))
    rows = [(None, text)] * 50 + [(None, text + " more")] * 50 + [(None, other)] * 20 + [(None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.n_links for r in ngramjoin.similar(docs).collect())
    assert got == [0] * 22 + [1] * 100
    assert sorted(str(r.text)[:1] for r in ngramjoin.keep_one(docs).collect()) == ["N", "N", "a", "b"]


def test_null_ids_keep_their_links(spark):
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(None, text), (5, text + " more"), (None, None)]
    got = ngramjoin.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_links for r in got) == [0, 1, 1]


def test_depth_meets_the_target():
    for threshold in (0.5, 0.8, 0.95):
        d = ngramjoin.depth_for(threshold, 0.999)
        assert d == 1 or 1 - (1 - threshold**d) ** ngramjoin.TREES >= 0.999
        assert d == ngramjoin.DEEPEST or 1 - (1 - threshold ** (d + 1)) ** ngramjoin.TREES < 0.999


def test_only_classes_whose_links_are_far_stay_open(spark):
    near = [(b"x", 9, 4), (b"x", 7, 1)]  # similarity 0.98 and 0.94
    far = [(b"y", 9, 4), (b"y", 0, 1)]  # one at 0.8: 7 of 100 such are missed at depth 10
    rows = spark.createDataFrame(near + far, "a binary, bin int, n long")
    assert [bytes(r.cls) for r in ngramjoin.settled(rows, 10, 0.8, 0.99, 24).collect()] == [b"x"]
    assert {bytes(r.cls) for r in ngramjoin.settled(rows, 6, 0.8, 0.99, 24).collect()} == {b"x", b"y"}


def test_shorter_prefixes_find_what_deep_ones_miss(spark, monkeypatch):
    rng = random.Random(21)
    rows = []
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(200)]
        other = list(base)
        for k in rng.sample(range(5, 195, 10), 4):
            other[k] = f"c{g}x{k}"  # about 0.82 similar
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    links = lambda: sum(r.n_links for r in ngramjoin.similar(docs).collect())
    assert links() == sum(v[2] for v in want.values()) == 120
    monkeypatch.setattr(ngramjoin, "depth_for", lambda *_: 10)
    assert links() < 120


def test_exact_matches_against_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    got = ngramjoin.exact_matches(sets, np.arange(30), np.arange(30), 0.5)
    for a in range(30):
        for b in range(30):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert got[a, b] == (len(x & y) / len(x | y) >= 0.5)


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(7)
    names = rng.sample(range(10_000), 120)
    edges = [*zip(names[:60], names[1:60]), *[(names[60], x) for x in names[61:100]], (names[100], names[100])]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in names[:60]} == {min(names[:60])} and {got[x] for x in names[60:100]} == {min(names[60:100])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_empty_table(spark):
    assert ngramjoin.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
