"""The filter language on one document of every kind of value, and random trees against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.filters import FilterError, compile_filter, fields

#: A parcel: each kind of JSON value at the top, inside an object, and inside a list.
DOC = {"parcel": "P-77", "kilos": 12, "cost": 7.25, "fragile": False, "stops": [3, 5, 8], "from": {"city": "Oslo", "gate": {"no": 2, "open": True}, "agent": None}, "marks": ["top", 12, None, False, 0.5], "lost": None, "extras": []}

CASES = [
    # numbers are equal by value, never to text or truth values
    ({"kilos": 12}, True), ({"kilos": 12.0}, True), ({"kilos": "12"}, False), ({"cost": 7.25}, True), ({"cost": 7}, False), ({"fragile": 0}, False), ({"fragile": False}, True), ({"kilos": True}, False),
    # paths lead through objects only; an object is equal as a whole
    ({"from.city": "Oslo"}, True), ({"from.gate.no": 2}, True), ({"from.gate": {"open": True}}, False), ({"from.gate": {"no": 2, "open": True}}, True), ({"from.city.part": "Oslo"}, False), ({"stops.1": 5}, False),
    # null is a value; what isn't there has none
    ({"lost": None}, True), ({"from.agent": None}, True), ({"from.phone": None}, False), ({"lost": {"$exists": True}}, True), ({"from.phone": {"$exists": False}}, True), ({"from.phone": {"$exists": True}}, False),
    # a list meets a condition by its members
    ({"stops": 5}, True), ({"stops": 4}, False), ({"stops": {"$ne": 5}}, False), ({"stops": {"$ne": 4}}, True), ({"marks": None}, True), ({"marks": False}, True), ({"marks": "12"}, False), ({"marks": 0.5}, True), ({"stops": [3, 5, 8]}, False), ({"extras": None}, False),
    ({"stops": {"$in": [1, 8]}}, True), ({"stops": {"$nin": [1, 8]}}, False), ({"marks": {"$in": ["down", "top"]}}, True), ({"extras": {"$nin": ["x"]}}, True), ({"parcel": {"$in": []}}, False), ({"parcel": {"$nin": []}}, True),
    # negations hold for what isn't there, comparisons don't
    ({"from.phone": {"$ne": "1"}}, True), ({"from.phone": {"$nin": ["1"]}}, True), ({"from.phone": {"$in": ["1"]}}, False), ({"from.phone": {"$gte": 0}}, False), ({"$not": {"from.phone": "1"}}, True),
    # comparisons stay within a type
    ({"kilos": {"$gt": 11}}, True), ({"kilos": {"$lte": 11.5}}, False), ({"kilos": {"$gt": "1"}}, False), ({"parcel": {"$gte": "P-7"}}, True), ({"parcel": {"$lt": 99}}, False), ({"fragile": {"$lt": True}}, True), ({"fragile": {"$gte": 0}}, False),
    # trees
    ({}, True), (None, True), ({"$and": []}, True), ({"$or": []}, False), ({"kilos": 12, "fragile": True}, False), ({"kilos": {"$gte": 12, "$lt": 13}}, True),
    ({"$or": [{"cost": 1}, {"$and": [{"from.gate.open": True}, {"$not": {"stops": 9}}]}]}, True), ({"$not": {"$or": [{"kilos": 12}, {"kilos": 13}]}}, False),
]


def test_cases(spark):
    one = spark.createDataFrame([(json.dumps(DOC),)], "j string").select(F.parse_json("j").alias("p"))
    row = one.select(*[compile_filter(c, F.col("p")).alias(f"c{k}") for k, (c, _) in enumerate(CASES)]).first()
    wrong = [(c, row[k]) for k, (c, want) in enumerate(CASES) if row[k] is not want]
    assert not wrong


@pytest.mark.parametrize("bad", [{"$nope": []}, {"a": {"$like": 1}}, {"a": {"$in": 3}}, {"a": {"$exists": 1}}, {"$and": 3}, {"a b": 1}, {"a": {"$in": "xyz"}}])
def test_what_is_not_in_the_language(spark, bad):
    with pytest.raises(FilterError):
        compile_filter(bad, F.col("p"))


def test_fields():
    assert fields({"$or": [{"a.b": 1}, {"$not": {"c": {"$gt": 2}}}], "d": 1}) == {"a.b", "c", "d"}


def matches(doc, f):
    def find(path):
        at = doc
        for p in path.split("."):
            if not isinstance(at, dict) or p not in at:
                return False, None
            at = at[p]
        return True, at

    def same(x, v):
        return type(x) is type(v) and x == v if not isinstance(x, (int, float)) or isinstance(x, bool) or isinstance(v, bool) else isinstance(v, (int, float)) and x == v

    def leaf(path, op, v):
        there, x = find(path)
        if op == "$exists":
            return there == v
        held = lambda v: there and (any(same(y, v) for y in x) if isinstance(x, list) else same(x, v))
        if op in ("$eq", "$ne"):
            return held(v) == (op == "$eq")
        if op in ("$in", "$nin"):
            return any(held(y) for y in v) == (op == "$in")
        number = lambda y: isinstance(y, (int, float)) and not isinstance(y, bool)
        if not there or not (number(x) and number(v) or isinstance(x, str) and isinstance(v, str)):
            return False
        return {"$gt": x > v, "$gte": x >= v, "$lt": x < v, "$lte": x <= v}[op]

    for k, v in f.items():
        ok = all(matches(doc, x) for x in v) if k == "$and" else any(matches(doc, x) for x in v) if k == "$or" else not matches(doc, v) if k == "$not" else all(leaf(k, op, x) for op, x in v.items())
        if not ok:
            return False
    return True


def test_random_trees(spark):
    rng = random.Random(42)
    value = lambda: rng.choice([0, 1, 2.5, "a", "b", True, False, None])
    path = lambda: rng.choice(["a", "b", "c.d", "c.e", "x"])

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            op = rng.choice(["$eq", "$ne", "$in", "$nin", "$gt", "$gte", "$lt", "$lte", "$exists"])
            v = [value() for _ in range(rng.randrange(3))] if op in ("$in", "$nin") else rng.random() < 0.5 if op == "$exists" else rng.choice([0, 1, 2.5, "a"]) if op[1] in "gl" else value()
            return {path(): {op: v}}
        if kind < 0.6:
            return {"$not": tree(depth - 1)}
        return {rng.choice(["$and", "$or"]): [tree(depth - 1) for _ in range(rng.randrange(3))]}

    docs = []
    for _ in range(30):
        d = {k: rng.choice([value(), [value() for _ in range(rng.randrange(3))]]) for k in "ab" if rng.random() < 0.8}
        if rng.random() < 0.7:
            d["c"] = rng.choice([{k: value() for k in "de" if rng.random() < 0.7}, 3])
        docs.append(d)
    trees = [tree(3) for _ in range(40)]
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, j string").select("k", F.parse_json("j").alias("p"))
    got = rows.select("k", *[compile_filter(t, F.col("p")).alias(f"t{n}") for n, t in enumerate(trees)]).collect()
    wrong = [(docs[r.k], t, r[f"t{n}"]) for r in got for n, t in enumerate(trees) if r[f"t{n}"] is not matches(docs[r.k], t)]
    assert not wrong, wrong[:2]
