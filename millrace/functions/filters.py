"""The filter language: JSON conditions on nested payloads, compiled to one Column over a VARIANT.

A bare value means $eq. $eq, $ne, $in, $nin, $gt, $gte, $lt, $lte and $exists stand under a dotted field path; $and,
$or and $not combine conditions. A missing field matches nothing but $ne, $nin and $exists: false; a stored null is
there. Types must agree (a bool isn't a number); if they don't, that's no match, never an error. A stored list matches
$eq if it holds the value and $in if it holds any. A path through anything but an object is missing.

Every leaf is true or false, never NULL, so $not is the plain opposite.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERED = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
OPERATORS = {"$eq", "$ne", "$in", "$nin", "$exists", *ORDERED}
_SEGMENT = re.compile(r"[A-Za-z0-9_]+\Z")
_NUMBER = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"


class FilterError(ValueError):
    """A condition that isn't in the language."""


def _field(payload: Column, path: str) -> Column:
    parts = path.split(".")
    if not all(_SEGMENT.match(p) for p in parts):
        raise FilterError(f"not a field path: {path!r}")
    # a segment that is a number names an object's key, never a place in a list
    return F.try_variant_get(payload, "$" + "".join(f"['{p}']" for p in parts), "variant")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _equals(v: Column, value: Any) -> Column:
    """Whether a variant scalar is the value, of the same kind."""
    if value is None:
        return _sure(F.is_variant_null(v))
    if isinstance(value, bool):
        return _sure((_kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value)))
    if isinstance(value, (int, float)):
        return _sure(_kind(v).rlike(_NUMBER) & (F.try_variant_get(v, "$", "double") == F.lit(float(value))))
    if isinstance(value, str):
        return _sure((_kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(value)))
    if isinstance(value, (list, Mapping)):
        import json

        wanted = F.parse_json(F.lit(json.dumps(value, sort_keys=True)))
        return _sure(F.to_json(v) == F.to_json(wanted))
    raise FilterError(f"not a value of the language: {value!r}")


def _holds(v: Column, value: Any) -> Column:
    """Equality, or membership if a list is stored."""
    listed = _sure(_kind(v).startswith("ARRAY"))
    inside = F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: _equals(x, value))
    return F.when(listed, _sure(inside)).otherwise(_equals(v, value))


def _compares(v: Column, op: str, value: Any) -> Column:
    if isinstance(value, bool):
        kind, stored = _kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")
    elif isinstance(value, (int, float)):
        kind, stored, value = _kind(v).rlike(_NUMBER), F.try_variant_get(v, "$", "double"), float(value)
    elif isinstance(value, str):
        kind, stored = _kind(v) == "STRING", F.try_variant_get(v, "$", "string")
    else:
        return F.lit(False)
    return _sure(kind & getattr(stored, ORDERED[op])(F.lit(value)))


#: What Python types the values of a promoted column's kind have.
KINDS: dict[str, tuple[type, ...]] = {"string": (str,), "number": (int, float), "boolean": (bool,), "time": (datetime, date)}


def _fits(kind: str, value: Any) -> bool:
    return isinstance(value, KINDS[kind]) and (kind == "boolean" or not isinstance(value, bool))


def _promoted(c: Column, kind: str, op: str, value: Any) -> Column:
    """The same on a typed column, whose comparisons reach the scan; a value of another type is no match. (A column has one null for missing and stored null.)"""
    if op == "$exists":
        return c.isNotNull() if value else c.isNull()
    if op in ("$eq", "$ne"):
        same = c.isNull() if value is None else c == F.lit(value) if _fits(kind, value) else F.lit(False)
        return same if op == "$eq" and value is not None else _sure(same) if op == "$eq" else ~_sure(same)
    if op in ("$in", "$nin"):
        known = [x for x in value if _fits(kind, x)]
        some = c.isin(known) if known else F.lit(False)
        if any(x is None for x in value):
            some = _sure(some) | c.isNull()
        return some if op == "$in" else ~_sure(some)
    return getattr(c, ORDERED[op])(F.lit(value)) if _fits(kind, value) else F.lit(False)


def _leaf(payload: Column, path: str, op: str, value: Any, promoted: Mapping[str, tuple[Column, str]]) -> Column:
    if op not in OPERATORS:
        raise FilterError(f"unknown operator {op}")
    if op in ("$in", "$nin") and (not isinstance(value, Sequence) or isinstance(value, str)):
        raise FilterError(f"{op} needs a list")
    if op == "$exists" and not isinstance(value, bool):
        raise FilterError("$exists needs true or false")
    if path in promoted:
        return _promoted(*promoted[path], op, value)
    if isinstance(value, (date, datetime)):
        raise FilterError("times are compared on promoted columns")
    v = _field(payload, path)
    if op == "$exists":
        return v.isNotNull() if value else v.isNull()
    if op in ORDERED:
        return _compares(v, op, value)
    if op in ("$eq", "$ne"):
        held = _holds(v, value)
        return held if op == "$eq" else ~held
    held = F.lit(False)
    for x in value:
        held = held | _holds(v, x)
    return held if op == "$in" else ~held


def compile_filter(condition: Mapping[str, Any] | None, payload: Column, promoted: Mapping[str, tuple[Column, str]] | None = None) -> Column:
    """The condition as a boolean Column. promoted: typed columns for some paths, with their kinds (string, number, boolean, time), so that Parquet sees the predicate."""
    if not condition:
        return F.lit(True)
    promoted = promoted or {}
    out: Column | None = None
    for key, value in condition.items():
        if key in ("$and", "$or"):
            if not isinstance(value, Sequence) or isinstance(value, str):
                raise FilterError(f"{key} needs a list")
            each = F.lit(key == "$and")
            for x in value:
                one = compile_filter(x, payload, promoted)
                each = each & one if key == "$and" else each | one
        elif key == "$not":
            each = ~_sure(compile_filter(value, payload, promoted))
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        elif isinstance(value, Mapping) and any(str(k).startswith("$") for k in value):
            each = F.lit(True)
            for op, x in value.items():
                each = each & _leaf(payload, key, op, x, promoted)
        else:
            each = _leaf(payload, key, "$eq", value, promoted)
        out = each if out is None else out & each
    return out


def fields(condition: Mapping[str, Any] | None) -> set[str]:
    """The field paths that a condition uses."""
    found: set[str] = set()
    for key, value in (condition or {}).items():
        if key in ("$and", "$or"):
            found |= set().union(*map(fields, value))
        elif key == "$not":
            found |= fields(value)
        else:
            found.add(key)
    return found
