"""Vector arithmetic in array expressions; float elements are widened to double first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values) -> Column:
    """A vector as one constant of the plan."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalized(v: Column) -> Column:
    size = norm(v)
    return F.when(size == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / size))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Higher is better for every metric."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "l2":
        return -l2(a, b)
    raise ValueError(f"no metric {metric!r}")


def int8(v: Column, largest: Column) -> Column:
    """Whole numbers from -127 to 127, scaled by the largest absolute element."""
    return F.transform(doubles(v), lambda x: F.rint(x / largest * 127).cast("int"))


def bits(v: Column) -> Column:
    """One sign for each element."""
    return F.transform(doubles(v), lambda x: (x > 0).cast("int"))


def sparse_dot(indices: Column, values: Column, query: dict[int, float]) -> Column:
    """The sum of products over the indices that both have."""
    total = F.lit(0.0)
    for k, w in query.items():
        at = F.array_position(indices, F.lit(k))
        total = total + F.when(at > 0, F.get(values, (at - 1).cast("int")).cast("double") * float(w)).otherwise(0.0)
    return total
