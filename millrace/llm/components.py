"""Connected components of a graph of edges, by joins: no group of a component is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b); roots and nodes have the edges' type.

    Each round every node points to its least neighbour, pointers are followed twice, and the graph shrinks to what the
    pointers lead to. With nodes in random order (hashes) the edges fall by a constant factor a round; edges that are left after
    all rounds raise RuntimeError.
    """
    live = shared.written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    for _ in range(rounds):
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        least = shared.written(least, "least")
        for _ in range(2):
            up = least.select(F.col("node").alias("root"), F.col("root").alias("above"))
            least = shared.written(least.join(up, "root").select("node", F.col("above").alias("root")), "least")
        steps.append(least)
        left = live.join(least.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        right = left.join(least.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        live = shared.written(right.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[-1]
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = step.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return shared.written(roots, "roots")
