"""Retrieval quality: ranked lists against graded relevance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import written


def metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int], query_id: str = "query_id", item: str = "doc_id") -> DataFrame:
    """query_id, k, recall, precision, hit_rate, mrr, ndcg of ranked (query, item, rank) against relevant (query, item, gain > 0).

    Queries of relevant without any hit count with zeros; a query without relevant items isn't judged.
    """
    good = relevant.filter("gain > 0")
    ideal = good.withColumn("_n", F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("gain").desc(), item)))
    best = [F.sum(F.when(F.col("_n") <= k, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("_n") + 1)).otherwise(0.0)).alias(f"ideal{k}") for k in ks]
    base = ideal.groupBy(query_id).agg(F.count("*").alias("n"), *best)
    hit = ranked.join(good, [query_id, item])
    parts = []
    for k in ks:
        near = F.col("rank") <= k
        parts += [F.count_if(near).alias(f"hits{k}"), F.sum(F.when(near, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg{k}"), F.min(F.when(near, F.col("rank"))).alias(f"first{k}")]
    found = base.join(hit.groupBy(query_id).agg(*parts), query_id, "left")
    rows = []
    for k in ks:
        hits = F.coalesce(f"hits{k}", F.lit(0))
        rows.append(F.struct(
            F.lit(k).alias("k"), F.round(hits / F.col("n"), 6).alias("recall"), F.round(hits / F.lit(k), 6).alias("precision"), (hits > 0).cast("double").alias("hit_rate"),
            F.round(F.coalesce(1 / F.col(f"first{k}"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col(f"dcg{k}") / F.col(f"ideal{k}"), F.lit(0.0)), 6).alias("ndcg"),
        ))
    return found.select(query_id, F.explode(F.array(*rows)).alias("m")).select(query_id, "m.*")


def compare(a: DataFrame, b: DataFrame, metric: str, by: list[str], small: float = 1e-9) -> DataFrame:
    """by, before, after, delta, relative, verdict of two runs, regressions first."""
    both = a.select(*by, F.col(metric).alias("before")).join(b.select(*by, F.col(metric).alias("after")), by)
    delta = F.round(F.col("after") - F.col("before"), 6)
    verdict = F.when(delta > small, "improved").when(delta < -small, "regressed").otherwise("unchanged")
    return both.withColumns({"delta": delta, "relative": F.when(F.col("before") != 0, F.round(delta / F.col("before"), 6)), "verdict": verdict}).orderBy("delta", *by)


def bootstrap(compared: DataFrame, rounds: int = 1000, seed: int = 11) -> DataFrame:
    """p_value of "after isn't better" and rounds: the share of paired resamples with a mean delta of 0 or less.

    Every pair is drawn a Poisson(1) number of times in each round, which depends on its place alone: a task sums its pairs
    for all rounds at once, and only those sums are shuffled, whatever the number of pairs.
    """

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(rounds), np.zeros(rounds)
        for part in parts:
            for delta, own in zip(part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)):
                times = np.random.default_rng([seed, int(own) & (2**63 - 1)]).poisson(1.0, rounds)
                total, n = total + times * delta, n + times
        yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), pa.array(total), pa.array(n)], ["round", "total", "n"])

    names = sorted(c for c in compared.columns if c != "delta")
    pairs = compared.select(F.col("delta").cast("double").alias("delta"), F.xxhash64(*names).alias("own"))
    sums = pairs.mapInArrow(draw, "round int, total double, n double").groupBy("round").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0")
    return sums.agg(F.avg((F.col("total") / F.col("n") <= 0).cast("double")).alias("p_value"), F.count("*").alias("rounds"))


#: Versions from this number on are temporary: an experiment's own, which no reader takes for the active one.
TEMPORARY = 1_000_000


def ab_run(tables, kb: str, active: int, run: Callable[[int], DataFrame], relevant: DataFrame, ks: list[int], build: Callable[[int], None] | None = None, trial: Callable[[int], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """metrics of the active version and of a trial. run, trial: the ranked hits (query_id, doc_id, rank) of a version.

    A trial of other chunks or vectors is built beside the active version by `build`, as a temporary version, and is dropped
    whatever happens; one that differs in the search alone has no build and reads the active version.
    """
    if build is None:
        return metrics(run(active), relevant, ks), metrics((trial or run)(active), relevant, ks)
    version = max([TEMPORARY - 1, *tables.versions(kb)]) + 1
    try:
        build(version)
        after = written(metrics((trial or run)(version), relevant, ks), "trial")  # worked out while the version is there
        return metrics(run(active), relevant, ks), after
    finally:
        tables.drop(kb, version)


def sweep(tables, kb: str) -> list[int]:
    """Drops temporary versions that a run which was killed has left; which."""
    left = [v for v in tables.versions(kb) if v >= TEMPORARY]
    for version in left:
        tables.drop(kb, version)
    return left
