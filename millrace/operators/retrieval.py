"""The stages after search: one row a hit (query_id, id, score, rank, ...), each stage DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.search import rank_by
from millrace.sources.tables import written


def best_per(hits: DataFrame, key: str, id_col: str, query_id: str = "query_id") -> DataFrame:
    """The best hit of each key (a document, a content hash) within a query, ranked anew."""
    w = Window.partitionBy(query_id, key).orderBy(F.col("score").desc(), F.col(id_col))
    return rank_by(hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "rank"), query_id, id_col)


def expand_parents(hits: DataFrame, parent: str, id_col: str, query_id: str = "query_id") -> DataFrame:
    """Hits of one parent become the parent: best score, sorted list of the children that matched."""
    up = F.coalesce(F.col(parent), F.col(id_col)).alias(id_col)
    made = hits.groupBy(query_id, up).agg(F.max("score").alias("score"), F.array_sort(F.collect_set(F.when(F.col(parent).isNotNull(), F.col(id_col)))).alias("matched_child_ids"))
    return rank_by(made, query_id, id_col)


def token_budget(hits: DataFrame, budget: int, tokens: str = "token_count", query_id: str = "query_id") -> DataFrame:
    """Whole hits in rank order until the total would pass the budget; truncated: whether any was left out."""
    w = Window.partitionBy(query_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(tokens).over(w)
    everything = F.sum(tokens).over(Window.partitionBy(query_id))
    return hits.withColumn("total_tokens", total).withColumn("truncated", everything > budget).filter(F.col("total_tokens") <= budget)


def threshold(hits: DataFrame, least: float) -> DataFrame:
    return hits.filter(F.col("score") >= least)


def mmr(hits: DataFrame, k: int, id_col: str, weight: float = 0.5, vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """Maximal marginal relevance over each query's candidates (a bounded list): weight * score less (1 - weight) * the greatest cosine to what is chosen."""
    kinds = {c: hits.schema[c].dataType.simpleString() for c in (query_id, id_col)}

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", id_col], ascending=[False, True], kind="stable").reset_index(drop=True)
        x = np.array(rows[vector].tolist(), float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rel, near = rows["score"].to_numpy(), np.zeros(len(rows))
        left, taken = list(range(len(rows))), []
        while left and len(taken) < k:
            gain = [round(weight * rel[i] - (1 - weight) * (near[i] if taken else 0.0), 9) for i in left]
            best = left.pop(int(np.argmax(gain)))
            near = np.maximum(near, x @ x[best]) if taken else x @ x[best]
            taken.append(best)
        out = rows.loc[taken, [query_id, id_col, "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype="int32")
        return out

    return hits.select(query_id, id_col, "score", vector).groupBy(query_id).applyInPandas(choose, f"{query_id} {kinds[query_id]}, {id_col} {kinds[id_col]}, score double, rank int")


def rerank(hits: DataFrame, scorer, id_col: str, query_id: str = "query_id") -> tuple[DataFrame, list[str]]:
    """Hits with the scorer's scores (a Column of hits' columns), ranked anew; if it can't be planned, the old order and a notice."""
    try:
        return rank_by(hits.drop("rank").withColumn("score", scorer()), query_id, id_col), []
    except Exception as e:  # noqa: BLE001  a scorer may fail in any way; the hits stay
        return hits, [f"rerank skipped: {type(e).__name__}"]


def rank_changes(before: DataFrame, after: DataFrame, id_col: str, query_id: str = "query_id") -> DataFrame:
    """What a stage did to each hit: its ranks before and after; null where it wasn't there."""
    a = before.select(query_id, id_col, F.col("rank").alias("rank_before"))
    b = after.select(query_id, id_col, F.col("rank").alias("rank_after"))
    return a.join(b, [query_id, id_col], "full_outer").withColumn("change", F.col("rank_before") - F.col("rank_after"))


class Trace:
    """The outputs of a query's stages by name, each written as it is kept, so the next stage and the explanation read it and nothing is worked out twice."""

    def __init__(self) -> None:
        self.stages: dict[str, DataFrame] = {}

    def keep(self, name: str, hits: DataFrame) -> DataFrame:
        self.stages[name] = written(hits, f"stage-{name}")
        return self.stages[name]

    def explained(self, id_col: str, drops: dict[str, str], query_id: str = "query_id") -> DataFrame:
        """query_id, id, the rank in each stage (null where it isn't), and dropped_by: the first of the stages in drops (with what they are called) that an id didn't come through, null for what is returned."""
        rows = [x.select(query_id, id_col, F.lit(name).alias("stage"), "rank") for name, x in self.stages.items()]
        ranks = reduce(DataFrame.unionByName, rows).groupBy(query_id, id_col).agg(*[F.min(F.when(F.col("stage") == s, F.col("rank"))).alias(s) for s in self.stages])
        why = F.lit(None).cast("string")
        for stage, name in reversed(drops.items()):
            why = F.when(F.col(stage).isNull(), name).otherwise(why)
        return ranks.withColumn("dropped_by", why)


def union_targets(targets: dict[str, Callable[[], DataFrame]], strict: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """(the hits of all targets with their list, the failures by target): each target is searched and its hits written; one that fails in planning or running is left out, unless strict."""
    found, failed = [], {}
    for name, run in targets.items():
        try:
            found.append(written(run(), "target").withColumn("list", F.lit(name)))
        except Exception as e:
            if strict:
                raise
            failed[name] = type(e).__name__
    if not found:
        raise RuntimeError(f"no target could be searched: {failed}")
    return reduce(DataFrame.unionByName, found), failed


def compress(hits: DataFrame, terms: DataFrame, text: str = "content", query_id: str = "query_id") -> DataFrame:
    """hits with only those sentences of the text that hold a term of the query, in order; hits without one are left as they are. terms: query_id, terms (lower-cased words)."""
    asked = hits.join(F.broadcast(terms.select(query_id, F.col("terms").alias("_terms"))), query_id, "left")
    own = F.filter(T.sentences(F.col(text)), lambda s: F.arrays_overlap(T.tokens(s), F.col("_terms")))
    kept = F.when(F.size(own) > 0, F.array_join(F.transform(own, F.trim), " ")).otherwise(F.col(text))
    return asked.withColumn(text, kept).drop("_terms")


#: Profiles of up to so many rows go to the queries.
BROADCAST_TERMS = 500_000


def route(queries: DataFrame, profiles: DataFrame, most: int = 1, query_id: str = "query_id") -> DataFrame:
    """query_id, target, score, rank: the targets whose profile weighs a query's distinct words most. queries: query_id, query; profiles: target, term, weight."""
    words = queries.select(query_id, F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    profiles = written(profiles, "profiles")
    few = profiles.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    # where words meet by term, a task has words of all queries, and sums of all queries before its shuffle; so words stay with their query, or go back to it
    met = words.join(F.broadcast(profiles), "term") if few else words.join(profiles, "term").repartition(query_id)
    scored = met.groupBy(query_id, "target").agg(F.round(F.sum("weight"), 6).alias("score"))
    return rank_by(scored, query_id, "target").filter(F.col("rank") <= most)


def citations(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    return hits.withColumn("citation", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")))


def load_policy(p95_ms: float, slo_ms: float = 150.0, candidate_k: int = 100) -> dict:
    """Less work under load: no reranking from 80 % of the objective on, fewer candidates beyond 150 %."""
    return {"rerank": p95_ms <= 0.8 * slo_ms, "candidate_k": min(candidate_k, 50) if p95_ms > 1.5 * slo_ms else candidate_k}


def settle(*layers: dict) -> dict:
    """The first value that is given for each key: request, then knowledge base, then defaults."""
    out: dict = {}
    for layer in reversed(layers):
        out |= {k: v for k, v in layer.items() if v is not None}
    return out
