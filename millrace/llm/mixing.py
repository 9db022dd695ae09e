"""Mixing to target weights by soft membership, in DataFrame functions only.

1. A naive Bayes classifier over hashed words and counted symbols is fitted on the labelled documents: its counts are
   sums over all of them, its table of log odds has BUCKETS entries a domain and is part of the plan as a literal. Odds
   nearer to 0 than LEAST_ODDS are taken for 0 (noise of rare words), and a document's sum of odds is divided by the
   square root of its number of words (words of a text aren't independent): so it is an evidence, not yet a posterior.
2. Every document gets its posterior domain probabilities: its evidence through logistic curves that are fitted on the
   labelled documents. They are rounded to 1 / GRID, so documents fall into a number of cells that is bounded whatever
   their number (5151 for three domains).
3. Nonnegative rates r minimise (x - T)' W (x - T), where x_k is the share of tokens sum_i r_i tokens_i p_ik that domain
   k is expected to get, T the targets and W the inverse of the domains' second moments sum_i tokens_i p_ik p_il; of all
   rates that do, those nearest to 1 (PULL times their squared distance by tokens is added). It is a projected gradient:
   a gradient at a document is a product with its posteriors, so steps add up to K numbers, the way, and the rate of a
   cell is 1 less p times the way, projected to 0 and above. Each step is one distributed sum over the cells' token
   totals, which only shares, moments and two lengths leave. It is scaled by the inverse moments of what has a rate
   above 0 (what rests at 0 carries no part of a step), and shortened where the dual function it lowers would not fall
   enough; that is convex and made of parabolas, so few steps do.
4. The fit ends when every domain is within MET of its target, or when a step moves the rates by less than STILL (root
   mean square over tokens): then they are the nearest that nonnegative rates reach, which `Fit` reports
   (met, settled, shares, gap, steps). After STEPS it ends unsettled, and says so.
5. A document's copies are the whole part of its rate, and one more with the probability of the rest, decided by a
   hash of its id and text.

Edge cases: null or empty texts have no tokens and a posterior from the curves' offsets; labels of an id that disagree count as the
later domain of the list; a table without labels gives every domain the same posterior; a domain that no posterior
reaches keeps its gap; no tokens at all give rate 1; repeated rows are drawn alike; ties don't arise, as nothing is
ranked; a text of any length is read whole. Columns with a result's name are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shared

BUCKETS = 1 << 15
SYMBOLS = "#*$%&!|<>=@\n"
#: Log odds nearer to 0 than this are noise of rare words.
LEAST_ODDS = 0.8
GRID = 100
#: Cells up to this number are broadcast to the documents; with three domains there are 5151 at most.
BROADCAST_CELLS = 200_000
#: Tables of so many cells at most are one file.
ONE_FILE = 200_000
STEPS, MET, STILL = 400, 1e-3, 1e-4
#: The weight of rates near 1, and the parts of a step that are tried.
PULL, SHORTER = 1e-6, (1.0, 0.25, 0.0625, 0.015625, 0.00390625)
#: Far from the natural shares: poor documents nearly all go, toxic ones are wanted several times.
TARGETS = {"good": 0.65, "poor": 0.01, "toxic": 0.34}


@dataclass(frozen=True)
class Fit:
    """How a fit of rates ended: whether the targets are met, whether it came to rest, each domain's share of tokens, the largest gap to a target, the steps taken."""

    met: bool
    settled: bool
    shares: dict[str, float]
    gap: float
    steps: int


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def buckets(text: Column) -> Column:
    """A bucket for each word."""
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def symbol_counts(text: Column) -> list[Column]:
    return [F.length(text) - F.length(F.replace(text, F.lit(s), F.lit(""))) for s in SYMBOLS]


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain (0 good, 1 poor, 2 toxic) of a table of quality and toxic."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select("doc_id", domain.alias("domain"))


def fit(labelled: DataFrame, n_domains: int, text: str = "text", domain: str = "domain", smoothing: float = 0.5) -> np.ndarray:
    """Log odds against domain 0 by domain and bucket; the symbols' buckets come last."""
    body = F.coalesce(F.col(text), F.lit(""))
    one = labelled.select(F.col(domain).alias("d"), body.alias("t"))
    words_ = F.transform(buckets(F.col("t")), lambda b: F.struct(b.alias("b"), F.lit(1).alias("n")))
    signs = F.array(*[F.struct(F.lit(BUCKETS + k).alias("b"), c.alias("n")) for k, c in enumerate(symbol_counts(F.col("t")))])
    of = [F.sum(F.when(F.col("d") == k, F.col("n")).otherwise(0)).alias(f"d{k}") for k in range(n_domains)]
    seen = one.select("d", F.explode(F.concat(words_, signs)).alias("x")).select("d", "x.*").groupBy("b").agg(*of).collect()  # BUCKETS + SYMBOLS rows at most
    counts = np.zeros((n_domains, BUCKETS + len(SYMBOLS)))
    for r in seen:
        counts[:, r.b] = [r[f"d{k}"] for k in range(n_domains)]
    # half of each word's probability is that of all domains together, so a rare word says little about any
    pooled = counts.sum(axis=0) + smoothing
    pooled /= pooled.sum()
    odds = np.log(0.5 * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) + 0.5 * pooled)
    odds = odds - odds[0]
    odds[np.abs(odds) < LEAST_ODDS] = 0
    return odds


def _literal(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join("0" if v == 0 else f"{v:.4g}" for v in values)), ",").cast("array<double>")


def _total(places: Column, values: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda s, b: s + F.get(values, b))


def _evidence(docs: DataFrame, odds: np.ndarray, text: str) -> DataFrame:
    """docs with n_tokens and, for each domain but the first, _x: the log odds of its words, less by the square root of their number (words of a text aren't independent)."""
    body = F.coalesce(F.col(text), F.lit(""))
    made = docs.withColumn("_b", buckets(body)).withColumn("n_tokens", F.size("_b").cast("long"))
    signs = symbol_counts(body)
    for k in range(1, len(odds)):
        told = _total(F.col("_b"), _literal(odds[k, :BUCKETS]))
        for c, w in zip(signs, odds[k, BUCKETS:]):
            if w:
                told = told + c * float(w)
        made = made.withColumn(f"_x{k}", told / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")))
    return made.drop("_b")


def calibrate(labelled: DataFrame, odds: np.ndarray, text: str = "text", domain: str = "domain") -> list[tuple[float, float]]:
    """Slope and offset of each domain's log odds against the first, by logistic regression on the labelled documents."""
    seen = shared.written(_evidence(labelled.select(text, domain), odds, text).drop(text), "evidence")
    pairs = [seen.filter(F.col(domain).isin(0, k)) for k in range(1, len(odds))]
    return [shared.logistic(rows, F.col(f"_x{k}"), F.col(domain) == k) for k, rows in enumerate(pairs, 1)]


def posteriors(docs: DataFrame, odds: np.ndarray, curves: list[tuple[float, float]], names: list[str], text: str = "text") -> DataFrame:
    """docs with n_tokens and p_NAME for each domain: whole multiples of 1 / GRID that sum to 1."""
    made = _evidence(docs, odds, text)
    made = made.withColumns({f"_s{k}": F.col(f"_x{k}") * a + b for k, (a, b) in enumerate(curves, 1)})
    rest = [F.col(f"_s{k}") for k in range(1, len(names))]
    made = made.withColumn("_top", F.greatest(F.lit(0.0), F.lit(0.0), *rest))
    e = [F.exp(-F.col("_top")), *[F.exp(s - F.col("_top")) for s in rest]]
    made = made.withColumn("_sum", sum(e[1:], e[0]))
    made = made.withColumns({f"_c{k}": F.floor(x / F.col("_sum") * GRID + 0.5).cast("int") for k, x in enumerate(e[1:], 1)})
    used = F.lit(0)
    for k in range(1, len(names)):  # rounding up can't take more than there is
        made = made.withColumn(f"_c{k}", F.least(F.col(f"_c{k}"), F.lit(GRID) - used))
        used = used + F.col(f"_c{k}")
    made = made.withColumn("_c0", F.lit(GRID) - used)
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], "n_tokens", *[(F.col(f"_c{k}") / GRID).alias(f"p_{n}") for k, n in enumerate(names)])


def fit_rates(cells: DataFrame, names: list[str], targets: list[float]) -> tuple[DataFrame, Fit]:
    """The cells (p_NAME, tokens) with their rates, and how the fit ended; targets: shares of all tokens."""
    k, p = len(names), [F.col(f"p_{n}") for n in names]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    want = np.array(targets, float) / sum(targets)
    if not total:
        return cells.withColumn("rate", F.lit(1.0)), Fit(False, True, dict.fromkeys(names, 0.0), float(want.max()), 0)

    def rate(way: np.ndarray) -> Column:
        """1 less the steps so far, projected; told by the cell alone."""
        return F.greatest(F.lit(0.0), F.lit(1.0) - sum((c * float(g) for c, g in zip(p, way)), F.lit(0.0)))

    def measured(way: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """The domains' shares, the second moments of what has a rate above 0, the rates' mean square, and how far they are from those before."""
        made = cells.withColumns({"_r": rate(way), "_d": rate(way) - rate(before)})
        moving = F.when(F.col("_r") > 0, F.col("tokens")).otherwise(0)
        sums = [*[F.col("tokens") * F.col("_r") * c for c in p], *[moving * p[i] * p[j] for i, j in pairs], F.col("tokens") * F.col("_r") * F.col("_r"), F.col("tokens") * F.col("_d") * F.col("_d")]
        now = [float(x) / total for x in made.agg(*[F.sum(x) for x in sums]).first()]
        moments = np.zeros((k, k))
        for (i, j), v in zip(pairs, now[k:]):
            moments[i, j] = moments[j, i] = v
        return np.array(now[:k]), moments, now[-2], math.sqrt(now[-1])

    way = np.zeros(k)
    shares, moments, square, _ = measured(way, way)
    metric = PULL * (moments + 1e-7 * np.trace(moments) * np.eye(k))
    height = lambda way, square: 0.5 * square + way @ want + 0.5 * way @ metric @ way
    settled, steps = False, 0
    while np.abs(shares - want).max() >= MET and steps < STEPS and not settled:
        gradient = shares - want - metric @ way
        step = np.linalg.solve(moments + metric, gradient)
        was = height(way, square)
        for part in SHORTER:
            steps += 1
            found = measured(way + part * step, way)
            if height(way + part * step, found[2]) <= was - 1e-4 * part * float(gradient @ step):
                break
        way = way + part * step
        shares, moments, square, move = found
        settled = move < STILL
    gap = float(np.abs(shares - want).max())
    return cells.withColumn("rate", rate(way)), Fit(gap < MET, gap < MET or settled, dict(zip(names, shares.tolist())), gap, steps)


def thinned(cells: DataFrame, targets: dict[str, float], thin: tuple[str, ...]) -> dict[str, float]:
    """targets with each share of a domain of thin lowered to what the cells have of it, and raised to what it has in the cells that are mostly of the others: less could be met by dropping those only. The others take the rest as they stand to each other."""
    others = F.when(sum((F.col(f"p_{n}") for n in thin), F.lit(0.0)) <= 0.5, F.col("tokens")).otherwise(0)
    sums = cells.agg(F.sum("tokens"), F.sum(others), *[F.sum(x * F.col(f"p_{n}")) for x in (F.col("tokens"), others) for n in thin]).first()
    whole, total, clean = sum(targets.values()), float(sums[0] or 0), float(sums[1] or 0)
    if not total:
        return targets
    has, floor = sums[2 : 2 + len(thin)], sums[2 + len(thin) :]
    least = {n: min(max(targets[n] / whole, float(f) / clean if clean else 0.0), float(x) / total) for n, x, f in zip(thin, has, floor)}
    rest = sum(t for n, t in targets.items() if n not in least)
    return {n: least[n] if n in least else (1 - sum(least.values())) * t / rest for n, t in targets.items()}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, thin: tuple[str, ...] = ()) -> DataFrame:
    """docs (of its columns those of keep, or all) with n_tokens, p_NAME of each domain, rate, n_copies, fit_met, fit_settled and fit_gap (how the fit ended, the same in every row). labels: doc_id and domain, an index into targets. Domains of thin are never raised to their target."""
    targets = targets or TARGETS
    names = list(targets)
    fields = ["n_tokens", *[f"p_{n}" for n in names], "rate", "n_copies", "fit_met", "fit_settled", "fit_gap"]
    docs = shared.without(docs, fields)
    kept = keep or docs.columns
    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    labelled = shared.with_label(one, labels, "domain")
    odds = fit(labelled, len(names))
    chance = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1_000_000)) / 1_000_000
    own = {f"_own{k}": F.col("`" + c.replace("`", "``") + "`") for k, c in enumerate(kept)}
    read = docs.select(F.col(text).alias("_text"), chance.alias("_chance"), *[c.alias(n) for n, c in own.items()])
    # words are looked up once for each document: cells and copies are both drawn from this table
    known = shared.written(posteriors(read, odds, calibrate(labelled, odds), names, "_text").drop("_text"), "posteriors")
    keys = [f"p_{n}" for n in names]
    few = math.comb(GRID + len(names) - 1, len(names) - 1) <= ONE_FILE
    packed = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    cells = shared.written(packed(known.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))), "cells")
    wanted = thinned(cells, targets, thin) if thin else targets
    rated, ended = fit_rates(cells, names, list(wanted.values()))
    rates = shared.written(packed(rated.drop("tokens")), "rates")
    small = rates.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    more = (F.col("_chance") < F.col("rate") - F.floor("rate")).cast("long")
    out = known.join(F.broadcast(rates) if small else rates, keys, "left")
    made = out.withColumns({"n_copies": F.floor("rate") + more, "fit_met": F.lit(ended.met), "fit_settled": F.lit(ended.settled), "fit_gap": F.lit(ended.gap)})
    return made.select(*[F.col(n).alias(c) for n, c in zip(own, kept)], *fields)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix(docs, domain_of(shared.table(spark, sf_dir, "labels")), keep=["doc_id"])
