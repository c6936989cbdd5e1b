"""From scored pairs to one decided set of records per S1. Ties always go to the smaller id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from linkloom.operators import windows

#: Candidates of an S1 that the expected-F rule looks at, and the least score of one.
MAX_CANDIDATES, MIN_PROB = 20, 0.01


def assign(pairs: DataFrame) -> DataFrame:
    """Each record only with its best S1."""
    return windows.first_rows(pairs, ["cand_id"], [F.desc("prob"), F.asc("s1_id")], 1).drop("place")


def keep(pairs: DataFrame, threshold: float, assigned: bool = True, fallback: float | None = None) -> DataFrame:
    """Decided pairs: scores from ``threshold`` up; an S1 left with none keeps its best candidate from ``fallback`` up."""
    owned = assign(pairs) if assigned else pairs
    kept = owned.where(F.col("prob") >= threshold)
    if fallback is None:
        return kept
    best = windows.first_rows(owned, ["s1_id"], [F.desc("prob"), F.asc("cand_id")], 1).drop("place").where(F.col("prob") >= fallback)
    return kept.unionByName(best.join(kept.select("s1_id").distinct(), "s1_id", "left_anti"))


def listed(decided: DataFrame, name: str = "ids") -> DataFrame:
    """One comma list of sorted ids per S1."""
    return decided.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(name))


def prefix_exact(probs, beta: float = 0.5) -> int:
    """Length of the prefix of descending probabilities with the greatest expected F-beta, labels independent; shorter ones win ties.

    The numbers of true labels inside and outside a prefix are Poisson-binomial, so the expectation is a sum over both.
    """
    p = np.asarray(probs, float)
    b2 = beta * beta

    def count(q):
        d = np.ones(1)
        for x in q:
            d = np.convolve(d, [1 - x, x])
        return d

    best, value = 0, float(np.prod(1 - p))
    for k in range(1, len(p) + 1):
        inside, outside = count(p[:k]), count(p[k:])
        tp, fn = np.arange(k + 1)[:, None], np.arange(len(p) - k + 1)[None, :]
        v = float((inside[:, None] * outside[None, :] * (1 + b2) * tp / (b2 * (tp + fn) + k)).sum())
        if v > value + 1e-12:
            best, value = k, v
    return best


def prefix_sampled(probs, beta: float = 0.5, samples: int = 256, seed: int = 0) -> int:
    """The same by ``samples`` seeded draws of the labels."""
    p = np.asarray(probs, float)
    if not len(p):
        return 0
    y = np.random.default_rng(seed).random((samples, len(p))) < p
    true, b2 = y.sum(axis=1), beta * beta
    values = [float((true == 0).mean())]
    for k in range(1, len(p) + 1):
        tp = y[:, :k].sum(axis=1)
        values.append(float(np.where(tp > 0, (1 + b2) * tp / (b2 * true + k), 0.0).mean()))
    return int(np.argmax(values))


def expected_f(pairs: DataFrame, mode: str = "exact", beta: float = 0.5) -> DataFrame:
    """Decided pairs: per S1 the prefix of its best candidates with the greatest expected F-beta.

    At most ``MAX_CANDIDATES`` of score ``MIN_PROB`` up are looked at, as the rule states; they are cut before they are gathered.
    """
    rule = prefix_exact if mode == "exact" else prefix_sampled
    chosen = F.pandas_udf(lambda lists: pd.Series([rule(list(x), beta) for x in lists]), "int")
    top = windows.first_rows(assign(pairs).where(F.col("prob") >= MIN_PROB), ["s1_id"], [F.desc("prob"), F.asc("cand_id")], MAX_CANDIDATES)
    lists = top.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("place", "prob", "cand_id"))).alias("x"))
    cut = lists.withColumn("k", chosen(F.col("x.prob"))).where("k > 0")
    return cut.select("s1_id", F.explode(F.slice("x", F.lit(1), F.col("k"))).alias("v")).select("s1_id", F.col("v.cand_id").alias("cand_id"), F.col("v.prob").alias("prob"))


def fbeta(tp: Column, pred: Column, true: Column, beta: float = 0.5) -> Column:
    """Per entity: 1 if both sets are empty, 0 without overlap."""
    b2 = beta * beta
    return F.when((pred == 0) & (true == 0), 1.0).when(tp == 0, 0.0).otherwise((1 + b2) * tp / (b2 * true + pred))


def per_entity(decided: DataFrame, truth: DataFrame, s1s: DataFrame, beta: float = 0.5) -> DataFrame:
    """``s1_id, n_pred, n_true, tp, fbeta`` for every S1 of ``s1s``; S1s decided elsewhere don't count."""
    pred = decided.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_pred"))
    true = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    hit = decided.join(truth, ["s1_id", "cand_id"], "left_semi").groupBy("s1_id").agg(F.count(F.lit(1)).alias("tp"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    made = s1s.select("s1_id").distinct().join(pred, "s1_id", "left").join(true, "s1_id", "left").join(hit, "s1_id", "left").select("s1_id", n("n_pred"), n("n_true"), n("tp"))
    return made.withColumn("fbeta", fbeta(F.col("tp"), F.col("n_pred"), F.col("n_true"), beta))


def tune(pairs: DataFrame, truth: DataFrame, s1s: DataFrame, grid: list[float], assigned: bool = True, fallback: float | None = None) -> DataFrame:
    """``threshold, f05`` for each threshold over all S1s, in one pass: a pair counts for every threshold it reaches.

    With ``fallback`` an S1 that a threshold leaves with none has its best candidate, if that reaches ``fallback``.
    """
    owned = (assign(pairs) if assigned else pairs).join(s1s.select("s1_id").distinct(), "s1_id", "left_semi")
    hits = owned.join(truth.withColumn("_y", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("y", F.coalesce("_y", F.lit(0)))
    reached = hits.select("s1_id", "y", F.explode(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("prob"))).alias("threshold"))
    sums = reached.groupBy("threshold", "s1_id").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("y").alias("tp"))
    true = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    every = s1s.select("s1_id").distinct().join(true, "s1_id", "left").select("s1_id", F.coalesce("n_true", F.lit(0)).alias("n_true"), F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    full = every.join(sums, ["threshold", "s1_id"], "left").fillna(0, ["n_pred", "tp"])
    if fallback is not None:
        best = windows.first_rows(hits, ["s1_id"], [F.desc("prob"), F.asc("cand_id")], 1).where(F.col("prob") >= fallback).select("s1_id", F.col("y").alias("_best"))
        full = full.join(best, "s1_id", "left")
        alone = (F.col("n_pred") == 0) & F.col("_best").isNotNull()
        full = full.withColumn("tp", F.when(alone, F.col("_best")).otherwise(F.col("tp"))).withColumn("n_pred", F.when(alone, 1).otherwise(F.col("n_pred")))
    return full.groupBy("threshold").agg(F.avg(fbeta(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("f05"))


def best_threshold(tuned: DataFrame) -> DataFrame:
    """The threshold of the greatest score, the smaller of equals."""
    return tuned.orderBy(F.desc("f05"), "threshold").limit(1)


def score(decided: DataFrame, truth: DataFrame, s1s: DataFrame) -> float | None:
    """Mean F0.5 over all ``s1s``, to nine decimals; null without any."""
    value = per_entity(decided, truth, s1s).agg(F.avg("fbeta")).first()[0]
    return None if value is None else round(value, 9)


def choose(pairs: DataFrame, truth: DataFrame, s1s: DataFrame, grid: list[float]) -> tuple[str, float, float]:
    """(rule, threshold, score): the best threshold, or expected F if that scores higher over the same S1s; the threshold wins ties."""
    best = best_threshold(tune(pairs, truth, s1s, grid).withColumn("f05", F.round("f05", 9))).first()
    expected = score(expected_f(pairs), truth, s1s)
    return ("expected_f", best.threshold, expected) if expected is not None and expected > best.f05 else ("threshold", best.threshold, best.f05)


def apply(pairs: DataFrame, rule: str, threshold: float) -> DataFrame:
    """Decided pairs by the chosen rule."""
    return expected_f(pairs) if rule == "expected_f" else keep(pairs, threshold)
