"""Queries of learning and scoring: grouped out-of-fold protocol, routing, weights, patches, pluggable scorers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.functions import metrics, similarity as sim, text
from linkloom.operators import boosting, sampling, windows
from linkloom.plans import views
from linkloom.plans.q_decide import unseen
from linkloom.plans.q_features import contested, owner_exclude, owners, side_scores, slot_of
from linkloom.plans.registry import query
from linkloom.plans.views import FOLD, P, REC
from linkloom.runtime import materialise

X = ["name_exact", "name_words", "num_jaccard", "postcode_eq", "addr_empty", "num_missing", "post_missing"]
#: Labelled rows on which a model is fitted at most.
FIT_ROWS = 200_000


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with cheap features; what is missing is 0 with a flag of its own, as the learners take no missing values."""
    p = views.framed_pairs(spark, sf_dir)
    words = lambda c: F.array_distinct(text.tokens(F.col(c)))
    jac, post = sim.jaccard(text.number_set(F.col("l_addr_nums")), text.number_set(F.col("r_addr_nums"))), sim.same_stated(F.col("l_postcode"), F.col("r_postcode"))
    made = p.select("s1_id", "cand_id", "prob", (F.col("l_name_core") == F.col("r_name_core")).cast("double").alias("name_exact"), F.coalesce(sim.jaccard(words("l_name_core"), words("r_name_core")), F.lit(0.0)).alias("name_words"), F.coalesce(jac, F.lit(0.0)).alias("num_jaccard"), F.coalesce(post, F.lit(0.0)).alias("postcode_eq"), (F.col("r_addr_norm") == "").cast("double").alias("addr_empty"), jac.isNull().cast("double").alias("num_missing"), post.isNull().cast("double").alias("post_missing"))
    return made.join(views.folds(spark, sf_dir).select("s1_id", "fold"), "s1_id", "left")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design(spark, sf_dir).join(views.labels(spark, sf_dir), ["s1_id", "cand_id"]).withColumn("label", F.col("y").cast("double")).where("fold is not null")


def sampled(rows: DataFrame, columns: list[str]) -> pd.DataFrame:
    """At most ``FIT_ROWS`` rows by draw, on the driver, for a fit."""
    return sampling.uniform(rows, FIT_ROWS, 1, "s1_id", "cand_id").select(*columns).toPandas()


def tallied(rows: DataFrame, columns: list[str]) -> pd.DataFrame:
    """Each distinct row of ``columns`` with ``n``, the rows that have it, on the driver, sorted; of a sample only if more than ``FIT_ROWS`` are distinct."""
    tally = lambda df: df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).limit(FIT_ROWS + 1).toPandas()
    made = tally(rows)
    made = made if len(made) <= FIT_ROWS else tally(sampling.uniform(rows, FIT_ROWS, 1, "s1_id", "cand_id"))
    return made.sort_values(columns, ignore_index=True)


def binned(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """By fold what its model sees of all ``rows``: bins of the features, labels, which rows are held out, how many rows each stands for, and the cuts between the bins.

    The cuts are quantiles of all rows of the other folds. Rows in the same bins are one to a model, so what comes to the driver is bounded
    by the bins, and for the cuts by the distinct values of single features, however many rows differ.
    Folds without both labels outside are left out.
    """
    tally = materialise(rows.groupBy(*X, "label", "fold").agg(F.count(F.lit(1)).alias("n")))
    values = tally.select("fold", "n", F.posexplode(F.array(*X, "label")).alias("j", "v")).groupBy("fold", "j", "v").agg(F.sum("n").alias("n")).toPandas()
    cuts = {}
    for k in sorted(set(values["fold"])):
        *of_x, of_label = (values[(values["fold"] != k) & (values["j"] == j)] for j in range(len(X) + 1))
        if len(set(of_label["v"])) == 2:
            cuts[int(k)] = [boosting.cuts_of(v["v"].to_numpy(), v["n"].to_numpy()) for v in of_x]

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[X].to_numpy(float)
            for k, c in cuts.items():
                yield pd.DataFrame(boosting.to_bins(x, c), columns=X).assign(label=batch["label"], n=batch["n"], k=k, held=batch["fold"] == k)

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*X, "label", "held"])
        cells = {c: [part[c].to_numpy(t).tobytes()] for c, t in (("label", "f8"), ("held", "?"), ("n", "i8"))}
        return pd.DataFrame({"k": [part["k"].iloc[0]], "bins": [part[X].to_numpy("i2").tobytes()]} | cells)

    keys = [*X, "label", "k", "held"]
    cells = tally.mapInPandas(seen, ", ".join(f"{c} smallint" for c in X) + ", label double, n long, k long, held boolean").groupBy(*keys).agg(F.sum("n").alias("n"))
    made = cells.groupBy("k").applyInPandas(packed, "k long, bins binary, label binary, held binary, n binary").collect()
    return {r.k: (np.frombuffer(r.bins, "i2").reshape(-1, len(X)), np.frombuffer(r.label, "f8"), np.frombuffer(r.held, "?"), np.frombuffer(r.n, "i8"), cuts[r.k]) for r in sorted(made, key=lambda r: r.k)}


def fold_models(rows: pd.DataFrame, **settings) -> dict[int, boosting.Booster]:
    """One booster per fold, fitted on the rows of the other folds and stopped early on its own."""
    x, y, fold = rows[X].to_numpy(float), rows["label"].to_numpy(), rows["fold"].to_numpy()
    return {int(k): boosting.boost(x, y, held=fold == k, **settings) for k in sorted(set(fold)) if len(set(y[fold != k])) == 2}


def models_of(spark: SparkSession, sf_dir: str) -> dict[int, boosting.Booster]:
    return fold_models(sampled(labelled(spark, sf_dir), [*X, "label", "fold"]))


def routed(df: DataFrame, models: dict[int, boosting.Booster]) -> DataFrame:
    """``pred``: the fold's own model where the row's S1 is in a fold, else the mean of all models, ``mean_pred``. No row is scored by a model that was fitted on it; without models both are null."""
    made = boosting.scored(df, {f"_p{k}": m for k, m in models.items()}, X) if models else df
    mean = sum((F.col(f"_p{k}") for k in models), F.lit(0.0)) / len(models) if models else F.lit(None).cast("double")
    own = F.coalesce(*(F.when(F.col("fold") == k, F.col(f"_p{k}")) for k in models), mean)
    return made.withColumn("mean_pred", mean).withColumn("pred", own).drop(*(f"_p{k}" for k in models))


@query("ml_oof")
def ml_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of the labelled pairs by boosted trees; folds are whole S1s."""
    return routed(labelled(spark, sf_dir), models_of(spark, sf_dir)).select("s1_id", "cand_id", "fold", "y", F.round("pred", 4).alias("pred"))


@query("ml_predict")
def ml_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs scored by the mean of the fold models."""
    return routed(design(spark, sf_dir), models_of(spark, sf_dir)).select("s1_id", "cand_id", F.round("mean_pred", 4).alias("pred"))


@query("ml_oof_route")
def ml_oof_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs scored out of sample: by fold where the S1 has one, by the mean otherwise."""
    return routed(design(spark, sf_dir), models_of(spark, sf_dir)).select("s1_id", "cand_id", F.round("pred", 4).alias("pred"))


@query("ml_importance")
def ml_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised gain of each feature over the fold models."""
    gains = [m.gains for m in models_of(spark, sf_dir).values()]
    total = sum(gains) if gains else np.zeros(len(X))
    share = total / total.sum() if total.sum() > 0 else total
    return spark.createDataFrame([(n, round(float(v), 4)) for n, v in zip(X, share)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def importance_weights(rows: DataFrame, domain: str, cap: float = 20.0) -> DataFrame:
    """``weight`` = p / (1 - p) of a domain score, scaled to mean 1, cut to [1/cap, cap], scaled again; missing scores raise."""
    odds = rows.withColumn("_w", F.col(domain) / (1 - F.col(domain)))
    first = odds.agg(F.avg("_w").alias("_m"))
    cut = odds.crossJoin(F.broadcast(first)).withColumn("_w", F.greatest(F.lit(1 / cap), F.least(F.lit(cap), F.col("_w") / F.col("_m")))).drop("_m")
    again = cut.agg(F.avg("_w").alias("_m"))
    return cut.crossJoin(F.broadcast(again)).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")


_DOM = f"{P}, d as (select s1_id, cand_id, (0.05 + 0.9 * prob) as dom from p), o as (select *, dom / (1 - dom) as w from d), a as (select *, greatest(0.05, least(20, w / (select avg(w) from o))) as v from o), f as (select *, v / (select avg(v) from a) as weight from a)"


def _weighted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_weights(views.pairs(spark, sf_dir).withColumn("dom", 0.05 + 0.9 * F.col("prob")), "dom")


query("ml_weights", f"with {_DOM} select s1_id, cand_id, round(weight, 6) as weight from f")(lambda spark, d: _weighted_pairs(spark, d).select("s1_id", "cand_id", F.round("weight", 6).alias("weight")))
query("ml_effective_size", f"with {_DOM} select round(sum(weight) * sum(weight) / (count(*) * sum(weight * weight)), 6) as ess, count(*)::bigint as n from f")(lambda spark, d: _weighted_pairs(spark, d).agg(F.round(F.pow(F.sum("weight"), F.lit(2)) / (F.count(F.lit(1)) * F.sum(F.col("weight") * F.col("weight"))), 6).alias("ess"), F.count(F.lit(1)).alias("n")))


def domain_scores(spark: SparkSession, rows: DataFrame, seen: DataFrame, unseen_: DataFrame) -> tuple[DataFrame, float]:
    """``rows`` with ``dom``, the probability that a row is one of ``unseen_``'s kind, and the classifier's AUC on rows that it wasn't fitted on.

    A booster learns to tell rows of unseen countries from the others on at most ``FIT_ROWS`` of each; a fifth stops it early.
    """
    parts = [sampled(df, ["s1_id", *X]).assign(y=float(k)) for k, df in enumerate((seen, unseen_))]
    both = pd.concat(parts, ignore_index=True)
    held = np.array([zlib.crc32(str(s).encode()) % 5 == 0 for s in both["s1_id"]], bool)
    model = boosting.boost(both[X].to_numpy(float), both["y"].to_numpy(), held=held, leaves=31)
    p, y = model.score(both[X].to_numpy(float))[held], both["y"].to_numpy()[held]
    ranks = pd.Series(p).rank().to_numpy()
    n1, n0 = y.sum(), (1 - y).sum()
    auc = float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")
    return boosting.scored(rows, {"dom": model}, X).withColumn("dom", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("dom")))), auc


@query("ml_weighted")
def ml_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted with importance weights of a domain classifier, against the unweighted one: AUC on the labelled rows out of fold, the classifier's AUC, the effective sample size."""
    every = materialise(design(spark, sf_dir).join(unseen(spark, sf_dir).select("s1_id", "unseen"), "s1_id"))
    rows = materialise(labelled(spark, sf_dir))
    made, domain_auc = domain_scores(spark, rows, every.where("not unseen"), every.where("unseen"))
    made = materialise(importance_weights(made, "dom"))
    ess = made.agg((F.pow(F.sum("weight"), F.lit(2)) / (F.count(F.lit(1)) * F.sum(F.col("weight") * F.col("weight")))).alias("ess")).first().ess
    fit = sampled(made, [*X, "label", "fold", "weight"])
    x, y, fold = fit[X].to_numpy(float), fit["label"].to_numpy(), fit["fold"].to_numpy()
    out = None
    for name, weight in (("plain", None), ("weighted", fit["weight"].to_numpy())):
        models = {int(k): boosting.boost(x, y, weight, held=fold == k) for k in sorted(set(fold))}
        row = metrics.auc(routed(made, models), "y", "pred").select(F.lit(name).alias("model"), F.round("auc", 4).alias("auc"), F.lit(round(domain_auc, 4)).alias("domain_auc"), F.lit(ess).cast("double").alias("ess"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ess", F.round("ess", 4))


#: Variants that are tried, each against the base settings.
VARIANTS = {"base": {}, "slow": {"rate": 0.05, "rounds": 400}, "leaves31": {"leaves": 31}, "leaves7": {"leaves": 7}, "least60": {"least": 60}, "features60": {"features": 0.6}, "l2_10": {"l2": 10.0}, "slow_leaves31": {"rate": 0.05, "rounds": 400, "leaves": 31}}
SEEDS = 3


@query("ml_tune")
def ml_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant by out-of-fold log loss, and the best one again as the mean over several seeds.

    On all labelled rows, as counts of those in the same bins; the models of variants, folds and seeds are fitted in a task each.
    """
    rows = binned(labelled(spark, sf_dir))
    y, n = (np.concatenate([r[c][r[2]] for r in rows.values()] or [np.zeros(0)]) for c in (1, 3))
    fold = np.repeat(list(rows), np.array([r[2].sum() for r in rows.values()], int))
    shared = spark.sparkContext.broadcast(rows)

    def out_of_fold(tries: list[dict]) -> np.ndarray:
        jobs = [(i, k, settings) for i, settings in enumerate(tries) for k in rows]

        def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i, k, settings in (jobs[j] for j in batch["id"]):
                    bins, y, held, n, cuts = shared.value[k]
                    x = boosting.of_bins(bins, cuts)
                    model = boosting.boost(x, y, held=held, count=n, cuts=cuts, **settings)
                    yield pd.DataFrame({"i": [i], "k": [k], "p": [model.score(x[held]).tobytes()]})

        p = np.full((len(tries), len(y)), np.nan)
        for r in spark.range(0, len(jobs), 1, max(1, len(jobs))).mapInPandas(fitted, "i long, k long, p binary").collect():
            p[r.i, fold == r.k] = np.frombuffer(r.p)
        return p

    def loss(p: np.ndarray) -> float:
        q = np.clip(p, 1e-15, 1 - 1e-15)
        return float(np.average(-(y * np.log(q) + (1 - y) * np.log(1 - q)), weights=n)) if len(q) else float("nan")

    tried = {name: loss(p) for name, p in zip(VARIANTS, out_of_fold(list(VARIANTS.values())))}
    best = min(tried, key=lambda v: (tried[v], v))
    tried[f"{best}_x{SEEDS}"] = loss(out_of_fold([{**VARIANTS[best], "seed": k} for k in range(SEEDS)]).mean(axis=0))
    return spark.createDataFrame([(n, round(v, 4)) for n, v in tried.items()], "variant string, logloss double").orderBy("logloss", "variant")


def patched(base: DataFrame, new: DataFrame, mask) -> DataFrame:
    """New scores where the mask holds and a new score exists, the base score elsewhere."""
    return base.join(new.select("s1_id", "cand_id", F.col("prob").alias("_new")), ["s1_id", "cand_id"], "left").withColumn("prob", F.when(mask & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("prob"))).drop("_new")


_CE = "ce as (select s1_id, cand_id, min(prob) as ce from scored_pairs where s1_id is not null and cand_id is not null and not isnan(prob) group by 1, 2 having min(prob) > 0.02)"


@query("ml_selftrain_patch", f"with {P}, {REC}, {_CE} select p.s1_id, p.cand_id, case when rec.country = 'France' and p.prob > 0.05 and p.prob < 0.95 and ce is not null then ce else p.prob end as prob from p left join rec on rec.entity_id = p.s1_id left join ce on ce.s1_id = p.s1_id and ce.cand_id = p.cand_id")
def ml_selftrain_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only unsure pairs of a chosen country take the new score."""
    c = views.records(spark, sf_dir).select(F.col("entity_id").alias("s1_id"), "country")
    mask = (F.col("country") == "France") & (F.col("prob") > 0.05) & (F.col("prob") < 0.95)
    return patched(views.pairs(spark, sf_dir).join(c, "s1_id", "left"), side_scores(spark, sf_dir).withColumnRenamed("ce_score", "prob"), mask).select("s1_id", "cand_id", "prob")


_SEEN = "seen as (select distinct country from fold where fold = 0 and not dev)"


@query("ml_rescore_unseen", f"with {P}, {REC}, {FOLD}, {_SEEN}, {_CE} select p.s1_id, p.cand_id, case when rec.country not in (select country from seen) and ce is not null then ce else p.prob end as prob from p left join rec on rec.entity_id = p.s1_id left join ce on ce.s1_id = p.s1_id and ce.cand_id = p.cand_id")
def ml_rescore_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = views.pairs(spark, sf_dir).join(unseen(spark, sf_dir).select("s1_id", "unseen"), "s1_id", "left")
    return patched(base, side_scores(spark, sf_dir).withColumnRenamed("ce_score", "prob"), F.coalesce("unseen", F.lit(False))).select("s1_id", "cand_id", "prob")


@query("ml_combine", f"with {P}, {FOLD} select p.s1_id, p.cand_id, case when dev then prob * prob else prob end as prob from p left join fold using (s1_id)")
def ml_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the development S1s replaced by joined ones; a missing replacement raises."""
    dev = views.folds(spark, sf_dir).select("s1_id", "dev")
    base = views.pairs(spark, sf_dir).join(dev, "s1_id", "left")
    new = base.where("dev").select("s1_id", "cand_id", (F.col("prob") * F.col("prob")).alias("_new"))
    missing = F.raise_error(F.lit("a pair has no replacement")).cast("double")
    return base.join(new, ["s1_id", "cand_id"], "left").select("s1_id", "cand_id", F.when(F.coalesce("dev", F.lit(False)), F.coalesce("_new", missing)).otherwise(F.col("prob")).alias("prob"))


@query("ml_biencoder", f"with {P}, {REC}, q as (select p.s1_id, p.cand_id, country from p join rec on entity_id = s1_id where prob >= 0.9), n as (select *, row_number() over (partition by country order by s1_id, cand_id) - 1 as k from q) select s1_id, cand_id, country, (k // 64)::bigint as batch from n")
def ml_biencoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of contrastive batches: 64 confident pairs of one country each."""
    c = views.records(spark, sf_dir).select(F.col("entity_id").alias("s1_id"), "country")
    rows = views.pairs(spark, sf_dir).where("prob >= 0.9").join(c, "s1_id")
    made = windows.numbered(rows, ["country"], [F.asc("s1_id"), F.asc("cand_id")], "_n")
    return made.select("s1_id", "cand_id", "country", F.floor((F.col("_n") - 1) / 64).alias("batch"))


def scored_by(pairs: DataFrame, records: DataFrame, score: Callable[[list[str], list[str]], list[float]], low: float, high: float, done: DataFrame | None = None, folds: DataFrame | None = None) -> DataFrame:
    """``s1_id, cand_id, ce_score`` of every pair by any batch scorer of two texts (the place for a cross-encoder or a language model); null outside the unsure band.

    Texts are joined for the scored pairs alone. Pairs in ``done`` keep the score they have there, so that an interrupted run goes on;
    with ``folds`` (``s1_id``) only pairs of those S1s are scored.
    """
    band = pairs.where((F.col("prob") > low) & (F.col("prob") < high)).select("s1_id", "cand_id")
    band = band.join(folds.select("s1_id").distinct(), "s1_id", "left_semi") if folds is not None else band
    todo = band.join(done, ["s1_id", "cand_id"], "left_anti") if done is not None else band
    side = lambda k, c: records.select(F.col("entity_id").alias(k), text.record_text(F.col("business_name"), F.col("business_address")).alias(c))
    run = F.pandas_udf(lambda a, b: pd.Series(score(a.tolist(), b.tolist()), dtype="float64"), "double")
    made = todo.join(side("s1_id", "_a"), "s1_id").join(side("cand_id", "_b"), "cand_id").select("s1_id", "cand_id", run("_a", "_b").alias("ce_score"))
    made = made.unionByName(done.select("s1_id", "cand_id", "ce_score").join(band, ["s1_id", "cand_id"], "left_semi")) if done is not None else made
    return pairs.select("s1_id", "cand_id").join(made, ["s1_id", "cand_id"], "left")


def lexical(a: list[str], b: list[str]) -> list[float]:
    """The default scorer: token-set ratio of both texts in lower case."""
    return [sim.token_set(x.lower(), y.lower()) for x, y in zip(a, b)]


@query("ml_crossenc")
def ml_crossenc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair scores in the unsure band, in two runs: the second takes up what the first, of fold 0, has finished."""
    p, rec = views.pairs(spark, sf_dir), views.records(spark, sf_dir)
    zero = views.folds(spark, sf_dir).where("fold = 0").select("s1_id")
    first = materialise(scored_by(p, rec, lexical, 0.05, 0.95, folds=zero).where("ce_score is not null"))
    return scored_by(p, rec, lexical, 0.05, 0.95, done=first).withColumn("ce_score", F.round("ce_score", 6))


def prompted(a: list[str], b: list[str]) -> list[float]:
    """The default scorer of prompts: how surely both records' names (before the bar) and addresses are one, the less alike of both counting more."""
    def halves(t: str) -> tuple[str, str]:
        name, _, address = t.lower().partition("|")
        return name.strip(), address.strip()

    out = []
    for x, y in zip(a, b):
        (na, aa), (nb, ab) = halves(x), halves(y)
        parts = [sim.token_sort(na, nb)] + ([sim.token_set(aa, ab)] if aa and ab else [])
        out.append(float(np.prod(parts) ** (1 / len(parts))))
    return out


query("ml_llm")(lambda spark, d: scored_by(views.pairs(spark, d), views.records(spark, d), prompted, 0.2, 0.8).withColumn("ce_score", F.round("ce_score", 6)))


def slot_features(groups: DataFrame, records: DataFrame) -> DataFrame:
    """``groups`` (``cand_id, s1_ids, probs``) with ``slots``: per slot its score's log odds, its score less the best other one, and how alike name and address are."""
    flat = groups.select("cand_id", F.posexplode("s1_ids").alias("slot", "s1_id"))
    side = lambda k, n: records.select(F.col("entity_id").alias(k), F.lower(text.record_text(F.col("business_name"), F.col("business_address"))).alias(n))
    texts = sim.scored(flat.join(side("s1_id", "_a"), "s1_id", "left").join(side("cand_id", "_b"), "cand_id", "left"), "_a", "_b", ["tset", "tsort"], "t")
    lists = texts.groupBy("cand_id").agg(F.array_sort(F.collect_list(F.struct("slot", "t_tset", "t_tsort"))).alias("t"))
    p = lambda x: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), x))
    best = lambda i: F.aggregate(F.transform("probs", lambda x, j: F.when(i == j, 0.0).otherwise(x)), F.lit(0.0), lambda m, x: F.greatest(m, x))
    slots = F.transform("probs", lambda x, i: F.array(F.log(p(x) / (1 - p(x))), x - best(i), F.col("t")[i]["t_tset"], F.col("t")[i]["t_tsort"]))
    return groups.join(lists, "cand_id").withColumn("slots", slots).drop("t")


@query("ml_owner")
def ml_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listwise owner model: a softmax over a contested record's S1s and nobody, fitted on reviewed groups that touch no S1 of fold 0, at most ``FIT_ROWS``.

    Out come the owner's probability per slot, nobody's, the margin over the best other slot and the list's length.
    """
    groups = materialise(slot_features(contested(views.pairs(spark, sf_dir)), views.records(spark, sf_dir)))
    judged = views.labels(spark, sf_dir).select("cand_id").distinct()
    fit = slot_of(groups.join(judged, "cand_id", "left_semi").join(owner_exclude(spark, sf_dir), "cand_id", "left_semi"), owners(spark, sf_dir))
    rows = sampling.uniform(fit, FIT_ROWS, 1, "cand_id").select("slots", "label").collect()
    model = boosting.listwise([np.array(r.slots, float) for r in rows], [r.label for r in rows])
    if not len(model.weights):
        model = boosting.Listwise(np.array([1.0, 0.0, 0.0, 0.0]), 0.0)
    made = groups.withColumn("p", boosting.listwise_scores(model, F.col("slots"))).select("s1_ids", "cand_id", "p", F.posexplode("s1_ids").alias("slot", "s1_id"))
    n = F.size("s1_ids")
    own, slots = F.col("p")[F.col("slot")], F.slice("p", F.lit(1), n)
    other = F.aggregate(F.transform(slots, lambda x, i: F.when(i == F.col("slot"), 0.0).otherwise(x)), F.lit(0.0), lambda m, x: F.greatest(m, x))
    return made.select("s1_id", "cand_id", F.round(own, 6).alias("own_p"), F.round(F.col("p")[n], 6).alias("own_none"), F.round(F.when(n > 1, own - other).otherwise(own), 6).alias("own_margin"), n.cast("bigint").alias("own_n"))
