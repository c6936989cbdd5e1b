"""Windows, decisions, metrics, samples, sources and monitoring against hand-made cases and brute force."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from linkloom.functions import metrics, similarity
from linkloom.operators import boosting, decide, retrieval, sampling, windows
from linkloom.plans import q_features, q_files, q_learn
from linkloom.runtime import materialise, small
from linkloom.sources import files, validate
from linkloom.streaming import monitor

PAIRS = [("A", "S2-1", 0.95), ("A", "S3-1", 0.80), ("A", "S2-9", 0.40), ("B", "S2-9", 0.90), ("B", "S3-5", 0.20), ("C", "S2-7", 0.30)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "s1_id string, cand_id string, prob double")


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.s1_id, set()).add(r.cand_id)
    return out


def test_decisions(spark, pairs):
    assert sets(decide.keep(pairs, 0.3)) == {"A": {"S2-1", "S3-1"}, "B": {"S2-9"}, "C": {"S2-7"}}
    assert sets(decide.keep(pairs, 0.85, fallback=0.25))["C"] == {"S2-7"}
    assert "C" not in sets(decide.keep(pairs, 0.85, fallback=0.35))
    truth = spark.createDataFrame([("A", "S2-1"), ("A", "S3-1"), ("B", "S2-9")], "s1_id string, cand_id string")
    s1s = spark.createDataFrame([("A",), ("B",), ("C",)], "s1_id string")
    best = decide.best_threshold(decide.tune(pairs, truth, s1s, [0.25, 0.5, 0.85])).first()
    assert (best.threshold, best.f05) == (0.5, 1.0)
    assert decide.keep(pairs.limit(0), 0.5).count() == 0


@pytest.mark.parametrize(("probs", "k"), [([], 0), ([0.02, 0.01], 0), ([0.99, 0.98, 0.97], 3), ([0.97, 0.15, 0.1], 1)])
def test_prefix(probs, k):
    assert decide.prefix_exact(probs) == k and decide.prefix_sampled(probs) == k


def test_prefix_exact_is_enumeration():
    rng = random.Random(3)
    for _ in range(20):
        p = sorted((rng.random() for _ in range(rng.randint(1, 6))), reverse=True)
        best, value = 0, math.prod(1 - x for x in p)
        for k in range(1, len(p) + 1):
            v = 0.0
            for mask in range(1 << len(p)):
                w = math.prod(x if mask >> i & 1 else 1 - x for i, x in enumerate(p))
                tp, true = bin(mask & (1 << k) - 1).count("1"), bin(mask).count("1")
                v += w * (1.25 * tp / (0.25 * true + k) if tp else 0)
            if v > value + 1e-12:
                best, value = k, v
        assert decide.prefix_exact(p) == best


def test_entity_fbeta(spark):
    d = spark.createDataFrame([("x", 47), ("x", 193), ("x", 812), ("z", 1)], "s1_id string, cand_id long")
    t = spark.createDataFrame([("x", 47), ("x", 812), ("w", 2)], "s1_id string, cand_id long")
    s = spark.createDataFrame([(c,) for c in "xyzw"], "s1_id string")
    got = {r.s1_id: round(r.fbeta, 7) for r in decide.per_entity(d, t, s).collect()}
    assert got == {"x": 0.7142857, "y": 1.0, "z": 0.0, "w": 0.0}


def test_competition(spark):
    df = spark.createDataFrame([("a", "r", 0.99), ("b", "r", 0.90), ("a", "q", 0.5)], "s1_id string, cand_id string, v double")
    got = {(r.s1_id, r.cand_id): round(r.v_margin, 6) for r in windows.best_other(df, "cand_id", "s1_id", "v", "v").collect()}
    assert got == {("a", "r"): 0.09, ("b", "r"): -0.09, ("a", "q"): 0.5}


def test_skew_safe_windows(spark):
    rng = random.Random(5)
    rows = [(("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 20)}"), i, rng.choice([None, *range(6)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, v int")
    w = Window.partitionBy("k")
    plain = df.select("id", F.row_number().over(w.orderBy("v", "id")).alias("n"), F.rank().over(w.orderBy(F.col("v").desc_nulls_last())).alias("r"), F.sum("v").over(w.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    want = {r.id: (r.n, r.r, r.s or 0) for r in plain.collect()}
    n = {r.id: r.n for r in windows.numbered(df, ["k"], [F.asc("v"), F.asc("id")], "n").collect()}
    r = {x.id: x.r for x in windows.with_rank(df, ["k"], "v", "r").collect()}
    s = {x.id: x.s for x in windows.running(df, ["k"], [F.asc("id")], s=(F.sum, F.col("v"))).collect()}
    assert {i: (n[i], r[i], s[i]) for i in want} == want
    tiles = {x.id: x.t for x in windows.tiles(df, [F.asc("id")], 7, "t").collect()}
    assert tiles == {x.id: x.t for x in df.select("id", F.ntile(7).over(Window.orderBy("id")).alias("t")).collect()}


def test_metrics(spark):
    one = lambda f, rows, schema, *c: f(spark.createDataFrame(rows, schema), *c).first()[0]
    ab = "a double, f double"
    assert one(metrics.smape, [(0.0, 0.0)], ab, "a", "f") == 0 and one(metrics.smape, [(0.0, 5.0)], ab, "a", "f") == 200
    assert one(metrics.mape, [(0.0, 3.0), (2.0, 1.0)], ab, "a", "f") == 50
    assert one(metrics.r2, [(1.0, 1.0), (1.0, 2.0)], ab, "a", "f") == 0
    assert one(metrics.extraction_f1, [("x", "x"), ("", "y"), ("z", "")], "a string, f string", "a", "f") == pytest.approx(0.5)
    assert one(metrics.auc, [(True, 0.9), (False, 0.1), (True, 0.5), (False, 0.5)], "y boolean, p double", "y", "p") == pytest.approx(0.875)
    with pytest.raises(Exception, match="missing or infinite"):
        one(metrics.mae, [(1.0, None)], ab, "a", "f")
    with pytest.raises(KeyError):
        metrics.get("nothing")
    act = spark.createDataFrame([("q", 3)], "q string, i int")
    pred = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "q string, i int, place int")
    assert metrics.map_at_k(act, pred, "q", "i", "place").first()[0] == pytest.approx(1 / 3)


def test_samples(spark):
    df = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 0.9).otherwise(0.1))
    a = sorted(r.id for r in sampling.uniform(df, 100, 1, "id").collect())
    assert a == sorted(r.id for r in sampling.uniform(df.repartition(7), 100, 1, "id").collect()) and len(set(a)) == 100
    heavy = sum(r.id < 1000 for r in sampling.weighted(df, 200, 1, F.col("w"), "id").collect())
    assert heavy > 150
    keep = sampling.thinned(df, "id", df.where("id < 10").select("id"), 0.5, 3)
    got = {r.id for r in keep.collect()}
    assert set(range(10)) <= got and abs(len(got) / 2000 - 0.5) < 0.05
    assert sampling.uniform(df.limit(0), 5, 1, "id").count() == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(retrieval, "POOL_ROWS", block)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    x[5] = x[4]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], str(i % 2)) for i in range(60)] + [(99, None, "0")], "id long, vec array<double>, part string")
    asked = df.where("id < 10")
    got = {(r.query_id, r.item_id): r["rank"] for r in retrieval.top_k(asked, df, 4).collect()}
    want = {}
    for q in range(10):
        order = sorted((i for i in range(60) if i % 2 == q % 2), key=lambda i: (-round(float(x[i] @ x[q]), 9), i))[:4]
        want |= {(q, i): k for k, i in enumerate(order)}
    assert got == want
    assert retrieval.top_k(asked.limit(0), df, 4).count() == 0


def test_prune_and_merge(spark):
    p = spark.createDataFrame([("x", "1", 0.5), ("y", "1", 0.001), ("w", "1", 0.004), ("z", "1", 0.0)], "s1_id string, cand_id string, prob double")
    ce = spark.createDataFrame([("x", "1", 0.9), ("y", "1", 0.5), ("w", "1", 0.0), ("z", "1", 0.005)], "s1_id string, cand_id string, ce_score double")
    ids = lambda df: {r.s1_id for r in df.collect()}
    assert ids(q_features.prune(p, 0.003)) == {"x", "w"}
    assert ids(q_features.prune(p, 0.003, ce, 0.01)) == {"x", "y", "w"}
    assert ids(q_features.prune(p, 0.0, ce, 0.01)) == {"x", "y", "z", "w"}
    with pytest.raises(ValueError, match="no second score"):
        q_features.prune(p, 0.003, ce.limit(1), 0.01)
    f = spark.createDataFrame([(k, 0.2 + k / 100, 0.6) for k in range(5)] + [(None, 0.2, 0.6)], "fold int, a double, b double")
    got = [round(r.merged, 2) for r in q_features.merged_out_of_sample(f).orderBy(F.col("fold").asc_nulls_last()).collect()]
    assert got == [0.4, 0.6, 0.6, 0.23, 0.24, 0.4]
    with pytest.raises(Exception, match="out-of-sample"):
        q_features.merged_out_of_sample(f.withColumn("b", F.lit(None).cast("double"))).collect()
    with pytest.raises(KeyError):
        q_features.build(p, ["nothing"])


def test_owner_groups(spark):
    p = spark.createDataFrame([("a", "x", 0.6), ("b", "x", 0.3), ("a", "y", 0.9), ("b", "y", 0.01), ("c", "z", 0.7)], "s1_id string, cand_id string, prob double")
    g = q_features.contested(p)
    assert [(r.cand_id, r.s1_ids) for r in g.collect()] == [("x", ["a", "b"])]
    assert q_features.contested(p, slots=1).count() == 0
    own = spark.createDataFrame([("x", "q")], "cand_id string, owner string")
    assert q_features.slot_of(g, own).first().label == 6
    assert q_features.slot_of(g, own.withColumn("owner", F.lit("b"))).first().label == 1


GOOD = ["S1-1\tS2-1,S3-1", "S1-2\t", "S1-3\tS2-2"]


@pytest.mark.parametrize(
    ("lines", "rule"),
    [
        (GOOD[:2], "missing S1"), (GOOD + GOOD[:1], "repeated S1"), (["S1-1\tS2-1,S2-1", *GOOD[1:]], "repeated id in a list"), (["S1-1\tS1-2", *GOOD[1:]], "id of another source"),
        (["S1-1\tS2-77", *GOOD[1:]], "unknown id"), (["S1-1\tS2-1, S3-1", *GOOD[1:]], "blank, empty or quoted id"), (["S1-1,S2-1", *GOOD[1:]], "fields"), (GOOD, None),
    ],
)
def test_validator(spark, lines, rule):
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in (1, 2, 3)], "s1_id string")
    pool = spark.createDataFrame([(x,) for x in ("S2-1", "S2-2", "S3-1", "S3-2")], "cand_id string")
    report = {r.rule: r.n for r in validate.list_file(spark.createDataFrame([(x,) for x in lines], "value string"), s1, pool).collect()}
    assert (report[rule] > 0) if rule else not any(report.values())


def test_files_round_trip(spark, tmp_path):
    rows = [("S1-1", 'a "b', "", "US"), ("007", "x\\y", " z ", "")]
    df = spark.createDataFrame(rows, files.RECORD)
    files.write_tsv(df, str(tmp_path / "r.tsv"))
    assert sorted(tuple(r) for r in files.scan_tsv(spark, str(tmp_path / "r.tsv"), files.RECORD).collect()) == sorted(rows)
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path), "_source9.tsv")
    build = lambda: df
    q_files.cached_frame(spark, str(tmp_path / "f"), {"k": 1}, build)
    with pytest.raises(ValueError, match="was built with"):
        q_files.cached_frame(spark, str(tmp_path / "f"), {"k": 2}, build)
    assert small(df).count() == 2 and materialise(df).count() == 2


def test_synthetic_is_seeded(spark):
    a = {tuple(r) for r in q_files.synthetic(spark, 200, 3).collect()}
    assert a == {tuple(r) for r in q_files.synthetic(spark, 200, 3).repartition(3).collect()} and a != {tuple(r) for r in q_files.synthetic(spark, 200, 4).collect()}


def test_stacked_checks(spark):
    long = spark.createDataFrame([("a", 0, "x", 0.1), ("a", 1, "y", 0.2)], "id string, fold int, experiment string, pred double")
    with pytest.raises(Exception, match="differ"):
        q_files.stacked(long, ["x", "y"]).collect()


def test_monitor(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=m), "a", float(v)) for i, (m, v) in enumerate([(0, 50), (5, 1), (18, 2), (20, 60), (60, 1)])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    assert [(r.event_id, r.gap_s) for r in monitor.stale(df, "event_type").orderBy("event_id").collect()] == [(2, 780.0), (4, 2400.0)]
    assert [r.n for r in monitor.idle(df, "event_type").collect()] == [2]
    assert [r.event_id for r in monitor.diverging(df, after=1).orderBy("event_id").collect()] == [3]
    df.write.parquet(str(tmp_path / "events.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events.parquet"))
    sent = monitor.drained(monitor.held_back(stream, "event_type"), "append", "t")
    assert sorted(r.event_id for r in sent.collect()) == [0, 4]
    assert monitor.stale(df.limit(0), "event_type").count() == 0


def test_weights(spark):
    df = spark.createDataFrame([(i, 0.01 + 0.98 * i / 99) for i in range(100)], "id int, dom double")
    w = [r.weight for r in q_learn.importance_weights(df, "dom").collect()]
    assert np.mean(w) == pytest.approx(1) and min(w) > 0


def test_states_and_ends(spark):
    import datetime

    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=m)
    rows = [(i, at(i * 4), "r", float(100 - i)) for i in range(120)]
    rows[37] = (37, at(37 * 4), "r", float("nan"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    got = {r.event_id: r for r in monitor.drained(monitor.written_states(_streamed(spark, df), "event_type", 200, every_steps=50, every_seconds=30), "append", "w").collect()}
    want, last, at_, low = [], None, None, None
    for i, ts, _, v in rows:
        n, bad = i + 1, v != v
        low = low if bad else v if low is None else min(low, v)
        if bad or last is None or n - last >= 50 or (ts - at_).total_seconds() >= 30:
            want.append(i)
            last, at_ = n, ts
    assert sorted(got) == want and got[37].nan and got[37].value_min == 64.0 and not got[want[-1]].nan
    assert abs(got[8].per_second - 9 / 32) < 1e-9 and abs(got[8].eta_s - (200 - 9) / (9 / 32)) < 1e-6
    ends = spark.createDataFrame([("a", 1, at(1), "end"), ("b", 2, at(1), "bad"), ("b", 3, at(0), "end"), ("c", 4, at(1), "x"), ("d", 5, at(1), "x"), ("e", 6, at(1), "x")], "run string, event_id long, ts timestamp, event_type string")
    exits = spark.createDataFrame([("c", 3), ("a", 1)], "run string, returncode int")
    alive = spark.createDataFrame([("d", False), ("e", True), ("c", False)], "run string, alive boolean")
    kinds = {"end": "completed", "bad": "failed"}
    assert {r.run: r.status for r in monitor.status(ends, "run", kinds, exits, alive).collect()} == {"a": "completed", "b": "failed", "c": "exited rc=3", "d": "died", "e": "running"}
    assert {r.status for r in monitor.status(ends, "run", kinds).collect()} == {"completed", "failed", "running"}


def _streamed(spark, df):
    from linkloom.sources.files import scratch

    path = scratch(spark, "events")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_hot_groups_are_ranked_over_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(k % 2, float((k * 7) % 40) if k % 9 else None) for k in range(300)], "k long, v double")
    plain = sorted(map(tuple, windows.with_rank(df, ["k"], "v", "r").collect()), key=repr)
    monkeypatch.setattr(windows, "GROUP_VALUES", 3)
    assert sorted(map(tuple, windows.with_rank(df, ["k"], "v", "r").collect()), key=repr) == plain


def test_null_strings_are_scored(spark):
    df = spark.createDataFrame([("ab", "ab", 1), (None, "ab", 2), (None, None, 3)], "a string, b string, n long")
    assert {r.n: r.x_ratio for r in similarity.scored(df, "a", "b", ["ratio"], "x").collect()} == {1: 1.0, 2: 0.0, 3: 1.0}


def test_scratch_is_deleted_and_a_cluster_needs_a_folder(spark, monkeypatch):
    import os

    from linkloom import runtime

    with runtime.scratch_scope():
        runtime.materialise(spark.range(3))
        path = runtime._written[-1]
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://there:7077")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="share"):
            runtime.scratch_root(spark)


def test_booster(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-3 * np.sign(x[:, 0] * x[:, 1])))).astype(float)
    held = np.arange(3000) % 3 == 0
    model = boosting.boost(x, y, held=held)
    p = model.score(x)[held]
    ranks = p.argsort().argsort() + 1
    n1 = y[held].sum()
    assert (ranks[y[held] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (held.sum() - n1)) > 0.9
    assert model.importance()[:2].sum() > 0.9 and abs(model.importance().sum() - 1) < 1e-9 and 0 < len(model.trees) < 200
    assert boosting.boost(x, np.ones(3000)).score(x[:1])[0] > 0.999 and not boosting.boost(x, np.ones(3000)).trees
    df = spark.createDataFrame([(i, *map(float, x[i])) for i in range(50)], "i int, a double, b double, c double, d double")
    got = {r.i: r.m for r in boosting.scored(df, {"m": model}, ["a", "b", "c", "d"]).collect()}
    assert all(abs(got[i] - v) < 1e-12 for i, v in enumerate(model.score(x[:50])))
    weight = np.where(x[:, 2] > 0, 1.0, 0.0)
    same = boosting.boost(x[x[:, 2] > 0], y[x[:, 2] > 0], least=1, rounds=5).score(x)
    assert np.abs(boosting.boost(x, y, weight, least=1, rounds=5).score(x) - same).mean() < 0.1


def test_booster_counts():
    """Rows with counts give the trees of the rows written out."""
    rng = np.random.default_rng(5)
    x, y, fold, n = rng.integers(0, 90, (600, 3)) / 7, rng.integers(0, 2, 600).astype(float), rng.integers(0, 3, 600), rng.integers(1, 9, 600)
    for settings in ({}, {"features": 0.6, "seed": 2}, {"least": 60, "leaves": 7}):
        a = boosting.boost(x, y, held=fold == 0, count=n, **settings)
        b = boosting.boost(*(np.repeat(v, n, axis=0) for v in (x, y)), held=np.repeat(fold == 0, n), **settings)
        assert len(a.trees) == len(b.trees) and np.abs(a.score(x) - b.score(x)).max() < 1e-9


def test_tuning_counts(spark, monkeypatch):
    """All labelled rows count, also above ``FIT_ROWS`` as long as no more are distinct."""
    rng = np.random.default_rng(6)
    made = pd.DataFrame(rng.integers(0, 3, (800, len(q_learn.X))) / 2.0, columns=q_learn.X)
    for c in q_learn.X[3:]:
        made[c] = 0.0
    made = made.assign(s1_id=[f"S1-{i}" for i in range(800)], cand_id="S2-1", fold=rng.integers(0, 3, 800), label=(rng.random(800) < 0.2 + 0.3 * made["name_words"]).astype(float))
    monkeypatch.setattr(q_learn, "labelled", lambda *_: spark.createDataFrame(made))
    monkeypatch.setattr(q_learn, "FIT_ROWS", 200)
    monkeypatch.setattr(q_learn, "VARIANTS", {"base": {}, "features60": {"features": 0.6}})
    got = {r.variant: r.logloss for r in q_learn.ml_tune(spark, "").collect()}
    x, y, fold = made[q_learn.X].to_numpy(float), made["label"].to_numpy(), made["fold"].to_numpy()

    def loss(seeds, **settings):
        p = np.mean([[m[k].score(x[i : i + 1])[0] for i, k in enumerate(fold)] for m in (q_learn.fold_models(made, seed=s, **settings) for s in seeds)], axis=0)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    want = {"base": loss([0]), "features60": loss([0], features=0.6)}
    best = min(want, key=want.get)
    want[f"{best}_x3"] = loss(range(3), **q_learn.VARIANTS[best])
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-4 for v in want)
    monkeypatch.setattr(q_learn, "FIT_ROWS", 3)
    assert q_learn.tallied(spark.createDataFrame(made), [*q_learn.X, "label"])["n"].sum() == 3


def test_tuning_is_whole(spark, monkeypatch):
    """All labelled rows count, also where more than ``FIT_ROWS`` are distinct and values share bins."""
    rng = np.random.default_rng(7)
    made = pd.DataFrame(0.0, index=range(900), columns=q_learn.X)
    made["name_words"], made["num_jaccard"], made["name_exact"] = rng.random(900), rng.integers(0, 200, 900) / 199, rng.integers(0, 2, 900)
    made = made.assign(s1_id=[f"S1-{i}" for i in range(900)], cand_id="S2-1", fold=rng.integers(0, 3, 900), label=(rng.random(900) < 0.1 + 0.8 * made["name_words"]).astype(float))
    monkeypatch.setattr(q_learn, "labelled", lambda *_: spark.createDataFrame(made).repartition(3))
    monkeypatch.setattr(q_learn, "FIT_ROWS", 50)
    monkeypatch.setattr(q_learn, "VARIANTS", {"base": {}, "features60": {"features": 0.6}})
    got = {r.variant: r.logloss for r in q_learn.ml_tune(spark, "").collect()}
    y, fold, models = made["label"].to_numpy(), made["fold"].to_numpy(), {v: q_learn.fold_models(made, **s) for v, s in q_learn.VARIANTS.items()}
    for v, m in models.items():
        p = np.choose(fold, [m[k].score(made[q_learn.X].to_numpy(float)) for k in range(3)])
        assert abs(got[v] + (y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) < 1e-4
    seen = q_learn.binned(q_learn.labelled())
    assert all(n.sum() == 900 and n[held].sum() == (fold == k).sum() for k, (_, _, held, n, _) in seen.items())
    one = made.assign(label=(fold == 1).astype(float))
    assert sorted(q_learn.binned(spark.createDataFrame(one))) == [0, 2]
    monkeypatch.setattr(q_learn, "labelled", lambda *_: spark.createDataFrame(made).limit(0))
    assert all(math.isnan(r.logloss) for r in q_learn.ml_tune(spark, "").collect())


def test_listwise(spark):
    rng = np.random.default_rng(4)
    lists = [rng.standard_normal((rng.integers(2, 6), 2)) for _ in range(2000)]
    labels = []
    for s in lists:
        z = np.append(2 * s[:, 0], 1.0)
        p = np.exp(z) / np.exp(z).sum()
        labels.append(int(rng.choice(len(z), p=p)))
    model = boosting.listwise(lists, [k if k < len(s) else 6 for s, k in zip(lists, labels)])
    assert abs(model.weights[0] - 2) < 0.3 and abs(model.weights[1]) < 0.3 and abs(model.none - 1) < 0.3
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 0.0]],)], "s array<array<double>>")
    p = df.select(boosting.listwise_scores(model, F.col("s")).alias("p")).first().p
    assert len(p) == 3 and abs(sum(p) - 1) < 1e-9 and p[0] > p[1]


def test_scores_are_taken_up(spark):
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.5), ("S1-2", "S2-2", 0.5), ("S1-3", "S2-3", 0.99)], "s1_id string, cand_id string, prob double")
    rec = spark.createDataFrame([(f"S{k}-{i}", f"name {i}", "") for k in (1, 2) for i in (1, 2, 3)], "entity_id string, business_name string, business_address string")
    done = spark.createDataFrame([("S1-1", "S2-1", 0.125)], "s1_id string, cand_id string, ce_score double")
    got = {r.s1_id: r.ce_score for r in q_learn.scored_by(pairs, rec, lambda a, b: [0.75] * len(a), 0.05, 0.95, done=done).collect()}
    assert got == {"S1-1": 0.125, "S1-2": 0.75, "S1-3": None}
    only = pairs.where("s1_id = 'S1-2'").select("s1_id")
    assert {r.s1_id: r.ce_score for r in q_learn.scored_by(pairs, rec, lambda a, b: [0.75] * len(a), 0.05, 0.95, folds=only).collect()} == {"S1-1": None, "S1-2": 0.75, "S1-3": None}
