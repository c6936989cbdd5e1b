"""Queries of decisions, metrics and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.functions import metrics
from linkloom.operators import decide, sampling, windows
from linkloom.plans import views
from linkloom.plans.q_relational import H
from linkloom.plans.registry import query
from linkloom.plans.views import FOLD, LAB, P, REC, TRUTH
from linkloom.runtime import materialise, table

GRID = [round(0.05 * k, 2) for k in range(1, 20)]
OWNED = "owned as (select * from p qualify row_number() over (partition by cand_id order by prob desc, s1_id) = 1)"
_S1S = "s1s as (select distinct s1_id from lab)"
_LISTED = "select s1_id, string_agg(distinct cand_id, ',' order by cand_id) as ids from {} group by s1_id"


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1s that were reviewed: the entities over which decisions are judged."""
    return views.labels(spark, sf_dir).select("s1_id").distinct()


def _fbeta_sql(decided: str) -> str:
    return (
        f"pr as (select s1_id, count(*) as n_pred from {decided} group by s1_id), tr as (select s1_id, count(*) as n_true from truth group by s1_id), "
        f"hi as (select s1_id, count(*) as tp from {decided} join truth using (s1_id, cand_id) group by s1_id), "
        "ent as (select s1_id, coalesce(n_pred, 0)::bigint as n_pred, coalesce(n_true, 0)::bigint as n_true, coalesce(tp, 0)::bigint as tp from s1s left join pr using (s1_id) left join tr using (s1_id) left join hi using (s1_id)), "
        "fb as (select *, case when n_pred = 0 and n_true = 0 then 1 when tp = 0 then 0 else 1.25::double * tp / (0.25::double * n_true + n_pred) end as f from ent)"
    )


query("dec_assign", f"with {P}, {OWNED} select s1_id, cand_id, prob from owned")(lambda spark, d: decide.assign(views.pairs(spark, d)).select("s1_id", "cand_id", "prob"))
query("dec_threshold", f"with {P}, {OWNED}, k as (select * from owned where prob >= 0.7) {_LISTED.format('k')}")(lambda spark, d: decide.listed(decide.keep(views.pairs(spark, d), 0.7)))
query(
    "dec_fallback",
    f"with {P}, {OWNED}, k as (select s1_id, cand_id from owned where prob >= 0.85), b as (select * from owned qualify row_number() over (partition by s1_id order by prob desc, cand_id) = 1), u as (select * from k union all select s1_id, cand_id from b where prob >= 0.25 and s1_id not in (select s1_id from k)) {_LISTED.format('u')}",
)(lambda spark, d: decide.listed(decide.keep(views.pairs(spark, d), 0.85, fallback=0.25)))
def _expected_sql(owned: str, tag: str) -> str:
    """Expected F in SQL: the numbers of true candidates inside (``fw``) and outside (``bw``) each prefix are lists, built candidate by candidate."""
    step = "list_transform(range(1, len(l) + 2), lambda i: coalesce(l[i], 0) * (1 - prob) + coalesce(case when i > 1 then l[i - 1] end, 0) * prob)"
    return (
        f"tp{tag} as (select s1_id, cand_id, prob, row_number() over (partition by s1_id order by prob desc, cand_id) as place from {owned} where prob >= 0.01 qualify place <= 20), "
        f"nn{tag} as (select s1_id, count(*) as n from tp{tag} group by s1_id), "
        f"fw{tag} as (select s1_id, 0::bigint as k, [1.0::double] as l from nn{tag} union all select f.s1_id, f.k + 1, {step} from fw{tag} f join tp{tag} t on t.s1_id = f.s1_id and t.place = f.k + 1), "
        f"bw{tag} as (select s1_id, n as k, [1.0::double] as l from nn{tag} union all select f.s1_id, f.k - 1, {step} from bw{tag} f join tp{tag} t on t.s1_id = f.s1_id and t.place = f.k), "
        f"ins{tag} as (select s1_id, k, unnest(l) as p, unnest(range(0, len(l))) as t from fw{tag} where k > 0), outs{tag} as (select s1_id, k, unnest(l) as p, unnest(range(0, len(l))) as u from bw{tag}), "
        f"ev{tag} as (select i.s1_id, i.k, sum(i.p * o.p * 1.25 * t / (0.25 * (t + u) + i.k)) as v from ins{tag} i join outs{tag} o on o.s1_id = i.s1_id and o.k = i.k group by 1, 2 union all select s1_id, 0, l[1] from bw{tag} where k = 0), "
        f"ek{tag} as (select s1_id, k from ev{tag} qualify row_number() over (partition by s1_id order by round(v, 11) desc, k) = 1), "
        f"ef{tag} as (select tp{tag}.s1_id, cand_id from tp{tag} join ek{tag} using (s1_id) where place <= k)"
    )


def _own_sql(pairs: str, name: str) -> str:
    return f"{name} as (select * from {pairs} qualify row_number() over (partition by cand_id order by prob desc, s1_id) = 1)"


def _tuned_sql(owned: str, s1s: str, name: str, fallback: str = "null") -> str:
    """``threshold, f05`` of a table of owned pairs over the S1s of another, with a best candidate from ``fallback`` up where a threshold leaves none."""
    return (
        f"{name}_g as (select unnest([{', '.join(map(str, GRID))}])::double as threshold), {name}_y as (select o.s1_id, o.cand_id, o.prob, (t.s1_id is not null)::int as y from {owned} o semi join {s1s} using (s1_id) left join truth t on t.s1_id = o.s1_id and t.cand_id = o.cand_id), "
        f"{name}_b as (select s1_id, y from {name}_y qualify row_number() over (partition by s1_id order by prob desc, cand_id) = 1 and prob >= {fallback}), "
        f"{name}_p as (select threshold, s1_id, count(*) as n, sum(y) as h from {name}_g join {name}_y on prob >= threshold group by 1, 2), {name}_n as (select s1_id, count(*) as nt from truth group by 1), "
        f"{name}_e as (select g.threshold, s.s1_id, case when p.n is null and b.y is not null then 1 else coalesce(p.n, 0) end as n, case when p.n is null and b.y is not null then b.y else coalesce(p.h, 0) end as h, coalesce(nt, 0) as nt "
        f"from {name}_g g cross join {s1s} s left join {name}_p p on p.threshold = g.threshold and p.s1_id = s.s1_id left join {name}_b b on b.s1_id = s.s1_id left join {name}_n q on q.s1_id = s.s1_id), "
        f"{name} as (select threshold, round(avg(case when n = 0 and nt = 0 then 1 when h = 0 then 0 else 1.25::double * h / (0.25::double * nt + n) end), 9) as f05 from {name}_e group by 1)"
    )


def _score_sql(decided: str, s1s: str, name: str) -> str:
    return (
        f"{name}_e as (select s.s1_id, (select count(*) from {decided} d where d.s1_id = s.s1_id) as n, (select count(*) from truth t where t.s1_id = s.s1_id) as nt, (select count(*) from {decided} d join truth t on t.s1_id = d.s1_id and t.cand_id = d.cand_id where d.s1_id = s.s1_id) as h from {s1s} s), "
        f"{name} as (select round(avg(case when n = 0 and nt = 0 then 1 when h = 0 then 0 else 1.25::double * h / (0.25::double * nt + n) end), 9) as f05 from {name}_e)"
    )


query("dec_expected_f", f"with recursive {P}, {OWNED}, {_expected_sql('owned', '')} {_LISTED.format('ef')}")(lambda spark, d: decide.listed(decide.expected_f(views.pairs(spark, d))))
query("dec_expected_f_sampled")(lambda spark, d: decide.listed(decide.expected_f(views.pairs(spark, d), "sampled")))

_TUNED = f"{P}, {TRUTH}, {_S1S}, {OWNED}, g as (select unnest([{', '.join(map(str, GRID))}])::double as threshold), tr as (select s1_id, count(*) as n_true from truth group by s1_id), pr as (select threshold, owned.s1_id, count(*) as n_pred, count(truth.s1_id) as tp from g join owned on owned.prob >= g.threshold left join truth on truth.s1_id = owned.s1_id and truth.cand_id = owned.cand_id group by 1, 2), tuned as (select g.threshold, avg(case when coalesce(n_pred, 0) = 0 and coalesce(n_true, 0) = 0 then 1 when coalesce(tp, 0) = 0 then 0 else 1.25::double * tp / (0.25::double * n_true + n_pred) end) as f05 from g cross join s1s left join tr using (s1_id) left join pr on pr.threshold = g.threshold and pr.s1_id = s1s.s1_id group by 1)"


def _tuned(spark: SparkSession, sf_dir: str, assigned: bool = True) -> DataFrame:
    return decide.tune(views.pairs(spark, sf_dir), views.truth(spark, sf_dir), reviewed(spark, sf_dir), GRID, assigned)


query("dec_tune", f"with {_TUNED} select threshold, round(f05, 6) as f05 from tuned")(lambda spark, d: _tuned(spark, d).select("threshold", F.round("f05", 6).alias("f05")))


_CHOSEN = f"{P}, {TRUTH}, {_S1S}, {OWNED}, {_tuned_sql('owned', 's1s', 'tu')}, {_expected_sql('owned', '')}, {_score_sql('ef', 's1s', 'se')}, bt as (select threshold, f05 from tu order by f05 desc, threshold limit 1), ch as (select case when se.f05 > bt.f05 then 'expected_f' else 'threshold' end as rule, bt.threshold, greatest(se.f05, bt.f05) as f05 from bt, se)"


def _chosen(spark: SparkSession, sf_dir: str) -> tuple[str, float, float]:
    return decide.choose(views.pairs(spark, sf_dir), views.truth(spark, sf_dir), reviewed(spark, sf_dir), GRID)


@query("dec_choose", f"with recursive {_CHOSEN} select rule, threshold, round(f05, 6) as f05 from ch")
def dec_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold against expected F over the reviewed S1s."""
    rule, at, f05 = _chosen(spark, sf_dir)
    return spark.createDataFrame([(rule, at, round(f05, 6))], "rule string, threshold double, f05 double")


_SPLIT = f"dv as (select distinct s1_id from fold where dev), s_dev as (select s1_id from s1s semi join dv using (s1_id)), s_tr as (select s1_id from s1s anti join dv using (s1_id)), p_tr as (select p.* from p semi join s_tr using (s1_id)), p_dev as (select p.* from p semi join s_dev using (s1_id)), {_own_sql('p_tr', 'o_tr')}, {_own_sql('p_dev', 'o_dev')}"
_STRATEGIES = ", ".join(
    [
        f"with recursive {P}, {TRUTH}, {FOLD}, {_S1S}, {_SPLIT}", _tuned_sql("o_tr", "s_tr", "ta"), _tuned_sql("p_tr", "s_tr", "tn"), *(_tuned_sql("o_tr", "s_tr", f"tf{k}", f"0.{k}") for k in (1, 2, 3)),
        "ba as (select * from ta order by f05 desc, threshold limit 1), bn as (select * from tn order by f05 desc, threshold limit 1)",
        "tfs as (select 0.1::double as fallback, * from tf1 union all select 0.2, * from tf2 union all select 0.3, * from tf3), bf as (select * from tfs order by f05 desc, fallback, threshold limit 1)",
        _expected_sql("o_tr", "_tr"), _expected_sql("o_dev", "_dev"), _score_sql("ef_tr", "s_tr", "xt"), _score_sql("ef_dev", "s_dev", "xd"),
        "da as (select s1_id, cand_id from o_dev where prob >= (select threshold from ba)), dn as (select s1_id, cand_id from p_dev where prob >= (select threshold from bn)), df0 as (select s1_id, cand_id from o_dev where prob >= (select threshold from bf))",
        "df1 as (select * from df0 union all select s1_id, cand_id from (select * from o_dev qualify row_number() over (partition by s1_id order by prob desc, cand_id) = 1) b where prob >= (select fallback from bf) and s1_id not in (select s1_id from df0))",
        _score_sql("da", "s_dev", "ca"), _score_sql("dn", "s_dev", "cn"), _score_sql("df1", "s_dev", "cf"),
    ]
)


@query(
    "dec_strategies",
    _STRATEGIES + " select 'threshold+assign' as strategy, threshold, null::double as fallback, round(ba.f05, 6) as oof, round(ca.f05, 6) as dev from ba, ca union all select 'threshold_no_assign', threshold, null, round(bn.f05, 6), round(cn.f05, 6) from bn, cn "
    "union all select 'threshold+assign+top1', threshold, fallback, round(bf.f05, 6), round(cf.f05, 6) from bf, cf union all select 'expected_f+assign', null, null, round(xt.f05, 6), round(xd.f05, 6) from xt, xd",
)
def dec_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules tuned on the reviewed S1s outside the development set and scored once on those inside: threshold with and without assignment, with the best fallback, expected F."""
    t, s = views.truth(spark, sf_dir), reviewed(spark, sf_dir)
    dev = views.folds(spark, sf_dir).where("dev").select("s1_id").distinct()
    s_tr, s_dev = materialise(s.join(dev, "s1_id", "left_anti")), materialise(s.join(dev, "s1_id", "left_semi"))
    p = views.pairs(spark, sf_dir)
    p_tr, p_dev = (materialise(p.join(x, "s1_id", "left_semi")) for x in (s_tr, s_dev))
    best = lambda **kw: decide.best_threshold(decide.tune(p_tr, t, s_tr, GRID, **kw).withColumn("f05", F.round("f05", 9))).first()
    owned, free = best(), best(assigned=False)
    backed = max(((b := best(fallback=fb)).f05, -fb, b.threshold) for fb in (0.1, 0.2, 0.3))
    rows = [
        ("threshold+assign", owned.threshold, None, owned.f05, decide.score(decide.keep(p_dev, owned.threshold), t, s_dev)),
        ("threshold_no_assign", free.threshold, None, free.f05, decide.score(decide.keep(p_dev, free.threshold, False), t, s_dev)),
        ("threshold+assign+top1", backed[2], -backed[1], backed[0], decide.score(decide.keep(p_dev, backed[2], fallback=-backed[1]), t, s_dev)),
        ("expected_f+assign", None, None, decide.score(decide.expected_f(p_tr), t, s_tr), decide.score(decide.expected_f(p_dev), t, s_dev)),
    ]
    return spark.createDataFrame(rows, "strategy string, threshold double, fallback double, oof double, dev double").withColumns({c: F.round(c, 6) for c in ("oof", "dev")})


@query("dec_apply", f"with recursive {_CHOSEN}, k as (select s1_id, cand_id from owned where prob >= (select threshold from ch) and (select rule from ch) = 'threshold' union all select s1_id, cand_id from ef where (select rule from ch) = 'expected_f') {_LISTED.format('k')}")
def dec_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen rule on all pairs."""
    rule, at, _ = _chosen(spark, sf_dir)
    return decide.listed(decide.apply(views.pairs(spark, sf_dir), rule, at))


_UNSEEN = "seen as (select distinct country from fold where fold = 0 and not dev), un as (select entity_id as s1_id, country, country not in (select country from seen) as unseen from rec where source = 'S1')"


def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s1_id, country, unseen``: whether an S1's country never occurs among the S1s that a model was fitted on (fold 0 without the development ones). Countries are an open set."""
    seen = views.folds(spark, sf_dir).where("fold = 0 and not dev").select("country").distinct().withColumn("_seen", F.lit(True))
    s1 = views.records(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "country")
    return s1.join(seen, "country", "left").select("s1_id", "country", F.col("_seen").isNull().alias("unseen"))


query("unseen_country", f"with {REC}, {FOLD}, {_UNSEEN} select s1_id, country, unseen from un")(unseen)


@query("dec_unseen_variant", f"with {P}, {OWNED}, {REC}, {FOLD}, {_UNSEEN}, k as (select owned.s1_id, cand_id from owned join un using (s1_id) where prob >= case when unseen then 0.9 else 0.7 end) {_LISTED.format('k')}")
def dec_unseen_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stricter threshold where the country is new."""
    owned = decide.assign(views.pairs(spark, sf_dir)).join(unseen(spark, sf_dir), "s1_id")
    return decide.listed(owned.where(F.col("prob") >= F.when(F.col("unseen"), 0.9).otherwise(0.7)))


_GUARD = f"{P}, {OWNED}, {REC}, d1 as (select s1_id, string_agg(cand_id, ',' order by cand_id) as ids, count(*) as n from owned where prob >= 0.7 group by s1_id), d2 as (select s1_id, string_agg(cand_id, ',' order by cand_id) as ids, count(*) as n from owned where prob >= 0.75 group by s1_id), un as (select s1_id, count(*) filter (where prob >= 0.3 and prob < 0.99) as unsure from owned group by s1_id)"


@query(
    "dec_drift_guard",
    f"with {_GUARD}, j as (select country, coalesce(d1.n, 0) as a, coalesce(d2.n, 0) as b, coalesce(unsure, 0) as u, (d1.ids is distinct from d2.ids)::int as flip from rec left join d1 on d1.s1_id = entity_id left join d2 on d2.s1_id = entity_id left join un on un.s1_id = entity_id where source = 'S1') "
    "select country, count(*)::bigint as n_s1, round(avg(a), 6) as before_per_s1, round(avg(b), 6) as after_per_s1, round(avg(u), 6) as unsure_per_s1, round(avg(flip), 6) as flipped, (avg(flip) > 0.03 or abs(avg(a) - avg(b)) > 0.02) as failed from j group by country",
)
def dec_drift_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two decided tables compared per country: matches per S1, unsure records per S1, share of S1s whose set changed, and the verdict."""
    p = decide.assign(views.pairs(spark, sf_dir))
    side = lambda t, c: p.where(F.col("prob") >= t).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(f"{c}_ids"), F.count(F.lit(1)).alias(c))
    unsure = p.groupBy("s1_id").agg(F.count(F.when((F.col("prob") >= 0.3) & (F.col("prob") < 0.99), 1)).alias("u"))
    s1 = views.records(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "country")
    j = s1.join(side(0.7, "a"), "s1_id", "left").join(side(0.75, "b"), "s1_id", "left").join(unsure, "s1_id", "left").fillna(0, ["a", "b", "u"])
    flip = F.avg((~F.col("a_ids").eqNullSafe(F.col("b_ids"))).cast("int"))
    made = j.groupBy("country").agg(F.count(F.lit(1)).alias("n_s1"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg("u").alias("u"), flip.alias("f"))
    return made.select("country", "n_s1", F.round("a", 6).alias("before_per_s1"), F.round("b", 6).alias("after_per_s1"), F.round("u", 6).alias("unsure_per_s1"), F.round("f", 6).alias("flipped"), ((F.col("f") > 0.03) | (F.abs(F.col("a") - F.col("b")) > 0.02)).alias("failed"))


# metrics ---------------------------------------------------------------------------------------------------------------

_DECIDED = f"{P}, {TRUTH}, {_S1S}, {OWNED}, k as (select s1_id, cand_id from owned where prob >= 0.7), {_fbeta_sql('k')}"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.per_entity(decide.keep(views.pairs(spark, sf_dir), 0.7), views.truth(spark, sf_dir), reviewed(spark, sf_dir))


query("met_entity_fbeta", f"with {_DECIDED} select s1_id, n_pred, n_true, tp, round(f, 6) as fbeta from fb")(lambda spark, d: _entities(spark, d).withColumn("fbeta", F.round("fbeta", 6)))
query("met_er_f05", f"with {_DECIDED} select round(avg(f), 6) as er_f05, count(*)::bigint as n from fb")(lambda spark, d: _entities(spark, d).agg(F.round(F.avg("fbeta"), 6).alias("er_f05"), F.count(F.lit(1)).alias("n")))
query("agg_macro", f"with {_DECIDED} select round(avg(f), 6) as macro_f05 from fb")(lambda spark, d: _entities(spark, d).agg(F.round(F.avg("fbeta"), 6).alias("macro_f05")))


@query("met_by_country", f"with {_DECIDED}, {REC} select country, count(*)::bigint as n, round(avg(f), 6) as f05 from fb join rec on entity_id = s1_id group by country")
def met_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: scored pairs, one owner per record, threshold, and the macro F0.5 per country over the reviewed S1s."""
    country = views.records(spark, sf_dir).select(F.col("entity_id").alias("s1_id"), "country")
    return _entities(spark, sf_dir).join(country, "s1_id").groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fbeta"), 6).alias("f05"))


_LINES = "l as (select l_extendedprice as a, l_quantity * 1000 as f from lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1000).alias("f"))


for _name, _sql in {
    "smape": "100 * avg(case when abs(a) + abs(f) = 0 then 0 else abs(f - a) / ((abs(a) + abs(f)) / 2) end)",
    "rmse": "sqrt(avg((a - f) ** 2))",
    "mae": "avg(abs(a - f))",
    "rmsle": "sqrt(avg((ln(1 + a) - ln(1 + f)) ** 2))",
    "mape": "100 * avg(abs((a - f) / a)) filter (where a <> 0)",
    "r2": "1 - sum((a - f) ** 2) / (var_pop(a) * count(*))",
}.items():
    query(f"met_{_name}", f"with {_LINES} select round({_sql}, 5) as {_name} from l")(lambda spark, d, name=_name: metrics.get(name)[0](_lines(spark, d), "a", "f").select(F.round(name, 5).alias(name)))

_CLASSED = f"{P}, {LAB}, c as (select prob, y, prob >= 0.5 as p from p join lab using (s1_id, cand_id))"


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).join(views.labels(spark, sf_dir), ["s1_id", "cand_id"]).withColumn("p", F.col("prob") >= 0.5)


_CLASSES = "k as (select unnest([true, false]) as class), s as (select class, count(*) filter (where y = class) as t, count(*) filter (where p = class) as q, count(*) filter (where p = class and y = class) as hit from k, c group by class)"
for _name, _pred, _sql in (
    ("accuracy", "p", "select round(avg((y = p)::int), 6) as accuracy from c"),
    ("f1_macro", "p", f"select round(avg(2 * hit / (t + q)), 6) as f1_macro from (with {_CLASSES} select * from s)"),
    ("f1_micro", "p", f"select round(2 * sum(hit) / (sum(t) + sum(q)), 6) as f1_micro from (with {_CLASSES} select * from s)"),
    ("auc", "prob", "select round((sum(r) filter (where y) - count(*) filter (where y) * (count(*) filter (where y) + 1) / 2) / (count(*) filter (where y) * count(*) filter (where not y)), 6) as auc from (select y, rank() over (order by prob) + (count(*) over (partition by prob) - 1) / 2 as r from c)"),
    ("logloss", "prob", "select round(avg(case when y then -ln(greatest(1e-15, least(1 - 1e-15, prob))) else -ln(1 - greatest(1e-15, least(1 - 1e-15, prob))) end), 6) as logloss from c"),
):
    query(f"met_{_name}", f"with {_CLASSED} {_sql}")(lambda spark, d, name=_name, pred=_pred: metrics.get(name)[0](_classed(spark, d), "y", pred).select(F.round(name, 6).alias(name)))


@query("met_extraction_f1", f"with {REC}, t as (select postcode, regexp_extract(business_address, '([0-9]{{5,6}})[^0-9]*$', 1) as guess from rec join (select entity_id, max(postcode) as postcode from normalised_frames group by 1) using (entity_id)), c as (select count(*) filter (where guess <> '' and guess = trim(coalesce(postcode, ''))) as tp, count(*) filter (where guess <> '' and guess <> trim(coalesce(postcode, ''))) as fp, count(*) filter (where guess = '' and trim(coalesce(postcode, '')) <> '') as fn from t) select round(2 * tp / (2 * tp + fp + fn), 6) as extraction_f1 from c")
def met_extraction_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a plain pattern over raw addresses finds the normalised postcode."""
    post = table(spark, sf_dir, "normalised_frames").groupBy("entity_id").agg(F.max("postcode").alias("postcode"))
    both = views.records(spark, sf_dir).join(post, "entity_id").withColumn("guess", F.regexp_extract("business_address", "([0-9]{5,6})[^0-9]*$", 1))
    return metrics.extraction_f1(both, "postcode", "guess").select(F.round("extraction_f1", 6).alias("extraction_f1"))


@query(
    "met_ndcg",
    f"with {_CLASSED.replace('select prob, y', 'select s1_id, prob, y')}, o as (select *, row_number() over (partition by s1_id order by prob desc) as place, row_number() over (partition by s1_id order by y desc) as ideal from c), t as (select s1_id, prob, avg(y::int) * sum(1 / log2(place + 1)) as g from o group by 1, 2), "
    "d as (select s1_id, sum(g) as dcg from t group by 1), i as (select s1_id, sum(y::int / log2(ideal + 1)) as idcg from o group by 1) select round(avg(coalesce(dcg / nullif(idcg, 0), 0)), 6) as ndcg from d join i using (s1_id)",
)
def met_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg(_classed(spark, sf_dir), "s1_id", "y", "prob").select(F.round("ndcg", 6).alias("ndcg"))


@query(
    "met_map_at_k",
    f"with {P}, {TRUTH}, r as (select s1_id, cand_id, row_number() over (partition by s1_id order by prob desc, cand_id) as place from p qualify place <= 10), h as (select r.*, row_number() over (partition by s1_id order by place) as hit from r join truth using (s1_id, cand_id)), g as (select s1_id, sum(hit / place) as gained from h group by 1), n as (select s1_id, count(*) as n from truth group by 1) select round(avg(coalesce(gained, 0) / least(n, 10)), 6) as map_at_k from n left join g using (s1_id)",
)
def met_map_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = windows.first_rows(views.pairs(spark, sf_dir), ["s1_id"], [F.desc("prob"), F.asc("cand_id")], 10)
    return metrics.map_at_k(views.truth(spark, sf_dir), ranked, "s1_id", "cand_id", "place").select(F.round("map_at_k", 6).alias("map_at_k"))


@query("met_registry", f"with {_CLASSED}, {_LINES} select 'mae' as metric, round(avg(abs(a - f)), 5) as value, false as higher_is_better from l union all select 'rmse', round(sqrt(avg((a - f) ** 2)), 5), false from l")
def met_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by name; an unknown name raises."""
    return metrics.several(_lines(spark, sf_dir), ["mae", "rmse"], "a", "f").withColumn("value", F.round("value", 5))


@query("met_finite_check", "select count(*)::bigint as n, count(*) filter (where prob is null or isnan(prob))::bigint as n_bad from scored_pairs")
def met_finite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose prediction a metric would refuse."""
    return table(spark, sf_dir, "scored_pairs").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("prob").isNull() | F.isnan("prob"), 1)).alias("n_bad"))


# folds -----------------------------------------------------------------------------------------------------------------

_HK = H.format("concat_ws('|', {}, '42')")
K = 5


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def drawn_folds(df: DataFrame, keys: list[str], within: list[str], k: int = K, seed: int = 42) -> DataFrame:
    """``keys, fold``: rows dealt out in the order of their draws, within strata if given, so that folds differ by at most one row a stratum."""
    made = windows.numbered(df.withColumn("_draw", sampling.draw(seed, *keys)), within, [F.asc("_draw"), *map(F.asc, keys)], "_no")
    return made.withColumn("fold", ((F.col("_no") - 1) % k).cast("int")).drop("_draw", "_no")


@query("cv_kfold", f"select o_orderkey, ((row_number() over (order by {_HK.format('o_orderkey')}, o_orderkey) - 1) % {K})::int as fold from orders")
def cv_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn_folds(_orders(spark, sf_dir), ["o_orderkey"], []).select("o_orderkey", "fold")


@query("cv_stratified", f"select o_orderkey, ((row_number() over (partition by o_orderstatus order by {_HK.format('o_orderkey')}, o_orderkey) - 1) % {K})::int as fold from orders")
def cv_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn_folds(_orders(spark, sf_dir), ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "fold")


@query("cv_stratified_reg", f"with b as (select o_orderkey, ntile(10) over (order by o_totalprice, o_orderkey) as bin from orders) select o_orderkey, ((row_number() over (partition by bin order by {_HK.format('o_orderkey')}, o_orderkey) - 1) % {K})::int as fold from b")
def cv_stratified_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = windows.tiles(_orders(spark, sf_dir), [F.asc("o_totalprice"), F.asc("o_orderkey")], 10, "bin")
    return drawn_folds(binned, ["o_orderkey"], ["bin"]).select("o_orderkey", "fold")


_GROUPED = f"g as (select o_custkey, ((row_number() over (order by {_HK.format('o_custkey')}, o_custkey) - 1) % {K})::int as fold from (select distinct o_custkey from orders))"


@query("cv_group", f"with {_GROUPED} select o_orderkey, fold from orders join g using (o_custkey)")
def cv_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are never split over folds: groups are dealt, then joined back."""
    orders = _orders(spark, sf_dir)
    return orders.join(drawn_folds(orders.select("o_custkey").distinct(), ["o_custkey"], []), "o_custkey").select("o_orderkey", "fold")


@query("cv_stratified_group", f"with m as (select o_custkey, min(o_orderstatus) as st from orders group by 1), g as (select o_custkey, ((row_number() over (partition by st order by {_HK.format('o_custkey')}, o_custkey) - 1) % {K})::int as fold from m) select o_orderkey, fold from orders join g using (o_custkey)")
def cv_stratified_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups, dealt within strata of their least status."""
    orders = _orders(spark, sf_dir)
    groups = orders.groupBy("o_custkey").agg(F.min("o_orderstatus").alias("st"))
    return orders.join(drawn_folds(groups, ["o_custkey"], ["st"]).drop("st"), "o_custkey").select("o_orderkey", "fold")


@query("cv_time", f"with c as (select o_orderkey, ntile({K + 1}) over (order by o_orderdate, o_orderkey) as chunk from orders) select o_orderkey, (chunk - 2)::int as fold from c")
def cv_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of time: fold k is validated on stretch k and trained on all before it; the first stretch, -1, is only trained on."""
    chunks = windows.tiles(_orders(spark, sf_dir), [F.asc("o_orderdate"), F.asc("o_orderkey")], K + 1, "chunk")
    return chunks.select("o_orderkey", (F.col("chunk") - 2).cast("int").alias("fold"))


@query("cv_iter", f"with {FOLD} select k::int as k, count(*) filter (where fold <> k)::bigint as n_train, count(*) filter (where fold = k)::bigint as n_val from fold, range({K}) t(k) group by k")
def cv_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of every fold's training and validation part, all in one pass."""
    split = views.folds(spark, sf_dir).select("fold", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("k"))
    return split.groupBy("k").agg(F.count(F.when(F.col("fold") != F.col("k"), 1)).alias("n_train"), F.count(F.when(F.col("fold") == F.col("k"), 1)).alias("n_val"))


@query("cv_dev_subset", f"with {FOLD} select s1_id from fold where fold = 0 order by {_HK.format('s1_id')}, s1_id limit 100")
def cv_dev_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed development sample of fold 0."""
    return sampling.uniform(views.folds(spark, sf_dir).where("fold = 0").select("s1_id"), 100, 42, "s1_id")
