"""Queries of composite features, candidate filters and contested groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.functions import similarity as sim, text
from linkloom.operators import windows
from linkloom.plans import views
from linkloom.plans.q_decide import unseen
from linkloom.plans.q_relational import COMP, RANKS, SIBV, anchors, view_ranks
from linkloom.plans.measures import measures_sql
from linkloom.plans.q_text import NORM2_SQL, norm2_features, with_cosines
from linkloom.plans.registry import query
from linkloom.plans.views import FOLD, LAB, NF, P, PF, REC, TRUTH, VEC, cosine_sql, tokens_sql

#: name -> function of the framed pairs; ``context`` needs ``cos_both`` and comes last
GROUPS: dict[str, Callable[[DataFrame], DataFrame]] = {}

NAME = ["name_ratio", "name_tset", "name_tsort", "name_partial", "name_jw", "name_full_tset", "name_exact", "name_len_l", "name_len_r"]
ADDRESS = ["addr_tset", "addr_tsort", "addr_partial", "num_jaccard", "num_common", "num_first", "postcode_eq", "addr_empty"]
CONTEXT = ["ctx_rank_s1", "ctx_gap_s1", "ctx_n_s1", "ctx_rank_c", "ctx_gap_c", "ctx_n_c", "is_s3"]


def group(name: str):
    def put(f):
        GROUPS[name] = f
        return f

    return put


@group("name")
def name_features(pairs: DataFrame) -> DataFrame:
    """Nine figures of two names. String ratios are computed once per distinct pair of names."""
    made = sim.scored(pairs, "l_name_core", "r_name_core", ["ratio", "tset", "tsort", "partial", "jw"], "name")
    made = sim.scored(made, "l_name_norm", "r_name_norm", ["tset"], "name_full")
    return made.withColumns({"name_exact": (F.col("l_name_core") == F.col("r_name_core")).cast("int"), "name_len_l": F.length("l_name_core"), "name_len_r": F.length("r_name_core")})


@group("address")
def address_features(pairs: DataFrame) -> DataFrame:
    """Eight figures of two addresses; null where a figure isn't defined."""
    made = sim.scored(pairs, "l_addr_norm", "r_addr_norm", ["tset", "tsort", "partial"], "addr")
    a, b = text.number_set(F.col("l_addr_nums")), text.number_set(F.col("r_addr_nums"))
    return made.withColumns({
        "num_jaccard": sim.jaccard(a, b), "num_common": F.size(F.array_intersect(a, b)), "num_first": sim.same_first(text.tokens(F.col("l_addr_nums")), text.tokens(F.col("r_addr_nums"))),
        "postcode_eq": sim.same_stated(F.col("l_postcode"), F.col("r_postcode")), "addr_empty": (F.col("r_addr_norm") == "").cast("int"),
    })


@group("context")
def context_features(pairs: DataFrame, value: str = "cos_both") -> DataFrame:
    """Where a pair stands among its S1's candidates of one source and among its record's S1s, over the whole population."""
    made = pairs.withColumn("source", F.substring("cand_id", 1, 2))
    made = windows.with_group(windows.with_rank(made, ["s1_id", "source"], value, "ctx_rank_s1"), ["s1_id", "source"], _t=F.max(value), ctx_n_s1=F.count(F.lit(1))).withColumn("ctx_gap_s1", F.col("_t") - F.col(value)).drop("_t")
    made = windows.with_group(windows.with_rank(made, ["cand_id"], value, "ctx_rank_c"), ["cand_id"], _t=F.max(value), ctx_n_c=F.count(F.lit(1))).withColumn("ctx_gap_c", F.col("_t") - F.col(value)).drop("_t")
    return made.withColumn("is_s3", (F.col("source") == "S3").cast("int")).drop("source")


def build(pairs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Feature groups in order, all of them by default; unknown names raise KeyError; context is left out without ``cos_both``."""
    for name in names or ["name", "address", "context"]:
        f = GROUPS[name]
        if name != "context" or "cos_both" in pairs.columns:
            pairs = f(pairs)
    return pairs


_NAME_SQL = (
    f"{measures_sql('select l_name_core as a, r_name_core as b from pf', 'mc', True)}, {measures_sql('select l_name_norm as a, r_name_norm as b from pf', 'mf')}, "
    "fn as (select s1_id, cand_id, mc.ratio as name_ratio, mc.tset as name_tset, mc.tsort as name_tsort, mc.partial as name_partial, mc.jw as name_jw, mf.tset as name_full_tset, (l_name_core = r_name_core)::int as name_exact, length(l_name_core)::int as name_len_l, length(r_name_core)::int as name_len_r "
    "from pf join mc on mc.a = l_name_core and mc.b = r_name_core join mf on mf.a = l_name_norm and mf.b = r_name_norm)"
)
_LN, _RN = (f"list_distinct({tokens_sql(f'{s}_addr_nums')})" for s in "lr")
_ADDRESS_SQL = (
    f"{measures_sql('select l_addr_norm as a, r_addr_norm as b from pf', 'mad', True)}, "
    f"fa as (select s1_id, cand_id, mad.tset as addr_tset, mad.tsort as addr_tsort, mad.partial as addr_partial, len(list_intersect({_LN}, {_RN})) / nullif(len(list_distinct(list_concat({_LN}, {_RN}))), 0) as num_jaccard, len(list_intersect({_LN}, {_RN}))::int as num_common, "
    "case when l_addr_nums <> '' and r_addr_nums <> '' then (string_split(l_addr_nums, ' ')[1] = string_split(r_addr_nums, ' ')[1])::int::double end as num_first, case when l_postcode <> '' and r_postcode <> '' then (l_postcode = r_postcode)::int::double end as postcode_eq, (r_addr_norm = '')::int as addr_empty "
    "from pf join mad on mad.a = l_addr_norm and mad.b = r_addr_norm)"
)


def _rounded(columns: list[str], alias: str = "") -> str:
    return ", ".join(f"round({alias}{c}::double, 6) as {c}" for c in columns)


query("feat_name", f"with {PF}, {_NAME_SQL} select s1_id, cand_id, {_rounded(NAME[:6])}, name_exact, name_len_l, name_len_r from fn")(lambda spark, d: name_features(views.framed_pairs(spark, d)).select("s1_id", "cand_id", *(F.round(c, 6).alias(c) for c in NAME)))
query("feat_address", f"with {PF}, {_ADDRESS_SQL} select s1_id, cand_id, {_rounded([c for c in ADDRESS if c not in ('num_common', 'addr_empty')])}, num_common, addr_empty from fa")(lambda spark, d: address_features(views.framed_pairs(spark, d)).select("s1_id", "cand_id", *(F.round(c, 6).alias(c) for c in ADDRESS)))


def _with_cos(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_cosines(views.framed_pairs(spark, sf_dir), views.vectors(spark, sf_dir), ["name", "both"])
    return made.withColumns({c: F.round(c, 9) for c in ("cos_name", "cos_both")})


_CTX = f"{PF}, {VEC}, x as (select s1_id, cand_id, substr(cand_id, 1, 2) as source, round({cosine_sql('a.vec', 'b.vec')}, 9) as v from pf left join vec a on a.entity_id = s1_id and a.view_name = 'both' left join vec b on b.entity_id = cand_id and b.view_name = 'both')"


@query(
    "feat_context",
    f"with {_CTX} select s1_id, cand_id, rank() over (partition by s1_id, source order by v desc nulls last) as ctx_rank_s1, round(max(v) over (partition by s1_id, source) - v, 6) as ctx_gap_s1, count(*) over (partition by s1_id, source) as ctx_n_s1, "
    "rank() over (partition by cand_id order by v desc nulls last) as ctx_rank_c, round(max(v) over (partition by cand_id) - v, 6) as ctx_gap_c, count(*) over (partition by cand_id) as ctx_n_c, (source = 'S3')::int as is_s3 from x",
)
def feat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = context_features(_with_cos(spark, sf_dir))
    return made.select("s1_id", "cand_id", *(F.round(c, 6).alias(c) if "gap" in c else F.col(c) for c in CONTEXT))


@query("feat_registry", "select unnest(['address', 'context', 'name']) as feature_group")
def feat_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(GROUPS)], "feature_group string")


_CONTEXT_SQL = (
    "cx as (select s1_id, cand_id, rank() over (partition by s1_id, source order by v desc nulls last) as ctx_rank_s1, max(v) over (partition by s1_id, source) - v as ctx_gap_s1, count(*) over (partition by s1_id, source) as ctx_n_s1, "
    "rank() over (partition by cand_id order by v desc nulls last) as ctx_rank_c, max(v) over (partition by cand_id) - v as ctx_gap_c, count(*) over (partition by cand_id) as ctx_n_c, (source = 'S3')::int as is_s3 from x)"
)
_COS_SQL = f"cs as (select s1_id, cand_id, round({cosine_sql('a.vec', 'b.vec')}, 9) as cos_name, round({cosine_sql('c.vec', 'd.vec')}, 9) as cos_both from pf left join vec a on a.entity_id = s1_id and a.view_name = 'name' left join vec b on b.entity_id = cand_id and b.view_name = 'name' left join vec c on c.entity_id = s1_id and c.view_name = 'both' left join vec d on d.entity_id = cand_id and d.view_name = 'both')"
_RANK_SQL = RANKS.split(f"{VEC}, ", 1)[1] + ", rk as (select s1_id, cand_id, min(rank) filter (where view = 'name') as rank_name, min(rank) filter (where view = 'both') as rank_both from ranks group by 1, 2)"


@query(
    "feat_stage1",
    f"with {_CTX}, {_NAME_SQL}, {_ADDRESS_SQL}, {_CONTEXT_SQL}, {_COS_SQL}, {_RANK_SQL} select s1_id, cand_id, {_rounded(['cos_name', 'cos_both', *NAME, *ADDRESS, *CONTEXT, 'rank_name', 'rank_both'])} "
    "from fn join fa using (s1_id, cand_id) join cx using (s1_id, cand_id) join cs using (s1_id, cand_id) left join rk using (s1_id, cand_id)",
)
def feat_stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole first design matrix with the views' ranks."""
    made = build(_with_cos(spark, sf_dir))
    ranks = view_ranks(spark, sf_dir).groupBy("s1_id", "cand_id").pivot("view", ["name", "both"]).agg(F.min("rank"))
    made = made.join(ranks.select("s1_id", "cand_id", F.col("name").alias("rank_name"), F.col("both").alias("rank_both")), ["s1_id", "cand_id"], "left")
    return made.select("s1_id", "cand_id", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ["cos_name", "cos_both", *NAME, *ADDRESS, *CONTEXT, "rank_name", "rank_both"]))


def competition(pairs: DataFrame, column: str = "prob") -> DataFrame:
    """Best value of the record under another S1, and the margin; of ``prob`` under the names of the second stage."""
    made = windows.best_other(pairs, "cand_id", "s1_id", column, "_c")
    names = ("s2_other_s1_best", "s2_margin_vs_other_s1") if column == "prob" else (f"comp_{column}_other_best", f"comp_{column}_margin")
    return made.withColumnsRenamed({"_c_other_best": names[0], "_c_margin": names[1]})


_WORDS = f"a as (select s1_id, cand_id, round(coalesce(len(list_intersect(list_distinct({tokens_sql('l_name_core')}), list_distinct({tokens_sql('r_name_core')}))) / nullif(len(list_distinct(list_concat({tokens_sql('l_name_core')}, {tokens_sql('r_name_core')}))), 0), 0), 9) as v from pf)"


@query(
    "feat_competition",
    f"with {PF}, {COMP}, {_WORDS}, cv as (select s1_id, cand_id, v, row_number() over w as rn, max(v) over (partition by cand_id) as first, nth_value(v, 2) over (partition by cand_id order by v desc, s1_id rows between unbounded preceding and unbounded following) as second from a window w as (partition by cand_id order by v desc, s1_id)) "
    "select cv.s1_id, cv.cand_id, round(other, 6) as s2_other_s1_best, round(prob - other, 6) as s2_margin_vs_other_s1, round(case when rn = 1 then coalesce(second, 0) else first end, 6) as comp_words_other_best, round(v - case when rn = 1 then coalesce(second, 0) else first end, 6) as comp_words_margin from cv join comp using (s1_id, cand_id)",
)
def feat_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition by score over all pairs, and by the overlap of names' words over the framed ones."""
    words = lambda c: F.array_distinct(text.tokens(F.col(c)))
    framed = views.framed_pairs(spark, sf_dir).select("s1_id", "cand_id", F.round(F.coalesce(sim.jaccard(words("l_name_core"), words("r_name_core")), F.lit(0.0)), 9).alias("words"))
    made = competition(framed, "words").join(competition(views.pairs(spark, sf_dir)), ["s1_id", "cand_id"])
    return made.select("s1_id", "cand_id", *(F.round(c, 6).alias(c) for c in ("s2_other_s1_best", "s2_margin_vs_other_s1", "comp_words_other_best", "comp_words_margin")))


def rarity(frames: DataFrame) -> DataFrame:
    """Per record how common its name is: counts of the same name among S1 and among the pool of its country, the pool's divided by the pool's size per S1, and how often its rarest word occurs.

    ``entity_id, rar_same_name_s1, rar_same_name_pool, rar_min_tok_df``. A country without S1 or pool has ratio 1; a name without words has 0 for its rarest word.
    """
    s1 = F.substring("entity_id", 1, 2) == "S1"
    same = frames.groupBy("country", "name_core").agg(F.count(F.when(s1, 1)).alias("rar_same_name_s1"), F.count(F.when(~s1, 1)).alias("_pool"))
    sizes = frames.groupBy("country").agg(F.coalesce(F.try_divide(F.nullif(F.count(F.when(~s1, 1)), F.lit(0)), F.count(F.when(s1, 1))), F.lit(1.0)).alias("_ratio"))
    words = frames.select("entity_id", "country", F.explode(text.tokens(F.col("name_core"))).alias("token"))
    df = words.groupBy("country", "token").agg(F.count(F.lit(1)).alias("df"))
    rarest = words.join(df, ["country", "token"]).groupBy("entity_id").agg(F.min("df").alias("_df"))
    made = frames.select("entity_id", "country", "name_core").join(same, ["country", "name_core"]).join(sizes, "country").join(rarest, "entity_id", "left")
    return made.select("entity_id", "rar_same_name_s1", (F.col("_pool") / F.col("_ratio")).alias("rar_same_name_pool"), F.coalesce("_df", F.lit(0)).cast("bigint").alias("rar_min_tok_df"))


@query(
    "feat_rarity",
    f"with {NF}, s as (select country, name_core, count(*) filter (where entity_id like 'S1%') as n1, count(*) filter (where entity_id not like 'S1%') as np from nf group by 1, 2), z as (select country, coalesce(nullif(count(*) filter (where entity_id not like 'S1%'), 0) / nullif(count(*) filter (where entity_id like 'S1%'), 0), 1) as ratio from nf group by 1), "
    f"t as (select entity_id, country, unnest({tokens_sql('name_core')}) as token from nf), df as (select country, token, count(*) as df from t group by 1, 2), m as (select entity_id, min(df) as df from t join df using (country, token) group by 1) "
    "select nf.entity_id, n1::bigint as rar_same_name_s1, round(np / ratio, 6) as rar_same_name_pool, coalesce(df, 0)::bigint as rar_min_tok_df from nf join s using (country, name_core) join z using (country) left join m on m.entity_id = nf.entity_id",
)
def feat_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarity(views.frames(spark, sf_dir)).withColumn("rar_same_name_pool", F.round("rar_same_name_pool", 6))


PROB = ["s2_prob", "s2_rank_in_s1", "s2_gap_to_max_s1", "s2_n_conf50_s1", "s2_n_conf90_s1", "s2_sum_prob_s1", "s2_other_s1_best", "s2_margin_vs_other_s1"]
SIBLING = [f"sib_{m}_{a}" for m in ("cos_name", "cos_both", "name_tset", "addr_tset") for a in ("max", "wmean")]


def sibling_features(pairs: DataFrame, frames: DataFrame, vectors: DataFrame) -> DataFrame:
    """Greatest and score-weighted likeness of each pair's record to its S1's other confident records; missing without such records."""
    sib = pairs.select("s1_id", "cand_id").join(anchors(pairs), "s1_id").where("cand_id <> anchor")
    f = frames.select("entity_id", "name_core", "addr_norm")
    sib = sib.join(f.select(F.col("entity_id").alias("cand_id"), F.col("name_core").alias("an"), F.col("addr_norm").alias("aa")), "cand_id").join(f.select(F.col("entity_id").alias("anchor"), F.col("name_core").alias("bn"), F.col("addr_norm").alias("ba")), "anchor")
    sib = sim.scored(sim.scored(sib, "an", "bn", ["tset"], "name"), "aa", "ba", ["tset"], "addr")
    for view in ("name", "both"):
        own = vectors.where(F.col("view_name") == view)
        sib = sib.join(own.select(F.col("entity_id").alias("cand_id"), F.col("vec").alias("_a")), "cand_id", "left").join(own.select(F.col("entity_id").alias("anchor"), F.col("vec").alias("_b")), "anchor", "left").withColumn(f"cos_{view}", sim.cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    aggs = []
    for m in ("cos_name", "cos_both", "name_tset", "addr_tset"):
        weight = F.sum(F.when(F.col(m).isNotNull(), F.col("anchor_prob")))
        aggs += [F.max(m).alias(f"sib_{m}_max"), F.try_divide(F.sum(F.col(m) * F.col("anchor_prob")), weight).alias(f"sib_{m}_wmean")]
    return sib.groupBy("s1_id", "cand_id").agg(*aggs, F.count(F.lit(1)).alias("sib_n_anchors"))


def cluster_features(pairs: DataFrame, frames: DataFrame, vectors: DataFrame) -> DataFrame:
    """Figures of the S1's scores, competition over the population, and likeness to siblings."""
    made = windows.numbered(pairs, ["s1_id"], [F.desc("prob"), F.asc("cand_id")], "s2_rank_in_s1")
    made = windows.with_group(made, ["s1_id"], s2_n_conf50_s1=F.count(F.when(F.col("prob") >= 0.5, 1)), s2_n_conf90_s1=F.count(F.when(F.col("prob") >= 0.9, 1)), s2_sum_prob_s1=F.sum("prob"), _t=F.max("prob"))
    made = competition(made.withColumn("s2_gap_to_max_s1", F.col("_t") - F.col("prob")).drop("_t")).withColumnRenamed("prob", "s2_prob")
    return made.join(sibling_features(pairs, frames, vectors), ["s1_id", "cand_id"], "left").withColumn("sib_n_anchors", F.coalesce("sib_n_anchors", F.lit(0)))


def _cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_features(views.pairs(spark, sf_dir), views.frames(spark, sf_dir), views.vectors(spark, sf_dir))


_R6 = lambda cols: [F.round(F.col(c).cast("double"), 6).alias(c) for c in cols]


def _sibling_sql(pairs: str, tag: str) -> str:
    """CTEs that end in ``sg<tag>``: likeness of each pair's record to its S1's other confident records, anchors from the table ``pairs``."""
    measures = {"cos_name": "cn", "cos_both": "cb", "name_tset": "nt", "addr_tset": "at_"}
    aggs = ", ".join(f"max({v}) as sib_{m}_max, sum({v} * anchor_prob) / nullif(sum(case when {v} is not null then anchor_prob end), 0) as sib_{m}_wmean" for m, v in measures.items())
    return (
        f"an{tag} as (select s1_id, cand_id as anchor, prob as anchor_prob from (select *, row_number() over (partition by s1_id order by prob desc, cand_id) as place from {pairs}) where place <= 3 and prob >= 0.5), "
        f"sb{tag} as materialized (select p.s1_id, p.cand_id, anchor, anchor_prob, l.name_core as la, r.name_core as ra, l.addr_norm as lb, r.addr_norm as rb from {pairs} p join an{tag} a on a.s1_id = p.s1_id and a.anchor <> p.cand_id join nf l on l.entity_id = p.cand_id join nf r on r.entity_id = anchor), "
        f"{measures_sql(f'select la as a, ra as b from sb{tag}', f'sn{tag}')}, {measures_sql(f'select lb as a, rb as b from sb{tag}', f'sa{tag}')}, "
        f"sv{tag} as (select s.s1_id, s.cand_id, anchor_prob, n.tset as nt, d.tset as at_, {cosine_sql('v1.vec', 'v2.vec')} as cn, {cosine_sql('v3.vec', 'v4.vec')} as cb from sb{tag} s join sn{tag} n on n.a = la and n.b = ra join sa{tag} d on d.a = lb and d.b = rb "
        "left join vec v1 on v1.entity_id = s.cand_id and v1.view_name = 'name' left join vec v2 on v2.entity_id = anchor and v2.view_name = 'name' left join vec v3 on v3.entity_id = s.cand_id and v3.view_name = 'both' left join vec v4 on v4.entity_id = anchor and v4.view_name = 'both'), "
        f"sg{tag} as (select s1_id, cand_id, {aggs}, count(*) as sib_n_anchors from sv{tag} group by 1, 2)"
    )


def _prob_sql(pairs: str, tag: str) -> str:
    """CTEs that end in ``pg<tag>``: figures of the S1's scores and competition, of the table ``pairs``."""
    return (
        f"cc{tag} as (select s1_id, cand_id, prob, case when rn = 1 then coalesce(second, 0) else first end as other from (select *, row_number() over w as rn, max(prob) over (partition by cand_id) as first, nth_value(prob, 2) over (partition by cand_id order by prob desc, s1_id rows between unbounded preceding and unbounded following) as second from {pairs} window w as (partition by cand_id order by prob desc, s1_id))), "
        f"pg{tag} as (select s1_id, cand_id, prob as s2_prob, row_number() over (partition by s1_id order by prob desc, cand_id) as s2_rank_in_s1, max(prob) over (partition by s1_id) - prob as s2_gap_to_max_s1, count(*) filter (where prob >= 0.5) over (partition by s1_id) as s2_n_conf50_s1, count(*) filter (where prob >= 0.9) over (partition by s1_id) as s2_n_conf90_s1, "
        f"sum(prob) over (partition by s1_id) as s2_sum_prob_s1, other as s2_other_s1_best, prob - other as s2_margin_vs_other_s1 from cc{tag})"
    )


query("feat_cluster", f"with {P}, {NF}, {VEC}, {_prob_sql('p', '1')}, {_sibling_sql('p', '1')} select s1_id, cand_id, {_rounded([*PROB, *SIBLING])}, coalesce(sib_n_anchors, 0)::double as sib_n_anchors from pg1 left join sg1 using (s1_id, cand_id)")(lambda spark, d: _cluster(spark, d).select("s1_id", "cand_id", *_R6([*PROB, *SIBLING, "sib_n_anchors"])))


@query("feat_cluster_words", f"with {SIBV} select s1_id, cand_id, round(max(v), 6) as sib_words_max, round(sum(v * anchor_prob) / sum(case when v is not null then anchor_prob end), 6) as sib_words_wmean, count(*)::bigint as sib_n_anchors from sv group by s1_id, cand_id")
def feat_cluster_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sibling part with a measure that SQL has too: overlap of names' words."""
    from linkloom.plans.q_relational import sibling_scores

    w = F.sum(F.when(F.col("v").isNotNull(), F.col("anchor_prob")))
    return sibling_scores(spark, sf_dir).groupBy("s1_id", "cand_id").agg(F.round(F.max("v"), 6).alias("sib_words_max"), F.round(F.try_divide(F.sum(F.col("v") * F.col("anchor_prob")), w), 6).alias("sib_words_wmean"), F.count(F.lit(1)).alias("sib_n_anchors"))


_RARITY_SQL = (
    f"rs as (select country, name_core, count(*) filter (where entity_id like 'S1%') as n1, count(*) filter (where entity_id not like 'S1%') as np from nf group by 1, 2), rz as (select country, coalesce(nullif(count(*) filter (where entity_id not like 'S1%'), 0) / nullif(count(*) filter (where entity_id like 'S1%'), 0), 1) as ratio from nf group by 1), "
    f"rt as (select entity_id, country, unnest({tokens_sql('name_core')}) as token from nf), rd as (select country, token, count(*) as df from rt group by 1, 2), rm as (select entity_id, min(df) as df from rt join rd using (country, token) group by 1), "
    "ry as (select nf.entity_id, n1 as same_name_s1, np / ratio as same_name_pool, coalesce(df, 0) as min_tok_df from nf join rs using (country, name_core) join rz using (country) left join rm on rm.entity_id = nf.entity_id)"
)
_RAR = [f"rar_{side}_{c}" for side in ("s1", "c") for c in ("same_name_s1", "same_name_pool", "min_tok_df")]


@query(
    "feat_stage2",
    f"with {PF}, {VEC}, {_prob_sql('p', '2')}, q as (select s1_id, cand_id, prob from pf), {_sibling_sql('q', '2')}, {NORM2_SQL}, {_RARITY_SQL}, "
    "ra2 as (select entity_id as s1_id, same_name_s1 as rar_s1_same_name_s1, same_name_pool as rar_s1_same_name_pool, min_tok_df as rar_s1_min_tok_df from ry), rb2 as (select entity_id as cand_id, same_name_s1 as rar_c_same_name_s1, same_name_pool as rar_c_same_name_pool, min_tok_df as rar_c_min_tok_df from ry) "
    f"select s1_id, cand_id, {_rounded(['prob', 's2_other_s1_best', 's2_margin_vs_other_s1', *SIBLING, 'sib_n_anchors', 'name2_ratio', 'name2_tset', 'name2_tsort', 'addr2_tset', 'addr2_tsort', *_RAR])} "
    "from q join pg2 using (s1_id, cand_id) join norm2 using (s1_id, cand_id) left join sg2 using (s1_id, cand_id) left join ra2 using (s1_id) left join rb2 using (cand_id)",
)
def feat_stage2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second design matrix of every S1: competition over all pairs, siblings, second normalisation, rarity."""
    p, frames = views.pairs(spark, sf_dir), views.frames(spark, sf_dir)
    crowd = competition(p).select("s1_id", "cand_id", "s2_other_s1_best", "s2_margin_vs_other_s1")
    own = views.framed_pairs(spark, sf_dir)
    made = norm2_features(own).join(crowd, ["s1_id", "cand_id"], "left")
    made = made.join(sibling_features(own.select("s1_id", "cand_id", "prob"), frames, views.vectors(spark, sf_dir)), ["s1_id", "cand_id"], "left")
    rare = rarity(frames)
    for key, p_ in (("s1_id", "s1"), ("cand_id", "c")):
        made = made.join(rare.select(F.col("entity_id").alias(key), *(F.col(c).alias(c.replace("rar_", f"rar_{p_}_")) for c in rare.columns[1:])), key, "left")
    cols = ["prob", "s2_other_s1_best", "s2_margin_vs_other_s1", *SIBLING, "sib_n_anchors", "name2_ratio", "name2_tset", "name2_tsort", "addr2_tset", "addr2_tsort", *(c for c in made.columns if c.startswith("rar_"))]
    return made.select("s1_id", "cand_id", *_R6(cols))


#: Added before rounding: adjusted scores have seven decimals, so their sums lie on ties.
_TIE = 1e-9


@query(
    "feat_stage3",
    f"with {P}, {NF}, {VEC}, {_prob_sql('p', '0')}, s as (select s1_id, cand_id, greatest(0.0, least(1.0, s2_prob + 0.1::double * s2_margin_vs_other_s1)) as prob from pg0), {_prob_sql('s', '3')}, {_sibling_sql('s', '3')} "
    f"select s1_id, cand_id, {', '.join(f'round({c}::double + {_TIE}, 6) as t3_{c}' for c in [*PROB, *SIBLING] if 'other_s1' not in c)}, coalesce(sib_n_anchors, 0)::double as t3_sib_n_anchors from pg3 left join sg3 using (s1_id, cand_id)",
)
def feat_stage3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster features again from a second stage's scores (here the margin-adjusted first ones), competition left out, prefixed."""
    second = competition(views.pairs(spark, sf_dir)).select("s1_id", "cand_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob") + 0.1 * F.col("s2_margin_vs_other_s1"))).alias("prob"))
    made = cluster_features(second, views.frames(spark, sf_dir), views.vectors(spark, sf_dir))
    kept = [c for c in [*PROB, *SIBLING, "sib_n_anchors"] if "other_s1" not in c]
    return made.select("s1_id", "cand_id", *(F.round(F.col(c).cast("double") + _TIE, 6).alias(f"t3_{c}") for c in kept))


# side tables of scores --------------------------------------------------------------------------------------------------

CE = "ce as (select s1_id, cand_id, min(prob) as ce_score from scored_pairs where s1_id is not null and cand_id is not null and not isnan(prob) group by 1, 2 having min(prob) > 0.02)"


def side_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scorer's table, missing for part of the pairs: here the least score that a pair ever had, above 0.02."""
    from linkloom.runtime import table

    return table(spark, sf_dir, "scored_pairs").where("s1_id is not null and cand_id is not null and not isnan(prob)").groupBy("s1_id", "cand_id").agg(F.min("prob").alias("ce_score")).where("ce_score > 0.02")


CE2 = "ce2 as (select s1_id, cand_id, max(prob) as ce_score from scored_pairs where s1_id is not null and cand_id like 'S3%' and not isnan(prob) group by 1, 2 having max(prob) < 0.9)"


def later_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third scorer's table, of records of S3 alone: the greatest score that a pair ever had, below 0.9."""
    from linkloom.runtime import table

    return table(spark, sf_dir, "scored_pairs").where("s1_id is not null and startswith(cand_id, 'S3') and not isnan(prob)").groupBy("s1_id", "cand_id").agg(F.max("prob").alias("ce_score")).where("ce_score < 0.9")


def with_scores(pairs: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Score tables attached by key as ``ce_score``, ``ce_score_2``, …; a pair that a table lacks has null."""
    for k, t in enumerate(tables, 1):
        pairs = pairs.join(t.select("s1_id", "cand_id", F.col("ce_score").alias("ce_score" if k == 1 else f"ce_score_{k}")), ["s1_id", "cand_id"], "left")
    return pairs


query("feat_scores", f"with {P}, {CE}, {CE2} select p.s1_id, p.cand_id, p.prob, ce.ce_score, ce2.ce_score as ce_score_2 from p left join ce using (s1_id, cand_id) left join ce2 using (s1_id, cand_id)")(lambda spark, d: with_scores(views.pairs(spark, d), [side_scores(spark, d), later_scores(spark, d)]))
query("feat_llm_map", f"with {P}, {CE} select p.s1_id, p.cand_id, case when ce_score > 0.05 and ce_score < 0.95 then ce_score end as llm_score from p left join ce using (s1_id, cand_id)")(
    lambda spark, d: with_scores(views.pairs(spark, d), [side_scores(spark, d)]).select("s1_id", "cand_id", F.when((F.col("ce_score") > 0.05) & (F.col("ce_score") < 0.95), F.col("ce_score")).alias("llm_score"))
)


def merged_out_of_sample(scores: DataFrame) -> DataFrame:
    """One score per pair that no model saw in training: folds 1 and 2 have model B's, 3 and 4 model A's, fold 0 and unknown folds the mean. A missing score raises."""
    picked = F.when(F.col("fold").isin(1, 2), F.col("b")).when(F.col("fold").isin(3, 4), F.col("a")).otherwise((F.col("a") + F.col("b")) / 2)
    return scores.withColumn("merged", F.when(picked.isNull(), F.raise_error(F.lit("a pair has no out-of-sample score")).cast("double")).otherwise(picked))


@query("feat_merge_oos", f"with {P}, {FOLD} select p.s1_id, p.cand_id, round(case when fold in (1, 2) then prob * prob when fold in (3, 4) then prob else (prob + prob * prob) / 2 end, 9) as merged from p left join fold using (s1_id)")
def feat_merge_oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pairs(spark, sf_dir).join(views.folds(spark, sf_dir).select("s1_id", "fold"), "s1_id", "left").withColumns({"a": F.col("prob"), "b": F.col("prob") * F.col("prob")})
    return merged_out_of_sample(p).select("s1_id", "cand_id", F.round("merged", 9).alias("merged"))


def prune(pairs: DataFrame, eps: float, ce: DataFrame | None = None, ce_eps: float = 0.0, new_country: DataFrame | None = None, new_ce: float = 0.0, most_missing: float | None = 0.001) -> DataFrame:
    """The candidate filter: likely by the first score, or by the second, or, for S1s of new countries, by a bar of their own.

    ``eps`` of 0 or less keeps everything. A missing second score counts as 0; more than ``most_missing`` of them raise.
    """
    if eps <= 0:
        return pairs
    keep = F.col("prob") >= eps
    made = pairs
    if ce is not None:
        made = with_scores(made, [ce])
        if most_missing is not None:
            share = made.agg(F.avg(F.col("ce_score").isNull().cast("int"))).first()[0] or 0.0
            if share > most_missing:
                raise ValueError(f"no second score for {share:.2%} of the pairs")
        keep |= F.coalesce("ce_score", F.lit(0.0)) >= ce_eps
        if new_country is not None:
            made = made.join(new_country.select("s1_id", "unseen"), "s1_id", "left")
            keep |= F.coalesce("unseen", F.lit(False)) & (F.coalesce("ce_score", F.lit(0.0)) >= new_ce)
    return made.where(keep).select(*pairs.columns)


@query("prune_rows", f"with {P}, {CE} select p.s1_id, p.cand_id, p.prob from p left join ce using (s1_id, cand_id) where prob >= 0.3 or coalesce(ce_score, 0) >= 0.2")
def prune_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune(views.pairs(spark, sf_dir), 0.3, side_scores(spark, sf_dir), 0.2, unseen(spark, sf_dir), 0.2, most_missing=None)


# contested records ------------------------------------------------------------------------------------------------------

SLOTS = 6


@query("competitors", f"with {P}, b as (select *, row_number() over (partition by cand_id order by prob desc, s1_id) as place from p qualify place <= 4), o as (select p.s1_id, p.cand_id, b.s1_id as rival, row_number() over (partition by p.s1_id, p.cand_id order by b.place) as k from p join b on b.cand_id = p.cand_id and b.s1_id <> p.s1_id qualify k <= 3), g as (select s1_id, cand_id, string_agg(rival, ',' order by k) as rivals from o group by 1, 2) select p.s1_id, p.cand_id, coalesce(rivals, '') as rivals from p left join g using (s1_id, cand_id)")
def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair's rivals: its record's three best other S1s."""
    p = views.pairs(spark, sf_dir)
    best = windows.first_rows(p, ["cand_id"], [F.desc("prob"), F.asc("s1_id")], 4).groupBy("cand_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("s1_id").alias("rival")))).alias("best"))
    rivals = F.slice(F.filter(F.transform("best", lambda x: x["rival"]), lambda r: r != F.col("s1_id")), 1, 3)
    return p.join(best, "cand_id").select("s1_id", "cand_id", F.array_join(rivals, ",").alias("rivals"))


def contested(pairs: DataFrame, slots: int = SLOTS, least: float = 0.01, contest: float = 0.05) -> DataFrame:
    """``cand_id, s1_ids, probs``: records whose second S1 is likely enough, with their best S1s; lists are cut before they are gathered."""
    top = windows.first_rows(pairs.where(F.col("prob") >= least), ["cand_id"], [F.desc("prob"), F.asc("s1_id")], slots)
    lists = top.groupBy("cand_id").agg(F.array_sort(F.collect_list(F.struct("place", "s1_id", "prob"))).alias("x"))
    return lists.where((F.size("x") > 1) & (F.col("x")[1]["prob"] >= contest)).select("cand_id", F.col("x.s1_id").alias("s1_ids"), F.col("x.prob").alias("probs"))


GROUPED = f"t as (select *, row_number() over (partition by cand_id order by prob desc, s1_id) as place from p where prob >= 0.01 qualify place <= {SLOTS}), g as (select cand_id, list(s1_id order by place) as s1_ids, list(prob order by place) as probs from t group by cand_id having count(*) > 1 and max(case when place = 2 then prob end) >= 0.05)"
OWNER = "owner as (select cand_id, min(s1_id) as owner from truth group by cand_id)"


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.truth(spark, sf_dir).groupBy("cand_id").agg(F.min("s1_id").alias("owner"))


def slot_of(groups: DataFrame, owner: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The true owner's place in the list from 0; ``slots`` if it isn't there or there is none."""
    at = F.array_position("s1_ids", F.col("owner"))
    return groups.join(owner, "cand_id", "left").withColumn("label", F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(slots).cast("bigint"))


query("owner_groups", f"with {P}, {GROUPED} select cand_id, array_to_string(s1_ids, ',') as s1_ids, len(probs)::bigint as n from g")(lambda spark, d: contested(views.pairs(spark, d)).select("cand_id", F.array_join("s1_ids", ",").alias("s1_ids"), F.size("probs").cast("bigint").alias("n")))
query("owner_label", f"with {P}, {TRUTH}, {GROUPED}, {OWNER} select g.cand_id, case when coalesce(list_position(s1_ids, owner), 0) > 0 then list_position(s1_ids, owner) - 1 else {SLOTS} end::bigint as label from g left join owner using (cand_id)")(lambda spark, d: slot_of(contested(views.pairs(spark, d)), owners(spark, d)).select("cand_id", "label"))


@query("owner_exclude", f"with {P}, {TRUTH}, {FOLD}, {GROUPED}, {OWNER}, z as (select s1_id from fold where fold = 0) select g.cand_id from g left join owner using (cand_id) where cand_id not in (select cand_id from (select cand_id, unnest(s1_ids) as s from g) where s in (select s1_id from z)) and (owner is null or owner not in (select s1_id from z))")
def owner_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training groups without those that hold, or are owned by, an S1 of fold 0."""
    groups = slot_of(contested(views.pairs(spark, sf_dir)), owners(spark, sf_dir))
    zero = views.folds(spark, sf_dir).where("fold = 0").select("s1_id")
    touched = groups.select("cand_id", F.explode(F.array_distinct(F.concat("s1_ids", F.when(F.col("owner").isNotNull(), F.array("owner")).otherwise(F.array().cast("array<string>"))))).alias("s1_id")).join(zero, "s1_id", "left_semi")
    return groups.join(touched, "cand_id", "left_anti").select("cand_id")


def owner_features(groups: DataFrame) -> DataFrame:
    """Per slot: the normalised score as the owner's probability, the rest as nobody's, the margin over the best other slot, the list's length."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    scale = F.greatest(total, F.lit(1.0))
    out = groups.select("cand_id", "s1_ids", "probs", scale.alias("scale"), total.alias("total"), F.posexplode("s1_ids").alias("slot", "s1_id"))
    p = F.col("probs")[F.col("slot")] / F.col("scale")
    best = F.aggregate(F.filter(F.transform("probs", lambda x, i: F.when(i == F.col("slot"), F.lit(0.0)).otherwise(x)), lambda x: x > 0), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return out.select("s1_id", "cand_id", p.alias("own_p"), F.greatest(F.lit(0.0), 1 - F.col("total")).alias("own_none"), (p - best / F.col("scale")).alias("own_margin"), F.size("s1_ids").cast("bigint").alias("own_n"))


@query(
    "owner_features",
    f"with {P}, {GROUPED}, e as (select cand_id, unnest(s1_ids) as s1_id, unnest(probs) as prob, list_sum(probs) as total, len(probs) as n from g), m as (select *, max(prob) over (partition by cand_id) as first, count(*) filter (where true) over (partition by cand_id) as c, nth_value(prob, 2) over (partition by cand_id order by prob desc, s1_id rows between unbounded preceding and unbounded following) as second, row_number() over (partition by cand_id order by prob desc, s1_id) as rn from e) "
    "select s1_id, cand_id, round(prob / greatest(total, 1), 6) as own_p, round(greatest(0, 1 - total), 6) as own_none, round((prob - case when rn = 1 then second else first end) / greatest(total, 1) + 1e-9, 6) as own_margin, n::bigint as own_n from m",
)
def owner_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = owner_features(contested(views.pairs(spark, sf_dir)))
    return made.select("s1_id", "cand_id", *(F.round(c, 6).alias(c) for c in ("own_p", "own_none")), F.round(F.col("own_margin") + 1e-9, 6).alias("own_margin"), "own_n")


@query("final_frame", f"with {P}, {LAB} select prob as s1_prob, y from p join lab using (s1_id, cand_id)")
def final_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is fitted on: ids dropped, the first stage's score under its own name."""
    return views.pairs(spark, sf_dir).join(views.labels(spark, sf_dir), ["s1_id", "cand_id"]).withColumnRenamed("prob", "s1_prob").drop("s1_id", "cand_id")
