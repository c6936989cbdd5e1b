"""Queries of joins, aggregations, windows, sorts, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from linkloom.functions import similarity as sim, text
from linkloom.operators import sampling, windows
from linkloom.plans import views
from linkloom.plans.q_text import with_cosines
from linkloom.plans.registry import query
from linkloom.plans.views import FOLD, LAB, NF, P, PF, REC, TRUTH, VEC, cosine_sql, tokens_sql
from linkloom.runtime import small, table



def _source():
    return F.substring("cand_id", 1, 2)


def _desc():
    return [F.desc("prob"), F.asc("cand_id")]


# joins ---------------------------------------------------------------------------------------------------------------


def anchors(pairs: DataFrame, n: int = 3, least: float = 0.5) -> DataFrame:
    """Up to ``n`` best candidates of each S1 that are at least ``least`` likely: ``s1_id, anchor, anchor_prob``."""
    return windows.first_rows(pairs, ["s1_id"], _desc(), n).where(F.col("prob") >= least).select("s1_id", F.col("cand_id").alias("anchor"), F.col("prob").alias("anchor_prob"))


def siblings(pairs: DataFrame) -> DataFrame:
    """Every pair beside its S1's anchors other than itself. An S1 has at most three anchors, so a hot S1 grows by three, not by its square."""
    return pairs.join(anchors(pairs), "s1_id").where("cand_id <> anchor")


ANCHORS = "anchors as (select s1_id, cand_id as anchor, prob as anchor_prob from (select *, row_number() over (partition by s1_id order by prob desc, cand_id) as place from p) where place <= 3 and prob >= 0.5)"
SIB = f"{ANCHORS}, sib as (select p.s1_id, p.cand_id, anchor, anchor_prob from p join anchors using (s1_id) where cand_id <> anchor)"


@query("join_inner_anchor", f"with {P}, {SIB} select s1_id, cand_id, anchor, anchor_prob from sib")
def join_inner_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return siblings(views.pairs(spark, sf_dir)).select("s1_id", "cand_id", "anchor", "anchor_prob")


@query("join_inner_keys", f"with {P}, {LAB} select s1_id, cand_id, prob, y from p join lab using (s1_id, cand_id)")
def join_inner_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).join(views.labels(spark, sf_dir), ["s1_id", "cand_id"])


@query("join_left_keys", f"with {P}, {LAB} select s1_id, cand_id, prob, y from p left join lab using (s1_id, cand_id)")
def join_left_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).join(views.labels(spark, sf_dir), ["s1_id", "cand_id"], "left")


@query("join_left_sample", f"with {P}, {FOLD}, best as (select s1_id, max(prob) as best from p group by s1_id) select s1_id, best from fold left join best using (s1_id)")
def join_left_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = views.pairs(spark, sf_dir).groupBy("s1_id").agg(F.max("prob").alias("best"))
    return views.folds(spark, sf_dir).select("s1_id").join(best, "s1_id", "left")


@query("join_lookup", f"with {P}, {REC} select p.s1_id, p.cand_id, a.country as s1_country, b.country as cand_country from p left join rec a on a.entity_id = p.s1_id left join rec b on b.entity_id = p.cand_id")
def join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of both sides by key; a missing key gives null."""
    rec = views.records(spark, sf_dir)
    a, b = (rec.select(F.col("entity_id").alias(k), F.col("country").alias(c)) for k, c in (("s1_id", "s1_country"), ("cand_id", "cand_country")))
    return views.pairs(spark, sf_dir).join(a, "s1_id", "left").join(b, "cand_id", "left").select("s1_id", "cand_id", "s1_country", "cand_country")


@query("join_semi", f"with {P}, {FOLD} select s1_id, cand_id from p where s1_id in (select s1_id from fold where dev)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).join(views.folds(spark, sf_dir).where("dev"), "s1_id", "left_semi").select("s1_id", "cand_id")


@query("join_anti", f"with {P}, {TRUTH} select s1_id, cand_id from p where cand_id not in (select cand_id from truth)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).join(views.truth(spark, sf_dir), "cand_id", "left_anti").select("s1_id", "cand_id")


@query(
    "join_cross_block",
    f"with {REC}, n as (select country, count(*) filter (where source = 'S1') as queries, count(*) filter (where source <> 'S1') as pool from rec where country <> '' group by country) select country, queries::bigint as queries, pool::bigint as pool, (queries * pool)::bigint as comparisons from n where queries > 0 and pool > 0",
)
def join_cross_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the blocks that a same-country comparison has, from counts; the pairs themselves are never made (blk_* compare in blocks)."""
    n = views.records(spark, sf_dir).where("country <> ''").groupBy("country").agg(F.count(F.when(F.col("source") == "S1", 1)).alias("queries"), F.count(F.when(F.col("source") != "S1", 1)).alias("pool"))
    return n.where("queries > 0 and pool > 0").withColumn("comparisons", F.col("queries") * F.col("pool"))


@query("join_label", f"with {P}, {TRUTH} select p.s1_id, p.cand_id, truth.s1_id is not null as y from p left join truth on truth.s1_id = p.s1_id and truth.cand_id = p.cand_id")
def join_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.truth(spark, sf_dir).withColumn("_y", F.lit(True))
    return views.pairs(spark, sf_dir).join(known, ["s1_id", "cand_id"], "left").select("s1_id", "cand_id", F.coalesce("_y", F.lit(False)).alias("y"))


@query("join_index_merge", f"with {LAB}, s as (select s1_id, cand_id, max(prob) as prob from scored_pairs where not isnan(prob) and s1_id is not null and cand_id is not null group by s1_id, cand_id) select s1_id, cand_id, y, prob from lab left join s using (s1_id, cand_id)")
def join_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed attachment of a side table with repeats, which are reduced first."""
    side = table(spark, sf_dir, "scored_pairs").where("not isnan(prob) and s1_id is not null and cand_id is not null").groupBy("s1_id", "cand_id").agg(F.max("prob").alias("prob"))
    return views.labels(spark, sf_dir).join(side, ["s1_id", "cand_id"], "left")


@query("join_zip", f"with {NF}, {REC} select nf.entity_id, nf.name_core, rec.source, rec.business_name from nf join rec using (entity_id)")
def join_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two tables side by side, by key: Spark has no row positions."""
    return views.frames(spark, sf_dir).select("entity_id", "name_core").join(views.records(spark, sf_dir).select("entity_id", "source", "business_name"), "entity_id")


@query("join_aligned_check", f"with {P}, {LAB}, a as (select distinct s1_id from lab), b as (select distinct s1_id from p) select (select count(*) from (select * from a except select * from b))::bigint as only_left, (select count(*) from (select * from b except select * from a))::bigint as only_right")
def join_aligned_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that either of two tables has alone; both counts are 0 for aligned tables."""
    a, b = (df.select("s1_id").distinct() for df in (views.labels(spark, sf_dir), views.pairs(spark, sf_dir)))
    sides = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), "s1_id", "full")
    return sides.agg(F.count(F.when(F.col("_r").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("_l").isNull(), 1)).alias("only_right"))


# aggregations ---------------------------------------------------------------------------------------------------------


def view_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in long form: ``s1_id, cand_id, view, rank`` from 0 by cosine within each S1 and source; pairs without vectors are left out."""
    made = with_cosines(views.pairs(spark, sf_dir), views.vectors(spark, sf_dir), ["name", "both"])
    long = made.select("s1_id", "cand_id", _source().alias("source"), F.explode(F.create_map(F.lit("name"), "cos_name", F.lit("both"), "cos_both")).alias("view", "score")).where("score is not null").withColumn("score", F.round("score", 9))
    return windows.with_rank(long, ["s1_id", "source", "view"], "score", "rank").select("s1_id", "cand_id", "view", (F.col("rank") - 1).alias("rank"))


RANKS = f"{P}, {VEC}, sc as (select s1_id, cand_id, a.view_name as view, round({cosine_sql('a.vec', 'b.vec')}, 9) as score from p join vec a on a.entity_id = s1_id join vec b on b.entity_id = cand_id and b.view_name = a.view_name), ranks as (select s1_id, cand_id, view, rank() over (partition by s1_id, substr(cand_id, 1, 2), view order by score desc) - 1 as rank from sc)"


@query("agg_min_rank", f"with {RANKS} select s1_id, cand_id, min(rank)::bigint as best_rank from ranks group by s1_id, cand_id")
def agg_min_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_ranks(spark, sf_dir).groupBy("s1_id", "cand_id").agg(F.min("rank").alias("best_rank"))


@query("agg_pivot", f"with {RANKS} select s1_id, cand_id, coalesce(min(rank) filter (where view = 'name'), 1000)::bigint as rank_name, coalesce(min(rank) filter (where view = 'both'), 1000)::bigint as rank_both from ranks group by s1_id, cand_id")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair, a rank per view; 1000 where a view lacks the pair."""
    wide = view_ranks(spark, sf_dir).groupBy("s1_id", "cand_id").pivot("view", ["name", "both"]).agg(F.min("rank"))
    return wide.select("s1_id", "cand_id", F.coalesce("name", F.lit(1000)).cast("bigint").alias("rank_name"), F.coalesce("both", F.lit(1000)).cast("bigint").alias("rank_both"))


@query("agg_crosstab", f"with {REC}, {TRUTH} select a.country as s1_country, count(*) filter (where b.source = 'S2')::bigint as s2, count(*) filter (where b.source = 'S3')::bigint as s3, count(*) filter (where a.country <> b.country)::bigint as abroad from truth join rec a on a.entity_id = s1_id join rec b on b.entity_id = cand_id group by 1")
def agg_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = views.records(spark, sf_dir)
    a = rec.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("s1_country"))
    b = rec.select(F.col("entity_id").alias("cand_id"), "source", "country")
    both = views.truth(spark, sf_dir).join(a, "s1_id").join(b, "cand_id")
    return both.groupBy("s1_country").agg(F.count(F.when(F.col("source") == "S2", 1)).alias("s2"), F.count(F.when(F.col("source") == "S3", 1)).alias("s3"), F.count(F.when(F.col("country") != F.col("s1_country"), 1)).alias("abroad"))


@query("agg_value_counts", f"with {REC} select country, count(*)::bigint as n, round(count(*) / sum(count(*)) over (), 6) as share from rec group by country")
def agg_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.records(spark, sf_dir).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("country", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("agg_collect", f"with {P}, b as (select *, row_number() over (partition by cand_id order by prob desc, s1_id) as place from p) select cand_id, string_agg(s1_id, ',' order by place) as s1_ids, count(*)::bigint as n from b where place <= 6 group by cand_id")
def agg_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered list of a record's six best S1s."""
    best = windows.first_rows(views.pairs(spark, sf_dir), ["cand_id"], [F.desc("prob"), F.asc("s1_id")], 6)
    lists = best.groupBy("cand_id").agg(F.array_sort(F.collect_list(F.struct("place", "s1_id"))).alias("x"))
    return lists.select("cand_id", F.array_join(F.transform("x", lambda v: v["s1_id"]), ",").alias("s1_ids"), F.size("x").cast("bigint").alias("n"))


@query("agg_set_per_s1", f"with {P}, b as (select * from p qualify row_number() over (partition by cand_id order by prob desc, s1_id) = 1) select s1_id, string_agg(cand_id, ',' order by cand_id) as ids from b where prob >= 0.5 group by s1_id")
def agg_set_per_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = windows.first_rows(views.pairs(spark, sf_dir), ["cand_id"], [F.desc("prob"), F.asc("s1_id")], 1).where("prob >= 0.5")
    return kept.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("ids"))


def sibling_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs beside anchors with the overlap of their names' words."""
    names = views.frames(spark, sf_dir).select("entity_id", F.array_distinct(text.tokens(F.col("name_core"))).alias("w"))
    sib = siblings(views.pairs(spark, sf_dir))
    sib = sib.join(names.select(F.col("entity_id").alias("cand_id"), F.col("w").alias("a")), "cand_id").join(names.select(F.col("entity_id").alias("anchor"), F.col("w").alias("b")), "anchor")
    return sib.select("s1_id", "cand_id", "anchor_prob", sim.jaccard(F.col("a"), F.col("b")).alias("v"))


_W = f"w as (select entity_id, list_distinct({tokens_sql('name_core')}) as w from nf)"
SIBV = f"{P}, {NF}, {SIB}, {_W}, sv as (select s1_id, cand_id, anchor_prob, len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) as v from sib join w a on a.entity_id = cand_id join w b on b.entity_id = anchor)"


@query("agg_sib_max", f"with {SIBV} select s1_id, cand_id, round(max(v), 6) as sib_max from sv group by s1_id, cand_id")
def agg_sib_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sibling_scores(spark, sf_dir).groupBy("s1_id", "cand_id").agg(F.round(F.max("v"), 6).alias("sib_max"))


@query("agg_sib_wmean", f"with {SIBV} select s1_id, cand_id, round(sum(v * anchor_prob) / sum(anchor_prob), 6) as sib_wmean from sv group by s1_id, cand_id")
def agg_sib_wmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sibling_scores(spark, sf_dir).groupBy("s1_id", "cand_id").agg(F.round(F.try_divide(F.sum(F.col("v") * F.col("anchor_prob")), F.sum("anchor_prob")), 6).alias("sib_wmean"))


@query("agg_sib_count", f"with {P}, {SIB}, n as (select s1_id, cand_id, count(*) as n from sib group by s1_id, cand_id) select p.s1_id, p.cand_id, coalesce(n.n, 0)::bigint as sib_n_anchors from p left join n using (s1_id, cand_id)")
def agg_sib_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pairs(spark, sf_dir)
    n = siblings(p).groupBy("s1_id", "cand_id").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, ["s1_id", "cand_id"], "left").select("s1_id", "cand_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("sib_n_anchors"))


@query("agg_min_df", f"with {NF}, t as (select entity_id, country, unnest({tokens_sql('name_core')}) as token from nf), df as (select country, token, count(*) as df from t group by 1, 2) select entity_id, min(df)::bigint as min_df from t join df using (country, token) group by entity_id")
def agg_min_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a name's rarest word occurs in its country; a frequent word's rows are counted before they are shuffled."""
    words = views.frames(spark, sf_dir).select("entity_id", "country", F.explode(text.tokens(F.col("name_core"))).alias("token"))
    df = words.groupBy("country", "token").agg(F.count(F.lit(1)).alias("df"))
    return words.join(df, ["country", "token"]).groupBy("entity_id").agg(F.min("df").alias("min_df"))


@query("agg_quantile", f"with {P}, {REC} select country, " + ", ".join(f"round(quantile_cont(prob, {q / 100}) + 1e-9, 6) as p{q}" for q in (10, 25, 50, 90, 99)) + " from p join rec on rec.entity_id = p.s1_id group by country")
def agg_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles with interpolation; scores have at most six decimals, so a group's buffer holds at most a million counts."""
    rec = views.records(spark, sf_dir).select(F.col("entity_id").alias("s1_id"), "country")
    cut = views.pairs(spark, sf_dir).join(rec, "s1_id").groupBy("country").agg(F.percentile("prob", F.array(*(F.lit(q / 100) for q in (10, 25, 50, 90, 99)))).alias("q"))
    return cut.select("country", *(F.round(F.col("q")[i] + 1e-9, 6).alias(f"p{q}") for i, q in enumerate((10, 25, 50, 90, 99))))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``value`` and its rank, the mean of equal values' places, from counts per distinct value over range partitions."""
    counted = windows.running(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), [], [F.asc(value)], _upto=(F.sum, F.col("_n")))
    return counted.select(value, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))


@query("agg_spearman", f"with {PF}, r as (select rank() over (order by prob) + (count(*) over (partition by prob) - 1) / 2 as a, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2 as b from (select prob, length(r_name_core) as n from pf)) select round(corr(a, b), 6) as spearman from r")
def agg_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of a pair's score with the length of the record's name."""
    both = views.framed_pairs(spark, sf_dir).select("prob", F.length("r_name_core").alias("n"))
    ranked = both.join(average_ranks(both, "prob", "a"), "prob").join(small(average_ranks(both, "n", "b")), "n")
    return ranked.agg(F.round(F.corr("a", "b"), 6).alias("spearman"))


@query("agg_mean_share", f"with {PF} select l_country as country, round(avg((r_addr_norm = '')::int), 6) as empty_address, round(avg(prob) + 1e-9, 6) as mean_prob, round(avg(prob) filter (where r_addr_norm <> '') + 1e-9, 6) as mean_prob_addressed from pf group by 1")
def agg_mean_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.col("r_addr_norm") == ""
    return views.framed_pairs(spark, sf_dir).groupBy(F.col("l_country").alias("country")).agg(F.round(F.avg(empty.cast("int")), 6).alias("empty_address"), F.round(F.avg("prob") + 1e-9, 6).alias("mean_prob"), F.round(F.avg(F.when(~empty, F.col("prob"))) + 1e-9, 6).alias("mean_prob_addressed"))


@query("agg_nunique_dup", "select source_tag, count(*)::bigint as n, count(distinct entity_id)::bigint as n_ids, (count(entity_id) - count(distinct entity_id))::bigint as n_dup from source_records group by source_tag")
def agg_nunique_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_records").groupBy("source_tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("n_ids"), (F.count("entity_id") - F.countDistinct("entity_id")).alias("n_dup"))


@query("agg_group_mean", f"with {P} select s1_id, round(avg(prob) + 1e-9, 6) as mean_prob, count(*)::bigint as n from p group by s1_id")
def agg_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).groupBy("s1_id").agg(F.round(F.avg("prob") + 1e-9, 6).alias("mean_prob"), F.count(F.lit(1)).alias("n"))


@query("agg_fold_summary", f"with {FOLD} select fold, count(*)::bigint as n, round(avg((country = 'India')::int), 6) as india_share, count(*) filter (where dev)::bigint as n_dev from fold group by fold")
def agg_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.folds(spark, sf_dir).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("country") == "India").cast("int")), 6).alias("india_share"), F.count(F.when(F.col("dev"), 1)).alias("n_dev"))


# windows --------------------------------------------------------------------------------------------------------------


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).withColumn("source", _source())


@query("win_rank_s1", f"with {P} select s1_id, cand_id, rank() over (partition by s1_id, substr(cand_id, 1, 2) order by prob desc) as rank_s1 from p")
def win_rank_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_rank(_sourced(spark, sf_dir), ["s1_id", "source"], "prob", "rank_s1").select("s1_id", "cand_id", "rank_s1")


@query("win_gap_s1", f"with {P} select s1_id, cand_id, round(max(prob) over (partition by s1_id, substr(cand_id, 1, 2)) - prob, 6) as gap_s1 from p")
def win_gap_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_group(_sourced(spark, sf_dir), ["s1_id", "source"], _top=F.max("prob")).select("s1_id", "cand_id", F.round(F.col("_top") - F.col("prob"), 6).alias("gap_s1"))


@query("win_n_s1", f"with {P} select s1_id, cand_id, count(*) over (partition by s1_id, substr(cand_id, 1, 2)) as n_s1 from p")
def win_n_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_group(_sourced(spark, sf_dir), ["s1_id", "source"], n_s1=F.count(F.lit(1))).select("s1_id", "cand_id", "n_s1")


@query("win_rank_c", f"with {P} select s1_id, cand_id, rank() over (partition by cand_id order by prob desc) as rank_c, round(max(prob) over (partition by cand_id) - prob, 6) as gap_c, count(*) over (partition by cand_id) as n_c from p")
def win_rank_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.with_group(windows.with_rank(views.pairs(spark, sf_dir), ["cand_id"], "prob", "rank_c"), ["cand_id"], _top=F.max("prob"), n_c=F.count(F.lit(1)))
    return made.select("s1_id", "cand_id", "rank_c", F.round(F.col("_top") - F.col("prob"), 6).alias("gap_c"), "n_c")


@query("win_first_rank", f"with {P} select s1_id, cand_id, row_number() over (partition by s1_id order by prob desc, cand_id) as place from p")
def win_first_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered(views.pairs(spark, sf_dir), ["s1_id"], _desc(), "place").select("s1_id", "cand_id", "place")


@query("win_topk_mask", f"with {P} select s1_id, cand_id from p qualify row_number() over (partition by s1_id order by prob desc, cand_id) <= 15")
def win_topk_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_rows(views.pairs(spark, sf_dir), ["s1_id"], _desc(), 15).select("s1_id", "cand_id")


@query("win_conf_counts", f"with {P} select s1_id, cand_id, count(*) filter (where prob >= 0.5) over w as n_conf50, count(*) filter (where prob >= 0.9) over w as n_conf90, round(sum(prob) over w, 6) as sum_prob, round(max(prob) over w - prob, 6) as gap_to_max from p window w as (partition by s1_id)")
def win_conf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.with_group(views.pairs(spark, sf_dir), ["s1_id"], n_conf50=F.count(F.when(F.col("prob") >= 0.5, 1)), n_conf90=F.count(F.when(F.col("prob") >= 0.9, 1)), _sum=F.sum("prob"), _top=F.max("prob"))
    return made.select("s1_id", "cand_id", "n_conf50", "n_conf90", F.round("_sum", 6).alias("sum_prob"), F.round(F.col("_top") - F.col("prob"), 6).alias("gap_to_max"))


COMP = "comp as (select s1_id, cand_id, prob, case when rn = 1 then coalesce(second, 0) else first end as other from (select *, row_number() over w as rn, max(prob) over (partition by cand_id) as first, nth_value(prob, 2) over (partition by cand_id order by prob desc, s1_id rows between unbounded preceding and unbounded following) as second from p window w as (partition by cand_id order by prob desc, s1_id)))"


@query("win_competition", f"with {P}, {COMP} select s1_id, cand_id, round(other, 6) as other_s1_best, round(prob - other, 6) as margin from comp")
def win_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.best_other(views.pairs(spark, sf_dir), "cand_id", "s1_id", "prob", "s")
    return made.select("s1_id", "cand_id", F.round("s_other_best", 6).alias("other_s1_best"), F.round("s_margin", 6).alias("margin"))


@query("win_cumcount_k", f"with {P} select cand_id, s1_id, row_number() over (partition by cand_id order by prob desc, s1_id) as place from p qualify place <= 4")
def win_cumcount_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_rows(views.pairs(spark, sf_dir), ["cand_id"], [F.desc("prob"), F.asc("s1_id")], 4).select("cand_id", "s1_id", F.col("place").cast("bigint").alias("place"))


@query("win_nth", f"with {P} select cand_id, prob as second_prob from p qualify row_number() over (partition by cand_id order by prob desc, s1_id) = 2")
def win_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_rows(views.pairs(spark, sf_dir), ["cand_id"], [F.desc("prob"), F.asc("s1_id")], 2).where("place = 2").select("cand_id", F.col("prob").alias("second_prob"))


@query("win_assign", f"with {P} select s1_id, cand_id, prob from p qualify row_number() over (partition by cand_id order by prob desc, s1_id) = 1")
def win_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_rows(views.pairs(spark, sf_dir), ["cand_id"], [F.desc("prob"), F.asc("s1_id")], 1).select("s1_id", "cand_id", "prob")


@query("win_top1_s1", f"with {P} select s1_id, cand_id, prob from p qualify row_number() over (partition by s1_id order by prob desc, cand_id) = 1")
def win_top1_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_rows(views.pairs(spark, sf_dir), ["s1_id"], _desc(), 1).select("s1_id", "cand_id", "prob")


@query("win_size_feature", f"with {P} select s1_id, cand_id, count(*) over (partition by s1_id) as n_cands from p")
def win_size_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_group(views.pairs(spark, sf_dir), ["s1_id"], n_cands=F.count(F.lit(1))).select("s1_id", "cand_id", "n_cands")


@query("win_rank_global", "select o_orderkey, ntile(10) over (order by o_totalprice, o_orderkey) as bin from orders")
def win_rank_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tiles(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.asc("o_totalprice"), F.asc("o_orderkey")], 10, "bin").select("o_orderkey", "bin")


@query("win_time_chunks", "select o_orderkey, ntile(7) over (order by o_orderdate, o_orderkey) as chunk from orders")
def win_time_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tiles(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 7, "chunk").select("o_orderkey", "chunk")


# sorts, samples, sets, projections -----------------------------------------------------------------------------------


@query("ord_stable_desc", f"with {P} select s1_id, cand_id, prob from p order by prob desc, s1_id, cand_id")
def ord_stable_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).orderBy(F.desc("prob"), "s1_id", "cand_id")


@query("ord_length", f"with {REC} select entity_id, length(business_name || ' | ' || business_address)::bigint as n from rec order by n desc, entity_id")
def ord_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by descending length of text within partitions, as batches of a model want them; no shuffle."""
    return views.records(spark, sf_dir).select("entity_id", F.length(text.record_text(F.col("business_name"), F.col("business_address"))).cast("bigint").alias("n")).sortWithinPartitions(F.desc("n"), "entity_id")


H = "('0x' || substr(md5({}), 1, 15))::bigint"
_H11, _H5 = H.format("concat_ws('|', s1_id, cand_id, '11')"), H.format("concat_ws('|', s1_id, cand_id, '5')")
_H7, _HS = H.format("concat_ws('|', entity_id, '7')"), H.format("concat_ws('|', s1_id, '11')")


@query("ord_argpartition", f"with {P} select s1_id, cand_id from p order by {_H11}, s1_id, cand_id limit 500")
def ord_argpartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(views.pairs(spark, sf_dir), 500, 11, "s1_id", "cand_id").select("s1_id", "cand_id")


@query("smp_uniform", f"with {REC} select entity_id from rec where source = 'S1' order by {_H7}, entity_id limit 300")
def smp_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(views.records(spark, sf_dir).where("source = 'S1'").select("entity_id"), 300, 7, "entity_id")


_U = "((" + H.format("concat_ws('|', s1_id, cand_id, '{}')") + " + 1) / 1152921504606846976.0::double)"


@query("smp_weighted", f"with {P} select s1_id, cand_id from p order by ln({_U.format(3)}) / (prob + 0.05) desc, s1_id, cand_id limit 400")
def smp_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted(views.pairs(spark, sf_dir), 400, 3, F.col("prob") + 0.05, "s1_id", "cand_id").select("s1_id", "cand_id")


@query("smp_training_pairs")
def smp_training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.training_pairs(join_inner_keys(spark, sf_dir), 200, 0.4, 0).select("s1_id", "cand_id", "y")


@query("smp_hard_easy")
def smp_hard_easy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hard_and_easy(join_inner_keys(spark, sf_dir), 150, 0.05, 0.95, 0.3, 1).select("s1_id", "cand_id", "y")


_PSEUDO = f"{P}, {REC}, q as (select p.s1_id, p.cand_id, p.prob from p join rec on rec.entity_id = p.s1_id where rec.country in ('US', 'France'))"


@query("smp_pseudo", f"with {_PSEUDO} select * from (select s1_id, cand_id, true as y from q where prob >= 0.97 order by {_H5}, s1_id, cand_id limit 200) union all select * from (select s1_id, cand_id, false as y from q where prob <= 0.03 order by ln({_U.format(5)}) / (prob + 0.05) desc, s1_id, cand_id limit 400)")
def smp_pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident pairs of chosen countries as labels: the likeliest by draw, and unlikely ones with the harder favoured."""
    rec = views.records(spark, sf_dir).where(F.col("country").isin("US", "France")).select(F.col("entity_id").alias("s1_id"))
    q = views.pairs(spark, sf_dir).join(rec, "s1_id", "left_semi")
    yes = sampling.uniform(q.where("prob >= 0.97"), 200, 5, "s1_id", "cand_id").withColumn("y", F.lit(True))
    no = sampling.weighted(q.where("prob <= 0.03"), 400, 5, F.col("prob") + 0.05, "s1_id", "cand_id").withColumn("y", F.lit(False))
    return yes.unionByName(no).select("s1_id", "cand_id", "y")


_KEEP = f"{P}, {FOLD}, keep as (select s1_id from (select distinct s1_id from p) left join (select s1_id, dev from fold where dev) using (s1_id) where dev or (({_HS} + 1) / 1152921504606846976.0::double) <= 0.8)"


@query("smp_density", f"with {_KEEP} select p.s1_id, p.cand_id from p join keep using (s1_id)")
def smp_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The competitors' population thinned: development S1s stay, four fifths of the others."""
    return sampling.thinned(views.pairs(spark, sf_dir), "s1_id", views.folds(spark, sf_dir).where("dev"), 0.8, 11).select("s1_id", "cand_id")


@query("set_union", f"with {P}, {TRUTH} select s1_id, cand_id from p union all select s1_id, cand_id from truth")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).select("s1_id", "cand_id").unionByName(views.truth(spark, sf_dir))


for _op, _make in (("intersect", DataFrame.intersect), ("except", DataFrame.subtract), ("union", lambda a, b: a.unionByName(b).distinct())):
    query(f"set_{'distinct_union' if _op == 'union' else 'diff' if _op == 'except' else _op}", f"with {P}, {TRUTH} select s1_id, cand_id from truth {_op} select s1_id, cand_id from p where prob >= 0.5")(
        lambda spark, d, make=_make: make(views.truth(spark, d), views.pairs(spark, d).where("prob >= 0.5").select("s1_id", "cand_id"))
    )


@query("set_dedup", "select entity_id, max(loaded_at) as loaded_at, count(*)::bigint as n from source_records where entity_id is not null group by entity_id")
def set_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity, the latest delivery, with the number of deliveries."""
    return table(spark, sf_dir, "source_records").where("entity_id is not null").groupBy("entity_id").agg(F.max("loaded_at").alias("loaded_at"), F.count(F.lit(1)).alias("n"))


_DECIDED = "d{n} as (select s1_id, string_agg(cand_id, ',' order by cand_id) as ids from (select * from p qualify row_number() over (partition by cand_id order by prob desc, s1_id) = 1) where prob >= {t} group by s1_id)"


@query("set_symdiff_sets", f"with {P}, {_DECIDED.format(n=1, t=0.5)}, {_DECIDED.format(n=2, t=0.8)} select coalesce(d1.s1_id, d2.s1_id) as s1_id, coalesce(d1.ids, '') as before, coalesce(d2.ids, '') as after from d1 full join d2 on d1.s1_id = d2.s1_id where d1.ids is distinct from d2.ids")
def set_symdiff_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1s whose decided set differs between two thresholds."""
    owned = windows.first_rows(views.pairs(spark, sf_dir), ["cand_id"], [F.desc("prob"), F.asc("s1_id")], 1)
    decided = lambda t, c: owned.where(F.col("prob") >= t).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(c))
    both = decided(0.5, "before").join(decided(0.8, "after"), "s1_id", "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("s1_id", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


@query("prj_band", f"with {P} select s1_id, cand_id, prob from p where prob > 0.05 and prob < 0.95")
def prj_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).where("prob > 0.05 and prob < 0.95")


@query("prj_clip", f"with {P} select s1_id, cand_id, greatest(0.1, least(0.9, prob)) as clipped, case when prob >= 0.9 then 'sure' when prob >= 0.5 then 'likely' else 'unlikely' end as class from p")
def prj_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("prob") >= 0.9, "sure").when(F.col("prob") >= 0.5, "likely").otherwise("unlikely")
    return views.pairs(spark, sf_dir).select("s1_id", "cand_id", F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.col("prob"))).alias("clipped"), kind.alias("class"))


@query("prj_explode", f"with {NF} select entity_id, unnest({tokens_sql('name_core')}) as token from nf")
def prj_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).select("entity_id", F.explode(text.tokens(F.col("name_core"))).alias("token"))


@query("prj_rename", f"with {P} select s1_id, cand_id, prob as t3_prob from p")
def prj_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.pairs(spark, sf_dir).withColumn("comp_prob", F.col("prob"))
    kept = df.drop(*(c for c in df.columns if c.startswith("comp_")))
    return kept.withColumnsRenamed({c: f"t3_{c}" for c in kept.columns if not c.endswith("_id")})
