"""Queries of blocking and retrieval. Queries are the S1 records, or vectors, whose number is divisible by 50; the pool is everything."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF, IDF, NGram, Normalizer, PCA, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.operators import retrieval
from linkloom.plans import views
from linkloom.plans.registry import query
from linkloom.plans.views import REC, TRUTH, VEC, cosine_sql
from linkloom.runtime import materialise, table

EVERY = 50
K = 10
KS = (1, 2, 3, 5, 10)
#: Ranks of the recall curve.
CURVE = (1, 2, 3, 5, 10, 20, 30, 50)


def unit(v: str):
    """The array scaled to length 1, in double precision."""
    norm = F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(F.col(v), lambda x: x.cast("double") / norm)


@query(
    "blk_topk",
    f"with q as (select vec_id, embedding from embeddings where vec_id % {EVERY} = 0) select q.vec_id as query_id, e.vec_id as item_id, round({cosine_sql('q.embedding', 'e.embedding')}, 6) as score, "
    f"row_number() over (partition by q.vec_id order by round({cosine_sql('q.embedding', 'e.embedding')}, 9) desc, e.vec_id) - 1 as rank from q, embeddings e qualify rank < {K}",
)
def blk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), unit("embedding").alias("vec"), F.lit("").alias("part"))
    return retrieval.top_k(all_.where(f"id % {EVERY} = 0"), all_, K).withColumn("score", F.round("score", 6))


_ASKING = f"substr(entity_id, 4)::bigint % {EVERY} = 0"


def dense(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """``s1_id, cand_id, view, source, rank, score``: per view and source the best records of the S1's own country."""
    vecs = views.vectors(spark, sf_dir).join(views.records(spark, sf_dir).where("country <> ''").select("entity_id", "country", "source"), "entity_id")
    vecs = materialise(vecs.select("entity_id", "view_name", "source", F.col("country"), unit("vec").alias("vec")))
    out = None
    for view in ("name", "both"):
        own = vecs.where(F.col("view_name") == view).select(F.col("entity_id").alias("id"), "vec", F.col("country").alias("part"), "source")
        asked = own.where("source = 'S1'").where(F.substring("id", 4, 20).cast("bigint") % EVERY == 0)
        for source in ("S2", "S3"):
            found = retrieval.top_k(asked, own.where(F.col("source") == source), k)
            part = found.select(F.col("query_id").alias("s1_id"), F.col("item_id").alias("cand_id"), F.lit(view).alias("view"), F.lit(source).alias("source"), "rank", "score")
            out = part if out is None else out.unionByName(part)
    return out


DENSE = f"{REC}, {VEC}, v as (select vec.entity_id, view_name, vec, country, source from vec join rec using (entity_id) where country <> ''), dense as (select a.entity_id as s1_id, b.entity_id as cand_id, a.view_name as view, b.source, round({cosine_sql('a.vec', 'b.vec')}, 9) as score from (select * from v where source = 'S1' and {_ASKING}) a join v b on b.country = a.country and b.view_name = a.view_name and b.source <> 'S1'), dk as (select *, row_number() over (partition by s1_id, view, source order by score desc, cand_id) - 1 as rank from dense qualify rank < {K})"


query("blk_dense", f"with {DENSE} select s1_id, cand_id, view, source, rank, round(score, 6) as score from dk")(lambda spark, d: dense(spark, d).withColumn("score", F.round("score", 6)))
query("blk_union", f"with {DENSE} select s1_id, cand_id, coalesce(min(rank) filter (where view = 'name'), {K})::bigint as rank_name, coalesce(min(rank) filter (where view = 'both'), {K})::bigint as rank_both from dk group by s1_id, cand_id")(
    lambda spark, d: dense(spark, d).groupBy("s1_id", "cand_id").pivot("view", ["name", "both"]).agg(F.min("rank")).select("s1_id", "cand_id", F.coalesce("name", F.lit(K)).cast("bigint").alias("rank_name"), F.coalesce("both", F.lit(K)).cast("bigint").alias("rank_both"))
)


def recall(found: DataFrame, truth: DataFrame, n_s1: int, ks=KS) -> DataFrame:
    """``k, recall, per_s1``: share of true pairs found among the first ``k`` ranks of any view, and pairs kept per S1. Null recall without true pairs."""
    best = found.groupBy("s1_id", "cand_id").agg(F.min("rank").alias("rank"))
    at = F.explode(F.array(*map(F.lit, ks))).alias("k")
    hit = truth.join(best, ["s1_id", "cand_id"], "left").select("rank", at).groupBy("k").agg(F.avg(F.coalesce((F.col("rank") < F.col("k")).cast("int"), F.lit(0))).alias("recall"))
    kept = best.select("rank", at).where("rank < k").groupBy("k").agg((F.count(F.lit(1)) / n_s1).alias("per_s1"))
    return kept.join(hit, "k", "left").select("k", F.round("recall", 6).alias("recall"), F.round("per_s1", 6).alias("per_s1"))


_TQ = f"tq as (select * from truth where substr(s1_id, 4)::bigint % {EVERY} = 0), nq as (select count(*) as n from rec where source = 'S1' and {_ASKING}), ks as (select unnest([{', '.join(map(str, KS))}]) as k), best as (select s1_id, cand_id, min(rank) as rank from dk group by 1, 2)"


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    number = F.substring("s1_id", 4, 20).cast("bigint") % EVERY == 0
    n = views.records(spark, sf_dir).where("source = 'S1'").where(F.substring("entity_id", 4, 20).cast("bigint") % EVERY == 0).count()
    return views.truth(spark, sf_dir).where(number), n


@query("blk_recall", f"with {DENSE}, {TRUTH}, {_TQ} select k, (select round(avg(coalesce((rank < k)::int, 0)), 6) from tq left join best using (s1_id, cand_id)) as recall, round((select count(*) from best where rank < k) / (select n from nq), 6) as per_s1 from ks where (select count(*) from best where rank < k) > 0")
def blk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall(dense(spark, sf_dir), *_asked(spark, sf_dir))


@query("blk_recall_curve", f"with {DENSE.replace(f'rank < {K}', f'rank < {CURVE[-1]}')}, {TRUTH}, {_TQ.replace(', '.join(map(str, KS)), ', '.join(map(str, CURVE)))}, c as (select view, source, s1_id, cand_id, rank from dk union all select 'UNION', 'ALL', s1_id, cand_id, rank from best) select view, source, k, count(*) filter (where rank < k)::bigint as n_pairs, count(*) filter (where rank < k and (s1_id, cand_id) in (select (s1_id, cand_id) from tq))::bigint as n_true from c, ks group by 1, 2, 3")
def blk_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and true pairs within each rank, per view and source and for their union."""
    found = materialise(dense(spark, sf_dir, CURVE[-1]))
    union = found.groupBy("s1_id", "cand_id").agg(F.min("rank").alias("rank")).select(F.lit("UNION").alias("view"), F.lit("ALL").alias("source"), "s1_id", "cand_id", "rank")
    known = _asked(spark, sf_dir)[0].withColumn("_y", F.lit(1))
    every = found.select("view", "source", "s1_id", "cand_id", "rank").unionByName(union).join(known, ["s1_id", "cand_id"], "left").select("*", F.explode(F.array(*map(F.lit, CURVE))).alias("k"))
    return every.groupBy("view", "source", "k").agg(F.count(F.when(F.col("rank") < F.col("k"), 1)).alias("n_pairs"), F.count(F.when((F.col("rank") < F.col("k")) & F.col("_y").isNotNull(), 1)).alias("n_true"))


@query("blk_recall_gain", f"with {DENSE}, {TRUTH}, {_TQ}, o as (select distinct s1_id, cand_id from dk where view = 'name'), n as (select distinct s1_id, cand_id from dk where view = 'both') select (select count(*) from tq)::bigint as n_true, (select count(*) from tq join o using (s1_id, cand_id))::bigint as old_hits, (select count(*) from tq join n using (s1_id, cand_id))::bigint as new_hits, (select count(*) from (select * from o union select * from n) u join tq using (s1_id, cand_id))::bigint as union_hits, (select count(*) from (select * from n except select * from o))::bigint as new_pairs")
def blk_recall_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a further view adds: hits of each and of both, and the pairs only it has."""
    found = dense(spark, sf_dir).groupBy("s1_id", "cand_id").agg(F.max((F.col("view") == "name").cast("int")).alias("old"), F.max((F.col("view") == "both").cast("int")).alias("new"))
    both = found.join(_asked(spark, sf_dir)[0].withColumn("y", F.lit(1)), ["s1_id", "cand_id"], "full")
    n = lambda c: F.count(F.when(c, 1))
    y, old, new = F.col("y") == 1, F.col("old") == 1, F.col("new") == 1
    return both.agg(n(y).alias("n_true"), n(y & old).alias("old_hits"), n(y & new).alias("new_hits"), n(y & (old | new)).alias("union_hits"), n(new & ~old).alias("new_pairs"))


@query("blk_reduction", f"with {DENSE}, b as (select count(*) as n from (select distinct s1_id, cand_id from dk)), s as (select count(*) filter (where source = 'S1' and {_ASKING}) as q, count(*) filter (where source <> 'S1') as pool from rec) select n::bigint as n_pairs, round(n / q, 6) as per_s1, round(1 - n / (q * pool), 6) as reduction from b, s")
def blk_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs per S1 and the share of all comparisons that blocking spares."""
    n = dense(spark, sf_dir).select("s1_id", "cand_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    asks = F.substring("entity_id", 4, 20).cast("bigint") % EVERY == 0
    sizes = views.records(spark, sf_dir).agg(F.count(F.when((F.col("source") == "S1") & asks, 1)).alias("q"), F.count(F.when(F.col("source") != "S1", 1)).alias("pool"))
    return n.crossJoin(F.broadcast(sizes)).select(F.col("n").alias("n_pairs"), F.round(F.col("n") / F.col("q"), 6).alias("per_s1"), F.round(1 - F.col("n") / (F.col("q") * F.col("pool")), 6).alias("reduction"))


def char_vectors(texts: DataFrame, buckets: int = 512, dims: int = 32, fit_rows: int = 20_000) -> DataFrame:
    """``id, vec`` of ``id, text``: hashed letter triples, sublinear counts by inverse document frequency, principal components, unit length.

    Fitted on at most ``fit_rows`` texts drawn by hash, applied to all.
    """
    padded = texts.select("id", F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")).alias("text"))
    letters = RegexTokenizer(inputCol="text", outputCol="letters", pattern=".", gaps=False, minTokenLength=1, toLowercase=True).transform(padded)
    grams = NGram(n=3, inputCol="letters", outputCol="grams").transform(letters)
    counted = HashingTF(inputCol="grams", outputCol="tf", numFeatures=buckets).transform(grams)
    logged = counted.withColumn("tf", array_to_vector(F.transform(vector_to_array("tf"), lambda x: F.log1p(x))))
    sample = materialise(logged.orderBy(F.xxhash64("id")).limit(fit_rows).select("id", "tf"))
    idf = IDF(inputCol="tf", outputCol="w").fit(sample)
    pca = PCA(k=dims, inputCol="w", outputCol="p").fit(idf.transform(sample))
    return Normalizer(inputCol="p", outputCol="u").transform(pca.transform(idf.transform(logged))).select("id", vector_to_array("u").alias("vec"))


query("blk_charvec")(lambda spark, d: char_vectors(views.frames(spark, d).select(F.col("entity_id").alias("id"), F.col("name_core").alias("text"))).select("id", F.transform("vec", lambda x: F.round(x, 4)).alias("vec")))


def embedded(texts: DataFrame, encode, dims: int) -> DataFrame:
    """``id, vec`` by any batch function from a list of strings to a matrix: the place for a neural encoder. Arrow batches, no shuffle."""
    import pandas as pd

    made = F.pandas_udf(lambda s: pd.Series(list(encode(s.fillna("").tolist()))), "array<float>")
    return texts.select("id", made(F.col("text")).alias("vec"))


def hashed_encoder(dims: int = 64):
    """Letter triples hashed with signs to ``dims`` values, unit length; all zero of the empty string."""

    def encode(texts):
        import numpy as np
        import xxhash

        out = np.zeros((len(texts), dims), np.float32)
        for row, t in zip(out, texts):
            t = f" {t} " if t else ""
            for i in range(len(t) - 2):
                h = xxhash.xxh32_intdigest(t[i : i + 3])
                row[h % dims] += 1 if h & 0x10000 else -1
            norm = np.linalg.norm(row)
            if norm:
                row /= norm
        return out

    return encode


query("blk_embed")(lambda spark, d: embedded(views.frames(spark, d).select(F.col("entity_id").alias("id"), F.col("name_norm").alias("text")), hashed_encoder(), 64))


@query("blk_lsh")
def blk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours of the stated queries by random projections in buckets, within a distance."""
    all_ = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.0, numHashTables=6, seed=7).fit(all_)
    near = model.approxSimilarityJoin(all_.where(f"vec_id % {EVERY} = 0"), all_, 1.3, "distance")
    return near.select(F.col("datasetA.vec_id").alias("query_id"), F.col("datasetB.vec_id").alias("item_id"), F.round("distance", 6).alias("distance")).where("query_id <> item_id")
