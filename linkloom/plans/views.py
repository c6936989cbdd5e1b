"""The linkage model's tables as the queries read them, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.runtime import table

_STATED = lambda c: F.coalesce(F.max(c), F.lit("")).alias(c)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity: re-deliveries are one record, missing texts are ``""``, missing countries ``""``."""
    return (
        table(spark, sf_dir, "source_records")
        .where("entity_id is not null")
        .groupBy("entity_id")
        .agg(F.max("source_tag").alias("source"), _STATED("business_name"), _STATED("business_address"), _STATED("country"))
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One normalised row per entity."""
    return table(spark, sf_dir, "normalised_frames").where("entity_id is not null").groupBy("entity_id").agg(*(_STATED(c) for c in ("country", "name_norm", "name_core", "addr_norm", "addr_nums", "postcode")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs once each, with their latest score; null and NaN scores don't count."""
    return (
        table(spark, sf_dir, "scored_pairs")
        .where("s1_id is not null and cand_id is not null and prob is not null and not isnan(prob)")
        .groupBy("s1_id", "cand_id")
        .agg(F.max(F.struct("scored_at", "prob")).alias("last"))
        .select("s1_id", "cand_id", F.col("last.prob").alias("prob"))
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed pairs once each; a pair reviewed both ways is no match."""
    return table(spark, sf_dir, "match_labels").where("y is not null").groupBy("s1_id", "cand_id").agg(F.min("y").alias("y"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True pairs."""
    return labels(spark, sf_dir).where("y").select("s1_id", "cand_id")


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold of each S1."""
    return table(spark, sf_dir, "s1_folds").where("s1_id is not null").groupBy("s1_id").agg(F.min("fold").alias("fold"), F.coalesce(F.max("country"), F.lit("")).alias("country"), F.max("dev").alias("dev"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector of 64 finite values, not all zero, per entity and view."""
    return (
        table(spark, sf_dir, "record_vectors")
        .where("entity_id is not null and view_name is not null and size(vec) = 64 and forall(vec, x -> x is not null and not isnan(x)) and exists(vec, x -> x <> 0)")
        .groupBy("entity_id", "view_name")
        .agg(F.max("vec").alias("vec"))
    )


def framed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs with the normalised fields of both sides (``l_``, ``r_``); pairs without both frames are left out."""
    fields = ("country", "name_norm", "name_core", "addr_norm", "addr_nums", "postcode")
    side = frames(spark, sf_dir)
    left = side.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"l_{c}") for c in fields))
    right = side.select(F.col("entity_id").alias("cand_id"), *(F.col(c).alias(f"r_{c}") for c in fields))
    return pairs(spark, sf_dir).join(left, "s1_id").join(right, "cand_id")


REC = "rec as (select entity_id, max(source_tag) as source, coalesce(max(business_name), '') as business_name, coalesce(max(business_address), '') as business_address, coalesce(max(country), '') as country from source_records where entity_id is not null group by entity_id)"
NF = "nf as (select entity_id, " + ", ".join(f"coalesce(max({c}), '') as {c}" for c in ("country", "name_norm", "name_core", "addr_norm", "addr_nums", "postcode")) + " from normalised_frames where entity_id is not null group by entity_id)"
P = "p as (select s1_id, cand_id, max_by(prob, (scored_at, prob)) as prob from scored_pairs where s1_id is not null and cand_id is not null and prob is not null and not isnan(prob) group by s1_id, cand_id)"
LAB = "lab as (select s1_id, cand_id, bool_and(y) as y from match_labels where y is not null group by s1_id, cand_id)"
TRUTH = LAB + ", truth as (select s1_id, cand_id from lab where y)"
FOLD = "fold as (select s1_id, min(fold) as fold, coalesce(max(country), '') as country, bool_or(dev) as dev from s1_folds where s1_id is not null group by s1_id)"
VEC = "vec as (select entity_id, view_name, max(vec) as vec from record_vectors where entity_id is not null and view_name is not null and len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0 group by entity_id, view_name)"
PF = P + ", " + NF + ", pf as (select p.*, " + ", ".join(f"l.{c} as l_{c}, r.{c} as r_{c}" for c in ("country", "name_norm", "name_core", "addr_norm", "addr_nums", "postcode")) + " from p join nf l on l.entity_id = p.s1_id join nf r on r.entity_id = p.cand_id)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


def cosine_sql(a: str, b: str) -> str:
    return f"({DOT.format(a=a, b=b)} / (sqrt({DOT.format(a=a, b=a)}) * sqrt({DOT.format(a=b, b=b)})))"


def tokens_sql(s: str) -> str:
    return f"list_filter(string_split({s}, ' '), lambda t: t <> '')"
