"""Seeded samples that don't depend on partitioning: each row's draw is a hash of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def draw(seed: int, *keys: str) -> Column:
    """A number of 60 bits from the keys and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys, F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")


def unit(seed: int, *keys: str) -> Column:
    """The draw as a number above 0 and at most 1."""
    return (draw(seed, *keys) + 1) / F.lit(float(2**60))


def uniform(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows, each set of rows as likely as any other: the ``n`` least draws."""
    return df.withColumn("_draw", draw(seed, *keys)).orderBy("_draw", *keys).limit(n).drop("_draw")


def weighted(df: DataFrame, n: int, seed: int, weight: Column, *keys: str) -> DataFrame:
    """``n`` rows without replacement in proportion to their weight: the greatest ln(u) / weight."""
    return df.withColumn("_key", F.log(unit(seed, *keys)) / weight).orderBy(F.desc("_key"), *keys).limit(n).drop("_key")


def training_pairs(pairs: DataFrame, n: int, positive_share: float, seed: int, floor: float = 0.05) -> DataFrame:
    """About ``n`` of ``s1_id, cand_id, prob, y``: positives up to their share, the rest negatives, likelier with a higher score."""
    have = pairs.where("y").count()
    n_pos = min(have, round(n * positive_share))
    return uniform(pairs.where("y"), n_pos, seed, "s1_id", "cand_id").unionByName(weighted(pairs.where("not y"), n - n_pos, seed, F.coalesce("prob", F.lit(0.0)) + floor, "s1_id", "cand_id"))


def hard_and_easy(pairs: DataFrame, n: int, low: float, high: float, positive_share: float, seed: int) -> DataFrame:
    """Four fifths from the band ``low < prob < high``, the rest weighted by score from outside, then positives cut to their share."""
    hard = (F.col("prob") > low) & (F.col("prob") < high)
    n_hard = min(pairs.where(hard).count(), int(n * 0.8))
    picked = uniform(pairs.where(hard), n_hard, seed, "s1_id", "cand_id").unionByName(weighted(pairs.where(~hard), n - n_hard, seed, F.col("prob") + 0.02, "s1_id", "cand_id"))
    n_pos = min(picked.where("y").count(), int(n * positive_share))
    return uniform(picked.where("y"), n_pos, seed + 1, "s1_id", "cand_id").unionByName(uniform(picked.where("not y"), n - n_pos, seed + 1, "s1_id", "cand_id"))


def thinned(df: DataFrame, key: str, always: DataFrame, share: float, seed: int) -> DataFrame:
    """Rows of keys in ``always`` and of a seeded share of the other keys; a key stays or goes whole."""
    kept = df.select(key).distinct().join(always.select(F.col(key), F.lit(True).alias("_always")).distinct(), key, "left").where(F.col("_always") | (unit(seed, key) <= share)).select(key)
    return df.join(kept, key, "left_semi")
