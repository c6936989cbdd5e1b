"""Readings of the scored pairs that several problems share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def counting_pairs(scored: DataFrame) -> DataFrame:
    """One row per (s1_id, cand_id) with the ``prob`` of its latest counting ``scored_at``.

    Rows with a null or NaN ``prob`` or a null id don't count. Of rows equally late the higher ``prob``
    holds; a null ``scored_at`` is earlier than any other. The maximum combines before the shuffle, and the key is the pair,
    so that a hot ``s1_id`` spreads over all tasks.
    """
    return (
        scored.select("s1_id", "cand_id", "prob", "scored_at")
        .where("s1_id is not null and cand_id is not null and prob is not null and not isnan(prob)")
        .groupBy("s1_id", "cand_id")
        .agg(F.max(F.struct("scored_at", "prob")).alias("last"))
        .select("s1_id", "cand_id", F.col("last.prob").alias("prob"))
    )


COUNTING_SQL = """
  select s1_id, cand_id, max_by(prob, (scored_at, prob)) as prob
  from scored_pairs
  where s1_id is not null and cand_id is not null and prob is not null and not isnan(prob)
  group by s1_id, cand_id
"""
