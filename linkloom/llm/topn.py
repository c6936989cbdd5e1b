"""Problem 3: the N best candidates of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.scores import counting_pairs
from linkloom.runtime import table

#: Candidates kept of each group.
TOP_N = 10


def top_per_group(pairs: DataFrame, n: int = TOP_N) -> DataFrame:
    """``s1_id, cand_id``: the ``n`` rows of highest ``prob`` per ``s1_id``, equal scores by smaller ``cand_id``.

    ``pairs`` holds one row per pair. The rank filter stands directly on the window, so the optimiser's group limit
    prunes every map task to ``n`` rows a group before the shuffle; a group of any size
    sends at most ``n`` rows a task. Fewer than ``n`` candidates all come out; no rows give no rows.
    """
    return pairs.sparkSession.sql(
        """
        select s1_id, cand_id from (
          select s1_id, cand_id, row_number() over (partition by s1_id order by prob desc, cand_id) as place from {pairs}
        ) where place <= {n}
        """,
        pairs=pairs,
        n=n,
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with null or NaN scores or null ids don't count, a pair scored again has its latest score."""
    return top_per_group(counting_pairs(table(spark, sf_dir, "scored_pairs")))
