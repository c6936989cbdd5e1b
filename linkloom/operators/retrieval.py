"""Exact top-k retrieval of queries against all rows of the same part, in blocks.

Queries and pool of a part are split into blocks of bounded size; each task multiplies one block of queries with one block of the pool and keeps the
best ``k`` per query, and only those are merged. Parts never meet, nothing comes to the driver, and no pair is emitted beyond the kept ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from linkloom.operators import windows
from linkloom.runtime import small

#: Queries and pool rows of one task; a block of the other side is repeated for each.
QUERY_ROWS, POOL_ROWS = 4_096, 32_768
#: Pool rows compared at a time.
STEP_ROWS = 4_096


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` per query, equal scores by smaller id."""
    found = found.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True])
    return found[found.groupby("query_id").cumcount() < k]


def _block(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        asked, pool = pdf[pdf.asks], pdf[~pdf.asks]
        if not len(asked) or not len(pool):
            return none
        ids, matrix = asked["id"].to_numpy(), np.array(asked["vec"].tolist(), np.float64)
        kept = []
        for at in range(0, len(pool), STEP_ROWS):
            rows = pool.iloc[at : at + STEP_ROWS]
            score = np.round(np.array(rows["vec"].tolist(), np.float64) @ matrix.T, 9)
            many = min(k, len(rows))
            floor = np.partition(score, len(rows) - many, axis=0)[len(rows) - many]
            r, q = np.nonzero(score >= floor)
            kept.append(_best(pd.DataFrame({"query_id": ids[q], "item_id": rows["id"].to_numpy()[r], "score": score[r, q]}), k))
        return _best(pd.concat(kept), k)

    return run


def top_k(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """``query_id, item_id, score, rank``: the ``k`` items of greatest inner product per query, ranks from 0, equal scores by smaller id.

    Both have ``id``, ``vec`` (arrays of one length) and ``part``; only items of the query's part count, so queries of a part without
    items don't come out. Queries and items with a null in a column take no part. ``k`` above the pool's size gives all of it.
    """
    usable = lambda df: df.where("id is not null and vec is not null and part is not null").select("id", "vec", "part")
    pool, asked = usable(pool), usable(queries)
    blocks = lambda df, rows, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    grid = small(blocks(asked, QUERY_ROWS, "n_i").join(blocks(pool, POOL_ROWS, "n_j"), "part"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, "part").select("part", own("n_i").alias("i"), each("n_j").alias("j"), F.lit(True).alias("asks"), "id", "vec")
    right = pool.join(grid, "part").select("part", each("n_i").alias("i"), own("n_j").alias("j"), F.lit(False).alias("asks"), "id", "vec")
    found = left.unionByName(right).groupBy("part", "i", "j").applyInPandas(_block(k), f"query_id {dict(asked.dtypes)['id']}, item_id {dict(pool.dtypes)['id']}, score double")
    best = windows.first_rows(found, ["query_id"], [F.desc("score"), F.asc("item_id")], k)
    return best.select("query_id", "item_id", "score", (F.col("place") - 1).cast("bigint").alias("rank"))
