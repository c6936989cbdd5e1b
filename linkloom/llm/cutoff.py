"""Problem 1: the score cutoff per group that keeps a target share, by distributed quickselect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm.scores import counting_pairs
from linkloom.runtime import materialise, small, table

#: Groups whose selection state is on the driver at once; more groups are worked in further passes.
GROUPS_AT_ONCE = 2_000
#: Distinct scores that a task reads.
SCORES_A_PART = 100_000

_SIDES = "group_no long, above long, equal long, below long, up long, down long, high double, high_n long, low double, low_n long"


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    """The lower weighted median; NaN of nothing."""
    if not len(values):
        return float("nan")
    order = np.argsort(values, kind="stable")
    sums = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(sums, (sums[-1] + 1) // 2)])


def _sides(state: dict[int, tuple[int, int, int]]):
    """Per batch and open group: counts around the pivot, and the median of either side."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for g, own in rows.groupby("group_no"):
                if g not in state:
                    continue
                low, high, pivot = state[g]
                own = own[(own.score > low) & (own.score < high)]
                v, n = own.score.to_numpy(), own.n.to_numpy()
                up, down = v > pivot, v < pivot
                out.append((g, n[up].sum(), n[v == pivot].sum(), n[down].sum(), up.sum(), down.sum(), _median(v[up], n[up]), n[up].sum(), _median(v[down], n[down]), n[down].sum()))
            yield pd.DataFrame(out, columns=["group_no", "above", "equal", "below", "up", "down", "high", "high_n", "low", "low_n"])

    return scan


def _pivots(medians: pd.DataFrame, side: str) -> dict[int, int]:
    """Per group the weighted median of the parts' medians of one side."""
    known = medians[medians[f"{side}_n"] > 0]
    return {int(g): int(_median(own[side].to_numpy(), own[f"{side}_n"].to_numpy())) for g, own in known.groupby("group_no")}


def select_cutoffs(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Cutoff and kept count of every group, by quickselect over weighted values.

    ``counted``: ``group_no`` long, ``score`` long, ``n`` long, one row per group and score.
    ``targets``: ``group_no``, ``keep_permille``. A group's cutoff is the highest occurring score c with
    ``1000 * count(score >= c) >= keep_permille * count``; a share of 0 or null gives the highest score, one
    above 1000 the lowest. Groups without rows don't come out. Each round is one pass: every part counts
    around the pivot and names the median of either side, the weighted median of these is the next pivot, and
    the side without the target rank is discarded: what is still open is written once it is under half of what was read, so the rounds together read about
    twice the first. A part is a batch of rows, which ``counted`` should hold sorted by group, as each part answers one row per open group in it; the state of at most ``GROUPS_AT_ONCE`` groups is on the driver.
    """
    spark = counted.sparkSession
    totals = counted.groupBy("group_no").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("scores")).join(targets, "group_no")
    totals = materialise(totals.select("group_no", "total", "scores", F.greatest(F.lit(1), F.least(F.col("total"), F.ceil(F.coalesce(F.col("keep_permille"), F.lit(0)) * F.col("total") / 1000))).cast("long").alias("rank")))
    found = None
    passes = max(1, -(-totals.count() // GROUPS_AT_ONCE))
    for k in range(passes):
        mine = F.pmod(F.xxhash64("group_no"), F.lit(passes)) == k
        want = totals.where(mine).collect()
        open_ = {r.group_no: (-(2**62), 2**62, 2**61, r.rank, 0) for r in want}  # low, high, pivot, rank left, kept above
        left = {r.group_no: r.scores for r in want}  # scores between low and high, at most
        rows, read = (counted.where(mine) if passes > 1 else counted), sum(left.values())
        done: list[tuple[int, int, int]] = []
        while open_:
            sides = rows.mapInPandas(_sides({g: s[:3] for g, s in open_.items()}), _SIDES).toPandas()
            sums = sides.groupby("group_no")[["above", "equal", "below", "up", "down"]].sum()
            high, low_ = _pivots(sides, "high"), _pivots(sides, "low")
            for g, r in sums.iterrows():
                low, top, pivot, rank, kept = open_[g]
                if rank <= r.above:
                    open_[g], left[g] = (pivot, top, high[g], rank, kept), int(r.up)
                elif rank <= r.above + r.equal:
                    done.append((int(g), pivot, int(kept + r.above + r.equal)))
                    del open_[g]
                else:
                    open_[g], left[g] = (low, pivot, low_[g], int(rank - r.above - r.equal), int(kept + r.above + r.equal)), int(r.down)
            bounds = [(g, s[0], s[1]) for g, s in open_.items()]
            if not bounds:
                break
            # every discarded side is dropped for good as soon as that halves what a round reads
            count = sum(left[g] for g in open_)
            if 2 * count <= read:
                still = rows.join(F.broadcast(spark.createDataFrame(bounds, "group_no long, _low long, _top long")), "group_no").where("score > _low and score < _top").drop("_low", "_top")
                rows, read = materialise(still.coalesce(max(1, -(-count // SCORES_A_PART)))), count
        part = spark.createDataFrame(done, "group_no long, cutoff long, n_kept long")
        found = part if found is None else found.unionByName(part)
    return found


def keep_share_cutoffs(scored: DataFrame, records: DataFrame, targets: DataFrame) -> DataFrame:
    """``source_tag, country, cutoff_micro, n_kept`` for every target group that has scored records.

    A scored record is a distinct ``cand_id`` with its highest counting ``prob`` over all ``s1_id``; its
    group is its source and country as written, null or empty countries are left out. Of an entity delivered
    several times the greatest source and country hold. Of target rows repeated for one group the greatest share holds.
    Empty tables give an empty result; extra columns are ignored. Scores are collapsed to counts per group and score
    before the selection, so no group ever gathers its records in one task.
    """
    best = counting_pairs(scored).groupBy("cand_id").agg(F.max("prob").alias("prob"))
    of = (
        records.where("entity_id is not null and country is not null and country <> '' and source_tag is not null")
        .groupBy(F.col("entity_id").alias("cand_id"))
        .agg(F.max("source_tag").alias("source_tag"), F.max("country").alias("country"))
    )
    groups = targets.where("source_tag is not null and country is not null").groupBy("source_tag", "country").agg(F.max("keep_permille").alias("keep_permille"))
    # groups are numbered by a hash; two of one number would be one group
    groups = small(materialise(groups.withColumn("group_no", F.xxhash64("source_tag", "country"))))
    counted = (
        of.join(groups, ["source_tag", "country"])
        .join(best, "cand_id")
        .groupBy("group_no", F.round(F.col("prob") * 1_000_000).cast("long").alias("score"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cut = select_cutoffs(materialise(counted.sortWithinPartitions("group_no")), groups.select("group_no", "keep_permille"))
    return cut.join(groups, "group_no").select("source_tag", "country", F.col("cutoff").alias("cutoff_micro"), "n_kept")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_share_cutoffs(table(spark, sf_dir, "scored_pairs"), table(spark, sf_dir, "source_records"), table(spark, sf_dir, "keep_targets"))
