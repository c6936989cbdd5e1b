"""Ranks, numbers and shares within groups that hold when one group has a third of all rows.

A plain window gathers a group in one task. Here ranks come from counts per distinct value, group figures from aggregates that
combine before the shuffle, the first rows of a group from the optimiser's group limit, and full numbering from range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkloom.runtime import materialise


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first ``n`` rows of each group with their place from 1; every map task sends at most ``n`` rows of a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def with_group(df: DataFrame, keys: list[str], **figures: Column) -> DataFrame:
    """``df`` with aggregates of its group on every row."""
    made = df.groupBy(*keys).agg(*(c.alias(n) for n, c in figures.items()))
    return df.join(made, keys)


#: Distinct values of a group that one task orders; groups with more are ranked over range partitions.
GROUP_VALUES = 1_000_000


def with_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rank of ``value`` in its group from the greatest down, equal values with the least rank of theirs.

    Null values rank last. Only distinct values are ordered, each with its count: in one task per group where every group has at most
    ``GROUP_VALUES`` of them, which is counted first, else over range partitions.
    """
    counted = materialise(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    falling = F.col(value).desc_nulls_last()
    most = counted.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= GROUP_VALUES:
        upto = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy(falling).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        upto = running(counted, keys, [falling], _upto=(F.sum, F.col("_n")))
    ranked = upto.select(*keys, F.col(value).alias("_v"), (F.col("_upto") - F.col("_n") + 1).alias(name))
    on = [F.col(f"_l.{k}") == F.col(f"_r.{k}") for k in keys]
    joined = df.alias("_l").join(ranked.alias("_r"), [*on, F.col(f"_l.{value}").eqNullSafe(F.col("_r._v"))])
    return joined.select("_l.*", F.col(f"_r.{name}"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Number of each row in its group from 1, without gathering any group, not even the whole table as one group.

    Rows are range-partitioned by keys and order; each partition numbers its part of a group and adds the rows that the group has in
    partitions before it. ``order`` must tell all rows of a group apart.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(df.repartitionByRange(parts, *(F.col(k) for k in keys), *order).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(offsets, [*keys, "_part"]).withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def running(df: DataFrame, keys: list[str], order: list[Column], **figures: tuple) -> DataFrame:
    """Running aggregates of each group up to and including the row, without gathering a group.

    ``figures``: name = (function such as F.min or F.sum, column). Range partitions aggregate their part, and add what the
    parts before them give. ``order`` must tell all rows of a group apart.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(df.repartitionByRange(parts, *(F.col(k) for k in keys), *order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_part").agg(*(f(c).alias(f"_t_{n}") for n, (f, c) in figures.items()))
    earlier = totals.select(*keys, "_part", *(f(f"_t_{n}").over(before).alias(f"_b_{n}") for n, (f, c) in figures.items()))
    made = ranged.select("*", *(f(c).over(own).alias(f"_o_{n}") for n, (f, c) in figures.items())).join(earlier, [*keys, "_part"])
    joined = {F.min: F.least, F.max: F.greatest}
    for n, (f, _) in figures.items():
        both = joined[f](f"_o_{n}", f"_b_{n}") if f in joined else F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + F.coalesce(F.col(f"_b_{n}"), F.lit(0))
        made = made.withColumn(n, both)
    return made.drop("_part", *(f"{p}{n}" for n in figures for p in ("_o_", "_b_")))


def tiles(df: DataFrame, order: list[Column], n: int, name: str) -> DataFrame:
    """``n`` nearly equal stretches of the ordered table, the larger ones first, numbered from 1."""
    made = numbered(df, [], order, "_row")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    small, rest = F.floor(F.col("_total") / n), F.col("_total") % n
    head = rest * (small + 1)
    tile = F.when(F.col("_row") <= head, F.ceil(F.col("_row") / (small + 1))).otherwise(rest + F.ceil((F.col("_row") - head) / F.greatest(small, F.lit(1))))
    return made.crossJoin(F.broadcast(total)).withColumn(name, tile.cast("long")).drop("_row", "_total")


def best_other(df: DataFrame, group: str, member: str, value: str, name: str) -> DataFrame:
    """Per row the greatest ``value`` of its group under another member, 0 if there is none, and the margin over it.

    The group's best row, equal values by smaller member, compares with the second; every other row with the best.
    """
    top = first_rows(df.select(group, member, value), [group], [F.desc(value), F.asc(member)], 2)
    tops = top.groupBy(group).agg(F.max(F.when(F.col("place") == 1, F.col(member))).alias("_best"), F.max(F.when(F.col("place") == 1, F.col(value))).alias("_first"), F.max(F.when(F.col("place") == 2, F.col(value))).alias("_second"))
    other = F.when(F.col(member) == F.col("_best"), F.coalesce("_second", F.lit(0.0))).otherwise(F.col("_first"))
    return df.join(tops, group).withColumn(f"{name}_other_best", other).withColumn(f"{name}_margin", F.col(value) - F.col(f"{name}_other_best")).drop("_best", "_first", "_second")
