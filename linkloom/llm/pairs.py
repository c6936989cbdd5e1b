"""Pairs of rows that agree on a key, without gathering a hot key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkloom.runtime import small

#: Rows of one key that one task joins; larger keys are salted into so many parts.
ROWS_A_PART = 2_000


def pairs_within(rows: DataFrame, keys: list[str], row_id: str, value: str) -> DataFrame:
    """``id_a < id_b`` and the keys, of rows with equal keys and different ``value``s.

    Keys with one value only make no pairs and are dropped before the join by an aggregate that combines before its shuffle.
    A key of many rows is split: one side by a hash of its id, the other repeated for each part. Null keys pair with nothing.
    """
    counted = rows.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("_n")).where("_low < _high")
    parts = counted.select(*keys, F.ceil(F.col("_n") / ROWS_A_PART).cast("int").alias("_parts"))
    joined = rows.join(parts, keys)
    a = joined.select(*keys, F.col(row_id).alias("id_a"), F.col(value).alias("_value_a"), F.pmod(F.xxhash64(row_id), F.col("_parts")).cast("int").alias("_part"))
    b = joined.select(*keys, F.col(row_id).alias("id_b"), F.col(value).alias("_value_b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return a.join(b, [*keys, "_part"]).where("id_a < id_b and _value_a <> _value_b").select("id_a", "id_b", *keys)


#: Entities of one value that one task joins; more frequent values are split.
ENTITIES_A_PART = 1_000


def expand(links: DataFrame, entities: DataFrame) -> DataFrame:
    """``id_a < id_b``: pairs of values (``value_a, value_b``, each pair once) to pairs of the entities (``entity_id, value``) that have them.

    An entity has one value, so that each pair comes out once. A frequent value is a number of parts: its entities by a hash of their
    ids, and a link of two such values one row for each pair of parts.
    """
    hot = entities.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ENTITIES_A_PART)
    hot = small(hot.select("value", F.ceil(F.col("n") / ENTITIES_A_PART).cast("int").alias("parts")))
    placed = entities.join(hot, "value", "left").select("entity_id", "value", F.pmod(F.xxhash64("entity_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    for s in "ab":
        links = links.join(hot.select(F.col("value").alias(f"value_{s}"), F.col("parts").alias(f"parts_{s}")), f"value_{s}", "left")
        links = links.withColumn(f"part_{s}", F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{s}", F.lit(1)) - 1)))
    side = lambda s: placed.select(F.col("entity_id").alias(f"id_{s}"), F.col("value").alias(f"value_{s}"), F.col("part").alias(f"part_{s}"))
    both = links.join(side("a"), ["value_a", "part_a"]).join(side("b"), ["value_b", "part_b"])
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
