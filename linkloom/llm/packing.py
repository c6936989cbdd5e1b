"""Problem 9: texts of varying length into containers of fixed capacity, as vector bin packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm.encoding import count_tokens
from linkloom.runtime import materialise, table

#: Limits of a container: tokens, segments, loss-bearing tokens.
CAPACITY, SEGMENTS, LOSS = 4_096, 256, 4_000
#: Items that one task packs; the number of tasks follows the data.
ITEMS_A_SHARD = 4_000
#: Partitions over which shards are spread; more shards share them.
MOST_PARTITIONS = 8_192
#: A container filled less than this is opened again and its items are packed anew with those of other shards.
KEEP_FILL = 0.995
#: Rounds; the last one keeps every container.
ROUNDS = 4


def fill(items: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of every item by the dot-product heuristic.

    ``items``: one row per item, one column per limit, none above its limit. One container is open at a time;
    it takes the item that still fits with the greatest dot product of the item's and the free room's shares, until none fits.
    Items of equal sizes are one kind; equal products go to the kind of greater first size.
    """
    kinds, kind_of = np.unique(items, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    stock = [list(np.flatnonzero(kind_of == k)[::-1]) for k in range(len(kinds))]
    left = np.array([len(s) for s in stock])
    shares = kinds / limits
    where = np.empty(len(items), np.int64)
    number, remaining = 0, len(items)
    while remaining:
        free = limits.astype(np.float64).copy()
        opened = False
        while remaining:
            fits = (left > 0) & (kinds <= free).all(axis=1)
            if not fits.any():
                break
            product = np.where(fits, shares @ (free / limits), -1.0)
            best = len(product) - 1 - int(np.argmax(product[::-1]))
            where[stock[best].pop()] = number
            left[best] -= 1
            free -= kinds[best]
            remaining -= 1
            opened = True
        if not opened:
            raise ValueError("an item is above a limit")
        number += 1
        alive = left > 0
        if number % 64 == 0 and not alive.all():
            kinds, shares, left, stock = kinds[alive], shares[alive], left[alive], [s for s, a in zip(stock, alive) if a]
    return where


def _pack_shard(limits: tuple[int, int, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "copy"], ignore_index=True)
        where = fill(pdf[["n_tokens", "n_segments", "n_loss"]].to_numpy(np.int64), np.array(limits))
        full = np.bincount(where, weights=pdf.n_tokens) / limits[0]
        return pdf.assign(slot=where, share=full[where])

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, items_a_shard: int = ITEMS_A_SHARD) -> DataFrame:
    """``doc_id, piece, start, n_tokens, container_id`` for every row of ``sizes`` (``doc_id, n_tokens`` and, if some tokens at the beginning bear no loss, ``n_masked``).

    Only an item above ``capacity`` is split, into full containers of its own and a last piece that is packed with the
    rest. ``loss`` is ``LOSS`` where masked tokens are known, else the capacity. A text's first token and its masked ones bear no loss. An item with more loss-bearing tokens than ``loss``, which may not be split for that, takes the
    whole limit: beside it a container holds only items without loss. Null and 0 sizes are items of no tokens and take a segment. Repeated rows are packed as often as
    they stand (``copy`` tells them apart inside). Items go to shards by a hash, so that any source or size spreads; no task holds more than about
    ``items_a_shard`` of them. What stands in badly filled containers is packed again, over fewer shards.
    """
    loss = loss or (LOSS if "n_masked" in sizes.columns else capacity)
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    masked = F.greatest(F.lit(1).cast("long"), F.coalesce(F.col("n_masked"), F.lit(0)).cast("long")) if "n_masked" in sizes.columns else F.lit(1).cast("long")
    pieces = (
        sizes.select("doc_id", n.alias("n"), masked.alias("masked"), F.monotonically_increasing_id().alias("copy"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > 0, F.ceil(F.col("n") / capacity) - 1).otherwise(0).cast("long"))))
        .select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"), "masked", "copy")
    )
    pieces = materialise(
        pieces.withColumn("n_segments", F.lit(1).cast("long"))
        .withColumn("n_loss", F.least(F.lit(loss).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("n_tokens") - F.greatest(F.lit(0).cast("long"), F.col("masked") - F.col("start")))))
        .drop("masked")
    )
    columns = ["doc_id", "piece", "start", "n_tokens"]
    at = F.xxhash64("doc_id", "piece", "copy")
    # whole containers need no packing; they are numbered once and written, so that the numbers stay
    done = materialise(pieces.where(F.col("n_tokens") == capacity).select(*columns, (F.monotonically_increasing_id() * 2 + 1).alias("container_id")))
    todo = pieces.where(F.col("n_tokens") < capacity)
    base = 0
    schema = todo.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", shard long, slot long, share double"
    for k in range(ROUNDS):
        count = todo.count()
        if not count:
            break
        shards = max(1, -(-count // items_a_shard))
        sharded = todo.withColumn("shard", F.pmod(F.xxhash64(at, F.lit(k)), F.lit(shards)))
        # a stated number of partitions: packing takes long for its few bytes, by which adaptive execution would merge shards
        packed = materialise(sharded.repartition(min(shards, MOST_PARTITIONS), "shard").groupBy("shard").applyInPandas(_pack_shard((capacity, segments, loss)), schema))
        last = k == ROUNDS - 1 or shards == 1
        kept = packed if last else packed.where(F.col("share") >= KEEP_FILL)
        # even numbers: round's base, shard and slot
        done = done.unionByName(kept.select(*columns, ((F.lit(base) + F.col("shard") * items_a_shard * 4 + F.col("slot")) * 2).alias("container_id")))
        if last:
            break
        base += shards * items_a_shard * 4
        todo = packed.where(F.col("share") < KEEP_FILL).drop("shard", "slot", "share")
    return done


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialise(count_tokens(table(spark, sf_dir, "documents"))))
