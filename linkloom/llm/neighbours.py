"""Problem 6: the most similar vectors of every vector, by randomly rotated one-bit codes.

Equal vectors are one class. Classes are assigned to cells round centroids of a bounded sample; where the sample gives fewer centroids than
the classes need cells, a second set of centroids, of the sample's differences from the first, splits every cell, so that cells follow the number of classes.
Every vector is stored in its ``PROBES`` nearest cells and asks in its nearest one. In a cell a vector is its 64 sign bits after one random rotation, packed, with the
correction scalar of its code. The estimated inner product and its error bound tell which vectors can still be among the nearest; only these are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from linkloom.runtime import materialise, small, table

#: Length of the vectors that take part, and neighbours of each.
DIMENSION, NEIGHBOURS = 64, 5
#: Classes that a cell should own, cells in which each class is stored.
CELL_ROWS, PROBES = 512, 8
#: Vectors of a view on which the centroids are fitted, and vectors for one centroid.
FIT_ROWS, FIT_EACH = 20_000, 8
#: Deviations of the estimate's error that the bound allows.
DEVIATIONS = 2.5
#: Classes that ask in one task, and that are stored in one; a larger cell is a grid of tasks.
ASKING_ROWS, STORED_ROWS = 8_192, 32_768
#: Decimals to which cosines are compared: vectors of one direction but different lengths are equally similar.
DECIMALS = 12
#: Stored rows compared at a time.
BLOCK_ROWS = 8_192

_SEED = 20_240_131


def rotation(dimension: int = DIMENSION) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dimension, dimension)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit vectors, and the inner product of each code's unit vector with its vector."""
    turned = unit.astype(np.float32) @ rotation(unit.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def estimate(codes: np.ndarray, scalar: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated ``asking`` vectors (rows) with coded ones (columns), and the code's error factor.

    With o' the code's unit vector, <o', q> / <o', o> estimates <o, q>; its error is at most about
    sqrt(1 - <o, q>^2) times the factor, which depends on the code alone.
    """
    d = asking.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32)
    signs = (2 * signs - 1) / np.float32(np.sqrt(d))
    return (asking @ signs.T) / scalar.astype(np.float32), (DEVIATIONS * np.sqrt(np.maximum(1 - scalar**2, 0)) / scalar / np.sqrt(d - 1)).astype(np.float32)


def _nearest(asking: np.ndarray, ask_ids: np.ndarray, stored: np.ndarray, ids: np.ndarray, codes: np.ndarray, scalar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``asking``, columns of ``stored`` that may be among their ``k`` nearest, and exact cosines; the own class is left out."""
    turned = (asking @ rotation(asking.shape[1]).T.astype(np.float64)).astype(np.float32)
    best = np.full((len(asking), k), -2.0, np.float32)  # the greatest lower bounds so far
    kept_rows, kept_cols, kept_upper = [], [], []
    for at in range(0, len(stored), BLOCK_ROWS):
        cols = slice(at, at + BLOCK_ROWS)
        guess, factor = estimate(codes[cols], scalar[cols], turned)
        np.clip(guess, -1, 1, out=guess)
        error = np.sqrt(1 - guess * guess)
        error += 0.15
        np.minimum(error, 1, out=error)
        error *= factor
        lower = guess - error
        lower[ask_ids[:, None] == ids[cols]] = -2
        if lower.shape[1] > k:
            top = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k:]
        else:
            top = lower
        both = np.hstack([best, top])
        best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        guess += error
        rows, cols_in = np.nonzero(guess >= best.min(axis=1)[:, None])
        kept_rows.append(rows)
        kept_cols.append(cols_in + at)
        kept_upper.append(guess[rows, cols_in])
    rows, cols, upper = np.concatenate(kept_rows), np.concatenate(kept_cols), np.concatenate(kept_upper)
    still = (upper >= best.min(axis=1)[rows]) & (ask_ids[rows] != ids[cols])
    rows, cols = rows[still], cols[still]
    exact = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[part] = np.round(np.einsum("ij,ij->i", asking[rows[part]], stored[cols[part]]), DECIMALS)
    return rows, cols, exact


def _cell(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = np.frombuffer(b"".join(pdf["packed"]), np.float32).reshape(len(pdf), -1).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        ids = pdf["class_id"].to_numpy()
        store, ask = pdf["stored"].to_numpy(), pdf["asks"].to_numpy()
        codes = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
        scalar = pdf["scalar"].to_numpy()
        out = []
        for at in range(0, int(ask.sum()), 1024):
            mine = np.flatnonzero(ask)[at : at + 1024]
            rows, cols, exact = _nearest(unit[mine], ids[mine], unit[store], ids[store], codes[store], scalar[store], k)
            order = np.lexsort((ids[store][cols], -exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            # classes as near as the k-th stay, their members decide
            last = np.full(len(mine), -2.0)
            np.maximum.at(last, rows[place == k - 1], exact[place == k - 1])
            keep = exact >= last[rows]
            out.append(pd.DataFrame({"class_id": ids[mine][rows[keep]], "near_id": ids[store][cols[keep]], "cosine": exact[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"class_id": [], "near_id": [], "cosine": []})

    return run


def _centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means on the sample, a few rounds; starts are spread rows of it."""
    centres = sample[np.random.default_rng(_SEED).choice(len(sample), cells, replace=False)]
    for _ in range(8):
        of = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-9)[:, None], centres)
    return centres.astype(np.float32)


def codebooks(sample: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of a sample of unit vectors and of its differences from them, so many that a pair of both, a cell, owns about ``CELL_ROWS`` of ``classes``.

    Each set has at most one centroid for ``FIT_EACH`` vectors of the sample; one difference of zeros where the first set is enough.
    """
    most, need = len(sample) // FIT_EACH + 1, -(-classes // CELL_ROWS)
    first = _centroids(sample, max(1, min(most, need)))
    more = min(most, -(-need // len(first)))
    if more <= 1:
        return first, np.zeros((1, sample.shape[1]), np.float32)
    rest = sample - first[np.argmax(sample @ first.T, axis=1)]
    second = rest[np.random.default_rng(_SEED + 1).choice(len(rest), more, replace=False)]
    for _ in range(8):
        of = np.argmin((second**2).sum(axis=1) - 2 * rest @ second.T, axis=1)
        sums, n = np.zeros_like(second), np.bincount(of, minlength=more)
        np.add.at(sums, of, rest)
        second = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], second)
    return first, second.astype(np.float32)


def nearest_cells(unit: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The ``PROBES`` nearest cells of each vector, nearest first; cell ``i * len(second) + j`` lies round the sum of both centroids."""
    near = unit @ first.T
    many = min(PROBES, near.shape[1])
    tops = np.argpartition(-near, many - 1, axis=1)[:, :many]
    at = np.take_along_axis(near, tops, axis=1)
    if len(second) == 1:
        order = np.argsort(-at, axis=1, kind="stable")
        return np.take_along_axis(tops, order, axis=1)
    # |x - c - d|^2 without |x|^2, in each of the nearest first cells
    size, cross = (first**2).sum(axis=1), first @ second.T
    far = (size[tops] - 2 * at)[:, :, None] + ((second**2).sum(axis=1) - 2 * (unit @ second.T))[:, None, :] + 2 * cross[tops]
    far = far.reshape(len(unit), -1)
    best = np.argpartition(far, PROBES - 1, axis=1)[:, :PROBES] if far.shape[1] > PROBES else np.tile(np.arange(far.shape[1]), (len(unit), 1))
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(far, best, axis=1), axis=1, kind="stable"), axis=1)
    return np.take_along_axis(tops, best // len(second), axis=1) * len(second) + best % len(second)


#: Vectors assigned at a time; bounds the distances held.
ASSIGN_ROWS = 256


def _assign(centres):
    """Adds code, correction scalar and nearest cells to packed classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_view = centres.value
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            unit = np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), -1)
            unit /= np.linalg.norm(unit, axis=1)[:, None]
            code, scalar = encode(unit)
            cells = [None] * len(pdf)
            for view, rows in pdf.groupby("view_name").groups.items():
                rows, (first, second) = np.asarray(rows), by_view[view]
                step = len(rows) if len(second) == 1 else ASSIGN_ROWS
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    for r, c in zip(part, nearest_cells(unit[part].astype(np.float32), first, second)):
                        cells[r] = c.tolist()
            raw = np.array(pdf["vec"].tolist(), np.float32)
            yield pd.DataFrame({"view_name": pdf["view_name"], "class_id": pdf["class_id"], "packed": [v.tobytes() for v in raw], "code": [c.tobytes() for c in code], "scalar": scalar.astype(np.float64), "cells": cells})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``view_name, entity_id, vec``: one vector per view and entity; null, empty, all-zero ones, those of another length or with a null or non-finite value take no part."""
    whole = F.transform("vec", lambda x: x.cast("float"))
    return (
        vectors.where("entity_id is not null and view_name is not null and vec is not null")
        .where((F.size("vec") == DIMENSION) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
        .groupBy("view_name", "entity_id")
        .agg(F.max(whole).alias("vec"))
    )


def nearest_entities(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``view_name, entity_id, near_id, place``: the ``k`` most similar entities of each by cosine, equal ones by smaller id.

    Entities sharing a vector are one class, of which the ``k + 1`` smallest ids can be neighbours at that cosine; so copies of
    one vector, however many, cost one search. With at most ``PROBES`` cells the search is exact but for the error bound.
    """
    spark = vectors.sparkSession
    members = materialise(usable(vectors).withColumn("class_id", F.xxhash64("view_name", "vec")))
    classes = materialise(members.groupBy("view_name", "class_id").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n")))
    centres = {}
    for row in classes.groupBy("view_name").count().collect():
        sample = np.array([r.vec for r in classes.where(F.col("view_name") == row.view_name).orderBy(F.xxhash64("class_id")).limit(FIT_ROWS).select("vec").collect()], np.float64)
        sample /= np.linalg.norm(sample, axis=1)[:, None]
        centres[row.view_name] = codebooks(sample, row["count"])
    shared = spark.sparkContext.broadcast(centres)
    coded = materialise(classes.mapInPandas(_assign(shared), "view_name string, class_id long, packed binary, code binary, scalar double, cells array<int>"))
    home = coded.withColumn("cell", F.col("cells")[0])
    row = ["view_name", "cell", "class_id", "packed", "code", "scalar"]
    asked = home.groupBy("view_name", "cell").agg(F.ceil(F.count(F.lit(1)) / ASKING_ROWS).cast("int").alias("asking"))
    placed = coded.select("*", F.posexplode("cells").alias("rank", "cell"))
    kept = placed.groupBy("view_name", "cell").agg(F.ceil(F.count(F.lit(1)) / STORED_ROWS).cast("int").alias("storing"))
    # a cell is a grid of parts: a row is stored in one column of them, and asks in one row of its nearest cell's
    placed = placed.join(small(asked.join(kept, ["view_name", "cell"])), ["view_name", "cell"])
    i, j = F.pmod(F.xxhash64("class_id"), F.col("asking")).cast("int"), F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("storing")).cast("int")
    stored = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(True).alias("stored"), ((F.col("rank") == 0) & (x == i)).alias("asks")))
    asks = F.when(F.col("rank") == 0, F.transform(F.filter(F.sequence(F.lit(0), F.col("storing") - 1), lambda y: y != j), lambda y: F.struct(i.alias("i"), y.alias("j"), F.lit(False).alias("stored"), F.lit(True).alias("asks"))))
    spread = placed.select(*row, F.explode(F.concat(stored, F.coalesce(asks, F.array()))).alias("at")).select(*row, "at.*")
    near = spread.groupBy("view_name", "cell", "i", "j").applyInPandas(_cell(k), "class_id long, near_id long, cosine double")
    near = materialise(near)
    small_ids = members.select("class_id", "entity_id", "view_name", F.row_number().over(Window.partitionBy("class_id").orderBy("entity_id")).alias("no")).where(F.col("no") <= k + 1)
    small_ids = materialise(small_ids)
    # classes of one member and of many: neighbours as (cosine, id) lists per class, then per member without itself
    outside = near.join(small_ids.select(F.col("class_id").alias("near_id"), F.col("entity_id").alias("other")), "near_id").select("class_id", "cosine", "other")
    inside = small_ids.join(classes.where("n > 1").select("class_id"), "class_id", "left_semi").select("class_id", F.lit(1.0).alias("cosine"), F.col("entity_id").alias("other"))
    order = Window.partitionBy("class_id").orderBy(F.desc("cosine"), "other")
    ranked = outside.unionByName(inside).withColumn("no", F.row_number().over(order)).where(F.col("no") <= k + 1).select("class_id", "cosine", "other", "no")
    lists = ranked.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("no", "other"))).alias("near"))
    own = F.filter("near", lambda x: x["other"] != F.col("entity_id"))
    return members.select("view_name", "entity_id", "class_id").join(lists, "class_id").select("view_name", "entity_id", F.posexplode(F.slice(own, 1, k)).alias("place", "x")).select("view_name", "entity_id", F.col("x.other").alias("near_id"), "place")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_entities(table(spark, sf_dir, "record_vectors"))
    return near.select("view_name", F.least("entity_id", "near_id").alias("id_a"), F.greatest("entity_id", "near_id").alias("id_b")).distinct()
