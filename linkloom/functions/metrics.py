"""Metrics as aggregations: each takes a table and names of columns and gives one row with one value.

Missing predictions (null or NaN) raise, as a metric over part of the rows would mislead; see :func:`finite`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkloom.operators import windows

#: name -> (function, whether higher is better)
METRICS: dict[str, tuple[Callable, bool]] = {}


def metric(name: str, higher: bool):
    def put(f):
        METRICS[name] = (f, higher)
        return f

    return put


def get(name: str) -> tuple[Callable, bool]:
    """A metric by name; unknown names raise KeyError."""
    return METRICS[name]


def finite(c: str) -> Column:
    """The column as double; null, NaN and infinite values raise."""
    v = F.col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"{c} has missing or infinite values")).cast("double")).otherwise(v)


def _one(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.agg(value.alias(name))


@metric("smape", False)
def smape(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Percent, 0 to 200; a row of two zeros is no error."""
    a, f = finite(true), finite(pred)
    return _one(df, 100 * F.avg(F.coalesce(F.try_divide(F.abs(f - a), (F.abs(a) + F.abs(f)) / 2), F.lit(0.0))), "smape")


@metric("rmse", False)
def rmse(df: DataFrame, true: str, pred: str) -> DataFrame:
    return _one(df, F.sqrt(F.avg(F.pow(finite(true) - finite(pred), F.lit(2)))), "rmse")


@metric("mae", False)
def mae(df: DataFrame, true: str, pred: str) -> DataFrame:
    return _one(df, F.avg(F.abs(finite(true) - finite(pred))), "mae")


@metric("rmsle", False)
def rmsle(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Negative values raise."""
    log = lambda c: F.when(finite(c) < 0, F.raise_error(F.lit("rmsle of a negative value")).cast("double")).otherwise(F.log1p(finite(c)))
    return _one(df, F.sqrt(F.avg(F.pow(log(true) - log(pred), F.lit(2)))), "rmsle")


@metric("mape", False)
def mape(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Percent, over rows whose true value isn't zero."""
    return _one(df.where(F.col(true) != 0), 100 * F.avg(F.abs((finite(true) - finite(pred)) / finite(true))), "mape")


@metric("r2", True)
def r2(df: DataFrame, true: str, pred: str) -> DataFrame:
    """0 where the true values don't vary."""
    a = finite(true)
    spread = F.var_pop(a) * F.count(F.lit(1))
    return _one(df, F.coalesce(1 - F.try_divide(F.sum(F.pow(a - finite(pred), F.lit(2))), F.nullif(spread, F.lit(0.0))), F.lit(0.0)), "r2")


@metric("accuracy", True)
def accuracy(df: DataFrame, true: str, pred: str) -> DataFrame:
    return _one(df, F.avg((F.col(true) == F.col(pred)).cast("int")), "accuracy")


def _by_class(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Per class of either column: true, predicted and hit rows."""
    pairs = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("n_true"), F.lit(0).alias("n_pred"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("n_true"), F.col("n").cast("int").alias("n_pred"), F.lit(0).cast("bigint").alias("hit")))).alias("x")).select("x.*")
    return sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("n_true", "n_pred", "hit")))


@metric("f1_macro", True)
def f1_macro(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Mean over the classes of either column of 2 hits / (true + predicted)."""
    return _one(_by_class(df, true, pred), F.avg(2 * F.col("hit") / (F.col("n_true") + F.col("n_pred"))), "f1_macro")


@metric("f1_micro", True)
def f1_micro(df: DataFrame, true: str, pred: str) -> DataFrame:
    return _one(_by_class(df, true, pred), 2 * F.sum("hit") / (F.sum("n_true") + F.sum("n_pred")), "f1_micro")


@metric("auc", True)
def auc(df: DataFrame, true: str, score: str) -> DataFrame:
    """Exact area under the ROC curve from average ranks; null without both classes. Only distinct scores are ordered, with their counts, over range partitions."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(true).cast("bigint")).alias("pos"))
    upto = windows.running(counts, [], [F.asc("s")], upto=(F.sum, F.col("n")))
    ranked = upto.select("n", "pos", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    p, total = F.sum("pos"), F.sum("n")
    return _one(ranked, F.try_divide(F.sum(F.col("pos") * F.col("rank")) - p * (p + 1) / 2, p * (total - p)), "auc")


@metric("logloss", False)
def logloss(df: DataFrame, true: str, prob: str) -> DataFrame:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), finite(prob)))
    return _one(df, F.avg(F.when(F.col(true).cast("int") == 1, -F.log(p)).otherwise(-F.log(1 - p))), "logloss")


@metric("extraction_f1", True)
def extraction_f1(df: DataFrame, true: str, pred: str) -> DataFrame:
    """F1 of extracted strings: trimmed, exact, empty and null mean none; a wrong extraction is a false positive only."""
    t, p = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in (true, pred))
    tp, fp, fn = (F.count(F.when(x, 1)) for x in ((p != "") & (p == t), (p != "") & (p != t), (p == "") & (t != "")))
    return _one(df, F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)), "extraction_f1")


@metric("ndcg", True)
def ndcg(df: DataFrame, query: str, relevance: str, score: str) -> DataFrame:
    """Mean normalised discounted gain over queries; rows of one score share their places' mean gain. Queries without relevant rows count as 0."""
    rel = F.col(relevance).cast("double")
    tied = df.groupBy(query, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.avg(rel).alias("g"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(query).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gain = tied.withColumn("first", before).withColumn("d", F.aggregate(F.sequence(F.col("first") + 1, F.col("first") + F.col("n")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0)))
    ideal = df.groupBy(query, rel.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    best = ideal.withColumn("first", before).withColumn("d", F.aggregate(F.sequence(F.col("first") + 1, F.col("first") + F.col("n")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0)))
    both = gain.groupBy(query).agg(F.sum(F.col("g") * F.col("d")).alias("dcg")).join(best.groupBy(query).agg(F.sum(F.col("s") * F.col("d")).alias("idcg")), query)
    return _one(both, F.avg(F.coalesce(F.try_divide(F.col("dcg"), F.nullif(F.col("idcg"), F.lit(0.0))), F.lit(0.0))), "ndcg")


@metric("map_at_k", True)
def map_at_k(actual: DataFrame, predicted: DataFrame, query: str, item: str, place: str, k: int = 10) -> DataFrame:
    """Mean average precision over queries with actual items. ``predicted`` has places from 1; of an item predicted twice the first place counts."""
    first = predicted.where(F.col(place) <= k).groupBy(query, item).agg(F.min(place).alias("at"))
    hits = first.join(actual.select(query, item).distinct(), [query, item])
    run = F.row_number().over(Window.partitionBy(query).orderBy("at"))
    gained = hits.withColumn("precision", run / F.col("at")).groupBy(query).agg(F.sum("precision").alias("gained"))
    sizes = actual.select(query, item).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    return _one(sizes.join(gained, query, "left"), F.coalesce(F.avg(F.coalesce("gained", F.lit(0.0)) / F.least(F.col("n"), F.lit(k))), F.lit(0.0)), "map_at_k")


def several(df: DataFrame, names: list[str], true: str, pred: str) -> DataFrame:
    """``metric, value, higher_is_better`` for several metrics of the same columns."""
    out = None
    for name in names:
        f, higher = get(name)
        row = f(df, true, pred).select(F.lit(name).alias("metric"), F.col(name).alias("value"), F.lit(higher).alias("higher_is_better"))
        out = row if out is None else out.unionByName(row)
    return out
