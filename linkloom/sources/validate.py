"""Checks of output files as the reader of them would make: on raw lines, as counts per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkloom.operators import windows

REPORT = "level string, rule string, n bigint, example string"


def _rule(df: DataFrame, level: str, rule: str, bad: Column, example: Column) -> DataFrame:
    return df.agg(F.count(F.when(bad, 1)).alias("n"), F.min(F.when(bad, example.cast("string"))).alias("example")).select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), "n", "example")


def raw_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files that begin with a byte-order mark or have carriage returns, which a text reader hides. Lines are read one by one, so a file may be of any size."""
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.csv").text(path).select("value", F.input_file_name().alias("file"))
    marks = lines.groupBy("file").agg(F.max(F.startswith("value", F.lit("\ufeff"))).alias("mark"), F.max(F.endswith("value", F.lit("\r"))).alias("cr"))
    return _rule(marks, "error", "byte order mark", F.col("mark"), F.col("file")).unionByName(_rule(marks, "warning", "carriage return", F.col("cr"), F.col("file")))


def list_file(lines: DataFrame, s1_ids: DataFrame, pool_ids: DataFrame) -> DataFrame:
    """Report on data lines (``value``): fields, repeated and unknown S1s, blanks, empties and quotes in lists, repeated, foreign and unknown ids, missing S1s."""
    parts = lines.select("value", F.split("value", "\t").alias("f"))
    rows = parts.where(F.size("f") == 2).select(F.col("f")[0].alias("s1"), F.col("f")[1].alias("ids"))
    items = rows.select("s1", F.explode(F.split("ids", ",")).alias("id")).where("id <> ''")
    raw = F.transform(F.split("ids", ","), lambda t: (t != F.trim(t)) | (t == ""))
    out = _rule(parts, "error", "fields", F.size("f") != 2, F.col("value"))
    out = out.unionByName(_rule(rows, "error", "blank, empty or quoted id", ((F.col("ids") != "") & F.exists(raw, lambda x: x)) | F.contains("ids", F.lit('"')), F.col("s1")))
    once = rows.groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(_rule(once, "error", "repeated S1", F.col("n") > 1, F.col("s1")))
    both = once.join(s1_ids.select(F.col("s1_id").alias("s1"), F.lit(True).alias("known")).distinct(), "s1", "full")
    out = out.unionByName(_rule(both, "error", "missing S1", F.col("n").isNull(), F.col("s1"))).unionByName(_rule(both, "error", "unknown S1", F.col("known").isNull(), F.col("s1")))
    twice = items.groupBy("s1", "id").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(_rule(twice, "error", "repeated id in a list", F.col("n") > 1, F.col("id"))).unionByName(_rule(items, "error", "id of another source", ~F.col("id").rlike("^S[23]-"), F.col("id")))
    seen = items.select(F.trim("id").alias("id")).distinct().join(pool_ids.select(F.col("cand_id").alias("id"), F.lit(True).alias("known")).distinct(), "id", "left")
    return out.unionByName(_rule(seen, "error", "unknown id", F.col("known").isNull(), F.col("id")))


def not_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that aren't candidates."""
    lost = matches.select("s1_id", "cand_id").join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    return _rule(lost, "error", "match not among candidates", F.lit(True), F.col("cand_id"))


def with_places(df: DataFrame, name: str = "_place") -> DataFrame:
    """Rows of text files with their number from 1, in the order of files and lines."""
    return windows.numbered(df.withColumn("_line", F.monotonically_increasing_id()), [], [F.asc("_line")], name).drop("_line")


def predictions(sub: DataFrame, sample: DataFrame, key: str, targets: list[str], nonnegative: bool = False, place: str | None = None, reorder: bool = False) -> DataFrame:
    """Report on a table of predictions, all strings, against a sample: columns, ids, their number and, by column ``place`` of both, their order (a warning with ``reorder``), values, ranges, and a summary per target.

    Missing target columns are reported and not looked into; without the key column only columns are.
    """
    spark = sub.sparkSession
    wanted = [c for c in [key, *targets] if c not in sub.columns]
    odd = [c for c in sub.columns if c.startswith(("Unnamed", "_c"))]
    columns = [("error", "unnamed column", len(odd), min(odd, default=None)), ("error", "missing column", len(wanted), min(wanted, default=None))]
    out = spark.createDataFrame(columns, REPORT)
    if key in wanted:
        return out
    ids = sub.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = ids.join(sample.select(F.col(key), F.lit(True).alias("known")).distinct(), key, "full")
    out = out.unionByName(_rule(ids, "error", "repeated id", F.col("n") > 1, F.col(key))).unionByName(_rule(ids, "error", "empty id", F.trim(F.coalesce(key, F.lit(""))) == "", F.col(key)))
    out = out.unionByName(_rule(both, "error", "missing id", F.col("n").isNull(), F.col(key))).unionByName(_rule(both, "error", "unexpected id", F.col("known").isNull(), F.col(key)))
    sizes = sub.agg(F.count(F.lit(1)).alias("a")).crossJoin(sample.agg(F.count(F.lit(1)).alias("b")))
    out = out.unionByName(_rule(sizes, "error", "row count", F.col("a") != F.col("b"), F.concat_ws(" instead of ", "a", "b")))
    if place:
        order = sub.select(key, F.col(place).alias("_a")).join(sample.select(key, F.col(place).alias("_b")), key)
        out = out.unionByName(_rule(order, "warning" if reorder else "error", "row order", F.col("_a") != F.col("_b"), F.col(key)))
    for c in [t for t in targets if t not in wanted]:
        v = F.trim(F.coalesce(F.col(c), F.lit("")))
        number = F.expr(f"try_cast(`{c}` as double)")
        out = out.unionByName(_rule(sub, "error", f"{c}: no finite value", F.lower(v).isin("", "nan", "none", "null", "inf", "-inf") | number.isNull() | F.isnan(number), v))
        if nonnegative:
            out = out.unionByName(_rule(sub, "error", f"{c}: negative", number < 0, v))
        same = sub.agg(F.countDistinct(v).alias("n"))
        out = out.unionByName(_rule(same, "warning", f"{c}: constant", F.col("n") == 1, F.lit(c)))
        figures = sub.agg(F.countDistinct(number).alias("n"), F.min(number).alias("low"), F.percentile_approx(number, 0.5).alias("middle"), F.max(number).alias("high"))
        out = out.unionByName(figures.select(F.lit("info").alias("level"), F.lit(f"{c}: summary").alias("rule"), "n", F.concat_ws(", ", F.concat(F.lit("min "), "low"), F.concat(F.lit("median "), "middle"), F.concat(F.lit("max "), "high")).alias("example")))
    return out
