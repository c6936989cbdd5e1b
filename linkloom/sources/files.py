"""Exact text files of records, matches and candidates: scans, sinks, discovery and checks."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from linkloom.runtime import fresh

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
MATCH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
CANDIDATE = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "candidate_entity_ids")])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on the shared scratch storage."""
    return fresh(spark, name)


def scan_tsv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated text as it stands: no quotes, no escapes, every field a string, empty fields ``""``, never null.

    The schema is given, never inferred, so ``007`` stays ``007``. With ``columns`` only those are parsed.
    """
    read = spark.read.csv(path, schema=schema, sep="\t", quote="", escape="", header=True, enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns or schema.fieldNames()))


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Tab-separated text without quotes; line ends and tabs inside fields become spaces. Several files unless one is asked for."""
    flat = df.select(*(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\\t\\r\\n]", " ").alias(c) for c in df.columns))
    (flat.coalesce(1) if one_file else flat).write.csv(path, sep="\t", quote="", escape="", header=True, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def complete(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``n_rows, n_lines, complete``: data rows against lines less one header per file."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))
    rows = scan_tsv(spark, path, schema).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.crossJoin(F.broadcast(lines)).select("n_rows", (F.col("n") - F.col("files")).alias("n_lines"), (F.col("n_rows") == F.col("n") - F.col("files")).alias("complete"))


def discover(spark: SparkSession, folder: str, suffix: str) -> str:
    """The one path of ``folder`` that ends with ``suffix``; none or several raise FileNotFoundError."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    found = sorted(str(s.getPath()) for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path) if PurePosixPath(str(s.getPath())).name.endswith(suffix))
    if len(found) != 1:
        raise FileNotFoundError(f"expected exactly one *{suffix} in {folder}, found {found}")
    return found[0]


def match_lists(decided: DataFrame, s1s: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row per S1, with its sorted ids in a comma list, empty for an S1 without any."""
    lists = decided.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(name))
    return s1s.select("s1_id").distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def truth_pairs(lists: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """Comma lists as pairs, ids trimmed, without empties and repeats; S1s without ids have no pair."""
    ids = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != ""))
    return lists.select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids).alias("cand_id"))
