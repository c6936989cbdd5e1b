"""Queries of scans, sinks, validators, data profile and gates."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from linkloom.functions import similarity as sim, text
from linkloom.operators import decide, sampling, windows
from linkloom.plans import views
from linkloom.plans.q_decide import reviewed
from linkloom.plans.q_relational import average_ranks
from linkloom.plans.registry import query
from linkloom.plans.views import FOLD, LAB, NF, P, PF, REC, TRUTH, VEC
from linkloom.runtime import materialise, table
from linkloom.sources import files, validate

_FLAT = "regexp_replace({}, '[\\t\\r\\n]', ' ', 'g')"
_REC4 = f"select entity_id, {_FLAT.format('business_name')} as business_name, {_FLAT.format('business_address')} as business_address, country from rec where source = '{{}}'"


def _written(spark: SparkSession, sf_dir: str, source: str = "S1") -> str:
    path = files.scratch(spark, f"{source}.tsv")
    files.write_tsv(views.records(spark, sf_dir).where(F.col("source") == source).select("entity_id", "business_name", "business_address", "country"), path)
    return path


query("io_tsv_scan", f"with {REC} " + _REC4.format("S1"))(lambda spark, d: files.scan_tsv(spark, _written(spark, d), files.RECORD))
query("io_tsv_scan2", f"with {REC} select entity_id, country from rec where source = 'S2'")(lambda spark, d: files.scan_tsv(spark, _written(spark, d, "S2"), files.RECORD, ["entity_id", "country"]))
query("io_rowcount_check", f"with {REC} select count(*)::bigint as n_rows, count(*)::bigint as n_lines, true as complete from rec where source = 'S1'")(lambda spark, d: files.complete(spark, _written(spark, d), files.RECORD))


@query("io_cache_build", f"with {REC} select source, count(*)::bigint as n, count(distinct country)::bigint as n_countries from rec where source in ('S1', 'S3') group by source")
def io_cache_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files to a columnar copy, partitioned by source; a reader of one source scans only its part."""
    both = files.scan_tsv(spark, _written(spark, sf_dir, "S1"), files.RECORD).withColumn("source", F.lit("S1")).unionByName(files.scan_tsv(spark, _written(spark, sf_dir, "S3"), files.RECORD).withColumn("source", F.lit("S3")))
    return materialise(both, ["source"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("country").alias("n_countries"))


query("io_load", f"with {REC} select source, count(*)::bigint as n from rec group by source")(lambda spark, d: views.records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")))


@query("io_sources_glob", f"with {REC} select count(*)::bigint as n from rec where source = 'S3'")
def io_sources_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one file per source is found by its ending and read."""
    path = _written(spark, sf_dir, "S3")
    folder, name = path.rsplit("/", 1)
    return files.scan_tsv(spark, files.discover(spark, folder, name), files.RECORD).agg(F.count(F.lit(1)).alias("n"))


_LISTS = f"{TRUTH}, s1s as (select distinct s1_id from lab)"


def _truth_file(spark: SparkSession, sf_dir: str) -> str:
    path = files.scratch(spark, "truth.tsv")
    files.write_tsv(files.match_lists(views.truth(spark, sf_dir), reviewed(spark, sf_dir)), path)
    return path


query("io_gt_map", f"with {TRUTH} select s1_id, cand_id from truth")(lambda spark, d: files.truth_pairs(files.scan_tsv(spark, _truth_file(spark, d), files.MATCH)))


@query("io_chunk_scan", f"with {P} select s1_id, prob from p")
def io_chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files read as one table, two of three columns."""
    return materialise(views.pairs(spark, sf_dir).repartition(4, "s1_id")).select("s1_id", "prob")


@query("io_pushdown_scan", f"with {FOLD} select s1_id, cand_id, prob from scored_pairs where prob >= 0.9 and not isnan(prob) and s1_id in (select s1_id from fold where dev)")
def io_pushdown_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that reaches the parquet scan, and a membership filter as a semi-join."""
    dev = views.folds(spark, sf_dir).where("dev").select("s1_id")
    return table(spark, sf_dir, "scored_pairs").where((F.col("prob") >= 0.9) & ~F.isnan("prob")).select("s1_id", "cand_id", "prob").join(dev, "s1_id", "left_semi")


query("io_meta_count", "select count(*)::bigint as n from lineitem")(lambda spark, d: table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n")))


@query("io_npy", f"with {VEC}, {REC} select view_name, source, count(*)::bigint as n, min(len(vec))::bigint as dims from vec join rec using (entity_id) where source <> 'S1' group by 1, 2")
def io_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's vectors of both sources stacked, keyed by id instead of by row."""
    vecs = views.vectors(spark, sf_dir).join(views.records(spark, sf_dir).select("entity_id", "source"), "entity_id")
    pool = vecs.where("source = 'S2'").unionByName(vecs.where("source = 'S3'"))
    return materialise(pool).groupBy("view_name", "source").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).cast("bigint").alias("dims"))


_OWNED = "owned as (select * from p qualify row_number() over (partition by cand_id order by prob desc, s1_id) = 1)"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.keep(views.pairs(spark, sf_dir), 0.7)


@query("io_tsv_sink", f"with {P}, {REC}, {_OWNED}, l as (select s1_id, string_agg(cand_id, ',' order by cand_id) as ids from owned where prob >= 0.7 group by 1) select entity_id as source1_entity_id, coalesce(ids, '') as matched_entity_ids from rec left join l on s1_id = entity_id where source = 'S1'")
def io_tsv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided lists written, one row per S1, and read again."""
    path = files.scratch(spark, "matches.tsv")
    s1 = views.records(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    files.write_tsv(files.match_lists(_decided(spark, sf_dir), s1), path)
    return files.scan_tsv(spark, path, files.MATCH)


@query("io_csv_sink", f"with {P}, {FOLD} select s1_id as id, coalesce(max(prob), 0)::varchar as score from fold left join p using (s1_id) group by s1_id")
def io_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions aligned to a sample by id, written and read as text."""
    best = views.pairs(spark, sf_dir).groupBy("s1_id").agg(F.max("prob").alias("score"))
    path = files.scratch(spark, "predictions")
    views.folds(spark, sf_dir).select("s1_id").join(best, "s1_id", "left").select(F.col("s1_id").alias("id"), F.coalesce("score", F.lit(0.0)).cast("string").alias("score")).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="id string, score string").select("id", F.format_string("%s", F.col("score")).alias("score"))


query("io_probe_empty", f"with {REC} select entity_id as source1_entity_id, '' as matched_entity_ids from rec where source = 'S1'")(
    lambda spark, d: files.match_lists(views.truth(spark, d).limit(0), views.records(spark, d).where("source = 'S1'").select(F.col("entity_id").alias("s1_id")))
)


@query("io_probe_country", f"with {P}, {REC}, {_OWNED}, l as (select s1_id, string_agg(cand_id, ',' order by cand_id) as ids from owned where prob >= 0.7 group by 1) select entity_id as source1_entity_id, case when country = 'France' then '' else coalesce(ids, '') end as matched_entity_ids from rec left join l on s1_id = entity_id where source = 'S1'")
def io_probe_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1 = views.records(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "country")
    lists = files.match_lists(_decided(spark, sf_dir), s1).join(s1.withColumnRenamed("s1_id", "source1_entity_id"), "source1_entity_id")
    return lists.select("source1_entity_id", F.when(F.col("country") == "France", "").otherwise(F.col("matched_entity_ids")).alias("matched_entity_ids"))


def cached_frame(spark: SparkSession, path: str, settings: dict, build) -> DataFrame:
    """The table at ``path`` if its settings are these, else built and written with them; other settings at the path raise ValueError."""
    mine = json.dumps(settings, sort_keys=True)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{path}/_settings")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        found = spark.read.text(f"{path}/_settings").first()[0]
        if found != mine:
            raise ValueError(f"{path} was built with {found}, not {mine}")
    else:
        build().write.parquet(f"{path}/data")
        spark.createDataFrame([(mine,)], "value string").coalesce(1).write.text(f"{path}/_settings")
    return spark.read.parquet(f"{path}/data")


@query("io_frame_cache", f"with {P} select s1_id, count(*)::bigint as n from p group by s1_id")
def io_frame_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built once under its settings; the second call reads it."""
    path = files.scratch(spark, "frame")
    build = lambda: views.pairs(spark, sf_dir).groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    cached_frame(spark, path, {"k": 15}, build)
    return cached_frame(spark, path, {"k": 15}, build)


@query("io_atomic", f"with {REC} select source, count(*)::bigint as n from rec group by source")
def io_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written one by one under the commit protocol; a part whose success mark stands is skipped when run again."""
    path = files.scratch(spark, "parts")
    rec = views.records(spark, sf_dir)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for source in ("S1", "S2", "S1", "S3"):
        mark = hadoop.Path(f"{path}/source={source}/_SUCCESS")
        if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            rec.where(F.col("source") == source).drop("source").write.parquet(f"{path}/source={source}")
    return spark.read.parquet(path).groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("io_oof", f"with {P}, {FOLD}, b as (select s1_id, max(prob) as best, avg(prob) as mean from p group by 1) select s1_id as id, fold, best as pred_best, round(mean, 9) as pred_mean from fold join b using (s1_id)")
def io_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of two experiments side by side; ids or folds that differ raise."""
    b = views.pairs(spark, sf_dir).groupBy("s1_id").agg(F.max("prob").alias("best"), F.avg("prob").alias("mean"))
    base = views.folds(spark, sf_dir).join(b, "s1_id").select(F.col("s1_id").alias("id"), "fold", "best", "mean")
    long = materialise(base.select("id", "fold", F.explode(F.create_map(F.lit("best"), "best", F.lit("mean"), "mean")).alias("experiment", "pred")), ["experiment"])
    return stacked(long, ["best", "mean"]).select("id", "fold", "pred_best", F.round("pred_mean", 9).alias("pred_mean"))


def stacked(long: DataFrame, experiments: list[str]) -> DataFrame:
    """``id, fold, pred_<experiment>``: one row per id; an id that an experiment lacks, or has in another fold, raises."""
    wide = long.groupBy("id").agg(F.min("fold").alias("fold"), F.max("fold").alias("_fold"), *(F.max(F.when(F.col("experiment") == e, F.col("pred"))).alias(f"pred_{e}") for e in experiments), F.count(F.lit(1)).alias("_n"))
    bad = (F.col("fold") != F.col("_fold")) | (F.col("_n") != len(experiments))
    return wide.withColumn("fold", F.when(bad, F.raise_error(F.lit("experiments differ in ids or folds")).cast("int")).otherwise(F.col("fold"))).drop("_fold", "_n")


@query("io_synth")
def io_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded records of three sources with a noise model: the same rows in any partitioning."""
    return synthetic(spark, 2_000, 5)


def synthetic(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``entity_id, source, business_name, business_address, country`` of ``n`` businesses: all in S1, about 70 % also in S2 and 60 % in S3 with typos and missing addresses, and n/5 records in S2 that are nobody's."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    pick = lambda key, salt, of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(key, F.lit(salt + seed)), F.lit(len(of))) + 1).cast("int"))
    k = F.col("k")
    base = spark.range(n + n // 5).withColumnRenamed("id", "k").select("k", F.concat_ws(" ", pick(k, 1, words), pick(k, 2, words), pick(k, 3, ["motors", "foods", "textiles", "bakery"])).alias("name"), F.concat_ws(" ", (F.pmod(F.xxhash64(k, F.lit(4 + seed)), F.lit(999)) + 1).cast("string"), pick(k, 5, words), F.lit("street")).alias("address"), pick(k, 6, ["US", "India", "France"]).alias("country"))
    u = lambda salt: F.pmod(F.xxhash64("k", F.lit(salt + seed)), F.lit(1000)) / 1000
    source = F.explode(F.filter(F.array(F.when(k < n, "S1"), F.when((k >= n) | (u(10) < 0.7), "S2"), F.when((k < n) & (u(11) < 0.6), "S3")), lambda x: x.isNotNull()))
    rows = base.select("*", source.alias("source"))
    noisy = F.col("source") != "S1"
    return rows.select(F.concat("source", F.lit("-"), F.format_string("%08d", "k")).alias("entity_id"), "source", F.when(noisy & (u(12) < 0.4), text.typo(F.col("name"), seed)).otherwise(F.col("name")).alias("business_name"), F.when(noisy & (u(13) < 0.1), "").otherwise(F.col("address")).alias("business_address"), "country")


# validators ------------------------------------------------------------------------------------------------------------


@query("val_outputs")
def val_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on both output files of the decided pairs."""
    p, rec = views.pairs(spark, sf_dir), views.records(spark, sf_dir)
    s1 = rec.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    pool = rec.where("source <> 'S1'").select(F.col("entity_id").alias("cand_id"))
    kept, cand = _decided(spark, sf_dir), windows.first_rows(p, ["s1_id"], [F.desc("prob"), F.asc("cand_id")], 15)
    out = None
    for decided, name, schema in ((kept, "matched_entity_ids", files.MATCH), (cand, "candidate_entity_ids", files.CANDIDATE)):
        path = files.scratch(spark, name)
        files.write_tsv(files.match_lists(decided, s1, name), path)
        lines = spark.read.text(path).where(~F.col("value").startswith("source1_entity_id\t"))
        report = validate.list_file(lines, s1, pool).unionByName(validate.raw_bytes(spark, path)).withColumn("file", F.lit(name))
        out = report if out is None else out.unionByName(report)
    return out.unionByName(validate.not_subset(kept, cand).withColumn("file", F.lit("both")))


@query(
    "val_generic",
    f"with {P}, {FOLD}, s as (select fold.s1_id, round(max(prob), 6) as score from fold left join p using (s1_id) group by 1), r as (select 'score: no finite value' as rule, count(*) filter (where score is null)::bigint as n from s union all select 'score: summary', count(distinct score) from s) "
    "select * from r union all select unnest(['repeated id', 'empty id', 'missing id', 'unexpected id', 'score: negative', 'score: constant', 'unnamed column', 'missing column', 'row count', 'row order']), 0",
)
def val_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a file of predictions, written and read as text, against a sample file of the same ids in the same order."""
    best = views.pairs(spark, sf_dir).groupBy("s1_id").agg(F.round(F.max("prob"), 6).alias("score"))
    sample = views.folds(spark, sf_dir).select("s1_id")
    sub = sample.join(best, "s1_id", "left").select("s1_id", F.col("score").cast("string").alias("score"))
    read = []
    for df, name in ((sub, "predictions"), (sample.withColumn("score", F.lit("0")), "sample")):
        path = files.scratch(spark, name)
        df.orderBy("s1_id").write.csv(path, header=True)
        read.append(validate.with_places(spark.read.csv(path, header=True)))
    return validate.predictions(*read, "s1_id", ["score"], nonnegative=True, place="_place").select("rule", "n")


@query("gate_promote", f"with {P}, {LAB}, a as (select avg((prob >= 0.5) = y) as x from p join lab using (s1_id, cand_id)), b as (select avg(((prob >= 0.7) = y)::int) as x from p join lab using (s1_id, cand_id)) select 'accuracy' as metric, round((select avg(((prob >= 0.5) = y)::int) from p join lab using (s1_id, cand_id)), 6) as old, round((select x from b), 6) as new, (select x from b) >= (select avg(((prob >= 0.5) = y)::int) from p join lab using (s1_id, cand_id)) - 0.01 as passed")
def gate_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new run's metric against the old one's with a tolerance."""
    j = views.pairs(spark, sf_dir).join(views.labels(spark, sf_dir), ["s1_id", "cand_id"])
    right = lambda t: F.avg(((F.col("prob") >= t) == F.col("y")).cast("int"))
    return j.agg(right(0.5).alias("old"), right(0.7).alias("new")).select(F.lit("accuracy").alias("metric"), F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), (F.col("new") >= F.col("old") - 0.01).alias("passed"))


_SETS = "a as (select s1_id, cand_id from owned where prob >= 0.7), b as (select s1_id, cand_id from owned where prob >= 0.72)"


@query("val_identical", f"with {P}, {_OWNED}, {_SETS} select (select count(*) from (select * from a except all select * from b))::bigint as only_first, (select count(*) from (select * from b except all select * from a))::bigint as only_second")
def val_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that either of two tables has more often than the other."""
    a, b = (decide.keep(views.pairs(spark, sf_dir), t).select("s1_id", "cand_id") for t in (0.7, 0.72))
    count = lambda x, y, c: x.exceptAll(y).agg(F.count(F.lit(1)).alias(c))
    return count(a, b, "only_first").crossJoin(count(b, a, "only_second"))


@query("val_stats", f"with {P}, {REC}, {_OWNED}, l as (select s1_id, count(*) as n from owned where prob >= 0.7 group by 1), j as (select coalesce(n, 0) as n from rec left join l on s1_id = entity_id where source = 'S1') select count(*)::bigint as n_rows, round(avg((n = 0)::int), 6) as empty_share, round(avg(n), 6) as mean_ids, max(n)::bigint as max_ids from j")
def val_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _decided(spark, sf_dir).groupBy(F.col("s1_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    j = views.records(spark, sf_dir).where("source = 'S1'").select("entity_id").join(n, "entity_id", "left").fillna(0, ["n"])
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg((F.col("n") == 0).cast("int")), 6).alias("empty_share"), F.round(F.avg("n"), 6).alias("mean_ids"), F.max("n").alias("max_ids"))


# profile ---------------------------------------------------------------------------------------------------------------


@query("eda_sizes", "select source_tag, count(*)::bigint as n, round(avg((trim(coalesce(business_name, '')) = '')::int), 6) as empty_name, round(avg((trim(coalesce(business_address, '')) = '')::int), 6) as empty_address, (count(*) - count(distinct entity_id))::bigint as dup_ids, (count(*) - count(distinct (coalesce(business_name, ''), coalesce(business_address, ''))))::bigint as dup_rows from source_records group by 1")
def eda_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = lambda c: F.round(F.avg((F.trim(F.coalesce(c, F.lit(""))) == "").cast("int")), 6)
    rows = F.count(F.lit(1))
    texts = F.countDistinct(F.struct(F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))))
    return table(spark, sf_dir, "source_records").groupBy("source_tag").agg(rows.alias("n"), empty("business_name").alias("empty_name"), empty("business_address").alias("empty_address"), (rows - F.countDistinct("entity_id")).alias("dup_ids"), (rows - texts).alias("dup_rows"))


_PER_S1 = f"{TRUTH}, e as (select s1_id, count(truth.cand_id) as n, count(truth.cand_id) filter (where truth.cand_id like 'S2%') as n2, count(truth.cand_id) filter (where truth.cand_id like 'S3%') as n3 from (select distinct s1_id from lab) left join truth using (s1_id) group by 1)"


@query("eda_gt", f"with {_PER_S1} select count(*)::bigint as n_s1, round(avg((n = 0)::int), 6) as singleton, round(avg((n2 > 0 and n3 = 0)::int), 6) as only_s2, round(avg((n3 > 0 and n2 = 0)::int), 6) as only_s3, round(avg((n2 > 0 and n3 > 0)::int), 6) as both, (select count(*) from (select cand_id from truth group by 1 having count(*) > 1))::bigint as multi_owner from e")
def eda_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.truth(spark, sf_dir)
    n = lambda s: F.count(F.when(F.col("cand_id").startswith(s), 1))
    e = reviewed(spark, sf_dir).join(t, "s1_id", "left").groupBy("s1_id").agg(F.count("cand_id").alias("n"), n("S2").alias("n2"), n("S3").alias("n3"))
    share = lambda c, a: F.round(F.avg(c.cast("int")), 6).alias(a)
    made = e.agg(F.count(F.lit(1)).alias("n_s1"), share(F.col("n") == 0, "singleton"), share((F.col("n2") > 0) & (F.col("n3") == 0), "only_s2"), share((F.col("n3") > 0) & (F.col("n2") == 0), "only_s3"), share((F.col("n2") > 0) & (F.col("n3") > 0), "both"))
    multi = t.groupBy("cand_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("multi_owner"))
    return made.crossJoin(F.broadcast(multi))


query("eda_gt_distribution", f"with {_PER_S1} select least(n, 10)::bigint as n_matches, count(*)::bigint as n_s1 from e group by 1")(
    lambda spark, d: reviewed(spark, d).join(views.truth(spark, d), "s1_id", "left").groupBy("s1_id").agg(F.count("cand_id").alias("n")).groupBy(F.least(F.col("n"), F.lit(10)).cast("bigint").alias("n_matches")).agg(F.count(F.lit(1)).alias("n_s1"))
)


@query(
    "eda_country",
    f"with {REC}, {TRUTH}, n as (select country, count(*) filter (where source = 'S1')::bigint as n_s1, count(*) filter (where source <> 'S1')::bigint as n_pool from rec group by 1), "
    "r as (select distinct s1_id from lab), t as (select s1_id, count(*) as n from truth group by 1), s as (select country, round(avg((t.n is null)::int), 6) as singleton from r join rec on entity_id = r.s1_id left join t on t.s1_id = r.s1_id group by 1), "
    "x as (select a.country, round(avg((a.country <> b.country)::int), 6) as cross_share from truth join rec a on a.entity_id = s1_id join rec b on b.entity_id = cand_id group by 1) "
    "select country, n_s1, n_pool, round(n_pool / nullif(n_s1, 0), 6) as ratio, singleton, cross_share from n left join s using (country) left join x using (country)",
)
def eda_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per country: records, pool per S1, reviewed S1s without a match, and matches that lie in another country."""
    rec, t = views.records(spark, sf_dir), views.truth(spark, sf_dir)
    s1, pool = F.count(F.when(F.col("source") == "S1", 1)), F.count(F.when(F.col("source") != "S1", 1))
    made = rec.groupBy("country").agg(s1.alias("n_s1"), pool.alias("n_pool"), F.round(F.try_divide(pool, s1), 6).alias("ratio"))
    of = lambda k, c: rec.select(F.col("entity_id").alias(k), F.col("country").alias(c))
    share = lambda c, a: F.round(F.avg(c.cast("int")), 6).alias(a)
    n = t.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    alone = reviewed(spark, sf_dir).join(of("s1_id", "country"), "s1_id").join(n, "s1_id", "left").groupBy("country").agg(share(F.col("n").isNull(), "singleton"))
    cross = t.join(of("s1_id", "country"), "s1_id").join(of("cand_id", "_other"), "cand_id").groupBy("country").agg(share(F.col("country") != F.col("_other"), "cross_share"))
    return made.join(alone, "country", "left").join(cross, "country", "left")


query("eda_crosstab", f"with {REC}, {TRUTH} select a.country as s1_country, b.country as cand_country, count(*)::bigint as n from truth join rec a on a.entity_id = s1_id join rec b on b.entity_id = cand_id group by 1, 2")(
    lambda spark, d: views.truth(spark, d).join(views.records(spark, d).select(F.col("entity_id").alias("s1_id"), F.col("country").alias("s1_country")), "s1_id").join(views.records(spark, d).select(F.col("entity_id").alias("cand_id"), F.col("country").alias("cand_country")), "cand_id").groupBy("s1_country", "cand_country").agg(F.count(F.lit(1)).alias("n"))
)


_SCRIPT = "case when regexp_matches(business_name, '[\\x{0900}-\\x{097F}]') then 'devanagari' when regexp_matches(business_name, '[\\x{00C0}-\\x{024F}]') then 'latin_accented' when regexp_matches(business_name, '[^\\x00-\\x7f]') then 'other_non_ascii' else 'ascii' end"


@query("eda_scripts", f"with {REC}, s as (select source, country, {_SCRIPT} as script from rec) select source, country, script, count(*)::bigint as n, round(count(*) / sum(count(*)) over (partition by source, country), 6) as share from s group by 1, 2, 3")
def eda_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.records(spark, sf_dir).groupBy("source", "country", text.script(F.col("business_name")).alias("script")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source", "country")), 6))


@query("eda_similarity", f"with {PF}, {TRUTH}, j as (select l_country as country, substr(t.cand_id, 1, 2) as source, l_name_core = r_name_core as same, case when l_name_core = '' or r_name_core = '' then 0 else jaro_winkler_similarity(l_name_core, r_name_core) end as jw from truth t join (select l.entity_id, l.country as l_country, l.name_core as l_name_core from nf l) on entity_id = s1_id join (select r.entity_id as rid, r.name_core as r_name_core from nf r) on rid = t.cand_id) select country, source, count(*)::bigint as n, round(avg(same::int), 6) as exact_share, round(quantile_cont(jw, 0.5), 5) as jw_median, round(quantile_cont(jw, 0.1), 5) as jw_p10, round(quantile_cont(jw, 0.25), 5) as jw_p25, round(quantile_cont(jw, 0.9), 5) as jw_p90 from j group by 1, 2")
def eda_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the names of true pairs are, per country and source."""
    f = views.frames(spark, sf_dir)
    t = views.truth(spark, sf_dir).join(f.select(F.col("entity_id").alias("s1_id"), "country", F.col("name_core").alias("a")), "s1_id").join(f.select(F.col("entity_id").alias("cand_id"), F.col("name_core").alias("b")), "cand_id")
    made = sim.scored(t, "a", "b", ["jw"], "x").withColumn("source", F.substring("cand_id", 1, 2))
    return made.groupBy("country", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("exact_share"), F.round(F.percentile("x_jw", 0.5), 5).alias("jw_median"), *(F.round(F.percentile("x_jw", q / 100), 5).alias(f"jw_p{q}") for q in (10, 25, 90)))


def random_others(asked: DataFrame, pool: DataFrame, key: str, seed: int) -> DataFrame:
    """Each row of ``asked`` (``id`` and the key) with ``other``: the id of one row of the pool with the same key, drawn by a hash of the row's id. Keys without a pool give nothing."""
    placed = windows.numbered(pool.select(F.col("id").alias("other"), key), [key], [F.asc("other")], "_n")
    sizes = pool.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    drawn = asked.join(sizes, key).withColumn("_n", F.pmod(sampling.draw(seed, "id"), F.col("_size")) + 1)
    return drawn.join(placed, [key, "_n"]).drop("_n", "_size")


@query("eda_similarity_words")
def eda_similarity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-set ratios of true pairs' names per country and source, and of as many random pairs of one country."""
    f = views.frames(spark, sf_dir)
    name = lambda k, c: f.select(F.col("entity_id").alias(k), F.col("name_core").alias(c))
    t = views.truth(spark, sf_dir).join(f.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    rec = f.select(F.col("entity_id").alias("id"), "country")
    asked = rec.join(t.select(F.col("s1_id").alias("id")).distinct(), "id", "left_semi")
    chance = random_others(asked, rec.where("not startswith(id, 'S1')"), "country", 5).select(F.col("id").alias("s1_id"), F.col("other").alias("cand_id"), "country", F.lit("random").alias("kind"))
    both = t.select("s1_id", "cand_id", "country", F.substring("cand_id", 1, 2).alias("kind")).unionByName(chance)
    made = sim.scored(both.join(name("s1_id", "a"), "s1_id").join(name("cand_id", "b"), "cand_id"), "a", "b", ["tset"], "x")
    return made.groupBy("country", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x_tset"), 5).alias("mean"), *(F.round(F.percentile("x_tset", q / 100), 5).alias(f"p{q}") for q in (10, 25, 50, 90)))


@query("eda_address", f"with {REC} select source, country, count(*)::bigint as n, round(avg((trim(business_address) = '')::int), 6) as empty, round(avg(regexp_matches(business_address, '(^|[^0-9])[0-9]{{5}}($|[^0-9])')::int), 6) as five_digits, round(avg(regexp_matches(business_address, '(^|[^0-9])[0-9]{{6}}($|[^0-9])')::int), 6) as six_digits, round(avg(contains(lower(business_address), 'near')::int), 6) as near, round(avg(length(business_address) - length(replace(business_address, ',', ''))), 6) as commas from rec group by 1, 2")
def eda_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("business_address")
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return views.records(spark, sf_dir).groupBy("source", "country").agg(F.count(F.lit(1)).alias("n"), share(F.trim(a) == "", "empty"), share(a.rlike("(^|[^0-9])[0-9]{5}($|[^0-9])"), "five_digits"), share(a.rlike("(^|[^0-9])[0-9]{6}($|[^0-9])"), "six_digits"), share(F.contains(F.lower(a), F.lit("near")), "near"), F.round(F.avg(F.length(a) - F.length(F.replace(a, F.lit(","), F.lit("")))), 6).alias("commas"))


@query(
    "eda_leakage",
    f"with {REC}, {TRUTH}, {FOLD}, l as (select entity_id, epoch_us(min(loaded_at)) as at from source_records where entity_id is not null and loaded_at is not null group by 1), n as (select substr(s1_id, 4)::bigint as a, substr(cand_id, 4)::bigint as b from truth), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as x, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as y from n), "
    "m as (select c.at as a, d.at as b from truth join l c on c.entity_id = s1_id join l d on d.entity_id = cand_id), q as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as x, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as y from m), "
    "dv as (select distinct business_name from fold join rec on entity_id = s1_id where dev), o as (select distinct business_name from fold join rec on entity_id = s1_id where not dev) "
    "select round(corr(x, y), 6) as id_spearman, count(*)::bigint as n, (select count(*) from n where a = b)::bigint as same_number, (select round(corr(x, y), 6) from q) as arrival_spearman, (select count(*) - count(distinct substr(entity_id, 4)) from rec)::bigint as shared_numbers, (select round(avg((o.business_name is not null)::int), 6) from dv left join o using (business_name)) as name_reuse from r",
)
def eda_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether ids, arrival or names give true pairs away: rank correlations of id numbers and of times of first arrival, equal numbers, numbers used by several records, names of the development S1s that others have."""
    t, rec = views.truth(spark, sf_dir), views.records(spark, sf_dir)
    number = lambda c: F.substring(c, 4, 20).cast("bigint")
    n = t.select(number("s1_id").alias("a"), number("cand_id").alias("b"))
    at = table(spark, sf_dir, "source_records").where("entity_id is not null and loaded_at is not null").groupBy("entity_id").agg(F.unix_micros(F.min("loaded_at").cast("timestamp")).alias("at"))
    m = t.join(at.select(F.col("entity_id").alias("s1_id"), F.col("at").alias("a")), "s1_id").join(at.select(F.col("entity_id").alias("cand_id"), F.col("at").alias("b")), "cand_id").select("a", "b")
    ranked = lambda d: d.join(average_ranks(d, "a", "x"), "a").join(average_ranks(d, "b", "y"), "b")
    first = ranked(n).agg(F.round(F.corr("x", "y"), 6).alias("id_spearman"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same_number"))
    second = ranked(m).agg(F.round(F.corr("x", "y"), 6).alias("arrival_spearman"))
    shared = rec.agg((F.count(F.lit(1)) - F.countDistinct(F.substring("entity_id", 4, 20))).alias("shared_numbers"))
    named = views.folds(spark, sf_dir).select(F.col("s1_id").alias("entity_id"), "dev").join(rec.select("entity_id", "business_name"), "entity_id")
    other = named.where("not dev").select("business_name", F.lit(1).alias("_o")).distinct()
    reuse = named.where("dev").select("business_name").distinct().join(other, "business_name", "left").agg(F.round(F.avg(F.col("_o").isNotNull().cast("int")), 6).alias("name_reuse"))
    return first.crossJoin(F.broadcast(second)).crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(reuse))


query("eda_id_lengths", f"with {REC} select source, length(entity_id)::bigint as id_length, count(*)::bigint as n from rec group by 1, 2")(lambda spark, d: views.records(spark, d).groupBy("source", F.length("entity_id").cast("bigint").alias("id_length")).agg(F.count(F.lit(1)).alias("n")))
