"""Queries of monitoring, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.plans.registry import query
from linkloom.runtime import table
from linkloom.sources import files
from linkloom.streaming import monitor


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


query("mon_heartbeat", "select event_id, count(*) over w as step, round(min(value) over w, 6) as best_min, round(max(value) over w, 6) as best_max from events window w as (partition by event_type order by ts, event_id rows unbounded preceding)")(
    lambda spark, d: monitor.beats(_events(spark, d)).select("event_id", "step", F.round("best_min", 6).alias("best_min"), F.round("best_max", 6).alias("best_max"))
)
query("mon_stale", "with g as (select user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1000000 as gap_s from events) select user_id, event_id, round(gap_s, 3) as gap_s from g where gap_s > 600")(
    lambda spark, d: monitor.stale(_events(spark, d), "user_id").withColumn("gap_s", F.round("gap_s", 3))
)
query("mon_diverge", "with r as (select event_id, value, count(*) over w as step, min(value) over w as low from events window w as (partition by event_type order by ts, event_id rows unbounded preceding)) select event_id, step from r where step >= 100 and low > 0 and value > 3 * low")(lambda spark, d: monitor.diverging(_events(spark, d)).select("event_id", "step"))
query(
    "mon_idle",
    "with a as (select *, sum((value >= 5)::int) over (partition by event_type order by ts, event_id rows unbounded preceding) as island from events), i as (select event_type, min(ts) as from_ts, max(ts) as to_ts, count(*)::bigint as n from a where value < 5 group by event_type, island) select * from i where epoch_us(to_ts) - epoch_us(from_ts) > 600000000",
)(lambda spark, d: monitor.idle(_events(spark, d), "event_type"))
_ENDS = {"purchase": "completed", "error": "failed"}


@query(
    "mon_terminal",
    "with l as (select user_id, arg_max(event_type, (ts, event_id, event_type)) as last, max(ts) as seen, max(case when event_type = 'signup' and value < 5 then floor(value)::int end) as rc from events group by user_id) "
    "select user_id, case when last = 'purchase' then 'completed' when last = 'error' then 'failed' when rc is not null then 'exited rc=' || rc when epoch_us(seen) < (select epoch_us(max(ts)) from events) - 86400000000 then 'died' else 'running' end as status from l",
)
def mon_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final states: by the last event, by an exit (low sign-ups stand for exit codes), by silence for a day, else running."""
    e = _events(spark, sf_dir)
    exits = e.where("event_type = 'signup' and value < 5").select("user_id", F.floor("value").cast("int").alias("returncode"))
    now = e.agg(F.max("ts").alias("now"))
    alive = e.groupBy("user_id").agg(F.max("ts").alias("at")).crossJoin(F.broadcast(now)).select("user_id", (F.unix_micros(F.col("at").cast("timestamp")) >= F.unix_micros(F.col("now").cast("timestamp")) - 86_400_000_000).alias("alive"))
    return monitor.status(e, "user_id", _ENDS, exits, alive)


_LOG = "select case event_type when 'error' then 'RuntimeError: cuda error: device-side assert, event ' || event_id when 'purchase' then 'Killed' when 'signup' then 'Traceback (most recent call last):' when 'view' then 'torch.OutOfMemoryError: event ' || event_id else 'step ' || event_id || ', not Killed' end as value from events"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    line = F.when(kind == "error", F.concat(F.lit("RuntimeError: cuda error: device-side assert, event "), "event_id")).when(kind == "purchase", "Killed").when(kind == "signup", "Traceback (most recent call last):").when(kind == "view", F.concat(F.lit("torch.OutOfMemoryError: event "), "event_id"))
    return _events(spark, sf_dir).select(line.otherwise(F.concat(F.lit("step "), "event_id", F.lit(", not Killed"))).alias("value"))


_HITS = f"with lines as ({_LOG}), s as (select unnest(['oom', 'traceback', 'cuda_error', 'killed']) as signature, unnest(['(?i)CUDA out of memory|OutOfMemoryError|CUBLAS_STATUS_ALLOC_FAILED|MemoryError', '(?m)^Traceback \\(most recent call last\\)', '(?i)CUDA error|device-side assert|illegal memory access|NCCL error', '(?m)^Killed$']) as p) select signature, count(*)::bigint as n from s, lines where regexp_matches(value, p) group by 1"
query("mon_logscan", _HITS)(lambda spark, d: monitor.log_hits(_log(spark, d), "value"))


@query("mon_logscan_stream", _HITS)
def mon_logscan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan of a log that is written in two parts: the stream reads each part once and counts on."""
    path = files.scratch(spark, "log")
    for even in (True, False):
        _log(spark, sf_dir).where((F.length("value") % 2 == 0) == even).write.mode("append").text(path)
    return monitor.drained(monitor.log_hits(spark.readStream.option("maxFilesPerTrigger", 4).text(path), "value"), "complete", "hits")


@query("mon_csv", "select event_type, count(*)::bigint as n, round(max(value), 6) as top from events group by 1")
def mon_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot rows appended to a table of text and read back."""
    path = files.scratch(spark, "watch")
    snap = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("top"))
    for odd in (True, False):
        snap.where((F.length("event_type") % 2 == 1) == odd).write.mode("append").csv(path, header=True)
    return spark.read.csv(path, header=True, schema="event_type string, n bigint, top double")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.stream_of(spark, sf_dir, "events", _events(spark, sf_dir).schema)


@query("mon_stream_windows", "select epoch_us(date_trunc('day', ts))::bigint as day_us, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2")
def mon_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of the stream in complete mode: equal to the batch."""
    flat = monitor.counted_windows(_stream(spark, sf_dir).withWatermark("ts", "1 hour")).select(F.unix_micros("w.start").alias("day_us"), "event_type", "n", F.round("total", 4).alias("total"))
    return monitor.drained(flat, "complete", "windows")


@query("mon_dedup")
def mon_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts per type with repeats held back for half an hour, by state in a stream."""
    return monitor.drained(monitor.held_back(_stream(spark, sf_dir).withWatermark("ts", "1 hour"), "event_type"), "append", "alerts")


@query("mon_heartbeat_written")
def mon_heartbeat_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which beats of each type a throttled heartbeat writes, with rate and remaining time to ten thousand steps."""
    made = monitor.drained(monitor.written_states(_stream(spark, sf_dir), "event_type", 10_000), "append", "states")
    return made.withColumns({c: F.round(c, 6) for c in ("value_min", "per_second", "eta_s")})


@query("mon_sessions")
def mon_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users by gaps of half an hour, as a stream in append mode: sessions that the watermark has closed."""
    s = _stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return monitor.drained(s.select("user_id", "w.start", "w.end", "n"), "append", "sessions")
