"""Monitoring of a table or stream of events: what a watchdog does on each beat, in batch and as a stream.

In batch the order of a run's events is by time and id; running figures don't gather a run in one task. Streams keep
bounded state per key and take late rows as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.operators import windows
from linkloom.sources.files import scratch

#: Minutes without a beat that are stale, minutes idle that alert, value under which a run idles, minutes an alert is held back, factor over the least value that diverges, beats before which nothing diverges.
STALE_MIN, IDLE_MIN, IDLE_BELOW, HOLD_MIN, DIVERGE, DIVERGE_FROM = 10, 10, 5.0, 30, 3.0, 100
#: Crash signatures in logs.
SIGNATURES = {
    "oom": "(?i)CUDA out of memory|OutOfMemoryError|CUBLAS_STATUS_ALLOC_FAILED|MemoryError",
    "traceback": "(?m)^Traceback \\(most recent call last\\)",
    "cuda_error": "(?i)CUDA error|device-side assert|illegal memory access|NCCL error",
    "killed": "(?m)^Killed$",
}
#: Steps and seconds between two written states of a run.
EVERY_STEPS, EVERY_SECONDS = 50, 30.0

_ORDER = ("ts", "event_id")


def _order():
    return [F.asc(c) for c in _ORDER]


def beats(events: DataFrame, run: str = "event_type") -> DataFrame:
    """Each event with its number in its run and the least and greatest value so far."""
    made = windows.running(events, [run], _order(), step=(F.sum, F.lit(1)), best_min=(F.min, F.col("value")), best_max=(F.max, F.col("value")))
    return made


def stale(events: DataFrame, run: str, minutes: float = STALE_MIN) -> DataFrame:
    """Gaps above ``minutes`` between neighbouring events of a run."""
    made = windows.numbered(events.select(run, *_ORDER), [run], _order(), "_n")
    before = made.select(run, (F.col("_n") + 1).alias("_n"), F.col("ts").alias("before"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    return made.join(before, [run, "_n"]).withColumn("gap_s", (gap / 1_000_000).cast("double")).where(F.col("gap_s") > minutes * 60).select(run, "event_id", "gap_s")


def diverging(events: DataFrame, run: str = "event_type", factor: float = DIVERGE, after: int = DIVERGE_FROM) -> DataFrame:
    """Events whose value is above ``factor`` times the least positive value so far, from step ``after`` on."""
    return beats(events, run).where((F.col("step") >= after) & (F.col("best_min") > 0) & (F.col("value") > factor * F.col("best_min")))


def idle(events: DataFrame, run: str, below: float = IDLE_BELOW, minutes: float = IDLE_MIN) -> DataFrame:
    """Stretches of a run in which every value is below the bar, at least ``minutes`` long: ``run, from_ts, to_ts, n``. Any active event ends a stretch."""
    active = (F.col("value") >= below).cast("long")
    made = windows.running(events, [run], _order(), island=(F.sum, active)).where(F.col("value") < below)
    islands = made.groupBy(run, "island").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count(F.lit(1)).alias("n"))
    length = F.unix_micros(F.col("to_ts").cast("timestamp")) - F.unix_micros(F.col("from_ts").cast("timestamp"))
    return islands.where(length > minutes * 60_000_000).select(run, "from_ts", "to_ts", "n")


def stream_of(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table's file as a stream, with ``ts`` as an instant, which watermarks need."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All that a stream gives for what is there now; exactly once, by a table per batch on shared storage. In complete mode the last batch holds."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    found = spark.read.parquet(out)
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")


def counted_windows(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Events and values per window and type; works on tables and streams."""
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _in_order(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """A key's rows of one micro-batch by time and id; held are only these columns, as arrays, for as many rows as the source puts into a micro-batch."""
    parts = [[b[c].to_numpy() for c in ("ts", "event_id", *columns)] for b in batches]
    whole = [np.concatenate(x) for x in zip(*parts)]
    for k in np.lexsort((whole[1], whole[0])):
        yield (pd.Timestamp(whole[0][k]), *(x[k] for x in whole[1:]))


def held_back(events: DataFrame, key: str, minutes: float = HOLD_MIN, once: bool = False) -> DataFrame:
    """Alerts that are sent: of one key none within ``minutes`` of the last one sent, or none ever again with ``once``. Stateful: per key the time last sent.

    Rows of one batch are taken in order of time; a row older than the last one sent is held back. On a stream with a watermark a key's
    state is dropped when its hold is over, except with ``once``.
    """
    hold = pd.Timedelta(minutes=minutes)
    timed = events.isStreaming and not once and any("spark.watermarkDelayMs" in f.metadata for f in events.schema.fields)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        sent = []
        for ts, event in _in_order(batches):
            ts = ts.tz_localize(None) if ts.tzinfo else ts
            if last is None or (not once and ts - last >= hold):
                last = ts
                sent.append((keys[0], event, ts))
        if last is not None:
            state.update((int(last.value // 1000),))
            if timed:
                state.setTimeoutTimestamp(max(int((last + hold).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(sent, columns=[key, "event_id", "ts"])

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return events.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(step, f"{key} string, event_id long, ts timestamp", "last long", "append", timeout)


def written_states(events: DataFrame, key: str, total_steps: int | None = None, every_steps: int = EVERY_STEPS, every_seconds: float = EVERY_SECONDS) -> DataFrame:
    """The states of a run that a throttled heartbeat writes: ``key, event_id, step, value_min, nan, per_second, eta_s``.

    An event is a step. It is written if ``every_steps`` steps or ``every_seconds`` seconds have passed since the last written one, at once if its value is
    null, NaN or infinite, which then never enters the least value. The rate is steps over seconds since the last
    measured state, the remaining time follows from ``total_steps``. Stateful, a few numbers per run.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, low, wrote, wrote_at, rate_n, rate_at = state.get if state.exists else (0, None, None, None, 0, None)
        out = []
        for ts, event, value in _in_order(batches, "value"):
            n, now = n + 1, ts.timestamp()
            rate_at = now if rate_at is None else rate_at
            broken = value is None or not np.isfinite(value)
            rate = eta = None
            if not broken:
                low = float(value) if low is None else min(low, float(value))
                if wrote is not None and n - wrote < every_steps and now - wrote_at < every_seconds:
                    continue
                if now > rate_at and n > rate_n:
                    rate = (n - rate_n) / (now - rate_at)
                    eta = max(0, total_steps - n) / rate if total_steps else None
                    rate_n, rate_at = n, now
            wrote, wrote_at = n, now
            out.append((keys[0], event, n, low, broken, rate, eta))
        state.update((n, low, wrote, wrote_at, rate_n, rate_at))
        yield pd.DataFrame(out, columns=[key, "event_id", "step", "value_min", "nan", "per_second", "eta_s"])

    schema = f"{key} string, event_id long, step long, value_min double, nan boolean, per_second double, eta_s double"
    return events.select(key, "event_id", "ts", "value").groupBy(key).applyInPandasWithState(step, schema, "n long, low double, wrote long, wrote_at double, rate_n long, rate_at double", "append", GroupStateTimeout.NoTimeout)


def status(events: DataFrame, run: str, ends: dict[str, str], exits: DataFrame | None = None, alive: DataFrame | None = None) -> DataFrame:
    """How each run stands: ``run, status``.

    The kind of its latest event names an end by ``ends``; else a row in ``exits`` (``run, returncode``) makes it ``exited rc=N``; else it ``died`` if
    ``alive`` (``run, alive``) says so, else it is running. The state decides, not the order in which rows arrive. Of several exits the greatest code holds.
    """
    last = events.groupBy(run).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    ended = F.coalesce(*(F.when(F.col("x.event_type") == kind, F.lit(end)) for kind, end in ends.items()), F.lit(None).cast("string"))
    none = last.sparkSession.createDataFrame([], f"{run} {dict(events.dtypes)[run]}, returncode int, alive boolean")
    gone = (exits if exits is not None else none).groupBy(run).agg(F.max("returncode").alias("_rc"))
    lives = (alive if alive is not None else none).groupBy(run).agg(F.max("alive").alias("_alive"))
    made = last.join(gone, run, "left").join(lives, run, "left")
    return made.select(run, F.coalesce(ended, F.when(F.col("_rc").isNotNull(), F.concat(F.lit("exited rc="), F.col("_rc").cast("string"))), F.when(~F.col("_alive"), F.lit("died")), F.lit("running")).alias("status"))


def log_hits(lines: DataFrame, column: str) -> DataFrame:
    """``signature, n``: lines with each crash signature, in one pass. On a stream only new lines are read, and counts go on."""
    hit = F.explode(F.filter(F.array(*(F.when(F.col(column).rlike(p), F.lit(n)) for n, p in SIGNATURES.items())), lambda x: x.isNotNull())).alias("signature")
    return lines.select(hit).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
