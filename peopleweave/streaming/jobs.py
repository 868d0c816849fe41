"""Structured Streaming jobs. Every job takes and returns streaming DataFrames (or starts a query)."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from ..operators.aggregates import FEEDBACK_KINDS, candidate_state
from ..operators.common import best_row
from ..session import shared_folder as scratch_folder, stored
from ..sources.sinks import KeyedTable


# --- running -----------------------------------------------------------------------------
def _run(job: DataFrame, root: str, mode: str) -> None:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    query = (job.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _result(job: DataFrame, root: str) -> DataFrame:
    return job.sparkSession.read.schema(job.schema.add("batch", "long")).option("basePath", f"{root}/out").parquet(f"{root}/out/batch=*")


def run_available(stream: DataFrame, mode: str = "append", keys=()) -> DataFrame:
    """Process all data present and return what the sink holds.

    Every batch is written under its id, so a replayed batch overwrites itself and nothing appears twice.
    In update mode the newest batch of each key counts.
    """
    root = scratch_folder(stream.sparkSession, "stream")
    _run(stream, root, mode)
    out = _result(stream, root)
    if mode == "update":
        out = best_row(out, list(keys), F.col("batch"))
    return out.drop("batch")


def run_to_end(stream: DataFrame, job: Callable[[DataFrame], DataFrame], marker: dict, mode: str = "append") -> DataFrame:
    """Process all data present, then close what the watermark has left open, and return what the sink holds.

    ``job`` gets the stream joined by a second source, a folder for end markers. Once the data is processed a marker, a row with the values
    given (a time far behind all data, and what the job's filters ask for), is put there and the same query goes on from its checkpoint: the marker
    moves the watermark past every window that is open, so each comes out once. The marker's own window stays open and never comes out.
    """
    spark, schema = stream.sparkSession, stream.schema
    root = scratch_folder(spark, "stream")
    ends = f"{root}/ends"
    spark.createDataFrame([], schema).write.parquet(ends)
    ended = job(stream.unionByName(spark.readStream.schema(schema).parquet(ends)))
    _run(ended, root, mode)
    row = spark.range(1).select(*[F.lit(marker.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
    row.write.mode("append").parquet(ends)
    _run(ended, root, mode)
    return _result(ended, root).drop("batch")


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Stream over a Parquet file or folder of files. The last letter is globbed because the file source wants
    a pattern or a folder."""
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


# --- state and counters ----------------------------------------------------------------------
def viewer_state(events: DataFrame) -> DataFrame:
    """Candidate state per (viewer, person) as a running aggregation; the formula does not depend on arrival order."""
    return candidate_state(events)


def negative_windows(feedback: DataFrame, min_count: int = 3, delay: str = "1 day", length: str = "30 days", slide: str = "1 day") -> DataFrame:
    """Repeated negative reasons in sliding windows."""
    rows = feedback.withWatermark("created_at", delay).filter("sentiment = 'negative' AND reason_code IS NOT NULL")
    counts = rows.groupBy(F.window("created_at", length, slide), "user_id", "reason_code").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                                                         "user_id", "reason_code", "n")


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "kind", "n")


def viewer_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "viewer_id").agg(F.count(F.lit(1)).alias("n_events"))
    return s.select("viewer_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "n_events")


# --- upserts ------------------------------------------------------------------------------------
def upsert_stream(stream: DataFrame, table: KeyedTable, merge, checkpoint: str):
    """Merge every micro-batch into the partitions of a keyed table that it touches.

    A batch that is replayed after a crash is merged again, which changes nothing if ``merge`` keeps the newest or the first row of a key.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, merge)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def new_evidence(stream: DataFrame, keys=("person_id", "source", "evidence_hash"), ts: str = "created_at", delay: str = "7 days") -> DataFrame:
    """Insert-if-absent on a stream: repeats of a key inside the delay are dropped; state is freed afterwards."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


# --- expiry --------------------------------------------------------------------------------------
CACHE_OUT = "cache_key string, payload string, expires_at timestamp, event string"
CACHE_STATE = "cache_keys array<string>, payloads array<string>, expires_ms array<bigint>"


def expiring_cache(entries: DataFrame, ttl_seconds: int, delay: str = "0 seconds", buckets: int = 4096) -> DataFrame:
    """entries (cache_key, payload, ts) -> 'stored' rows, and an 'expired' row when a key's time runs out.

    Keys lie in buckets by hash, and a bucket's keys are handled together, as a call for each key costs far more than its few rows. A bucket's state
    holds its live keys, which leave it on expiry; its timer waits for the earliest of them. A newer entry of a key restarts its clock.
    """
    columns = ["cache_key", "payload", "expires_ms"]

    def rows(found: pd.DataFrame, event: str) -> pd.DataFrame:
        return pd.DataFrame({"cache_key": found["cache_key"], "payload": found["payload"], "expires_at": pd.to_datetime(found["expires_ms"], unit="ms"), "event": event})

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = pd.DataFrame(dict(zip(columns, state.get)) if state.exists else {c: [] for c in columns}, dtype=object)
        if not state.hasTimedOut:
            def newest(some):
                return some.sort_values(["cache_key", "ts", "payload"]).drop_duplicates("cache_key", keep="last")

            fresh = newest(pd.concat([newest(frame) for frame in frames]))
            fresh["expires_ms"] = fresh["ts"].astype("datetime64[ms]").astype("int64") + ttl_seconds * 1000
            # Of equal times the one already stored stays.
            both = pd.concat([live.assign(old=1), fresh[columns].assign(old=0)]).sort_values(["cache_key", "expires_ms", "old"])
            live = both.drop_duplicates("cache_key", keep="last")
            yield rows(live[live["old"] == 0], "stored")
        watermark = state.getCurrentWatermarkMs()
        over = live["expires_ms"].astype("int64") < watermark
        if over.any():
            yield rows(live[over], "expired")
        live = live[~over]
        if live.empty:
            state.remove()
            return
        times = live["expires_ms"].astype("int64")
        state.update((live["cache_key"].tolist(), [None if pd.isna(p) else p for p in live["payload"]], times.tolist()))
        state.setTimeoutTimestamp(max(int(times.min()), watermark + 1))

    dealt = entries.withWatermark("ts", delay).withColumn("bucket", F.pmod(F.xxhash64("cache_key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, CACHE_OUT, CACHE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_entries(entries: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Batch twin of the expiry: the newest entry per key still alive at ``now``."""
    newest = entries.groupBy("cache_key").agg(F.max_by("payload", F.struct("ts", "payload")).alias("payload"), F.max("ts").alias("ts"))
    return newest.filter(F.unix_micros("ts") + ttl_seconds * 1000000 > F.unix_micros(F.lit(now).cast("timestamp")))


# --- joins and late data ---------------------------------------------------------------------------
def surfaced_then_feedback(surfaced: DataFrame, feedback: DataFrame, within: str = "3 days", delay: str = "1 day") -> DataFrame:
    """Feedback given within some days of a candidate being surfaced; both sides carry a watermark, so state is bounded."""
    s = surfaced.select(F.col("viewer_id").alias("s_viewer"), F.col("person_id").alias("s_person"), F.col("event_id").alias("surfaced_id"),
                        F.col("ts").alias("surfaced_at"))
    f = feedback.select("viewer_id", "person_id", F.col("event_id").alias("feedback_id"), "kind", F.col("ts").alias("feedback_at"))
    if surfaced.isStreaming:
        s, f = s.withWatermark("surfaced_at", delay), f.withWatermark("feedback_at", delay)
    on = ((F.col("s_viewer") == F.col("viewer_id")) & (F.col("s_person") == F.col("person_id")) & (F.col("feedback_at") >= F.col("surfaced_at"))
          & (F.col("feedback_at") <= F.col("surfaced_at") + F.expr(f"interval {within}")))
    return s.join(f, on).select("viewer_id", "person_id", "surfaced_id", "feedback_id", "kind", "surfaced_at", "feedback_at")


def split_late(batch: DataFrame, watermark, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of one micro-batch; rows without a time are in time, and so are all while there is no watermark."""
    late = F.coalesce(F.col(ts) < F.lit(watermark).cast("timestamp"), F.lit(False))
    return batch.filter(~late), batch.filter(late)


def keep_late(stream: DataFrame, root: str, ts: str = "ts", delay: str = "1 day") -> StreamingQuery:
    """Write a stream to ``root``/in_time and the rows behind the watermark to ``root``/late, where nothing is lost.

    The watermark of a batch is the largest time of all earlier batches less ``delay``. Every batch stores the largest time up to itself under its
    id, and so does what it writes: a replayed batch finds the same watermark and overwrites its own output.
    """
    spark = stream.sparkSession
    clock_schema = StructType([StructField("upto", TimestampType()), StructField("batch", LongType())])
    spark.createDataFrame([], clock_schema).write.mode("append").partitionBy("batch").parquet(f"{root}/clock")

    def write(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(clock_schema).parquet(f"{root}/clock").filter(F.col("batch") < batch_id).agg(F.max("upto").alias("upto"))
        clock = before.select("upto", (F.col("upto") - F.expr(f"interval {delay}")).alias("watermark")).first()
        rows = stored(batch, "late-batch")
        for name, part in zip(("in_time", "late"), split_late(rows, clock["watermark"], ts)):
            part.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        upto = rows.agg(F.greatest(F.max(ts).cast("timestamp"), F.lit(clock["upto"]).cast("timestamp")).alias("upto"))
        upto.write.mode("overwrite").parquet(f"{root}/clock/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start()


def late_tables(spark: SparkSession, root: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) that ``keep_late`` has written."""
    def read(name):
        return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/batch=*")
    return read("in_time"), read("late")


def feedback_only(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind").isin(FEEDBACK_KINDS))
