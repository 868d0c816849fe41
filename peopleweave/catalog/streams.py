"""Queries run as streams over all data present; oracles are their batch twins."""
from pyspark.sql import functions as F

from ..bindings import Tables, with_sql
from ..operators.common import newest_wins
from ..sources.sinks import keyed_table
from ..streaming import jobs
from .aggregates import STATE
from .registry import query


class StreamTables(Tables):
    """The same relations with the events table read as a stream."""

    def raw(self, name):
        if name != "events":
            return super().raw(name)
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        df = jobs.table_stream(self.spark, f"{self.sf_dir}/{name}.parquet", schema)
        return df.withColumn("ts", F.col("ts").cast("timestamp"))


END = "2999-01-01 00:00:00"


def streamed(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


@query("str1_viewer_state", with_sql(["all_viewer_events"], "SELECT * FROM state", STATE))
def str1(t: Tables):
    return jobs.run_available(jobs.viewer_state(streamed(t).all_viewer_events()), "update", ["viewer_id", "person_id"])


@query("str2_negative_windows", with_sql(["feedback"], """
SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, user_id, reason_code, count(*) AS n FROM (
  SELECT *, date_trunc('day', created_at) - to_days(CAST(unnest(range(0, 30)) AS INT)) AS window_start FROM feedback WHERE sentiment = 'negative' AND reason_code IS NOT NULL)
GROUP BY ALL HAVING count(*) >= 3"""))
def str2(t: Tables):
    return jobs.run_to_end(streamed(t).feedback(), jobs.negative_windows, {"created_at": END, "sentiment": "negative", "reason_code": "end of input"})


@query("str3_daily_counts", with_sql(["viewer_events"], """
SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS n FROM viewer_events GROUP BY 1, 2"""))
def str3(t: Tables):
    return jobs.run_to_end(streamed(t).viewer_events(), jobs.daily_counts, {"ts": END})


@query("str4_viewer_sessions", with_sql(["viewer_events"], """
SELECT viewer_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS ended_at, count(*) AS n_events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY viewer_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY viewer_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM viewer_events))
GROUP BY viewer_id, s"""))
def str4(t: Tables):
    return jobs.run_to_end(streamed(t).viewer_events(), jobs.viewer_sessions, {"ts": END})


@query("str5_incremental_upsert", with_sql(["viewer_events"], """
SELECT c_custkey AS viewer_id, coalesce(kind, 'none') AS kind FROM customer LEFT JOIN (SELECT viewer_id, arg_max(kind, (ts, event_id)) AS kind FROM viewer_events GROUP BY 1) ON viewer_id = c_custkey
UNION ALL SELECT viewer_id, arg_max(kind, (ts, event_id)) FROM viewer_events WHERE viewer_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1"""))
def str5(t: Tables):
    start = t.raw("customer").select(F.col("c_custkey").alias("viewer_id"), F.lit("none").alias("kind"), F.lit("1970-01-01").cast("timestamp").alias("ts"),
                                     F.lit(-1).cast("long").alias("event_id"))
    table = keyed_table(start, jobs.scratch_folder(t.spark, "table"), ["viewer_id"], 16)
    events = streamed(t).viewer_events().select("viewer_id", "kind", "ts", "event_id")
    jobs.upsert_stream(events, table, lambda old, new: newest_wins(old, new, ["viewer_id"], F.struct("ts", "event_id")), jobs.scratch_folder(t.spark, "state")).awaitTermination()
    return table.read().select("viewer_id", "kind")


@query("str6_expiring_cache", with_sql(["viewer_events"], """
SELECT cache_key, event, expires_at FROM stored UNION ALL SELECT cache_key, 'expired', expires_at FROM stored WHERE expires_at < (SELECT max(ts) FROM viewer_events)""", """
stored AS (SELECT CAST(viewer_id AS VARCHAR) || '-' || person_id AS cache_key, 'stored' AS event, date_trunc('millisecond', max(ts)) + INTERVAL 1 DAY AS expires_at FROM viewer_events GROUP BY viewer_id, person_id)"""))
def str6(t: Tables):
    entries = streamed(t).viewer_events().select(F.concat_ws("-", "viewer_id", "person_id").alias("cache_key"), F.col("kind").alias("payload"), "ts")
    return jobs.run_available(jobs.expiring_cache(entries, 86400)).select("cache_key", "event", "expires_at")


@query("str6_live_entries", with_sql(["viewer_events"], """
SELECT viewer_id || '-' || person_id AS cache_key FROM viewer_events GROUP BY viewer_id, person_id HAVING max(ts) + INTERVAL 1 DAY > TIMESTAMP '2024-01-25 00:00:00'"""))
def str6_batch(t: Tables):
    entries = t.viewer_events().select(F.concat_ws("-", "viewer_id", "person_id").alias("cache_key"), F.col("kind").alias("payload"), "ts")
    return jobs.live_entries(entries, "2024-01-25 00:00:00", 86400).select("cache_key")


@query("str7_insert_if_absent", with_sql(["viewer_events"], "SELECT DISTINCT viewer_id, person_id, kind FROM viewer_events"))
def str7(t: Tables):
    rows = streamed(t).viewer_events().select("viewer_id", "person_id", "kind", "ts")
    return jobs.run_available(jobs.new_evidence(rows, ["viewer_id", "person_id", "kind"], "ts", "60 days")).select("viewer_id", "person_id", "kind")


@query("str8_surfaced_feedback", with_sql(["viewer_events"], """
SELECT s.event_id AS surfaced_id, f.event_id AS feedback_id, f.kind FROM viewer_events s JOIN viewer_events f ON s.viewer_id = f.viewer_id AND s.person_id = f.person_id AND s.value > 100
  AND f.kind IN ('interested', 'not_interested', 'contacted') AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 3 DAY"""))
def str8(t: Tables):
    s = streamed(t)
    return jobs.run_available(jobs.surfaced_then_feedback(s.surfaced_events(), jobs.feedback_only(s.viewer_events()))).select(
        "surfaced_id", "feedback_id", "kind")


# Events arrive in weekly files; one in sixteen, by a hash of its id, comes a file too late.
@query("str9_late_rows", with_sql(["viewer_events"], """
SELECT event_id, ts < (SELECT max(ts) FROM arrived b WHERE b.file < a.file) - INTERVAL 2 DAY IS TRUE AS late FROM arrived a""", """
arrived AS (SELECT event_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 0 WHEN ts < TIMESTAMP '2024-01-15' THEN 1 WHEN ts < TIMESTAMP '2024-01-22' THEN 2 ELSE 3 END
  + (substr(md5(CAST(event_id AS VARCHAR)), 1, 1) = '0')::INT AS file FROM viewer_events)"""))
def str9(t: Tables):
    rows = t.viewer_events()
    week = sum((F.when(F.col("ts") >= F.lit(day).cast("timestamp"), 1).otherwise(0) for day in ("2024-01-08", "2024-01-15", "2024-01-22")), F.lit(0))
    rows = rows.withColumn("file", week + (F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 1) == "0").cast("int"))
    root = jobs.scratch_folder(t.spark, "late")
    for file in range(5):
        rows.filter(F.col("file") == file).drop("file").coalesce(1).write.mode("append").parquet(f"{root}/arrivals")
    stream = t.spark.readStream.schema(rows.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/arrivals")
    jobs.keep_late(stream, root, delay="2 days").awaitTermination()
    kept, late = jobs.late_tables(t.spark, root, stream.schema)
    return kept.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))
