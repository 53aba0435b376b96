"""Queries of streams: whole tables as files that arrive out of order, run to their end, held to SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.plans.files import _new
from strophe.plans.registry import query
from strophe.shared import ranked
from strophe.streaming import exact, incremental

#: Far behind all events: what comes then closes the windows before it.
_LAST = "2100-01-01 00:00:00"


def _arriving(events: DataFrame, ts: str = "ts", parts: int = 3) -> DataFrame:
    """The rows as a stream of files in their order in time, but every tenth row comes a part later than its time."""
    spark = events.sparkSession
    path = _new(events)
    n = events.count()
    placed = ranked(events, [ts, "event_id"], "__at").withColumn("__part", F.least(F.floor(F.col("__at") * parts / max(n, 1)) + (F.col("event_id") % 10 == 0).cast("int"), F.lit(parts - 1)))
    for part in range(parts):  # files are read in the order of their making
        placed.where(F.col("__part") == part).drop("__at", "__part").coalesce(2).write.mode("append").parquet(path)
    spark.range(1).select(*(F.to_timestamp(F.lit(_LAST)).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema)).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _run(out: DataFrame, times: int = 2) -> DataFrame:
    """What a stream appends; run again from its checkpoint, it finds nothing new."""
    path, at = _new(out), _new(out)
    for _ in range(times):
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


@query("""SELECT event_type, s AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 20 SECOND, ts), time_bucket(INTERVAL 20 SECOND, ts) - INTERVAL 20 SECOND, time_bucket(INTERVAL 20 SECOND, ts) - INTERVAL 40 SECOND]) AS s FROM events) GROUP BY ALL""")
def streamed_rates(t):
    log = _arriving(t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"))
    rates = incremental.request_windows(log, late="3650 days", by="event_type", length="60 seconds", slide="20 seconds")
    return _run(rates.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n"))


@query("""WITH f AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first FROM events),
d AS (SELECT user_id, min(first) + INTERVAL 4 HOUR AS deadline, min(CASE WHEN event_type IN ('purchase', 'error') AND ts <= first + INTERVAL 4 HOUR THEN ts END) AS at FROM f GROUP BY 1),
o AS (SELECT d.user_id, d.at, count(*) FILTER (f.ts <= coalesce(d.at, d.deadline)) AS polls, min(CASE WHEN f.ts = d.at AND event_type IN ('purchase', 'error') THEN CASE event_type WHEN 'error' THEN 'failed' ELSE 'succeeded' END END) AS outcome FROM d JOIN f ON f.user_id = d.user_id GROUP BY ALL)
SELECT user_id, coalesce(outcome, 'timeout') AS outcome, polls FROM o""")
def streamed_polls(t):
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("running")
    log = _arriving(t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", status.alias("status")))
    return _run(incremental.poll(log.where("user_id IS NOT NULL OR event_id IS NULL"), 4 * 3_600_000, "user_id", late="3650 days")).where("user_id IS NOT NULL")


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_type <> 'view'")
def flushed_events(t):
    e = t("events").select("event_id", "event_type", F.round("value", 6).alias("value"), "ts")
    path, at = _new(e), _new(e)
    log = _arriving(e)
    for _ in range(2):  # the second run finds nothing new
        exact.append_once(log, "event_id", lambda b: b.where("event_type <> 'view'").drop("ts"), path, at, every=500, kind="csv", header=True).awaitTermination()
    return exact.read_appended(e.sparkSession, path, "event_id long, event_type string, value double", "csv", header=True).drop("flush")
