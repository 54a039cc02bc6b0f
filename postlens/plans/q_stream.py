"""Registered queries: streams over the ``events`` table.

Each runs the streaming query with ``trigger(availableNow=True)`` into files
under the checkpoint folder and returns the written result.  ``ingest_late`` and the
``*_open`` queries run over several arrivals of rows, most of them late."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from postlens.plans.registry import register
from postlens.session import checkpoint_dir
from postlens.streaming import streams as ST


def _dirs(spark, tag):
    base = os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    return f"{base}/out", f"{base}/chk"


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return ST.read_stream(spark, d, schema, glob="events.parquet")


def _final_windows_sql(size: str, slide: str, delay: str, offset: str | None) -> str:
    # windows are emitted once the watermark (max event time - delay) passes their end
    starts = (f"time_bucket(INTERVAL '{slide}', ts, TIMESTAMP '1970-01-05')" if offset
              else f"time_bucket(INTERVAL '{slide}', ts, TIMESTAMP '1970-01-01')")
    return f"""
WITH e AS (SELECT * FROM events),
wm AS (SELECT max(ts) - INTERVAL '{delay}' AS wm FROM e),
b AS (SELECT {starts} AS last_start, event_type, value, ts FROM e),
x AS (SELECT last_start - INTERVAL '{slide}' * k AS window_start, event_type, value, ts
      FROM b, range(0, CAST(epoch(INTERVAL '{size}') / epoch(INTERVAL '{slide}') AS BIGINT)) r(k)),
y AS (SELECT * FROM x WHERE ts >= window_start AND ts < window_start + INTERVAL '{size}')
SELECT window_start, window_start + INTERVAL '{size}' AS window_end, event_type,
       round(CAST(sum(CAST(value AS DECIMAL(28,9))) AS DOUBLE) / count(value), 6) AS avg_metric, count(*) AS n
FROM y GROUP BY window_start, event_type
HAVING window_start + INTERVAL '{size}' <= (SELECT wm FROM wm)"""


@register("weekly_series_stream", _final_windows_sql("7 days", "7 days", "1 day", "monday"))
def q_weekly_series_stream(spark, d):
    """Weekly event-time windows (Monday start), watermark 1 day, append."""
    out, chk = _dirs(spark, "weekly")
    with ST.utc_session(spark):
        agg = ST.weekly_series_stream(_events(spark, d), ts="ts", key="event_type", metric="value")
        ST.run_to_files(ST.window_bounds_ntz(agg), out, chk)
    return spark.read.parquet(out)


@register("hourly_stream", _final_windows_sql("24 hours", "1 hour", "1 hour", None))
def q_hourly_stream(spark, d):
    """Sliding 24 h / 1 h windows, watermark 1 hour, append."""
    out, chk = _dirs(spark, "hourly")
    with ST.utc_session(spark):
        agg = ST.hourly_stream(_events(spark, d), ts="ts", key="event_type", metric="value")
        ST.run_to_files(ST.window_bounds_ntz(agg), out, chk)
    return spark.read.parquet(out)


@register("ingest_stream", """
SELECT DISTINCT CAST(user_id AS VARCHAR) || '-' || event_type AS link FROM events""")
def q_ingest_stream(spark, d):
    """Every link added to the pool exactly once."""
    base = os.path.join(checkpoint_dir(spark), f"ingest-{uuid.uuid4().hex}")
    ev = _events(spark, d).select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("link"),
        F.col("ts").alias("scraped_at"), "value")
    with ST.utc_session(spark):
        q = ST.ingest_stream(ev, pool_path=f"{base}/pool", checkpoint=f"{base}/chk")
        q.awaitTermination()
    return spark.read.parquet(f"{base}/pool").select("link")


ARRIVALS = 3


@register("ingest_late", """
SELECT DISTINCT CAST(user_id AS VARCHAR) || '-' || event_type AS link FROM events""")
def q_ingest_late(spark, d):
    """Rows arrive in several batches that all span the whole time, so most links that are
    new in a later batch are older than rows already seen; the query restarts for each."""
    base = os.path.join(checkpoint_dir(spark), f"ingest-{uuid.uuid4().hex}")
    ev = spark.read.parquet(f"{d}/events.parquet").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("link"),
        F.col("ts").alias("scraped_at"), "value")
    part = F.pmod(F.xxhash64("link", "scraped_at"), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        ev.where(part == k).write.mode("append").parquet(f"{base}/in")
        with ST.utc_session(spark):
            ST.ingest_stream(ST.read_stream(spark, f"{base}/in", ev.schema), pool_path=f"{base}/pool",
                             checkpoint=f"{base}/chk").awaitTermination()
    return spark.read.parquet(f"{base}/pool").select("link")


WINDOW_ARRIVALS = 5


def _open_windows_sql(size: str, slide: str, origin: str) -> str:
    # arrival k holds the rows whose minute is k modulo 5; a snapshot has all arrivals up to it
    return f"""
WITH e AS (SELECT event_type, value, ts, minute(ts) % {WINDOW_ARRIVALS} AS came FROM events WHERE ts IS NOT NULL),
x AS (SELECT time_bucket(INTERVAL '{slide}', ts, TIMESTAMP '{origin}') - INTERVAL '{slide}' * k AS window_start,
             event_type, value, came
      FROM e, range(0, CAST(epoch(INTERVAL '{size}') / epoch(INTERVAL '{slide}') AS BIGINT)) r(k)),
s AS (SELECT came, window_start, event_type, sum(CAST(value AS DECIMAL(28,9))) AS total,
             count(value) AS n_values, count(*) AS n
      FROM x GROUP BY came, window_start, event_type)
SELECT arrival, window_start, window_start + INTERVAL '{size}' AS window_end, event_type,
       round(CAST(sum(total) AS DOUBLE) / sum(n_values), 6) AS avg_metric, CAST(sum(n) AS BIGINT) AS n
FROM s, range(0, {WINDOW_ARRIVALS}) a(arrival) WHERE came <= arrival
GROUP BY arrival, window_start, event_type"""


def _open_windows(spark, d, tag, windows):
    """Snapshots of the windows after each of several arrivals that all span the whole time."""
    base = os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    ev = spark.read.parquet(f"{d}/events.parquet").where("ts IS NOT NULL").select("ts", "event_type", "value")
    shots = None
    for k in range(WINDOW_ARRIVALS):
        ev.where(F.minute("ts") % WINDOW_ARRIVALS == k).write.mode("append").parquet(f"{base}/in")
        with ST.utc_session(spark):
            ST.open_windows_stream(ST.read_stream(spark, f"{base}/in", ev.schema), out=f"{base}/log",
                                   checkpoint=f"{base}/chk", ts="ts", key="event_type", metric="value",
                                   windows=windows).awaitTermination()
        shot = ST.read_windows(spark, f"{base}/log", "event_type", upto=k).withColumn("arrival", F.lit(k).cast("long"))
        shots = shot if shots is None else shots.unionByName(shot)
    return shots.withColumn("avg_metric", F.round("avg_metric", 6))


@register("weekly_open", _open_windows_sql("7 days", "7 days", "1970-01-05"))
def q_weekly_open(spark, d):
    """Weekly windows after every arrival, open ones and late rows included."""
    return _open_windows(spark, d, "weekly-open", ST.WEEKLY)


@register("hourly_open", _open_windows_sql("24 hours", "1 hour", "1970-01-01"))
def q_hourly_open(spark, d):
    """Sliding 24 h windows after every arrival, open ones and late rows included."""
    return _open_windows(spark, d, "hourly-open", ST.HOURLY)
