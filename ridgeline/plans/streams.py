"""Streaming queries over the events file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows


def stream_tumbling_counts(spark, sf_dir):
    out = windows.closed(spark, f"{sf_dir}/events.parquet", "ts", "1 hour", lambda e: windows.tumbling(e, "ts", "6 hours", "event_type"))
    return out.select((F.unix_micros("window.start") / F.lit(3_600_000_000)).cast("long").alias("hour"), "event_type", "n")


def stream_session_process(spark, sf_dir):
    out = windows.closed(spark, f"{sf_dir}/events.parquet", "ts", "1 hour", lambda e: windows.sessions(e, "ts", "6 hours", "user_id"))
    return out.select("user_id", F.unix_micros("window.start").alias("first"), F.unix_micros("window.end").alias("closed"), "n")


QUERIES = [
    ("stream_tumbling_counts", stream_tumbling_counts, "SELECT CAST(epoch_us(ts) // 21600000000 * 6 AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    ("stream_session_process", stream_session_process, """WITH b AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS br FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(br) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, min(t) AS first, max(t) + 21600000000 AS closed, count(*) AS n FROM s GROUP BY user_id, k"""),
]
