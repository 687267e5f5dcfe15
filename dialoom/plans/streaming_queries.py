"""Streams run over what a table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.session import table
from dialoom.streaming import events as E


LATE = "2 days"


def _events(spark, sf_dir):
    return E.staged(table(spark, sf_dir, "events"), "ts")


def stream_window(spark, sf_dir):
    """Daily counts of the closed days, over four micro-batches."""
    return E.drain(E.windowed_counts(_events(spark, sf_dir), "ts", "1 day", LATE, "event_type"))


def stream_sliding(spark, sf_dir):
    """Counts of the closed two-day windows that begin every day."""
    return E.drain(E.windowed_counts(_events(spark, sf_dir), "ts", "2 days", LATE, "event_type", slide="1 day"))


def stream_sessions(spark, sf_dir):
    return E.drain(E.sessions(_events(spark, sf_dir), "ts", "30 minutes", LATE, "user_id"))


def stream_fill_forward(spark, sf_dir):
    """Labels carried on over four micro-batches in file order."""
    rows = E.staged(table(spark, sf_dir, "reflow_rows").select("sales_id", "customer_id", "row_order", "sender", "sop_l2"), "row_order").filter(F.col("sender").isin("客户", "CSM", "未发送"))
    slim = rows.select("sales_id", "customer_id", "row_order", "sender", F.col("sop_l2").alias("label"))
    return E.drain(E.fill_forward_state(slim, lambda p: p["sender"] != "客户"))


QUERIES = {f.__name__: f for f in (stream_window, stream_sliding, stream_sessions, stream_fill_forward)}
ORACLES = {
    "stream_window": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)",
    "stream_sliding": """WITH w AS (SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events)
SELECT CAST(d AS TIMESTAMP) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM w WHERE d + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY ALL""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""",
    "stream_fill_forward": """SELECT row_order, coalesce(sop_l2, last_value(CASE WHEN sender <> '客户' THEN sop_l2 END IGNORE NULLS) OVER (PARTITION BY sales_id, customer_id ORDER BY row_order)) AS label FROM reflow_rows WHERE sender IN ('客户', 'CSM', '未发送')""",
}
