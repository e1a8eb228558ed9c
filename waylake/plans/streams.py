"""Queries on the event table, which the stream operators also read as a stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylake.session import table
from waylake.streaming import events as ev


def evt01_latest_state(spark, root):
    """The last event of each user."""
    return ev.latest(table(spark, root, "events"), "user_id", "ts", "event_type")


def evt02_sessions(spark, root):
    """Events of a user that follow each other within half an hour."""
    s = ev.sessions(table(spark, root, "events"), "user_id", "ts", "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("most"))


def evt03_windows(spark, root):
    """Events of each type in windows of an hour."""
    return ev.window_counts(table(spark, root, "events"), "event_type", "ts", "1 hour")


QUERIES = {"evt01_latest_state": evt01_latest_state, "evt02_sessions": evt02_sessions, "evt03_windows": evt03_windows}
SQL = {
    "evt01_latest_state": "SELECT user_id, m.ts AS ts, m.v AS value FROM (SELECT user_id, max(struct_pack(ts := ts, v := event_type)) AS m FROM events GROUP BY 1)",
    "evt02_sessions": """SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, max(n) AS most FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
 FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY 1, 2) GROUP BY 1""",
    "evt03_windows": "SELECT event_type, date_trunc('hour', ts) AS started, count(*) AS n FROM events GROUP BY 1, 2",
}
