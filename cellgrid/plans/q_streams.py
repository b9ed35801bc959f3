"""Queries that run streams over the events and must equal their batch twins, and those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.model import r6
from cellgrid.plans.registry import query
from cellgrid.sources.tables import fresh_path, table
from cellgrid.streaming import totals


def event_stream(spark: SparkSession, sf_dir: str, copies: int = 1) -> tuple[DataFrame, str]:
    """The events, ``copies`` times over, as a stream of files, and the folder of the run."""
    path = fresh_path(spark, "stream")
    for _ in range(copies):
        table(spark, sf_dir, "events").write.mode("append").parquet(f"{path}/in")
    return totals.read_events(spark, f"{path}/in"), path


@query("stream_totals", "2.11", "SELECT date_trunc('day', ts) AS start, user_id, round(sum(value), 4) AS total, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_totals(spark, sf_dir):
    events, path = event_stream(spark, sf_dir)
    done = totals.run_to_table(totals.windowed_totals(events), f"{path}/out", f"{path}/state", ["start", "user_id"])
    return done.select("start", "user_id", r6(F.col("total"), 4).alias("total"), "n")


#: Windows that the watermark, two days behind the last event, has passed.
PASSED = "(SELECT max(ts) FROM events) - INTERVAL 2 DAY"


@query(
    "stream_sliding", "2.11",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS start, user_id, value FROM events, range(0, 2) t(k))
    SELECT start, user_id, round(sum(value), 4) AS total, count(*)::BIGINT AS n FROM w WHERE start + INTERVAL 24 HOUR <= {PASSED} GROUP BY ALL""",
)
def stream_sliding(spark, sf_dir):
    """Overlapping windows, appended when they are final."""
    events, path = event_stream(spark, sf_dir)
    done = totals.run_to_table(totals.windowed_totals(events, size="24 hours", slide="12 hours"), f"{path}/out", f"{path}/state")
    return done.select("start", "user_id", r6(F.col("total"), 4).alias("total"), "n")


SESSIONS = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT ON (event_id) * FROM events) WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g), z AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, no)"""


@query("stream_sessions", "2.11", f"WITH {SESSIONS} SELECT start, user_id, n::BIGINT AS n FROM z WHERE last + INTERVAL 2 HOUR <= {PASSED}")
def stream_sessions(spark, sf_dir):
    """Sessions, appended when the watermark has passed their end."""
    events, path = event_stream(spark, sf_dir)
    return totals.run_to_table(totals.sessions(events, "2 hours"), f"{path}/out", f"{path}/state").select("start", "user_id", "n")


@query("stream_once", "2.11", "SELECT event_id, user_id, value FROM events")
def stream_once(spark, sf_dir):
    """Every event twice, taken once."""
    events, path = event_stream(spark, sf_dir, copies=2)
    return totals.run_to_table(totals.once(events).select("event_id", "user_id", "value"), f"{path}/out", f"{path}/state")


@query("session_counts", "2.11", f"WITH {SESSIONS} SELECT start, user_id, n::BIGINT AS n FROM z")
def session_counts(spark, sf_dir):
    return totals.sessions(totals.once(table(spark, sf_dir, "events")), "2 hours").select("start", "user_id", "n")
