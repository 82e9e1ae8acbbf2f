"""Queries over the progress feed (batch twins of the streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitwise.registry.base import register
from unitwise.sources import tables as T
from unitwise.sources.tables import with_views
from unitwise.streaming import progress as X

register("latest_progress", lambda sp, d: X.latest_progress(T.progress(sp, d)).select(
    "job_id", "stage", "detail", "n_events"), with_views(
    "SELECT job_id, arg_max(stage, (event_at, event_id)) AS stage, arg_max(detail, (event_at, event_id))"
    " FILTER (detail IS NOT NULL) AS detail, count(kind) AS n_events FROM rr_progress GROUP BY job_id",
    "rr_progress"))
# Ten jobs share the feed here, so that each has far more events than the limit.
register("cap_events", lambda sp, d: X.cap_events(
    T.progress(sp, d).withColumn("job_id", F.col("job_id") % 10)).select("job_id", "event_id", "event_no"), with_views(
    "SELECT job_id, event_id, event_no FROM (SELECT event_id, job_id % 10 AS job_id, row_number() OVER (PARTITION BY"
    " job_id % 10 ORDER BY event_at, event_id) AS event_no FROM rr_progress WHERE kind IS NOT NULL)"
    " WHERE event_no <= 100", "rr_progress"))
_AS_OF = "2024-01-31 00:00:00"
register("stale_jobs", lambda sp, d: X.stale_jobs(
    T.progress(sp, d), F.to_timestamp(F.lit(_AS_OF)), ("validating",)).select("job_id", "stage"),
    with_views(
    "SELECT job_id, stage FROM (SELECT job_id, max(event_at) AS last_at, arg_max(stage, (event_at,"
    f" event_id)) AS stage FROM rr_progress GROUP BY 1) WHERE last_at < TIMESTAMP '{_AS_OF}' - INTERVAL"
    " 10 MINUTE AND stage <> 'validating'", "rr_progress"))


def _dense(sp, d):
    """The feed on a time scale where updates of a job follow within seconds."""
    return T.progress(sp, d).withColumn("event_at", F.timestamp_millis(
        F.unix_millis("event_at") % 600000))


def _throttle_sql(fed: str) -> str:
    """The rule event by event, all jobs side by side."""
    return "WITH RECURSIVE" + with_views("", "rr_progress")[4:] + f""", fed AS ({fed}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms, event_id) AS n FROM fed),
walked AS (
  SELECT job_id, event_id, n, true AS written, ms AS last_ms, stage AS last_stage FROM numbered WHERE n = 1
  UNION ALL
  SELECT job_id, event_id, n, w, CASE WHEN w THEN ms ELSE last_ms END, CASE WHEN w THEN stage ELSE last_stage END
  FROM (SELECT x.*, v.last_ms, v.last_stage,
               x.kind IS NOT NULL OR x.stage IS DISTINCT FROM v.last_stage OR x.ms - v.last_ms >= 1000 AS w
        FROM walked v JOIN numbered x ON x.job_id = v.job_id AND x.n = v.n + 1))
SELECT job_id, event_id FROM walked WHERE written"""


# Ten jobs with all events, most of one stage and without a kind: chains of many seconds without a certain write.
_CHAINS = {"job_id": "event_id % 10", "stage": "CASE WHEN event_id % 397 = 0 THEN 'b' ELSE 'a' END",
           "kind": "CASE WHEN event_id % 501 = 0 THEN kind END", "ms": "event_id * 17 + event_id % 7 * 211"}
register("throttle", lambda sp, d: X.throttle(_dense(sp, d)), _throttle_sql(
    "SELECT job_id, event_id, stage, kind, epoch_ms(event_at) % 600000 AS ms FROM rr_progress"))
register("throttle_chains", lambda sp, d: X.throttle(T.progress(sp, d).selectExpr(
    "event_id", *[f"{e} AS {n}" for n, e in _CHAINS.items()]).withColumn("event_at", F.timestamp_millis("ms"))), _throttle_sql(
    "SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in _CHAINS.items()) + " FROM rr_progress"))
