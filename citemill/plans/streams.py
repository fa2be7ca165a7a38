"""Queries that fold events in order: rate limits with bursts and job phases, with recursive SQL as their counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bibliography as view
from ..streaming import limits, phases

HOUR = 3_600_000_000
STATUS = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"
RUN, PHASE, ERROR = "user_id * 1000 + event_id % 5", "CASE WHEN event_id % 3 = 0 THEN props END", "CASE WHEN event_type = 'error' THEN 'error at ' || CAST(event_id AS STRING) END"


def rate_limited(spark, sf_dir):
    """Two events of a type an hour, and two more at once."""
    found = limits.limited(view.read(spark, sf_dir, "events"), "event_type", "ts", "event_id", 2, HOUR, 2)
    return found.select("event_id", "event_type", "accepted", "excess")


def job_phases(spark, sf_dir):
    e = view.read(spark, sf_dir, "events")
    events = e.select(F.expr(RUN).alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"), F.expr(PHASE).alias("phase"), F.expr(ERROR).alias("error"))
    return phases.final(phases.replay(events))


QUERIES = {f.__name__: f for f in (rate_limited, job_phases)}

SQL = {
    "rate_limited": f"""WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT event_id, event_type, us, n, 0::BIGINT AS level, true AS accepted, 0::BIGINT AS lifted FROM e WHERE n = 1
        UNION ALL SELECT event_id, event_type, us, n, CASE WHEN l <= 2 * {HOUR} THEN l ELSE l - {HOUR} END, l <= 2 * {HOUR}, l
          FROM (SELECT e.*, greatest(f.level - 2 * (e.us - f.us), -{HOUR}) + {HOUR} AS l FROM f JOIN e ON e.event_type = f.event_type AND e.n = f.n + 1))
      SELECT event_id, event_type, accepted, lifted / {HOUR} AS excess FROM f""",
    "job_phases": f"""WITH RECURSIVE e AS (SELECT {RUN} AS run, epoch_us(ts) AS us, {STATUS} AS asked, {PHASE} AS new_phase, {ERROR} AS new_error, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT run, 0::BIGINT AS n, '' AS status, NULL::VARCHAR AS phase, NULL::VARCHAR AS error, NULL::BIGINT AS created_at, NULL::BIGINT AS updated_at, 0::BIGINT AS illegal FROM e WHERE n = 1
        UNION ALL SELECT run, n, CASE WHEN ok THEN coalesce(asked, status) ELSE status END, CASE WHEN ok THEN coalesce(new_phase, phase) ELSE phase END, CASE WHEN ok THEN coalesce(new_error, error) ELSE error END,
          CASE WHEN ok THEN coalesce(created_at, us) ELSE created_at END, CASE WHEN ok THEN us ELSE updated_at END, illegal + CASE WHEN ok THEN 0 ELSE 1 END
        FROM (SELECT e.run, e.n, e.us, e.asked, e.new_phase, e.new_error, f.status, f.phase, f.error, f.created_at, f.updated_at, f.illegal,
            CASE f.status WHEN '' THEN coalesce(e.asked = 'queued', false) WHEN 'queued' THEN coalesce(e.asked IN ('queued', 'running', 'failed'), true)
              WHEN 'running' THEN coalesce(e.asked IN ('running', 'completed', 'failed'), true) ELSE false END AS ok
          FROM f JOIN e ON e.run = f.run AND e.n = f.n + 1))
      SELECT run, status, phase, error, created_at, updated_at, illegal FROM f WHERE status <> '' QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1""",
}
