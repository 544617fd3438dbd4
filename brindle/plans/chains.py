"""Queries on chains of causes and on contexts at a stop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import errors
from ..sources.documents import table
from ..streaming import sessions
from .catalogue import query

# An event is caused by one a few before it, every 97th by itself, every 89th by a later one; the code of a failed transport is looked for.
_CAUSE = "CASE WHEN event_id % 97 = 0 THEN event_id WHEN event_id % 89 = 0 THEN event_id + 3 ELSE event_id - 1 - event_id % 3 END"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, {_CAUSE} AS cause, CASE WHEN event_type = 'error' AND value > 20 THEN event_id % 50 END AS code FROM events),
  w AS (SELECT event_id, event_id AS at, 0 AS hop FROM e UNION ALL SELECT w.event_id, e.cause, hop + 1 FROM w JOIN e ON e.event_id = w.at WHERE e.code IS NULL AND hop < 7)
SELECT w.event_id, max(e.code) AS code FROM w LEFT JOIN e ON e.event_id = w.at GROUP BY 1""")
def root_causes(spark, d):
    """The first code along each event's chain of causes, of eight events at most; chains are longer, and some are cycles."""
    e = table(spark, d, "events").withColumn("cause", F.expr(_CAUSE))
    return errors.root_codes(e, F.when((F.col("event_type") == "error") & (F.col("value") > 20), F.col("event_id") % 50), key="event_id")


# A user's day is a session: views capture a context that takes some seconds or, every fifth, never comes; errors and purchases stop.
@query("""WITH e AS (SELECT *, user_id || ' ' || strftime(ts, '%Y-%m-%d') AS session_id FROM events),
  c AS (SELECT session_id, ts AS started, ts + to_microseconds((value * 60000000)::BIGINT) AS finished, 'view ' || event_id AS context FROM e WHERE event_type = 'view' AND event_id % 5 > 0),
  s AS (SELECT session_id, event_id AS stop_id, ts AS stopped FROM e WHERE event_type IN ('error', 'purchase')),
  d AS (SELECT stop_id, arg_max(context, (finished, context)) AS context FROM s JOIN c ON c.session_id = s.session_id AND finished <= stopped GROUP BY 1),
  f AS (SELECT stop_id, arg_max(context, (started, context)) AS context FROM s JOIN c ON c.session_id = s.session_id AND started <= stopped AND finished > stopped GROUP BY 1)
SELECT stop_id, coalesce(d.context, f.context, 'at stop ' || stop_id) AS context, CASE WHEN d.context IS NOT NULL THEN 'captured' WHEN f.context IS NOT NULL THEN 'in flight' ELSE 'fallback' END AS tier
FROM s LEFT JOIN d USING (stop_id) LEFT JOIN f USING (stop_id)""")
def context_sources(spark, d):
    e = table(spark, d, "events").withColumn("session_id", F.concat(F.col("user_id").cast("string"), F.lit(" "), F.date_format("ts", "yyyy-MM-dd")))
    took = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("value").cast("decimal(18,6)") * 60)
    views = e.where("event_type = 'view'").select("session_id", F.col("ts").alias("started"), F.when(F.col("event_id") % 5 > 0, F.col("ts") + took).alias("finished"), F.concat(F.lit("view "), F.col("event_id").cast("string")).alias("context"))
    stops = e.where("event_type in ('error', 'purchase')").select("session_id", F.col("event_id").alias("stop_id"), F.col("ts").alias("at"), F.concat(F.lit("at stop "), F.col("event_id").cast("string")).alias("fallback"))
    return sessions.resolved_contexts(stops, views).select("stop_id", "context", "tier")
