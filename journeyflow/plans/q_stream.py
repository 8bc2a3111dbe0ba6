"""Catalogue: U1, the session-window journey operator (batch twin of the stream)."""

from __future__ import annotations

from pyspark.sql import functions as F

from journeyflow.plans.common import table
from journeyflow.plans.registry import query
from journeyflow.plans.sql import with_ctes
from journeyflow.streaming.sessions import journey_sessions


@query("u1_stream_journeys_batch_twin", sql=with_ctes("j1_s") + """SELECT user_id, make_timestamp(min(us)) AS session_start,
       make_timestamp(max(us)) AS session_end, CAST(count(*) AS BIGINT) AS n_events, bool_or(event_type = 'purchase') AS reached_success
FROM j1_s GROUP BY user_id, sid""")
def u1(spark, sf):
    ev = table(spark, sf, "events")
    return journey_sessions(ev, "user_id", "ts", "12 hours", F.col("event_type") == "purchase")
