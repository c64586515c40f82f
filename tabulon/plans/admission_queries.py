"""Admission queries over ``events`` (Z1 batch and stream, Z2).

Key = user_id.  The reference's 20 requests per 60 s never binds on 150
users over 30 days, so the window is one day and the limit 2: then most
arrivals meet a full window and rejections feed back into later decisions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import admission as Z
from tabulon.plans.registry import register
from tabulon.sources.testdata import table
from tabulon.streaming.admission_stream import admission_stream, run_to_table

WINDOW_S = 86_400
LIMIT = 2
WINDOW_US = WINDOW_S * 1_000_000


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), "ts")


# One step per event of each key; the state is the list of admitted stamps
# inside the window.
ADMISSION_SQL = f"""
WITH RECURSIVE ev AS (
  SELECT user_id AS k, event_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
r(k, i, event_id, t, admitted, stamps) AS (
  SELECT k, i, event_id, t, true, [t] FROM ev WHERE i = 1
  UNION ALL
  SELECT e.k, e.i, e.event_id, e.t,
         len(list_filter(r.stamps, lambda s: s >= e.t - {WINDOW_US})) < {LIMIT},
         CASE WHEN len(list_filter(r.stamps, lambda s: s >= e.t - {WINDOW_US})) < {LIMIT}
              THEN list_append(list_filter(r.stamps, lambda s: s >= e.t - {WINDOW_US}), e.t)
              ELSE list_filter(r.stamps, lambda s: s >= e.t - {WINDOW_US}) END
  FROM r JOIN ev e ON e.k = r.k AND e.i = r.i + 1)"""


@register("admission_batch", ADMISSION_SQL + "\nSELECT event_id, k AS key, admitted FROM r")
def admission_batch(spark, sf):
    """Z1 over the whole event table: admitted or rejected per event."""
    return Z.admission(_events(spark, sf), limit=LIMIT, window_seconds=WINDOW_S).select(
        "event_id", "key", "admitted")


@register("admission_summary", ADMISSION_SQL + """
SELECT k AS key, count(*) AS arrivals, CAST(sum(CAST(admitted AS BIGINT)) AS BIGINT) AS admitted,
       CAST(sum(CAST(NOT admitted AS BIGINT)) AS BIGINT) AS rejected FROM r GROUP BY k""")
def admission_summary(spark, sf):
    """Z1 per key: arrivals, admitted, rejected."""
    return Z.admission_summary(Z.admission(_events(spark, sf), limit=LIMIT, window_seconds=WINDOW_S))


@register("admission_arrivals", f"""
SELECT event_id, user_id AS key,
       count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                      RANGE BETWEEN {WINDOW_US} PRECEDING AND CURRENT ROW) AS arrivals
FROM events""")
def admission_arrivals(spark, sf):
    """Arrivals of the key in the closed window ending at each event."""
    return Z.arrivals_in_window(_events(spark, sf), window_seconds=WINDOW_S).select("event_id", "key", "arrivals")


@register("admission_stream", ADMISSION_SQL + "\nSELECT event_id, k AS key, admitted FROM r")
def admission_stream_query(spark, sf):
    """Z1 as a stream: the events file read as a file stream (availableNow)
    through keyed state into a parquet table in the shared checkpoint
    folder; must equal the batch decisions."""
    schema = table(spark, sf, "events").schema
    out = run_to_table(spark, sf, schema, lambda s: admission_stream(
        s.select("event_id", F.col("user_id").alias("key"), "ts"), limit=LIMIT, window_seconds=WINDOW_S),
        glob="events.parquet")
    return out.select("event_id", "key", "admitted")
