"""Queries on event tables: the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.sources.tables import events


def velocity(s, d):
    """Events of each user in the seven days up to each event: a range frame, no self-join."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-7 * 86400, 0)
    return events(s, d).select("event_id", F.count("*").over(w).alias("n_7d"))


def capped(s, d, cap=3):
    """Events that a cap of messages in 24 hours would let through, counted over all of the user's messages."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-86400, -1)
    return events(s, d).withColumn("before", F.count("*").over(w)).filter(F.col("before") < cap).select("event_id", "before")


def sessions(s, d):
    """Sessions of a user, closed after 30 minutes without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("long") - F.lag(F.col("ts").cast("timestamp").cast("long")).over(w) > 1800
    e = events(s, d).withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def transitions(s, d):
    """Counts of state changes: an event type followed by another one of the user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(s, d).withColumn("next", F.lead("event_type").over(w)).filter("next IS NOT NULL").groupBy(F.col("event_type").alias("state"), "next").agg(F.count("*").alias("n"))


QUERIES = {
    "event_dedup": lambda s, d: events(s, d).groupBy("user_id", "event_type", F.date_trunc("day", "ts").alias("day")).agg(F.min("event_id").alias("event_id")),
    "tumbling_counts": lambda s, d: events(s, d).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total"),
    "sliding_velocity": velocity,
    "frequency_cap": capped,
    "sessions": sessions,
    "state_transitions": transitions,
    "lifecycle_pivot": lambda s, d: events(s, d).groupBy("user_id").agg(*[F.min(F.when(F.col("event_type") == t, F.col("ts"))).alias(f"first_{t}") for t in ("click", "purchase", "view")]),
}

_ep = "CAST(floor(epoch(ts)) AS BIGINT)"
_w = "PARTITION BY user_id ORDER BY ts, event_id"
ORACLES = {
    "event_dedup": "SELECT user_id, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3",
    "tumbling_counts": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "sliding_velocity": f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {_ep} RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS n_7d FROM events",
    "frequency_cap": f"SELECT event_id, n AS before FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {_ep} RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS n FROM events) WHERE n < 3",
    "sessions": f"""WITH a AS (SELECT *, CAST(coalesce({_ep} - lag({_ep}) OVER ({_w}) > 1800, true) AS INTEGER) AS new FROM events), b AS (SELECT *, sum(new) OVER ({_w}) AS session FROM a)
      SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY user_id, session""",
    "state_transitions": f"WITH a AS (SELECT event_type AS state, lead(event_type) OVER ({_w}) AS next FROM events) SELECT state, next, count(*) AS n FROM a WHERE next IS NOT NULL GROUP BY 1, 2",
    "lifecycle_pivot": "SELECT user_id, min(ts) FILTER (event_type = 'click') AS first_click, min(ts) FILTER (event_type = 'purchase') AS first_purchase, min(ts) FILTER (event_type = 'view') AS first_view FROM events GROUP BY 1",
}
