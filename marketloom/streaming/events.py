"""Structured Streaming forms of the event operators.

Each takes and returns a streaming DataFrame with an event-time column; state is bounded by the watermark. The
batch forms in :mod:`marketloom.plans.events` give the same rows on the same input.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are forgotten once the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def tumbling(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, given out when a window can no longer change."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, width: str = "30 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each user in sliding windows."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width, step).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.end").alias("until"), "user_id", "n")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("first_ts"), "n")
    )


def attribute(clicks: DataFrame, changes: DataFrame, hours: int = 168, late: str = "1 hour") -> DataFrame:
    """Changes with the clicks of their user in the hours before: an interval join, whose state is bounded by it."""
    c = clicks.withWatermark("ts", late).select(F.col("user_id").alias("c_user"), F.col("ts").alias("click_ts"))
    e = changes.withWatermark("ts", late)
    near = (F.col("user_id") == F.col("c_user")) & (F.col("click_ts") <= F.col("ts")) & (F.col("click_ts") >= F.col("ts") - F.expr(f"INTERVAL {hours} HOURS"))
    return e.join(c, near).drop("c_user")


def last_click(events: DataFrame, hours: int = 168, change: str = "purchase", late: str = "1 hour") -> DataFrame:
    """Each change with the last click of its user in the hours before it: ``event_id, user_id, ts, click_ts`` (null: none), ``late``.

    A change waits in its user's state until the watermark has passed it, as a click may still come; then it is given out once, in
    the batch that passes it or by a timer. Clicks stay for the hours that they may count for, so state is bounded by the
    watermark, which follows clicks and changes alone. Rows behind it come too late: they are given out apart, marked ``late`` and
    without a click, and change nothing. A click at the time of a change counts.
    """
    out = "event_id long, user_id long, ts timestamp, click_ts timestamp, late boolean"
    span = hours * 3_600_000_000

    def micros(ts: pd.Series) -> list[int]:
        return ts.astype("datetime64[us]").astype("int64").tolist()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clicks, ids, times = map(list, state.get) if state.exists else ([], [], [])
        mark = state.getCurrentWatermarkMs() * 1000
        rows = []
        if not state.hasTimedOut:
            for batch in frames:
                behind = batch["ts"] < pd.Timestamp(mark, unit="us")
                rows += [(i, key[0], t, None, True) for i, t in zip(batch.loc[behind, "event_id"], batch.loc[behind, "ts"], strict=True)]
                batch = batch[~behind]
                is_click = batch["event_type"] == "click"
                clicks += micros(batch.loc[is_click, "ts"])
                ids += batch.loc[~is_click, "event_id"].tolist()
                times += micros(batch.loc[~is_click, "ts"])
        clicks.sort()
        for i, t in ((i, t) for i, t in zip(ids, times, strict=True) if t < mark):
            k = bisect.bisect_right(clicks, t) - 1
            near = clicks[k] if k >= 0 and clicks[k] >= t - span else None
            rows.append((i, key[0], pd.Timestamp(t, unit="us"), None if near is None else pd.Timestamp(near, unit="us"), False))
        waiting = [(i, t) for i, t in zip(ids, times, strict=True) if t >= mark]
        clicks = [c for c in clicks if c >= mark - span]
        if waiting or clicks:
            state.update((clicks, [i for i, _ in waiting], [t for _, t in waiting]))
            due = min(t for _, t in waiting) // 1000 + 1 if waiting else (clicks[-1] + span) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if rows:
            frame = pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "click_ts", "late"])
            yield frame.astype({"ts": "datetime64[us]", "click_ts": "datetime64[us]"})

    kinds = events.withWatermark("ts", late).filter(F.col("event_type").isin("click", change)).select("event_id", "user_id", "ts", "event_type")
    return kinds.groupBy("user_id").applyInPandasWithState(
        step, out, "clicks array<long>, ids array<long>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def transitions(events: DataFrame, moves: dict[tuple[str, str], str], start: str, expire_days: int = 90) -> DataFrame:
    """Each user's state machine: ``user_id, ts, state_from, state_to``.

    ``moves`` maps (state, event type) to the next state. A user without events for ``expire_days`` moves to
    ``expired`` by a timer. Events of a batch are taken in order of time, then id.
    """
    out = "user_id long, ts timestamp, state_from string, state_to string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        user, rows = key[0], []
        now, last = state.get if state.exists else (start, 0)
        if state.hasTimedOut:
            rows.append((user, pd.Timestamp(last + expire_days * 86_400_000, unit="ms"), now, "expired"))
            state.remove()
        else:
            batch = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            for ts, kind in zip(batch["ts"], batch["event_type"], strict=True):
                to = moves.get((now, kind))
                if to:
                    rows.append((user, ts, now, to))
                    now = to
                last = max(last, int(pd.Timestamp(ts).timestamp() * 1000))
            state.update((now, last))
            state.setTimeoutTimestamp(max(last + expire_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["user_id", "ts", "state_from", "state_to"])

    return (
        events.withWatermark("ts", "1 hour")
        .groupBy("user_id")
        .applyInPandasWithState(step, out, "state string, last long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work through what is there and stop; files are committed exactly once."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work through what is there and leave the whole result, also of what may still change; each batch replaces the last one's."""
    replace = lambda df, _: df.write.mode("overwrite").parquet(path)
    query = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
