"""Progress events as a stream: counts per hour and kind, and the state of each item, late events bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Statuses after which nothing more is awaited, and how long an item may be silent before that (minutes).
ENDED = ("COMPLETED", "FAILED", "CANCELLED")
IDLE = 15


def timeline(events: DataFrame, late: str | None = None) -> DataFrame:
    """hour, event_type, n. With `late`, of a stream whose events may come so late."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def latest(events: DataFrame) -> DataFrame:
    """The last status of each item: user_id, status, at."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


def once(events: DataFrame, late: str) -> DataFrame:
    """A stream's events by `id`, those that come again within `late` and those that are later than it left out."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def tracked(events: DataFrame, late: str = "10 minutes", idle: int = IDLE) -> DataFrame:
    """The state of each item of a stream of `events` (item, id, ts, status, types): item, ts, status, types, n_events, expired.

    A row is given out whenever an item's state changes, so the last row by n_events is its present state. Events may
    come in any order: the status is that of the greatest (ts, id), types the last that is not null by the same order.
    An event that comes again counts once, one that is later than `late` not at all. An item that has not ended and is
    silent for `idle` minutes of event time gets a last row that is `expired`; then, and when one that has ended is
    silent for as long, its state is given up. State is kept by item in the state store and taken up again from the checkpoint.
    """
    micros = lambda t: int(pd.Timestamp(t).value // 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["item", "ts", "status", "types", "n_events", "expired"]
        n, at, last, status, types_at, types_id, types = state.get if state.exists else (0, None, None, None, None, None, None)

        def row(expired: bool) -> pd.DataFrame:
            return pd.DataFrame([(key[0], pd.Timestamp(at, unit="us"), status, types, n, expired)], columns=columns).astype({"types": "Int64"})

        if state.hasTimedOut:
            state.remove()
            if status not in ENDED:
                yield row(True)
            return
        before = (at, last, types_at, types_id)
        for part in parts:
            for e in part.itertuples(index=False):
                n, place = n + 1, (micros(e.ts), int(e.id))
                if at is None or place > (at, last):
                    (at, last), status = place, e.status
                if not pd.isna(e.types) and (types_at is None or place > (types_at, types_id)):
                    (types_at, types_id), types = place, int(e.types)
        state.update((n, at, last, status, types_at, types_id, types))
        state.setTimeoutTimestamp(max(at // 1000 + idle * 60_000, state.getCurrentWatermarkMs() + 1))
        if before != (at, last, types_at, types_id):
            yield row(False)

    shown = once(events.select("item", "id", "ts", "status", F.col("types").cast("long").alias("types")), late)
    kind = shown.schema["item"].dataType.simpleString()
    return shown.groupBy("item").applyInPandasWithState(
        run, f"item {kind}, ts timestamp, status string, types long, n_events long, expired boolean",
        "n long, at long, last long, status string, types_at long, types_id long, types long", "append", GroupStateTimeout.EventTimeTimeout,
    )


def state_of(rows: DataFrame) -> DataFrame:
    """The present state of each item from the rows that `tracked` has given out."""
    columns = [c for c in rows.columns if c != "item"]
    return rows.groupBy("item").agg(F.max_by(F.struct(*columns), F.struct("n_events", "expired", "ts")).alias("s")).select("item", "s.*")


def ready(latest_status: DataFrame, outputs: DataFrame, completed: str = "COMPLETED") -> DataFrame:
    """Items that can be verified: `latest_status` (item, status) is `completed` and `outputs` (item, extracted) has their output."""
    there = outputs.filter("extracted").select(F.col("item").alias("__item"))
    return latest_status.filter(F.col("status") == completed).join(there, F.col("item").cast("string") == F.col("__item").cast("string"), "left_semi")
