"""The escalation ladder as time moves on: event-time timers for the rungs of each complaint.

Events are (complaint_id, event_time, due_date, status). A due date arms the rungs that have not
fired yet, a later event with another due date (an extension) moves them, Resolved cancels them,
and each rung of a complaint fires once. The newest event by event time decides, in whatever batch
it comes. One more time forgets a complaint `ttl_days` after its newest event and its last rung,
in event time, so that settled complaints do not stay for ever."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.policy_rules import ladder_rungs
from .timers import BUCKETS, NEVER, BucketTimers, bucketed

RUNG_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("ladder_level", T.StringType()),
    T.StructField("fired_ms", T.LongType()),
])


class LadderTimers(BucketTimers):
    """Columns armed_<level> (its time), fired_<level> and forget_ms of each complaint."""

    def __init__(self, ttl_days: int):
        self.ttl_ms = ttl_days * 86_400_000
        self.rungs = ladder_rungs()
        self.armed = [f"armed_{level}" for level, _ in self.rungs]
        self.fired = [f"fired_{level}" for level, _ in self.rungs]
        self.fields = {"forget_ms": NEVER, **dict.fromkeys(self.armed, NEVER),
                       **dict.fromkeys(self.fired, False)}

    def newest(self, events):
        order = events.assign(done=events["status"] == "Resolved").sort_values(
            ["event_time", "done"], ascending=False, kind="stable")
        return order.drop_duplicates("complaint_id")

    def apply(self, rows, events, known):
        at, due = events["event_ms"].to_numpy(), events["due_ms"].to_numpy()
        done = (events["status"] == "Resolved").to_numpy()
        moved = ~done & (due != NEVER)
        quiet = ~done & ~moved & known  # nothing new about the deadline
        end = np.where(quiet, np.maximum(at, np.where(quiet, rows["forget_ms"], 0) - self.ttl_ms),
                       at)
        base = np.where(moved, due, 0)
        for (_, distance), armed, fired in zip(self.rungs, self.armed, self.fired):
            time = base + distance
            end = np.where(moved, np.maximum(end, time), end)
            free = moved & ~rows[fired].to_numpy(bool)
            rows[armed] = np.where(free, time, np.where(done | moved, NEVER, rows[armed]))
        rows["forget_ms"] = end + self.ttl_ms

    def pending(self, rows):
        return rows[["forget_ms", *self.armed]].to_numpy().min(axis=1)

    def expire(self, rows, now):
        found, rows = [], rows.copy()
        for (level, _), armed, fired in zip(self.rungs, self.armed, self.fired):
            over = rows[armed] <= now
            found.append(pd.DataFrame({"complaint_id": rows.loc[over, "complaint_id"],
                                       "ladder_level": level, "fired_ms": rows.loc[over, armed]}))
            rows[fired] |= over
            rows[armed] = rows[armed].mask(over, NEVER)
        found = pd.concat([f for f in found if len(f)] or found[:1], ignore_index=True)
        return rows[rows["forget_ms"] > now].reset_index(drop=True), found


def ladder_firings(events: DataFrame, delay: str = "0 seconds", ttl_days: int = 365,
                   buckets: int = BUCKETS) -> DataFrame:
    """(complaint_id, ladder_level, fired_ms) once per rung that event time passes. Needs the
    RocksDB state store provider."""
    return bucketed(events, delay, buckets).transformWithStateInPandas(
        statefulProcessor=LadderTimers(ttl_days), outputStructType=RUNG_SCHEMA,
        outputMode="Append", timeMode="EventTime")
