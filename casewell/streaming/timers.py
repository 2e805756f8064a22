"""Deadlines that pass as time moves on, by event-time timers.

Events are (complaint_id, event_time, due_date, status). A due date arms or re-arms the
deadline, the status Resolved cancels it, and each deadline fires once. The newest event of a
complaint by event time decides, in whatever batch it comes: state holds its time beside the
armed deadline, and older events change nothing.

Complaints are dealt over a fixed number of buckets by a hash of their id. A bucket is one key of
the stream: its complaints are one table in its state, and one timer waits for the earliest of
their times. So a batch reads and writes state once a bucket and not some times a complaint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

DEADLINE_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("due_date", T.TimestampType()),
    T.StructField("status", T.StringType()),
])
FIRING_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("due_ms", T.LongType()),
])
BUCKETS = 1024
#: A time that never comes: nothing is armed.
NEVER = np.iinfo(np.int64).max


class BucketTimers(StatefulProcessor):
    """Complaints of a bucket as a table: complaint_id, event_ms (time of the newest event) and
    the columns of `fields` with the values of a new complaint. Subclasses say how events change
    rows and which times a row waits for."""

    fields: dict[str, object] = {}

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("complaints", T.StructType([
            T.StructField("table", T.BinaryType()), T.StructField("timer_ms", T.LongType())]))

    # -- for subclasses

    def newest(self, events: pd.DataFrame) -> pd.DataFrame:
        """The event of each complaint that decides, from those of a batch."""
        raise NotImplementedError

    def apply(self, rows: pd.DataFrame, events: pd.DataFrame, known: np.ndarray) -> None:
        """Change `rows` by `events`, row by row; `known` tells old complaints from new ones."""
        raise NotImplementedError

    def pending(self, rows: pd.DataFrame) -> np.ndarray:
        """The next time that each row waits for."""
        raise NotImplementedError

    def expire(self, rows: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(rows that stay, firings) as event time passes `now`."""
        raise NotImplementedError

    # -- state and timers

    def _load(self) -> tuple[pd.DataFrame, int]:
        if not self.state.exists():
            kinds = {n: np.asarray([v]).dtype for n, v in self.fields.items()}
            return pd.DataFrame({"complaint_id": pd.Series(dtype=object), "event_ms": pd.Series(
                dtype=np.int64), **{n: pd.Series(dtype=k) for n, k in kinds.items()}}), NEVER
        table, timer = self.state.get()
        return pa.ipc.open_stream(table).read_pandas(), int(timer)

    def _save(self, rows: pd.DataFrame, timer: int, fired: bool = False) -> None:
        """Store the rows; `timer` waits, unless it has fired."""
        first = int(self.pending(rows).min()) if len(rows) else NEVER
        if first != timer or fired:
            if timer != NEVER and not fired:
                self.handle.deleteTimer(timer)
            if first != NEVER:
                self.handle.registerTimer(first)
        if not len(rows):
            self.state.clear()
            return
        table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(
                compression="zstd")) as out:
            out.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(), first))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        if parts:
            events = self.newest(pd.concat(parts, ignore_index=True))
            before, timer = self._load()
            at = pd.Index(before["complaint_id"]).get_indexer(events["complaint_id"])
            known = at >= 0
            late = known & (before["event_ms"].to_numpy()[at] > events["event_ms"].to_numpy()
                            if len(before) else False)
            events, at, known = events[~late], at[~late], known[~late]
            changed = pd.DataFrame({
                "complaint_id": events["complaint_id"], "event_ms": events["event_ms"],
                **self.fields}).reset_index(drop=True)
            for name in self.fields:
                changed.loc[known, name] = before[name].to_numpy()[at[known]]
            self.apply(changed, events.reset_index(drop=True), known)
            stay = np.ones(len(before), bool)
            stay[at[known]] = False
            whole = [f for f in (before[stay], changed) if len(f)]
            self._save(pd.concat(whole, ignore_index=True) if whole else changed, timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer = int(expiredTimerInfo.getExpiryTimeInMs())
        rows, current = self._load()
        if current != timer:  # another timer has taken its place
            return
        now = max(timer, int(timerValues.getCurrentWatermarkInMs()))
        rows, firings = self.expire(rows, now)
        self._save(rows, timer, fired=True)
        if len(firings):
            yield firings

    def close(self) -> None:
        pass


class DeadlineTimer(BucketTimers):
    fields = {"due_ms": NEVER}

    def newest(self, events):
        order = events.sort_values("event_time", kind="stable")
        return order.drop_duplicates("complaint_id", keep="last")

    def apply(self, rows, events, known):
        due, done = events["due_ms"], events["status"] == "Resolved"
        rows["due_ms"] = np.where(done, NEVER, np.where(due != NEVER, due, rows["due_ms"]))

    def pending(self, rows):
        return rows["due_ms"].to_numpy()

    def expire(self, rows, now):
        over = rows["due_ms"] <= now
        firings = rows.loc[over, ["complaint_id", "due_ms"]]
        return rows.assign(due_ms=rows["due_ms"].mask(over, NEVER)), firings


def bucketed(events: DataFrame, delay: str, buckets: int):
    """Events with times in milliseconds, by bucket; `due_ms` is NEVER without a due date. Events
    without a time have no place among the others and are left out."""
    return (
        events.withWatermark("event_time", delay).where(F.col("event_time").isNotNull())
        .select(F.pmod(F.xxhash64("complaint_id"), F.lit(buckets)).alias("bucket"),
                "complaint_id", "event_time", F.unix_millis("event_time").alias("event_ms"),
                F.coalesce(F.unix_millis("due_date"), F.lit(int(NEVER))).alias("due_ms"), "status")
        .groupBy("bucket")
    )


def deadline_firings(events: DataFrame, delay: str = "0 seconds", buckets: int = BUCKETS
                     ) -> DataFrame:
    """(complaint_id, due_ms) once per deadline that passes in event time. Needs the RocksDB
    state store provider."""
    return bucketed(events, delay, buckets).transformWithStateInPandas(
        statefulProcessor=DeadlineTimer(), outputStructType=FIRING_SCHEMA, outputMode="Append",
        timeMode="EventTime")
