"""Streams run with `availableNow` must end where the batch operators end."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from casewell import schema as S
from casewell import sources as src
from casewell import streaming as st
from casewell.operators import events as ev
from casewell.operators import filters as f
from casewell.streaming.agents import RESOLUTION_LOG, TRIAGE_LOG

AS_OF = "2024-01-30 12:00:00"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _split(df, path, n):
    """Write a frame as n files, one per micro-batch."""
    for i in range(n):
        df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(n)) == i).coalesce(1).write.mode(
            "append").parquet(path)


def test_append_log_and_positions(spark, sf001, tmp_path):
    log = src.communications_log(spark, sf001)
    reg = src.register(spark, sf001)
    _split(log, str(tmp_path / "in"), 3)
    stream = st.file_stream(spark, str(tmp_path / "in"), log.schema, 1)
    st.run_available(
        st.append_batches(stream, str(tmp_path / "store"), lambda d: ev.valid_events(d, reg)),
        str(tmp_path / "ck"))
    stored = st.read_store(spark, str(tmp_path / "store"), log.schema)
    cols = ["complaint_id", "seq", "total_messages"]
    assert _rows(ev.add_communications(reg, None, stored).select(cols)) == _rows(
        ev.add_communications(reg, None, log).select(cols))


def test_latest_rejected_and_repeated(spark, sf001, tmp_path):
    events = src.escalation_requests(spark, sf001)
    reg = src.register(spark, sf001)
    _split(events, str(tmp_path / "in"), 3)

    def stream():
        return st.file_stream(spark, str(tmp_path / "in"), events.schema, 1)

    st.run_available(
        st.latest_live(stream()).writeStream.outputMode("complete").format("memory")
        .queryName("latest"), str(tmp_path / "c1"))
    assert _rows(spark.table("latest").select("complaint_id", "seq")) == _rows(
        ev.latest_per_id(events).select("complaint_id", "seq"))

    out = str(tmp_path / "bad")
    st.run_available(
        st.rejected_live(stream(), reg).writeStream.format("parquet").option("path", out),
        str(tmp_path / "c2"))
    assert _rows(spark.read.parquet(out).select("complaint_id", "seq")) == _rows(
        ev.rejected_events(events, reg).select("complaint_id", "seq"))

    once = str(tmp_path / "once")
    st.run_available(
        st.first_escalations(stream(), delay="3650 days").writeStream.format("parquet")
        .option("path", once), str(tmp_path / "c3"))
    ids = [r[0] for r in spark.read.parquet(once).select("complaint_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in events.select("complaint_id").distinct().collect())


def test_live_counts(spark, sf001, tmp_path):
    reg = src.register(spark, sf001)
    reg.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.file_stream(spark, str(tmp_path / "in"), reg.schema)
    st.run_available(
        st.status_counts_live(stream).writeStream.outputMode("complete").format("memory")
        .queryName("by_status"), str(tmp_path / "c1"))
    want = f.originals(reg).groupBy("status", "severity").count()
    assert _rows(spark.table("by_status")) == _rows(want)
    st.run_available(
        st.channel_counts_live(stream).writeStream.outputMode("append").format("memory")
        .queryName("by_day"), str(tmp_path / "c2"))
    got = spark.table("by_day")
    # days that the watermark has passed are complete and equal to the batch counts
    batch = f.originals(reg).groupBy(
        F.date_trunc("day", "created_date").alias("window_start"), "channel").count()
    last = reg.agg(F.max("created_date")).first()[0] - timedelta(hours=1)
    want = batch.where(F.col("window_start") + F.expr("interval 1 day") <= F.lit(last))
    assert got.count() > 0
    assert _rows(got.select("window_start", "channel", "count")) == _rows(want)


def test_triage_stream_equals_batch_and_is_idempotent(spark, sf001, tmp_path):
    reg = src.register(spark, sf001)
    _split(reg, str(tmp_path / "in"), 2)
    store, messages = str(tmp_path / "esc"), str(tmp_path / "msg")
    stream = st.file_stream(spark, str(tmp_path / "in"), reg.schema, 1)
    st.run_available(st.run_triage(stream, AS_OF, store, messages), str(tmp_path / "ck"))
    done = st.read_store(spark, store, TRIAGE_LOG)
    none = spark.createDataFrame([], TRIAGE_LOG)
    want = ev.auto_triage(reg, AS_OF, none)
    assert done.count() > 0
    assert _rows(done) == _rows(want)
    assert spark.read.parquet(messages).count() == done.count()
    # the same complaints once more: nothing new
    again = str(tmp_path / "in2")
    reg.coalesce(1).write.parquet(again)
    st.triage_batch(spark.read.parquet(again), 99, AS_OF, store, messages)
    assert st.read_store(spark, store, TRIAGE_LOG).count() == want.count()


def test_resolution_agent_takes_two_per_run_and_drops_none(spark, sf001, tmp_path):
    reg, verdicts = src.register(spark, sf001), src.verdicts(spark, sf001)
    options = {"categories": ["click"]}
    want = st.resolution_tick(reg, verdicts, spark.createDataFrame([], RESOLUTION_LOG), None,
                              **options)
    n = want.count()
    assert n > 2
    for _ in range(n // 2 + 2):
        spark.range(1).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    ticks = st.file_stream(spark, str(tmp_path / "ticks"), spark.range(1).schema, 1)
    store = str(tmp_path / "log")
    st.run_available(st.run_resolution_agent(ticks, reg, verdicts, store, 2, **options),
                     str(tmp_path / "ck"))
    log = spark.read.parquet(store)
    assert log.groupBy("batch_id").count().agg(F.max("count")).first()[0] == 2
    assert _rows(log.select("complaint_id")) == _rows(want.select("complaint_id"))


def test_deadline_timers(spark, tmp_path):
    base = datetime(2024, 1, 1)

    def at(h):
        return base + timedelta(hours=h)

    batches = [
        [("A", at(0), at(4), "Open"), ("B", at(0), at(24), "Open"), ("C", at(0), at(4), "Open")],
        [("C", at(1), None, "Resolved"), ("A", at(2), at(5), "Open")],
        [("clock", at(10), None, "tick")],
        [("clock", at(11), None, "tick")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, st.DEADLINE_SCHEMA).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    import os
    import time
    # file order decides the batches; spread the modification times
    files = sorted((p for p in (tmp_path / "in").glob("*.parquet")),
                   key=lambda p: p.stat().st_mtime_ns)
    now = time.time()
    for i, p in enumerate(files):
        os.utime(p, (now + i, now + i))
    stream = st.file_stream(spark, str(tmp_path / "in"), st.DEADLINE_SCHEMA, 1)
    st.run_available(
        st.deadline_firings(stream).writeStream.outputMode("append").format("memory")
        .queryName("fired"), str(tmp_path / "ck"))
    fired = [(r.complaint_id, r.due_ms) for r in spark.table("fired").collect()]
    due = int((at(5) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert fired == [("A", due)]
    assert S.SLA_HOURS["Critical"] == 4


class _Handle:
    """State of one key, counting calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_bucket_of_complaints_takes_few_state_calls():
    """Thousands of complaints, ids that are null or repeat, resolved and moved deadlines."""
    from casewell.streaming.timers import NEVER, DeadlineTimer

    def events(rows):
        out = pd.DataFrame(rows, columns=["complaint_id", "event_ms", "due_ms", "status"])
        return [out.assign(event_time=pd.to_datetime(out["event_ms"], unit="ms"))]

    handle, timers = _Handle(), DeadlineTimer()
    timers.init(handle)
    many = [(f"c{i}", 10, 1000 + i, "Open") for i in range(5000)] + [(None, 10, 2000, "Open")]
    assert list(timers.handleInputRows((0,), iter(events(many)), _Now(0))) == []
    later = [("c1", 20, NEVER, "Resolved"), ("c2", 20, 9000, "Open"), ("c3", 5, NEVER, "Resolved"),
             ("c4", 20, NEVER, "tick")]
    list(timers.handleInputRows((0,), iter(events(later)), _Now(0)))
    assert handle.timers == {1000}
    handle.timers.clear()
    info = _Now(1000)
    fired = pd.concat(timers.handleExpiredTimer((0,), _Now(2000), info))
    want = {f"c{i}": 1000 + i for i in range(1001) if i not in (1, 2)} | {None: 2000}
    assert dict(zip(fired["complaint_id"], fired["due_ms"])) == want and len(fired) == len(want)
    assert handle.timers == {2001} and handle.calls < 15
    assert list(timers.handleExpiredTimer((0,), _Now(2000), info)) == []  # no second time
