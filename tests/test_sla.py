"""Hand-worked deadline tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casewell import sources as src
from casewell.operators import events as ev
from casewell.operators import filters, sla, stats

AS_OF = "2024-01-10 00:00:00"
ROWS = [
    ("a", "Critical", "2024-01-09 21:00", 4, 1.0, "On Track", 75.0),
    ("b", "Critical", "2024-01-09 20:30", 4, 0.5, "At Risk", 87.5),
    ("c", "Critical", "2024-01-09 20:00", 4, 0.0, "At Risk", 100.0),
    ("d", "Critical", "2024-01-09 19:59", 4, -1 / 60, "Breached", 100.0),
    ("e", "High", "2024-01-09 12:00", 24, 12.0, "On Track", 50.0),
    ("f", "Weird", "2024-01-08 00:00", 72, 24.0, "On Track", 200 / 3),
    ("g", "Low", "2024-01-01 00:00", 168, -48.0, "Breached", 100.0),
    ("h", "Medium", "2024-01-11 00:00", 72, 96.0, "On Track", -100 / 3),
]
SCHEMA = ("complaint_id string, severity string, created_date timestamp, status string, "
          "is_duplicate boolean, category string, branch string, channel string, "
          "sentiment string, resolution_days double")


@pytest.fixture(scope="module")
def register(spark):
    rows = [(r[0], r[1], datetime.strptime(r[2], "%Y-%m-%d %H:%M"), "Open", False, "Credit Card",
             "b1", "Email", "Angry", None) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


def test_states(register):
    got = {r.complaint_id: r for r in sla.sla_columns(register, AS_OF).collect()}
    for key, _, _, hours, remaining, status, pct in ROWS:
        r = got[key]
        assert (r.sla_hours, r.sla_status) == (hours, status)
        assert r.hours_remaining == pytest.approx(remaining)
        assert r.completion_pct == pytest.approx(pct)
        assert r.is_breached == (status == "Breached")


def test_summary_and_empty(register):
    r = sla.sla_summary(register, AS_OF).first()
    assert tuple(r) == (8, 4, 2, 2, 50.0)
    assert tuple(sla.sla_summary(register.limit(0), AS_OF).first()) == (0, 0, 0, 0, 100.0)


def test_states_partition_the_unresolved(spark, sf001):
    from casewell import sources as src

    reg = src.register(spark, sf001)
    r = sla.sla_summary(reg, "2024-01-30 12:00:00").first()
    n = filters.not_resolved(filters.originals(reg)).count()
    assert r.total_open == n == r.on_track + r.at_risk + r.breached


def test_flags_and_triage(spark, register):
    flags = {r.complaint_id: r.flag_reason for r in sla.regulatory_flags(register, AS_OF).collect()}
    assert flags == {**dict.fromkeys("abcd", "Critical severity"), "g": "SLA breached"}
    none = spark.createDataFrame([], "complaint_id string")
    first = ev.auto_triage(register, AS_OF, none)
    assert [(r.complaint_id, r.escalation_level, r.escalated_to) for r in first.collect()] == [
        ("d", "L2", "Credit Card Disputes Team")]
    assert ev.auto_triage(register, AS_OF, first).count() == 0


def test_extensions_do_not_add_up(spark, register):
    events = spark.createDataFrame(
        [("g", 1, 24, "first", None), ("g", 2, 72, "second", None), ("zz", 3, 5, "x", None)],
        "complaint_id string, seq long, extend_hours int, reason string, extended_at timestamp")
    ext = ev.extend_sla(register, events)
    assert [(r.complaint_id, r.due_date, r.extended_by) for r in ext.collect()] == [
        ("g", datetime(2024, 1, 11), 72)]
    r = sla.sla_columns(register, AS_OF, ext).where("complaint_id = 'g'").first()
    assert (r.sla_status, r.hours_remaining) == ("At Risk", 24.0)
    assert r.completion_pct == pytest.approx(100 * (1 - 24 / 168))
    texts = [m.message for m in ev.extension_messages(register, events).orderBy("seq").collect()]
    assert texts[1] == ("SLA extended by 72 hours. Reason: second. New due: 2024-01-11 00:00")


def test_missing_values(spark, register):
    odd = register.withColumn("status", F.lit(None).cast("string")).withColumn(
        "category", F.when(F.col("complaint_id") != "a", F.col("category")))
    assert filters.not_resolved(odd).count() == 8
    assert stats.count_by(odd, "category").first()["count"] == 7
    total = stats.regulatory_summary(odd).where("dimension = 'total'").first()
    assert (total.total, total.pending) == (8, 8)
    undated = register.withColumn("created_date", F.lit(None).cast("timestamp"))
    r = sla.sla_columns(undated, AS_OF).first()
    assert r.sla_status is None and r.completion_pct is None
    unflagged = register.withColumn("is_duplicate", F.lit(None).cast("boolean"))
    assert filters.originals(unflagged).count() == 0


def test_display_is_half_even(register):
    shown = {r.complaint_id: r for r in sla.sla_display(sla.sla_columns(register, AS_OF)).collect()}
    assert shown["f"].completion_pct == 66.7
    assert shown["a"].due_date == "2024-01-10 01:00"


def test_capped_list_keeps_total(register):
    rows = sla.capped(sla.breached(register, AS_OF), 1).collect()
    assert [(r.complaint_id, r.total) for r in rows] == [("d", 2)]


def test_capped_list_and_total_in_one_scan(spark, sf001):
    rows = sla.breached(src.register(spark, sf001), AS_OF).select("complaint_id", "severity")
    got = sla.capped(rows, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    want = rows.orderBy("complaint_id").limit(5).collect()
    assert [(r.complaint_id, r.severity) for r in got.collect()] == [tuple(r) for r in want]
    assert {r.total for r in got.collect()} == {rows.count()}


def test_capped_list_of_many_tasks_nulls_and_ties(spark):
    ids = spark.range(0, 5000, 1, 100).select(F.format_string("%05d", "id").alias("complaint_id"))
    odd = spark.createDataFrame([(None,), ("00001",), ("00001",)], "complaint_id string")
    got = sla.capped(ids.unionAll(odd), 4, "n").collect()
    assert [(r.complaint_id, r.n) for r in got] == [
        ("00000", 5003), ("00001", 5003), ("00001", 5003), ("00001", 5003)]
    assert [r.complaint_id for r in sla.capped(odd, 9).collect()] == ["00001", "00001", None]
    assert sla.capped(odd.limit(0), 3).collect() == [] == sla.capped(odd, 0).collect()


def test_running_numbers_with_a_hot_key(spark):
    """One key with most rows; slices of ten numbers instead of one window."""
    rows = [("hot", i) for i in range(0, 400, 3)] + [("cold", 5), ("cold", 395)]
    df = spark.createDataFrame(rows, "complaint_id string, seq long")
    got = {(r.complaint_id, r.seq): r.position
           for r in ev.running_number(df, "complaint_id", width=10).collect()}
    for key in ("hot", "cold"):
        seqs = sorted(s for k, s in rows if k == key)
        assert [got[key, s] for s in seqs] == list(range(1, len(seqs) + 1))


def test_plan_of_summary_has_one_small_shuffle(register, spark, sf001):
    from casewell import sources as src

    df = sla.sla_summary(src.register(spark, sf001), AS_OF)
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("\n+- Exchange") <= 1 and "Python" not in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan




def test_one_complaint_holds_most_events(spark, register):
    """The last request wins for a hot id as for any other; strangers are rejected."""
    rows = [("g", i, f"L{i % 3}", "r", "t", None, None) for i in range(3000)]
    rows += [("a", 1, "L1", "r", "t", "me", None), ("zz", 2, "L1", "r", "t", None, None)]
    events = spark.createDataFrame(
        rows, "complaint_id string, seq long, escalation_level string, reason string, "
              "escalated_to string, escalated_by string, escalated_at timestamp").repartition(8)
    got = {r.complaint_id: (r.seq, r.escalation_level, r.escalated_by)
           for r in ev.escalate(register, events).collect()}
    assert got == {"g": (2999, "L2", "Agent"), "a": (1, "L1", "me")}
    assert ev.rejected_events(events, register).count() == 1
    summary = {r.level: r["count"] for r in
               stats.escalation_summary(register, ev.escalate(register, events)).collect()}
    assert summary == {"L1": 1, "L2": 1}
