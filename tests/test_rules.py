"""Policy rules, clusters, bursts and their streams: hand-worked cases, hot keys, brute force."""

import itertools
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from casewell import schema as S
from casewell import streaming as st
from casewell.operators import clusters, policy_rules, sessions, timeline

BASE = datetime(2024, 1, 1)
REGISTER = ("complaint_id string, category string, severity string, status string, "
            "created_date timestamp, resolution_days double, is_duplicate boolean, "
            "duplicate_of string")


def at(hours):
    return BASE + timedelta(hours=hours)


def row(key, category="Credit Card", severity="Critical", status="Open", created=0, days=None,
        dup=False, of=None):
    return (key, category, severity, status, None if created is None else at(created), days, dup,
            of)


def frame(spark, rows, kind=REGISTER):
    return spark.createDataFrame(rows, kind)


def ms(ts):
    return int((ts - datetime(1970, 1, 1)).total_seconds() * 1000)


# -- timeline ------------------------------------------------------------------

def log_with_a_busy_key(n=3000, seed=3):
    pick = random.Random(seed)
    rows = [("hot" if pick.random() < .4 else f"k{pick.randrange(50)}",
             at(pick.randrange(400) / 4), i) for i in range(n)]
    return rows + [(None, at(1), n), ("hot", None, n + 1)]


def test_intervals_of_validity(spark):
    rows = log_with_a_busy_key()
    log = frame(spark, rows, "complaint_id string, ts timestamp, seq bigint")
    for hours in (1, 24, 10_000):
        found = {r.seq: r.valid_until for r in timeline.valid_until(
            log, "ts", "seq", slice_hours=hours).collect()}
        want = {}
        by_key = defaultdict(list)
        for key, ts, seq in rows:
            if key is not None and ts is not None:
                by_key[key].append((ts, seq))
        for events in by_key.values():
            events.sort()
            want |= {a[1]: b[0] for a, b in itertools.pairwise(events)} | {events[-1][1]: None}
        assert found == want


def test_next_row_of_another_log(spark):
    rows, others = log_with_a_busy_key(seed=4), log_with_a_busy_key(seed=5)
    left = frame(spark, rows, "complaint_id string, ts timestamp, seq bigint")
    right = frame(spark, others, "complaint_id string, at timestamp, ts bigint")
    by_key = defaultdict(list)
    for key, ts, _ in others:
        if key is not None and ts is not None:
            by_key[key].append(ts)
    want = {seq: None if ts is None else min((t for t in by_key[key] if t >= ts), default=None)
            for key, ts, seq in rows}
    for hours in (1, 24, 10_000):
        found = timeline.next_after(left, right, "ts", "at", slice_hours=hours)
        assert found.columns == ["complaint_id", "ts", "seq", "next_at"]
        assert {r.seq: r.next_at for r in found.collect()} == want


def test_a_busy_thread_is_split(spark):
    """Rows are ordered by (key, slice): no window over rows has the key alone."""
    log = frame(spark, log_with_a_busy_key(), "complaint_id string, ts timestamp, seq bigint")
    for df in (timeline.valid_until(log, "ts", "seq"), timeline.next_after(log, log, "ts", "ts")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert len(windows) == 2 and sum("_slice" in w.split("], [")[1] for w in windows) == 1


# -- ladder, acknowledgement, ageing, penalties --------------------------------

def test_ladder(spark):
    hours = {"a": 3.9, "b": 4, "c": 4.1, "d": 52, "e": 52.1, "f": 124, "g": 124.1}
    rows = [row(k, created=-h) for k, h in hours.items()]
    rows += [row("r", status="Resolved", created=-999), row("n", created=None),
             row("x", category=None, status=None, created=-60), row("y", dup=True, created=-60)]
    found = {r.complaint_id: r for r in policy_rules.escalation_ladder(
        frame(spark, rows), BASE).collect()}
    assert {k: r.ladder_level for k, r in found.items()} == {
        "c": "L1", "d": "L1", "e": "L2", "f": "L2", "g": "L3", "x": "L2"}
    assert found["c"].escalated_to == "Credit Card Disputes Team - Level 1 Manager"
    assert found["e"].escalated_to == "Zonal Head" and not found["e"].regulatory_alert
    assert found["g"].regulatory_alert


def test_acknowledgement(spark):
    rows = [row("a"), row("b"), row("c"), row("d", status="Resolved", days=31.0),
            row("e", status="Resolved"), row("n", created=None), row("f", status=None)]
    messages = [("a", "customer", at(1)), ("a", "agent", at(-1)), ("a", "agent", at(5)),
                ("a", "agent", at(9)), ("b", "agent", at(73)), ("c", "agent", at(0)),
                ("f", "agent", at(999)), (None, "agent", at(1)), ("e", "agent", None)]
    log = frame(spark, messages, "complaint_id string, sender string, ts timestamp")
    found = {r.complaint_id: r for r in policy_rules.ack_and_final_deadlines(
        frame(spark, rows), log, at(24 * 30 + 1)).collect()}
    assert {k: r.ack_hours for k, r in found.items()} == {
        "a": 5, "b": 73, "c": 0, "d": None, "e": None, "n": None, "f": None}
    assert {k for k, r in found.items() if r.ack_late} == {"b", "d", "e", "f"}
    assert {k for k, r in found.items() if r.final_late} == {"a", "b", "c", "d", "f"}
    early = policy_rules.ack_and_final_deadlines(frame(spark, rows), log, at(24 * 30)).collect()
    assert {r.complaint_id for r in early if r.final_late} == {"d"}


def test_stages_add_up_to_the_age(spark):
    rows = [row("a"), row("b", status="Resolved", days=10.0), row("late", created=24 * 50),
            row("n", created=None), row("q", status="Resolved")]
    log = [("a", 0, "Open", at(0)), ("a", 1, "Escalated", at(24 * 5)),
           ("a", 2, "Open", at(24 * 8)), ("b", 0, "Open", at(0)), ("b", 1, "Resolved", at(240)),
           ("b", 2, "Open", at(480)), ("late", 0, "Open", at(24 * 50)),
           ("x", 0, "Open", at(0)), ("q", 0, "Open", at(-48)), ("n", 0, "Open", at(3))]
    found = policy_rules.stage_ageing(
        frame(spark, rows),
        frame(spark, log, "complaint_id string, seq bigint, status string, changed_at timestamp"),
        at(24 * 40)).collect()
    days = {(r.complaint_id, r.stage, r.status): r.days for r in found}
    assert days == {
        ("a", "Branch", "Open"): 5, ("a", "Branch", "Escalated"): 2,
        ("a", "Zonal Office", "Escalated"): 1, ("a", "Zonal Office", "Open"): 6,
        ("a", "Principal Nodal Officer", "Open"): 15, ("a", "Overdue", "Open"): 11,
        ("b", "Branch", "Open"): 7, ("b", "Zonal Office", "Open"): 3,
        ("q", "Branch", "Open"): 7, ("q", "Zonal Office", "Open"): 7,
        ("q", "Principal Nodal Officer", "Open"): 15, ("q", "Overdue", "Open"): 11}


def plain_penalty(created, limit, versions, end):
    total, k = 0, 1
    while created + timedelta(days=k) <= end:
        day = created + timedelta(days=k)
        hours = max(((t, s, h) for t, s, h in versions if t <= day), default=(0, 0, 0))[2]
        total += day > created + timedelta(days=limit, hours=hours)
        k += 1
    return total


def test_penalty_against_a_walk_over_days(spark):
    pick = random.Random(8)
    rows, log = [], []
    for i in range(120):
        days = float(pick.randrange(1, 15)) if pick.random() < .3 else None
        rows.append(row(f"c{i}", pick.choice([*S.PENALTY_DAYS, "Credit Card", None]),
                        status="Resolved" if days else "Open",
                        created=pick.randrange(500), days=days))
        log += [(f"c{i}", pick.randrange(900), pick.randrange(300), at(pick.randrange(-50, 800)))
                for _ in range(pick.choice([0, 0, 1, 3, 9]))]
    log = [(k, s, h, t) for s, (k, _, h, t) in enumerate(log)]
    as_of = at(24 * 25)
    found = {r.complaint_id: (r.penalty_days, r.penalty) for r in policy_rules.penalty_accrual(
        frame(spark, rows),
        frame(spark, log, "complaint_id string, seq bigint, extend_hours int, "
                          "extended_at timestamp"), as_of, slice_hours=100).collect()}
    want = {}
    for key, category, _, status, created, days, _, _ in rows:
        if category in S.PENALTY_DAYS:
            end = min(as_of, created + timedelta(days=days)) if days else as_of
            n = plain_penalty(created, S.PENALTY_DAYS[category],
                              [(t, s, h) for k, s, h, t in log if k == key], end)
            want[key] = (n, 100 * n)
    assert found == want and any(n for n, _ in want.values())


# -- clusters ------------------------------------------------------------------

def plain_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    pick = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in range(1000)],
             "star": [(10_000 - i, 5000) for i in range(10_000)],
             "random": [(pick.randrange(300), pick.randrange(300)) for _ in range(180)]
             + [(1, None), (None, None), (7, 7), (301, 301)]}[shape]
    pick.shuffle(edges)
    found = clusters.components(frame(spark, edges, "a int, b int")).collect()
    assert len(found) == len({r.id for r in found})
    assert {r.id: r.component for r in found} == plain_components(edges)


def test_clusters_name_size_and_first(spark):
    rows = [row("A", created=5), row("B", created=1, dup=True, of="A"), row("C", created=None),
            row("D", of="D"), row("E", of="gone"), row("F", created=1), row("G")]
    pairs = frame(spark, [("C", "B"), ("F", "B"), ("X", "A"), (None, "A")],
                  "complaint_id_1 string, complaint_id_2 string")
    found = clusters.duplicate_clusters(frame(spark, rows), pairs).collect()
    assert sorted(map(tuple, found)) == [(k, "A", 4, "B") for k in "ABCF"]
    none = clusters.duplicate_clusters(frame(spark, rows).where("complaint_id = 'G'"))
    assert none.collect() == []


# -- bursts --------------------------------------------------------------------

def test_both_forms_of_bursts(spark):
    pick = random.Random(6)
    rows = [("hot" if pick.random() < .4 else f"u{pick.randrange(40)}",
             BASE + timedelta(minutes=pick.randrange(20_000))) for _ in range(2500)]
    rows += [("edge", at(0)), ("edge", at(.5)), ("edge", at(1.1)), (None, at(0)), ("edge", None)]
    events = frame(spark, rows, "user string, ts timestamp")
    want = []
    for user, group in itertools.groupby(
            sorted(r for r in rows if None not in r), key=lambda r: r[0]):
        times = [t for _, t in group]
        burst, n = [times[0]], 0
        for t in [*times[1:], None]:
            if t is not None and t - burst[-1] <= timedelta(minutes=30):
                burst.append(t)
                continue
            n += 1
            want.append((user, n, burst[0], burst[-1], len(burst)))
            burst = [t]
    found = sessions.gap_islands(events, "user", "ts", 30, slice_hours=7).collect()
    assert sorted(map(tuple, found)) == want
    plain = sessions.session_bursts(events, "user", "ts").collect()
    assert sorted(map(tuple, plain)) == [(u, *rest) for u, _, *rest in want]
    assert Counter(r[0] for r in want)["edge"] == 2


# -- streams -------------------------------------------------------------------

def feed(spark, path, rows):
    spark.createDataFrame(rows, st.DEADLINE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_ladder_stream(spark, tmp_path):
    source, checkpoint, out = (str(tmp_path / x) for x in ("in", "ck", "out"))

    def run(rows):
        feed(spark, source, rows)
        stream = st.file_stream(spark, source, st.DEADLINE_SCHEMA)
        st.run_available(st.ladder_firings(stream).writeStream.outputMode("append")
                         .format("parquet").option("path", out), checkpoint)

    run([("A", at(0), at(4), "Open"), ("B", at(0), at(4), "Open"), ("C", at(0), at(4), "Open")])
    run([("C", at(2), None, "Resolved"), ("clock", at(10), None, "tick")])  # A, B: L1
    run([("B", at(11), at(30), "Open"), ("clock", at(60), None, "tick")])  # extended; A: L2
    run([("clock", at(79), None, "tick")])  # B: L2 at 78, counted from the new deadline
    run([("A", at(80), None, "Resolved"), ("clock", at(9000), None, "tick")])  # B: L3
    found = sorted((r.complaint_id, r.ladder_level, r.fired_ms)
                   for r in spark.read.parquet(out).collect())
    assert found == [("A", "L1", ms(at(4))), ("A", "L2", ms(at(52))), ("B", "L1", ms(at(4))),
                     ("B", "L2", ms(at(78))), ("B", "L3", ms(at(150)))]


def test_running_totals_stream(spark, tmp_path):
    source, checkpoint, out = (str(tmp_path / x) for x in ("in", "ck", "out"))
    kind = "complaint_id string, seq bigint, channel string"
    stored = frame(spark, [("a", 0, "x"), ("c", 0, "x"), (None, 1, "x")], kind)
    for rows in ([("a", 2, "x"), ("a", 1, None), ("b", 1, "x")],
                 [("a", 3, "x"), (None, 5, "x"), ("a", None, "x")], [("c", 9, "x"), ("a", 4, "x")]):
        frame(spark, rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream = st.file_stream(spark, source, stored.schema)
        st.run_available(st.numbered_live(stream, stored).writeStream.outputMode("append")
                         .format("parquet").option("path", out), checkpoint)
    found = spark.read.parquet(out).select("complaint_id", "seq", "total_messages").collect()
    assert sorted(map(tuple, found)) == [
        ("a", 1, 3), ("a", 2, 4), ("a", 3, 5), ("a", 4, 6), ("b", 1, 2), ("c", 9, 3)]
