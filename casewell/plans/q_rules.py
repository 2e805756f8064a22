"""Rules of the policy texts, clusters of duplicates and bursts of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from .. import sources as src
from .. import streaming as st
from ..functions.text import lookup
from ..functions.time import add_hours, as_timestamp
from ..operators import clusters, policy_rules, sessions
from ..operators import similarity as sim
from ..session import ROCKSDB, scratch_path
from ..sources.driver_tables import complaint_key
from . import sql as X
from .catalog import AS_OF, query
from .q_register import REG, _case
from .q_similarity import LOW, _vectors
from .q_stats import _ext
from .q_streaming import _sink, _stream

#: After the messages of the tables, so that there are answers.
LATER = "2024-02-20 00:00:00"
GAP_MINUTES = 6 * 60

_CLUSTERS = X.with_(X.REG, X.pairs(5, LOW, 0.9999)).replace("WITH", "WITH RECURSIVE", 1) + """,
known AS (SELECT complaint_id AS a, duplicate_of AS b FROM reg WHERE duplicate_of IS NOT NULL
  UNION SELECT concat('CMP', id_1), concat('CMP', id_2) FROM prs),
ends AS (SELECT a, b FROM known WHERE a IN (SELECT complaint_id FROM reg)
  AND b IN (SELECT complaint_id FROM reg)),
sym AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
reach(a, b) AS (SELECT a, b FROM sym UNION
  SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
SELECT a AS complaint_id, min(b) AS cluster, count(*) AS size,
  arg_min(b, (created_date, b)) AS first_id
FROM reach JOIN reg ON reg.complaint_id = b GROUP BY a"""


@query(_CLUSTERS)
def duplicate_clusters(spark, d):
    """Components over the stored links and the pairs found by vectors."""
    pairs = sim.duplicate_pairs(_vectors(spark, d), 5, LOW).select(
        complaint_key(F.col("id_1")).alias("complaint_id_1"),
        complaint_key(F.col("id_2")).alias("complaint_id_2"))
    return clusters.duplicate_clusters(src.register(spark, d), pairs)


_LADDER_CASE = " ".join(
    f"WHEN over > {hours} THEN '{name}'" for hours, name, _ in reversed(S.LADDER))
_LADDER = X.with_(X.REG, X.EXTREQ, X.EXTALL, X.EXT, X.sla("reg", "sla", overrides=True)) + f""",
o AS (SELECT *, -hours_remaining AS over FROM sla WHERE NOT is_duplicate
  AND status IS DISTINCT FROM 'Resolved'),
l AS (SELECT *, CASE {_LADDER_CASE} END AS ladder_level FROM o)
SELECT complaint_id, ladder_level, CASE ladder_level
  WHEN 'L1' THEN concat({_case('category', S.DEPARTMENTS, S.DEFAULT_DEPARTMENT)},
    '{S.LADDER[0][2]}') WHEN 'L2' THEN '{S.LADDER[1][2]}' ELSE '{S.LADDER[2][2]}' END
  AS escalated_to, over AS hours_breached, ladder_level = 'L3' AS regulatory_alert
FROM l WHERE ladder_level IS NOT NULL"""


@query(_LADDER)
def escalation_ladder(spark, d):
    return policy_rules.escalation_ladder(src.register(spark, d), AS_OF, _ext(spark, d))


@query(X.with_(X.REG, X.COMM) + f""", ack AS (SELECT r.complaint_id, min(c.ts) AS answered FROM reg r
  JOIN comm c ON c.complaint_id = r.complaint_id AND c.sender = 'agent'
    AND c.ts >= r.created_date AND c.ts <= TIMESTAMP '{LATER}' GROUP BY 1)
SELECT r.complaint_id, epoch_us(answered) AS acknowledged_us,
  (epoch_us(answered) - epoch_us(created_date)) / 3.6e9 AS ack_hours,
  epoch_us(created_date + INTERVAL 3 DAY) AS ack_due_us,
  epoch_us(created_date + INTERVAL 30 DAY) AS final_due_us,
  coalesce(answered, TIMESTAMP '{LATER}') > created_date + INTERVAL 3 DAY AS ack_late,
  CASE WHEN status = 'Resolved' THEN coalesce(resolution_days > 30, false)
    ELSE created_date + INTERVAL 30 DAY < TIMESTAMP '{LATER}' END AS final_late
FROM reg r LEFT JOIN ack ON ack.complaint_id = r.complaint_id""")
def ack_and_final_deadlines(spark, d):
    rows = policy_rules.ack_and_final_deadlines(
        src.register(spark, d), src.communications_log(spark, d), LATER)
    return rows.select(
        "complaint_id", F.unix_micros("acknowledged_at").alias("acknowledged_us"), "ack_hours",
        F.unix_micros("ack_due").alias("ack_due_us"),
        F.unix_micros("final_due").alias("final_due_us"), "ack_late", "final_late")


_BORDERS = [0, *(days for _, days in S.STAGES[:-1]), 1_000_000]
_STAGES = ", ".join(f"('{name}', {low}, {high})" for (name, _), low, high in
                    zip(S.STAGES, _BORDERS, _BORDERS[1:], strict=False))


@query(X.with_(X.REG, X.ESCREQ) + f""", log AS (
SELECT complaint_id, -1 AS seq, 'Open' AS status, created_date AS moved FROM reg
UNION ALL SELECT e.complaint_id, seq, 'Escalated', escalated_at FROM escreq e
  JOIN reg USING (complaint_id) WHERE escalated_at >= created_date
UNION ALL SELECT complaint_id, 4611686018427387904, 'Resolved',
  created_date + to_days(cast(resolution_days AS integer)) FROM reg WHERE status = 'Resolved'),
till AS (SELECT *, lead(moved) OVER (PARTITION BY complaint_id ORDER BY moved, seq) AS nxt FROM log),
done AS (SELECT complaint_id, min(moved) AS done FROM log WHERE status = 'Resolved' GROUP BY 1),
cut AS (SELECT t.complaint_id, stage, t.status,
  least(epoch_us(coalesce(nxt, TIMESTAMP '{AS_OF}')), epoch_us(coalesce(done, TIMESTAMP '{AS_OF}')),
        epoch_us(TIMESTAMP '{AS_OF}'), epoch_us(created_date) + high * 86400000000)
  - greatest(epoch_us(moved), epoch_us(created_date) + low * 86400000000) AS micros
FROM till t JOIN reg USING (complaint_id) LEFT JOIN done USING (complaint_id),
  (VALUES {_STAGES}) s(stage, low, high))
SELECT complaint_id, stage, status, cast(sum(micros) AS bigint) AS micros,
  sum(micros) / 86400000000.0::DOUBLE AS days FROM cut WHERE micros > 0 GROUP BY 1, 2, 3""")
def stage_ageing(spark, d):
    reg = src.register(spark, d)
    log = policy_rules.status_log(reg, src.escalation_requests(spark, d))
    return policy_rules.stage_ageing(reg, log, AS_OF)


@query(X.with_(X.REG, X.EXTREQ) + f""", p AS (SELECT complaint_id, created_date,
  CASE category WHEN 'click' THEN 5 WHEN 'view' THEN 1 END AS lim,
  CASE WHEN status = 'Resolved' THEN least(TIMESTAMP '{AS_OF}',
    created_date + to_days(cast(resolution_days AS integer))) ELSE TIMESTAMP '{AS_OF}' END AS till
  FROM reg WHERE category IN ('click', 'view')),
days AS (SELECT *, created_date + to_days(cast(k AS integer)) AS day FROM p, range(1, 60) t(k)
  WHERE created_date + to_days(cast(k AS integer)) <= till),
force AS (SELECT days.complaint_id, k, lim,
    coalesce(arg_max(extend_hours, (extended_at, seq)), 0) AS hours
  FROM days LEFT JOIN extreq x ON x.complaint_id = days.complaint_id AND extended_at <= day
  GROUP BY ALL)
SELECT p.complaint_id, count(k) AS penalty_days, 100 * count(k) AS penalty
FROM p LEFT JOIN force f ON f.complaint_id = p.complaint_id AND k * 24 > f.lim * 24 + hours
GROUP BY 1""")
def penalty_accrual(spark, d):
    """The tables have no card or transfer category: two others take their limits."""
    return policy_rules.penalty_accrual(
        src.register(spark, d), src.extension_requests(spark, d), AS_OF,
        limits={"click": 5, "view": 1})


_BURSTS = f"""WITH f AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >
  INTERVAL {GAP_MINUTES} MINUTE, true) AS new FROM events WINDOW w AS
  (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts
  RANGE UNBOUNDED PRECEDING) AS burst FROM f),
b AS (SELECT user_id, cast(burst AS bigint) AS burst, epoch_us(min(ts)) AS start_us,
  epoch_us(max(ts)) AS end_us, count(*) AS events FROM n GROUP BY 1, 2)
"""


def _micros(df, *columns):
    return df.select(*columns, F.unix_micros("burst_start").alias("start_us"),
                     F.unix_micros("burst_end").alias("end_us"), "events")


def _events(spark, d, read=src.table):
    return read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))


@query(_BURSTS + "SELECT user_id, start_us, end_us, events FROM b")
def session_bursts(spark, d):
    found = sessions.session_bursts(_events(spark, d), "user_id", "ts", f"{GAP_MINUTES} minutes")
    return _micros(found, "user_id")


@query(_BURSTS + "SELECT * FROM b")
def gap_islands(spark, d):
    return _micros(sessions.gap_islands(_events(spark, d), "user_id", "ts", GAP_MINUTES),
                   "user_id", "burst")


@query(_BURSTS + f"""SELECT user_id, start_us, end_us, events FROM b
WHERE end_us + {GAP_MINUTES * 60_000_000} <= (SELECT epoch_us(max(ts)) FROM events) - 3600000000""")
def stream_session_bursts(spark, d):
    """Bursts that the watermark has closed."""
    live = st.bursts_live(_events(spark, d, _stream), "user_id", "ts", f"{GAP_MINUTES} minutes")
    out = _sink(spark, lambda p: live.writeStream.format("parquet").option("path", p), "bursts")
    return _micros(spark.read.parquet(out), "user_id")


@query(X.with_(X.REG, X.sla()) + f""", r(level, hours) AS (VALUES {', '.join(
    f"('{name}', {hours})" for hours, name, _ in S.LADDER)})
SELECT complaint_id, level AS ladder_level, epoch_us(due_date) // 1000 + hours * 3600000 AS fired_ms
FROM sla, r WHERE status <> 'Resolved' AND -hours_remaining >= hours""")
def stream_ladder(spark, d):
    """Creation and resolution events in six shuffled files, a micro-batch each, then the clock:
    every rung that `AS_OF` has passed fires once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reg = src.register(spark, d)
    due = add_hours("created_date", lookup("severity", S.SLA_HOURS, S.DEFAULT_SLA_HOURS))
    events = reg.select("complaint_id", F.col("created_date").alias("event_time"),
                        due.alias("due_date"), F.lit("Open").alias("status")).unionAll(
        reg.where("status = 'Resolved'").select(
            "complaint_id", F.col("created_date") + F.expr("INTERVAL 1 SECOND"),
            F.lit(None).cast("timestamp"), "status"))
    feed, checkpoint = scratch_path(spark, "ladder-in"), scratch_path(spark, "ladder-ck")
    out, delay = scratch_path(spark, "ladder"), "400 days"
    events.repartition(6, F.xxhash64("complaint_id", "status")).write.parquet(feed)
    clock = spark.range(1).select(
        F.lit("clock").alias("complaint_id"),
        (as_timestamp(AS_OF) + F.expr(f"INTERVAL {delay}")).alias("event_time"),
        F.lit(None).cast("timestamp").alias("due_date"), F.lit("tick").alias("status"))

    def run():
        stream = st.file_stream(spark, feed, st.DEADLINE_SCHEMA, 1)
        st.run_available(st.ladder_firings(stream, delay).writeStream.outputMode("append")
                         .format("parquet").option("path", out), checkpoint)

    run()
    clock.write.mode("append").parquet(feed)
    run()
    return spark.read.parquet(out)


@query(X.with_(X.REG, X.COMM) + """SELECT complaint_id, seq, row_number() OVER
  (PARTITION BY complaint_id ORDER BY seq) + 1 AS total_messages FROM comm""")
def stream_running_totals(spark, d):
    """Totals kept by the stream: the first turns are stored before it begins, the others come in
    three micro-batches in the order of their numbers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    log = src.communications_log(spark, d).select("complaint_id", "seq")
    feed, out = scratch_path(spark, "totals-in"), scratch_path(spark, "totals")
    before = log.where("seq < 1")
    for low, high in ((1, 2), (2, 4), (4, None)):
        part = log.where(f"seq >= {low}" + (f" and seq < {high}" if high else ""))
        part.coalesce(1).write.mode("append").parquet(feed)
        stream = st.file_stream(spark, feed, log.schema)
        st.run_available(st.numbered_live(stream, before).writeStream.outputMode("append")
                         .format("parquet").option("path", out), out + "-ck")
    first = before.withColumn("total_messages", F.row_number().over(
        sim.Window.partitionBy("complaint_id").orderBy("seq")).cast("bigint") + 1)
    return spark.read.parquet(out).unionByName(first)


@query(X.with_(X.ESCREQ) + "SELECT complaint_id, seq, escalation_level, escalated_to FROM escreq "
       "QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY seq DESC) = 1")
def stream_latest_store(spark, d):
    """Escalations in ten shuffled micro-batches, kept as last writes with a snapshot after every
    four batches."""
    requests = src.escalation_requests(spark, d).select(
        "complaint_id", "seq", "escalation_level", "escalated_to")
    feed, store = scratch_path(spark, "latest-in"), scratch_path(spark, "latest-store")
    requests.repartition(10, F.xxhash64("seq")).write.parquet(feed)
    stream = st.file_stream(spark, feed, requests.schema, 1)
    st.run_available(st.upsert_batches(stream, store, every=4), store + "-ck")
    return st.read_latest(spark, store, requests.schema)
