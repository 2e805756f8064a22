"""Event logs, threads, triage, resolutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from .. import sources as src
from ..operators import events as ev
from ..operators import filters
from . import sql as X
from .catalog import AS_OF, query
from .q_register import _case
from .q_stats import _esc, _ext

ESC = X.with_(X.REG, X.ESCREQ, X.ESC)
EXT = X.with_(X.REG, X.EXTREQ, X.EXTALL, X.EXT)
COMM = X.with_(X.REG, X.COMM)


@query(X.with_(X.ESCREQ) + "SELECT complaint_id, seq, escalation_level, reason, escalated_to "
       "FROM escreq QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY seq DESC) = 1")
def latest_per_id(spark, d):
    return ev.latest_per_id(src.escalation_requests(spark, d)).select(
        "complaint_id", "seq", "escalation_level", "reason", "escalated_to")


@query(ESC + "SELECT complaint_id, seq FROM escreq WHERE complaint_id IN "
       "(SELECT complaint_id FROM reg)")
def valid_events(spark, d):
    return ev.valid_events(src.escalation_requests(spark, d), src.register(spark, d)).select(
        "complaint_id", "seq")


@query(ESC + "SELECT complaint_id, seq FROM escreq WHERE complaint_id NOT IN "
       "(SELECT complaint_id FROM reg)")
def rejected_events(spark, d):
    return ev.rejected_events(src.escalation_requests(spark, d), src.register(spark, d)).select(
        "complaint_id", "seq")


@query(ESC + "SELECT complaint_id, seq, escalation_level, reason, escalated_to, escalated_by, "
       "epoch_us(escalated_at) AS escalated_us, status FROM esc")
def escalate(spark, d):
    return _esc(spark, d).select(
        "complaint_id", "seq", "escalation_level", "reason", "escalated_to", "escalated_by",
        F.unix_micros("escalated_at").alias("escalated_us"), "status")


@query(ESC + """SELECT complaint_id, seq, 'system' AS sender, concat('Complaint escalated to ',
  coalesce(escalation_level, 'Unknown'), ' — ', escalated_to, '. Reason: ', reason) AS message,
  'System' AS channel, 'escalation' AS type
FROM escreq WHERE complaint_id IN (SELECT complaint_id FROM reg)""")
def escalation_messages(spark, d):
    return ev.escalation_messages(src.register(spark, d), src.escalation_requests(spark, d)).drop(
        "ts")


@query(ESC + """SELECT r.complaint_id, r.status, e.complaint_id IS NOT NULL AS escalated,
  coalesce(e.escalation_level, 'None') AS escalation_level
FROM reg r LEFT JOIN esc e ON e.complaint_id = r.complaint_id""")
def with_escalation(spark, d):
    return ev.with_escalation(src.register(spark, d), _esc(spark, d)).select(
        "complaint_id", "status", "escalated", "escalation_level")


@query(ESC + "SELECT complaint_id FROM reg WHERE complaint_id NOT IN "
       "(SELECT complaint_id FROM esc)")
def not_yet_escalated(spark, d):
    return ev.not_yet_escalated(src.register(spark, d), _esc(spark, d)).select("complaint_id")


@query(ESC + "SELECT complaint_id, escalation_level, escalated_to, "
       "(SELECT count(*) FROM esc) AS total FROM esc")
def active_escalations(spark, d):
    active = ev.active_escalations(_esc(spark, d))
    return active.select("complaint_id", "escalation_level", "escalated_to",
                         active.agg(F.count(F.lit(1))).scalar().alias("total"))


@query(EXT + "SELECT complaint_id, epoch_us(due_date) AS due_us, extend_hours AS extended_by, "
       "reason FROM ext")
def extend_sla(spark, d):
    return _ext(spark, d).select("complaint_id", F.unix_micros("due_date").alias("due_us"),
                                 "extended_by", "reason")


@query(EXT + """SELECT complaint_id, seq, concat('SLA extended by ', extend_hours,
  ' hours. Reason: ', reason, '. New due: ', strftime(due_date, '%Y-%m-%d %H:%M')) AS message
FROM extall""")
def extension_messages(spark, d):
    return ev.extension_messages(src.register(spark, d), src.extension_requests(spark, d)).select(
        "complaint_id", "seq", "message")


_THREAD = X.with_(X.REG, X.TXT, X.COMM) + """SELECT complaint_id, -1 AS seq, 'customer' AS sender,
  complaint_text AS message, channel, 'original_complaint' AS type FROM txt
UNION ALL SELECT complaint_id, seq, sender, message, channel, type FROM comm
WHERE complaint_id IN (SELECT complaint_id FROM reg)"""


@query(_THREAD)
def thread(spark, d):
    return ev.thread(src.register(spark, d, with_text=True), src.communications_log(spark, d)
                     ).drop("ts")


@query(COMM + """SELECT r.complaint_id, count(c.seq) + 1 AS total_messages FROM reg r
LEFT JOIN comm c ON c.complaint_id = r.complaint_id GROUP BY 1""")
def thread_totals(spark, d):
    return ev.thread_totals(src.register(spark, d), src.communications_log(spark, d))


@query(COMM + """SELECT complaint_id, seq, (SELECT count(*) FROM comm o
    WHERE o.complaint_id = c.complaint_id)
  + row_number() OVER (PARTITION BY complaint_id ORDER BY seq) + 1 AS total_messages
FROM comm c WHERE complaint_id IN (SELECT complaint_id FROM reg)""")
def add_communications(spark, d):
    """The whole log appended once more to a store that already holds it."""
    log = src.communications_log(spark, d)
    return ev.add_communications(src.register(spark, d), log, log).select(
        "complaint_id", "seq", "total_messages")


@query(COMM + """SELECT complaint_id, status FROM reg WHERE NOT is_duplicate
AND status = 'Resolved' AND complaint_id IN (SELECT complaint_id FROM comm
  WHERE type = 'auto_resolution' OR contains(message, 'Autonomous Agent auto-resolved'))""")
def auto_resolved_audit(spark, d):
    return ev.auto_resolved_audit(src.register(spark, d), src.communications_log(spark, d)
                                  ).select("complaint_id", "status")


@query(X.with_(X.REG, X.COMM, X.ESCREQ, X.ESC, X.EXTREQ, X.EXTALL, X.EXT,
               X.sla("reg", "sla", overrides=True)) + """SELECT s.complaint_id, s.status,
  s.sla_status, strftime(s.due_date, '%Y-%m-%d %H:%M') AS due_date,
  e.complaint_id IS NOT NULL AS escalated,
  coalesce(e.escalation_level, 'None') AS escalation_level,
  (SELECT count(*) + 1 FROM comm c WHERE c.complaint_id = s.complaint_id) AS total_messages
FROM sla s LEFT JOIN esc e ON e.complaint_id = s.complaint_id WHERE s.complaint_id = 'CMP97'""")
def lookup_complaint(spark, d):
    row = ev.lookup_complaint(src.register(spark, d), "CMP97", AS_OF,
                              src.communications_log(spark, d), _esc(spark, d), _ext(spark, d))
    return row.select("complaint_id", "status", "sla_status", "due_date", "escalated",
                      "escalation_level", "total_messages")


_TRIAGE = X.with_(X.REG, X.ESCREQ, X.ESC, X.sla())
_CAND = """FROM sla WHERE NOT is_duplicate AND status = 'Open' AND severity = 'Critical'
  AND is_breached"""


@query(_TRIAGE + "SELECT complaint_id, category, hours_remaining " + _CAND)
def triage_candidates(spark, d):
    return ev.triage_candidates(src.register(spark, d), AS_OF).select(
        "complaint_id", "category", "hours_remaining")


@query(_TRIAGE + f"""SELECT complaint_id, 'L2' AS escalation_level,
  '{S.TRIAGE_REASON}' AS reason,
  {_case('category', S.DEPARTMENTS, S.DEFAULT_DEPARTMENT)} AS escalated_to,
  'Auto-Triage Agent' AS escalated_by, 'Active' AS status
{_CAND} AND complaint_id NOT IN (SELECT complaint_id FROM esc)""")
def auto_triage(spark, d):
    return ev.auto_triage(src.register(spark, d), AS_OF, _esc(spark, d)).drop("escalated_at")


@query(_TRIAGE + f"""SELECT complaint_id, 'system' AS sender, '{S.TRIAGE_MESSAGE}' AS message,
  'AI Agent' AS channel {_CAND} AND complaint_id NOT IN (SELECT complaint_id FROM esc)""")
def triage_messages(spark, d):
    done = ev.auto_triage(src.register(spark, d), AS_OF, _esc(spark, d))
    return ev.triage_messages(done).drop("ts", "type")


_RES = X.with_(X.REG, X.VERD) + """, cand AS (SELECT complaint_id FROM reg WHERE NOT is_duplicate
  AND status = 'Open' AND category IN ('click', 'view', 'error')
  AND severity IN ('Low', 'Medium')),
ok AS (SELECT * FROM verd WHERE can_auto_resolve AND complaint_id IN (FROM cand))
"""


def _candidates(reg):
    return filters.low_risk_candidates(reg, ["click", "view", "error"], limit=None)


@query(_RES + """SELECT r.complaint_id,
  CASE WHEN ok.complaint_id IS NOT NULL THEN 'Resolved' ELSE status END AS status,
  CASE WHEN ok.complaint_id IS NOT NULL THEN 1::DOUBLE ELSE resolution_days END
    AS resolution_days, ok.resolution_note
FROM reg r LEFT JOIN ok ON ok.complaint_id = r.complaint_id""")
def apply_resolutions(spark, d):
    reg = src.register(spark, d)
    done = ev.apply_resolutions(reg, src.verdicts(spark, d), _candidates(reg), set_note=True)
    return done.select("complaint_id", "status", "resolution_days", "resolution_note")


@query(_RES + f"SELECT complaint_id, concat('{S.AUTO_RESOLUTION_PREFIX}', reasoning) AS message, "
       "'auto_resolution' AS type FROM ok")
def resolution_messages(spark, d):
    reg = src.register(spark, d)
    return ev.resolution_messages(src.verdicts(spark, d), _candidates(reg), AS_OF).select(
        "complaint_id", "message", "type")
