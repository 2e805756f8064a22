"""Deadline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as src
from ..operators import sla
from . import sql as X
from .catalog import AS_OF, query
from .q_stats import _ext

SLA = X.with_(X.REG, X.sla())
SLAX = X.with_(X.REG, X.EXTREQ, X.EXTALL, X.EXT, X.sla("reg", "sla", overrides=True))
FLAT = """complaint_id, cast(sla_hours AS bigint) AS sla_hours, epoch_us(due_date) AS due_us,
  hours_remaining, is_breached, sla_status, completion_pct"""
OPEN = "NOT is_duplicate AND status IS DISTINCT FROM 'Resolved'"


def _flat(df):
    return df.select("complaint_id", "sla_hours", F.unix_micros("due_date").alias("due_us"),
                     "hours_remaining", "is_breached", "sla_status", "completion_pct")


@query(SLA + f"SELECT {FLAT} FROM sla")
def sla_columns(spark, d):
    return _flat(sla.sla_columns(src.register(spark, d), AS_OF))


@query(SLAX + f"SELECT {FLAT} FROM sla")
def apply_sla_overrides(spark, d):
    return _flat(sla.sla_columns(src.register(spark, d), AS_OF, _ext(spark, d)))


@query(SLA + "SELECT complaint_id, cast(sla_hours AS bigint) AS sla_hours, "
       "strftime(due_date, '%Y-%m-%d %H:%M') AS due_date, is_breached, sla_status FROM sla "
       "WHERE complaint_id = 'CMP61'")
def sla_for(spark, d):
    return sla.sla_for(src.register(spark, d), "CMP61", AS_OF).drop(
        "hours_remaining", "completion_pct")


@query(SLA + f"SELECT complaint_id, category, severity, status, branch, {FLAT[13:]} FROM sla "
       f"WHERE is_breached AND {OPEN}")
def breached(spark, d):
    rows = sla.breached(src.register(spark, d), AS_OF)
    return rows.select("category", "severity", "status", "branch", *_flat(rows).columns[:2],
                       F.unix_micros("due_date").alias("due_us"), "hours_remaining",
                       "is_breached", "sla_status", "completion_pct")


@query(SLA + f", b AS (SELECT * FROM sla WHERE is_breached AND {OPEN}) SELECT complaint_id, "
       "severity, hours_remaining, (SELECT count(*) FROM b) AS total FROM b "
       "ORDER BY complaint_id LIMIT 50")
def breached_first_50(spark, d):
    """Capped list beside the uncapped total."""
    rows = sla.breached(src.register(spark, d), AS_OF)
    return sla.capped(rows.select("complaint_id", "severity", "hours_remaining"), 50)


@query(SLA + f"SELECT complaint_id, category, hours_remaining, completion_pct FROM sla "
       f"WHERE sla_status = 'At Risk' AND {OPEN}")
def at_risk(spark, d):
    return sla.at_risk(src.register(spark, d), AS_OF).select(
        "complaint_id", "category", "hours_remaining", "completion_pct")


@query(SLA + f", b AS (SELECT * FROM sla WHERE sla_status = 'At Risk' AND {OPEN}) "
       "SELECT complaint_id, (SELECT count(*) FROM b) AS total FROM b "
       "ORDER BY complaint_id LIMIT 8")
def at_risk_panel(spark, d):
    return sla.capped(sla.at_risk(src.register(spark, d), AS_OF).select("complaint_id"), 8)


@query(SLA + f"""SELECT count(*) AS total_open,
  count(*) FILTER (sla_status = 'On Track') AS on_track,
  count(*) FILTER (sla_status = 'At Risk') AS at_risk,
  count(*) FILTER (sla_status = 'Breached') AS breached,
  count(*) FILTER (sla_status = 'On Track')::DOUBLE / count(*)::DOUBLE * 100::DOUBLE
    AS compliance_rate
FROM sla WHERE {OPEN}""")
def sla_summary(spark, d):
    return sla.sla_summary(src.register(spark, d), AS_OF)


@query(SLA + """SELECT complaint_id, category, severity, status, branch,
  is_breached AS sla_breached,
  CASE WHEN severity = 'Critical' THEN 'Critical severity' ELSE 'SLA breached' END AS flag_reason
FROM sla WHERE NOT is_duplicate AND (severity = 'Critical' OR is_breached)""")
def regulatory_flags(spark, d):
    return sla.regulatory_flags(src.register(spark, d), AS_OF).drop("created_date")
