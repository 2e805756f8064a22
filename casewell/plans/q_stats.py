"""Aggregates, windows, sorts."""

from __future__ import annotations


from .. import schema as S
from .. import sources as src
from ..operators import events, stats
from . import sql as X
from .catalog import AS_OF, query
from .q_register import REG, _case


def _count(key: str) -> str:
    return REG + (f"SELECT {key}, count(*) AS count FROM reg WHERE NOT is_duplicate AND "
                  f"{key} IS NOT NULL GROUP BY 1")


@query(_count("category"))
def count_by_category(spark, d):
    return stats.by_count(stats.count_by(src.register(spark, d), "category"), "category")


@query(_count("sentiment"))
def count_by_sentiment(spark, d):
    return stats.count_by(src.register(spark, d), "sentiment")


@query(_count("severity"))
def count_by_severity(spark, d):
    return stats.count_by(src.register(spark, d), "severity")


@query(_count("branch") + " ORDER BY count DESC, branch LIMIT 10")
def top_branches(spark, d):
    return stats.top_branches(src.register(spark, d))


@query(REG + "SELECT channel, count(*) AS count, "
       f"{_case('channel', S.CHANNEL_ICONS, S.DEFAULT_ICON)} AS icon FROM reg "
       "WHERE NOT is_duplicate GROUP BY 1")
def count_by_channel(spark, d):
    return stats.count_by_channel(src.register(spark, d))


@query(REG + "SELECT strftime(created_date, '%Y-%m') AS month, count(*) AS count FROM reg "
       "WHERE NOT is_duplicate GROUP BY 1 ORDER BY 1")
def monthly_trend(spark, d):
    return stats.monthly_trend(src.register(spark, d))


@query(REG + "SELECT category, branch, count(*) AS count FROM reg WHERE NOT is_duplicate "
       "GROUP BY 1, 2")
def heatmap(spark, d):
    return stats.heatmap(src.register(spark, d))


def _esc(spark, d):
    return events.escalate(src.register(spark, d), src.escalation_requests(spark, d))


def _ext(spark, d):
    return events.extend_sla(src.register(spark, d), src.extension_requests(spark, d))


_OVERVIEW = X.with_(X.REG, X.EXTREQ, X.EXTALL, X.EXT, X.ESCREQ, X.ESC,
                    X.sla("reg", "sla", overrides=True)) + """SELECT
  count(*) FILTER (NOT is_duplicate) AS total_complaints,
  count(*) FILTER (NOT is_duplicate AND status = 'Open') AS open,
  count(*) FILTER (NOT is_duplicate AND status = 'In Progress') AS in_progress,
  count(*) FILTER (NOT is_duplicate AND status = 'Resolved') AS resolved,
  count(*) FILTER (NOT is_duplicate AND status = 'Escalated') AS escalated,
  count(*) FILTER (NOT is_duplicate AND severity = 'Critical') AS critical_count,
  count(*) FILTER (NOT is_duplicate AND severity = 'High') AS high_count,
  count(*) FILTER (is_duplicate) AS duplicate_count,
  avg(resolution_days) AS avg_resolution_days,
  count(*) FILTER (NOT is_duplicate AND status <> 'Resolved' AND sla_status = 'Breached')
    AS sla_breached,
  count(*) FILTER (NOT is_duplicate AND status <> 'Resolved' AND sla_status = 'At Risk')
    AS sla_at_risk,
  count(*) FILTER (NOT is_duplicate AND status <> 'Resolved' AND sla_status = 'On Track')
    ::DOUBLE / count(*) FILTER (NOT is_duplicate AND status <> 'Resolved')::DOUBLE * 100::DOUBLE
    AS sla_compliance_rate,
  (SELECT count(*) FROM esc) AS active_escalations FROM sla"""


@query(_OVERVIEW)
def overview(spark, d):
    return stats.overview(src.register(spark, d), AS_OF, _esc(spark, d), _ext(spark, d))


@query(_OVERVIEW)
def overview_defaults(spark, d):
    """The overview with its defaults for missing figures."""
    return stats.null_safe_overview(
        stats.overview(src.register(spark, d), AS_OF, _esc(spark, d), _ext(spark, d)))


@query(REG + """SELECT category, count(*) AS total,
  count(*) FILTER (status = 'Resolved') AS resolved,
  count(*) FILTER (status = 'Escalated') AS escalated,
  count(*) FILTER (severity = 'Critical') AS critical,
  count(*) FILTER (status = 'Resolved') * 100::DOUBLE / count(*)::DOUBLE AS resolution_rate,
  CASE WHEN count(*) FILTER (status = 'Resolved') * 100::DOUBLE / count(*) >= 70 THEN 'success'
    WHEN count(*) FILTER (status = 'Resolved') * 100::DOUBLE / count(*) >= 40 THEN 'warning'
    ELSE 'destructive' END AS band
FROM reg WHERE NOT is_duplicate GROUP BY 1""")
def category_report(spark, d):
    return stats.category_report(src.register(spark, d))


@query(REG + """SELECT CASE WHEN grouping(category) = 0 THEN 'category'
    WHEN grouping(channel) = 0 THEN 'channel' WHEN grouping(branch) = 0 THEN 'branch'
    ELSE 'total' END AS dimension,
  coalesce(category, channel, branch) AS key, count(*) AS total,
  count(*) FILTER (status = 'Resolved') AS resolved,
  count(*) FILTER (status <> 'Resolved') AS pending,
  count(*) FILTER (status = 'Escalated') AS escalated,
  count(*) FILTER (severity = 'Critical') AS critical,
  count(*) FILTER (status = 'Resolved') * 100::DOUBLE / count(*)::DOUBLE AS resolution_rate
FROM reg WHERE NOT is_duplicate
GROUP BY GROUPING SETS ((category), (channel), (branch), ())""")
def regulatory_summary(spark, d):
    return stats.regulatory_summary(src.register(spark, d))


@query(X.with_(X.REG, X.ESCREQ, X.ESC) + """SELECT coalesce(escalation_level, 'Unknown') AS level,
  count(*) AS count, (SELECT count(*) FROM esc) AS total_escalated,
  (SELECT count(*) FROM esc) * 100::DOUBLE
    / greatest((SELECT count(*) FROM reg WHERE NOT is_duplicate), 1) AS escalation_rate
FROM esc GROUP BY 1""")
def escalation_summary(spark, d):
    return stats.escalation_summary(src.register(spark, d), _esc(spark, d))


@query(REG + " UNION ".join(
    f"SELECT '{c}' AS \"column\", {c} AS \"value\" FROM reg WHERE NOT is_duplicate"
    for c in stats.FILTER_COLUMNS))
def filter_options(spark, d):
    return stats.filter_options(src.register(spark, d))


def _map_sql(label: str, key: str, tail: str = "") -> str:
    return (f"SELECT '{label}' AS label, '{{' || string_agg('\"' || k || '\":' || n, ',' "
            f"ORDER BY n DESC, k) || '}}' AS counts FROM (SELECT {key} AS k, count(*) AS n "
            f"FROM reg WHERE NOT is_duplicate GROUP BY 1 {tail})")


@query(REG + " UNION ALL ".join([
    _map_sql("category", "category"), _map_sql("sentiment", "sentiment"),
    _map_sql("severity", "severity"),
    _map_sql("top_branches", "branch", "ORDER BY n DESC, k LIMIT 5")]))
def label_count_maps(spark, d):
    return stats.label_count_maps(src.register(spark, d))


@query(_count("branch") + " ORDER BY count DESC, branch LIMIT 1")
def arg_max_label(spark, d):
    return stats.arg_max_label(src.register(spark, d), "branch")


@query(REG + """SELECT count(*) AS total, count(*) FILTER (NOT is_duplicate) AS originals,
  count(*) FILTER (is_duplicate) AS duplicates, count(DISTINCT category) AS categories
FROM reg""")
def dataset_profile(spark, d):
    return stats.dataset_profile(src.register(spark, d)).drop("first_date", "last_date")


_TOP = REG + """, t AS (SELECT branch, count(*) AS count FROM reg WHERE NOT is_duplicate
  GROUP BY 1 ORDER BY count DESC, branch LIMIT 10),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, branch) AS rank,
  count / max(count) OVER () AS ratio FROM t)
"""


@query(_TOP + """SELECT branch, count, rank, concat(cast(rank AS varchar), CASE rank WHEN 1
  THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END) AS badge FROM r""")
def branch_rank(spark, d):
    return stats.branch_rank(src.register(spark, d)).select("branch", "count", "rank", "badge")


@query(_TOP + """SELECT branch, ratio, CASE WHEN ratio > 0.8 THEN 'destructive'
  WHEN ratio > 0.5 THEN 'warning' ELSE 'success' END AS band FROM r""")
def branch_ratio(spark, d):
    return stats.branch_rank(src.register(spark, d)).select("branch", "ratio", "band")


@query(REG + """SELECT channel, count(*) AS count, cast(floor(count(*) * 100::DOUBLE
  / (SELECT count(*) FROM reg WHERE NOT is_duplicate) + 0.5::DOUBLE) AS bigint) AS percent
FROM reg WHERE NOT is_duplicate GROUP BY 1""")
def channel_share(spark, d):
    return stats.channel_share(src.register(spark, d))


@query(REG + "SELECT complaint_id FROM reg")
def shuffled(spark, d):
    return stats.shuffled(src.register(spark, d)).select("complaint_id")


@query(X.with_(X.REG, X.EXTREQ, X.EXTALL, X.EXT, X.ESCREQ, X.ESC,
               X.sla("reg", "sla", overrides=True)) + """SELECT s.complaint_id, s.category,
  coalesce(s.duplicate_of, '') AS duplicate_of, s.sla_status,
  strftime(s.due_date, '%Y-%m-%d %H:%M') AS sla_due_date, s.is_breached AS sla_breached,
  e.complaint_id IS NOT NULL AS escalated, coalesce(e.escalation_level, 'None')
  AS escalation_level
FROM sla s LEFT JOIN esc e ON e.complaint_id = s.complaint_id WHERE NOT s.is_duplicate""")
def regulatory_export(spark, d):
    rows = stats.regulatory_export(src.register(spark, d), AS_OF, _esc(spark, d), _ext(spark, d))
    return rows.select("complaint_id", "category", "duplicate_of", "sla_status", "sla_due_date",
                       "sla_breached", "escalated", "escalation_level")


