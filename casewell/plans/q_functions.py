"""Scalar helpers, each group over one table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources as src
from ..operators import sla
from . import sql as X
from .catalog import AS_OF, query
from .q_register import REG
from .q_sla import SLA


@query(r"""SELECT doc_id, concat(substr(text, 1, 120), '...') AS clipped,
  CASE WHEN length(text) > 120 THEN concat(substr(text, 1, 120), '...') ELSE text END AS snippet,
  lower(regexp_replace(substr(text, 1, 60), '^\s+|\s+$', '', 'g')) AS prefix_key,
  contains(lower(text), 'the ') OR contains(lower(text), 'der ') AS mentions,
  concat('Dear ', source, ', about ', lang, '.') AS letter
FROM documents""")
def text_functions(spark, d):
    return src.table(spark, d, "documents").select(
        "doc_id", fn.ellipsis("text", 120).alias("clipped"),
        fn.ellipsis_if_longer("text", 120).alias("snippet"),
        fn.prefix_key("text").alias("prefix_key"),
        fn.contains_any("text", ["the ", "der "]).alias("mentions"),
        fn.fill_template("Dear {name}, about {topic}.", name="source", topic="lang")
        .alias("letter"))


@query(REG + f"""SELECT complaint_id, concat(cast({X.HOURS} AS varchar), ' hours') AS sla_text,
  concat(cast(event_id % 101 AS varchar), '%') AS percent,
  concat('CMP', CASE WHEN user_id < 1000 THEN lpad(cast(user_id AS varchar), 4, '0')
    ELSE cast(user_id AS varchar) END) AS user_key,
  strftime(created_date, '%Y-%m-%d %H:%M') AS minute, strftime(created_date, '%Y-%m') AS month,
  epoch_us(created_date + to_hours(event_id % 100)) AS later_us,
  (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_date)) / 3.6e9 AS age_hours,
  strftime(created_date, '%Y-%m-%d') AS day
FROM reg""")
def time_and_label_functions(spark, d):
    reg = src.register(spark, d)
    iso = F.date_format("created_date", "yyyy-MM-dd'T'HH:mm:ss")
    return reg.select(
        "complaint_id",
        fn.hours_label(fn.lookup("severity", {"Critical": 4, "High": 24, "Medium": 72,
                                              "Low": 168}, 72)).alias("sla_text"),
        fn.percent_text((F.col("event_id") % 101) / 100).alias("percent"),
        fn.padded_id("user_id").alias("user_key"),
        fn.short_timestamp(iso).alias("minute"),
        fn.month_of("created_date").alias("month"),
        F.unix_micros(fn.add_hours("created_date", F.col("event_id") % 100)).alias("later_us"),
        fn.hours_between(F.lit(AS_OF).cast("timestamp"), F.col("created_date"))
        .alias("age_hours"),
        fn.short_date(iso).alias("day"))


@query(SLA + """SELECT complaint_id,
  CASE WHEN hours_remaining < 1
    THEN concat(cast(cast(floor(hours_remaining * 60 + 0.5::DOUBLE) AS bigint) AS varchar),
      'm left')
    ELSE concat(cast(cast(floor(hours_remaining + 0.5::DOUBLE) AS bigint) AS varchar), 'h left')
    END AS label,
  least(100::DOUBLE, greatest(0::DOUBLE, completion_pct)) AS meter,
  CASE WHEN hours_remaining < 2 THEN 'destructive' ELSE 'warning' END AS urgency,
  CASE WHEN completion_pct >= 70 THEN 'success' WHEN completion_pct >= 40 THEN 'warning'
    ELSE 'destructive' END AS resolution_band
FROM sla""")
def band_functions(spark, d):
    rows = sla.sla_columns(src.register(spark, d), AS_OF)
    return rows.select(
        "complaint_id", fn.remaining_label("hours_remaining").alias("label"),
        fn.clamp_percent("completion_pct").alias("meter"),
        fn.urgency("hours_remaining").alias("urgency"),
        fn.band("completion_pct", fn.RESOLUTION_BANDS).alias("resolution_band"))


@query(X.with_(X.COMM) + """SELECT complaint_id, seq,
  CASE WHEN type = 'auto_resolution' THEN 'auto_resolution' WHEN sender = 'system' THEN 'system'
    WHEN sender = 'customer' THEN 'customer' ELSE 'agent' END AS kind,
  message AS body FROM comm""")
def message_functions(spark, d):
    """Auto-resolutions get their prefix first, so that there is one to take off."""
    log = src.communications_log(spark, d)
    from .. import schema as S

    prefixed = F.when(F.col("type") == "auto_resolution",
                      F.concat(F.lit(S.AUTO_RESOLUTION_PREFIX), "message")).otherwise(
                          F.col("message"))
    return log.withColumn("message", prefixed).select(
        "complaint_id", "seq", fn.message_kind("sender", "type").alias("kind"),
        fn.message_body("message", "type").alias("body"))
