"""Sources, filters, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from .. import sources as src

from ..operators import feed, filters, lookups
from ..session import scratch_path
from . import sql as X
from .catalog import query

REG = X.with_(X.REG)
TXT = X.with_(X.REG, X.TXT)
FEED = X.with_(X.FEED)
REG_COLUMNS = ["complaint_id", "category", "sentiment", "severity", "channel", "branch", "status",
               "resolution_days", "is_duplicate", "duplicate_of"]


@query(REG + f"SELECT {', '.join(REG_COLUMNS)}, strftime(created_date, '%Y-%m-%d %H:%M:%S') "
       "AS created FROM reg")
def register_csv_roundtrip(spark, d):
    """The register written as CSV and read back with the fixed schema."""
    path = scratch_path(spark, "register-csv")
    base = src.register(spark, d)
    for f in S.BASE_SCHEMA.fields:
        if f.name not in base.columns:
            base = base.withColumn(f.name, F.lit(None).cast(f.dataType))
    src.write_register(base.select(S.BASE_SCHEMA.names), path, "csv")
    back = src.read_register(spark, path, classified=False)
    return back.select(*REG_COLUMNS, F.date_format("created_date", "yyyy-MM-dd HH:mm:ss")
                       .alias("created"))


@query(REG + """SELECT complaint_id, category, status, resolution_days, is_duplicate,
  concat('case ', complaint_id, chr(10), 'said "', category, '"', chr(10), chr(10), branch, ', ',
    channel) AS complaint_text, strftime(created_date, '%Y-%m-%d %H:%M:%S') AS created FROM reg""")
def register_split_csv(spark, d):
    """The register with texts of several lines written as CSV and read back in blocks."""
    path = scratch_path(spark, "register-lines")
    text = F.concat(F.lit("case "), "complaint_id", F.lit('\nsaid "'), "category", F.lit('"\n\n'),
                    "branch", F.lit(", "), "channel")
    base = src.register(spark, d).withColumn("complaint_text", text)
    for f in S.BASE_SCHEMA.fields:
        if f.name not in base.columns:
            base = base.withColumn(f.name, F.lit(None).cast(f.dataType))
    src.write_register(base.select(S.BASE_SCHEMA.names), path, "csv")
    rows, _ = src.read_register_split(spark, path, classified=False)
    return rows.select("complaint_id", "category", "status", "resolution_days", "is_duplicate",
                       "complaint_text",
                       F.date_format("created_date", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query(REG + "SELECT strftime(created_date, '%Y-%m') AS month, count(*) AS n, "
       "count(DISTINCT complaint_id) AS ids FROM reg GROUP BY 1")
def register_month_partitions(spark, d):
    """The register written by month and read back."""
    path = scratch_path(spark, "register-parquet")
    src.write_register(src.register(spark, d), path)
    back = src.read_register_parquet(spark, path)
    return back.groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("complaint_id").alias("ids"))


@query("SELECT vec_id AS id, len(embedding) AS dim, "
       "round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def embeddings_roundtrip(spark, d):
    path = scratch_path(spark, "embeddings")
    src.write_embeddings(src.read_embeddings(spark, f"{d}/embeddings.parquet", "vec_id"), path)
    return src.read_embeddings(spark, path).select(
        "id", F.size("embedding").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(REG + "SELECT concat('{\"complaint_id\":\"', complaint_id, '\",\"status\":\"', status, "
       "'\",\"resolution_days\":', coalesce(cast(cast(resolution_days AS bigint) AS varchar) || "
       "'.0', 'null'), '}') AS record FROM reg")
def to_records(spark, d):
    return src.to_records(
        src.register(spark, d).select("complaint_id", "status", "resolution_days"))


@query(REG + "SELECT * EXCLUDE (created_date) FROM reg WHERE NOT is_duplicate")
def originals(spark, d):
    return filters.originals(src.register(spark, d)).drop("created_date")


_SEARCH = """, page AS (SELECT * FROM reg WHERE NOT is_duplicate AND category = 'error'
  AND severity = 'High' ORDER BY complaint_id LIMIT 50)
SELECT complaint_id, category, sentiment, severity, status, branch,
  coalesce(cast(cast(resolution_days AS bigint) AS varchar) || '.0', '') AS resolution_days,
  coalesce(duplicate_of, '') AS duplicate_of, (SELECT count(*) FROM page) AS total FROM page"""


@query(REG.rstrip() + _SEARCH)
def search_complaints(spark, d):
    hits = filters.search_complaints(src.register(spark, d), category="error", severity="High")
    return hits.select("complaint_id", "category", "sentiment", "severity", "status", "branch",
                       "resolution_days", "duplicate_of", "total")


@query(TXT + "SELECT complaint_id, category, severity FROM txt WHERE category = 'view' AND "
       "(lower(complaint_text) LIKE '%ther the%' OR lower(complaint_id) LIKE '%ther the%')")
def text_search(spark, d):
    hits = filters.text_search(src.register(spark, d, with_text=True), "THER the",
                               category="view")
    return hits.select("complaint_id", "category", "severity")


@query(TXT + "SELECT count(*) FILTER (lower(complaint_text) LIKE '%mp77%' OR "
       "lower(complaint_id) LIKE '%mp77%') AS matched, count(*) AS total FROM txt")
def search_match_counts(spark, d):
    return filters.match_counts(src.register(spark, d, with_text=True), "MP77")


@query(REG + "SELECT complaint_id, category, severity FROM reg WHERE NOT is_duplicate AND "
       "status = 'Open' AND category IN ('click', 'view') AND severity IN ('Low', 'Medium') "
       "ORDER BY complaint_id LIMIT 2")
def low_risk_candidates(spark, d):
    return filters.low_risk_candidates(src.register(spark, d), ["click", "view"]).select(
        "complaint_id", "category", "severity")


@query(TXT + "SELECT complaint_id, status, severity FROM txt WHERE NOT is_duplicate AND "
       "status IN ('Open', 'In Progress') AND severity IN ('Low', 'Medium') AND "
       "(contains(lower(complaint_text), 'upi') OR contains(lower(complaint_text), 'ation') OR "
       "contains(lower(complaint_text), 'pende'))")
def low_risk_by_text(spark, d):
    return filters.low_risk_by_text(
        src.register(spark, d, with_text=True), ["upi", "ation", "pende"]
    ).select("complaint_id", "status", "severity")


@query(REG + "SELECT complaint_id, status FROM reg WHERE status IS DISTINCT FROM 'Resolved'")
def not_resolved(spark, d):
    return filters.not_resolved(src.register(spark, d)).select("complaint_id", "status")


@query(TXT + "SELECT complaint_id FROM txt WHERE complaint_text IS NOT NULL AND "
       "regexp_replace(complaint_text, '^\\s+|\\s+$', '', 'g') <> ''")
def require_text(spark, d):
    return filters.require_text(src.register(spark, d, with_text=True), blank_too=True).select(
        "complaint_id")


@query(REG + "SELECT complaint_id, coalesce(duplicate_of, '') AS duplicate_of, "
       "coalesce(cast(cast(resolution_days AS bigint) AS varchar) || '.0', '') "
       "AS resolution_days, cast(is_duplicate AS varchar) AS is_duplicate FROM reg")
def blank_nulls(spark, d):
    return filters.blank_nulls(src.register(spark, d).select(
        "complaint_id", "duplicate_of", "resolution_days", "is_duplicate"))


@query(REG + "SELECT complaint_id, category FROM reg")
def project_base(spark, d):
    reg = src.register(spark, d).select("complaint_id", "category")
    return filters.project_base(reg.withColumn("predicted_category", F.col("category"))
                                .withColumn("source", F.lit("x")))


@query(REG + "SELECT complaint_id, severity = 'Critical' AND status = 'Escalated' "
       "AS agent_escalated FROM reg")
def agent_escalated_flag(spark, d):
    return filters.agent_escalated_flag(src.register(spark, d)).select(
        "complaint_id", "agent_escalated")


_KW = " OR ".join(f"contains(lower(text), '{w}')" for w in S.REGULATORY_KEYWORDS)


@query(f"""WITH f AS (SELECT doc_id, source, lang, ({_KW}) OR n_chars > 2000 AS flag
FROM documents)
SELECT doc_id, flag AS regulatory_flag, CASE WHEN flag THEN
  concat('Flagged due to potential regulatory impact or high severity. [Source: ', source, ']')
  ELSE '' END AS regulatory_reason FROM f""")
def regulatory_keyword_flag(spark, d):
    """Long documents stand in for a high severity."""
    docs = src.table(spark, d, "documents").select(
        "doc_id", "text", F.col("source").alias("policy_source"),
        F.lit(None).cast("string").alias("policy_text"),
        F.when(F.col("n_chars") > 2000, "High").otherwise("Low").alias("severity"))
    return filters.regulatory_keyword_flag(docs, text="text").select(
        "doc_id", "regulatory_flag", "regulatory_reason")


# -- lookups ----------------------------------------------------------------------

def _case(column: str, mapping: dict, default) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {lit(default)} END"


@query(REG + f"SELECT complaint_id, cast({X.HOURS} AS bigint) AS sla_hours FROM reg")
def with_sla_hours(spark, d):
    return lookups.with_sla_hours(src.register(spark, d)).select("complaint_id", "sla_hours")


@query(FEED + "SELECT feed_id, category, "
       f"{_case('category', S.DEPARTMENTS, S.DEFAULT_DEPARTMENT)} AS department FROM mapped")
def with_department(spark, d):
    rows = src.external_feed(spark, d).select(
        "feed_id", feed.map_product("product").alias("category"))
    return lookups.with_department(rows)


@query(REG + "SELECT complaint_id, channel, "
       f"{_case('channel', S.CHANNEL_ICONS, S.DEFAULT_ICON)} AS icon FROM reg")
def with_channel_icon(spark, d):
    return lookups.with_channel_icon(src.register(spark, d)).select(
        "complaint_id", "channel", "icon")


@query(REG + "SELECT complaint_id, cast("
       f"{_case('severity', S.PRIORITY_SCORES, S.DEFAULT_PRIORITY)} AS bigint) "
       f"AS priority_score, {_case('sentiment', S.TONE_TIPS, S.DEFAULT_TONE)} "
       "AS customer_tone_tip FROM reg")
def with_priority_and_tone(spark, d):
    return lookups.with_tone(lookups.with_priority(src.register(spark, d))).select(
        "complaint_id", "priority_score", "customer_tone_tip")


_ICONS = ", ".join(f"('{k}', '{v}')" for k, v in S.CHANNEL_ICONS.items())


@query(REG + f""", cfg(name, icon) AS (VALUES {_ICONS}),
c AS (SELECT lower(channel) AS n, count(*) AS count FROM reg WHERE NOT is_duplicate
  AND channel <> 'Phone Call' GROUP BY 1)
SELECT name, icon, coalesce(cast(count AS varchar), '—') AS count
FROM cfg LEFT JOIN c ON lower(cfg.name) = c.n""")
def channel_config_join(spark, d):
    """One channel is left out, so that the placeholder shows."""
    from ..operators.stats import count_by

    reg = src.register(spark, d).where(F.col("channel") != "Phone Call")
    return lookups.channel_config_join(count_by(reg, "channel"))


@query(REG + "SELECT e.vec_id, r.complaint_id, r.category FROM embeddings e "
       "JOIN reg r ON r.event_id = e.vec_id")
def index_to_row(spark, d):
    """Vectors and register rows meet by key, never by position."""
    vec = src.table(spark, d, "embeddings").select("vec_id")
    return vec.join(src.register(spark, d), F.col("vec_id") == F.col("event_id")).select(
        "vec_id", "complaint_id", "category")


# -- set operations -------------------------------------------------------------------

@query(X.with_(X.REG, X.FEED) + "SELECT complaint_id, category, severity, is_duplicate, "
       "NULL AS source FROM reg UNION ALL SELECT concat('EXT', lpad(cast(feed_id AS varchar), "
       "6, '0')), category, NULL, false, 'External' FROM mapped")
def append_feed(spark, d):
    return feed.append_feed(src.register(spark, d), src.external_feed(spark, d)).select(
        "complaint_id", "category", "severity", "is_duplicate", "source")


@query(X.with_(X.REG, X.FEED) + "SELECT complaint_id, count(*) AS count FROM (SELECT "
       "complaint_id FROM reg UNION ALL SELECT concat('EXT', lpad(cast(feed_id % 150 AS varchar)"
       ", 6, '0')) FROM mapped) GROUP BY 1 HAVING count(*) > 1")
def id_collisions(spark, d):
    rows = src.external_feed(spark, d).withColumn("feed_id", F.col("feed_id") % 150)
    return feed.id_collisions(src.register(spark, d), rows)


@query(FEED + "SELECT feed_id, product, category FROM mapped")
def map_product(spark, d):
    return src.external_feed(spark, d).select(
        "feed_id", "product", feed.map_product("product").alias("category"))


_CHANNELS = "[" + ", ".join(f"'{c}'" for c in S.CHANNELS) + "]"


def _pick(salt: str, n: int) -> str:
    return (f"cast(concat('0x', substr(md5(concat(complaint_id, '{salt}')), 1, 6)) AS bigint) "
            f"% {n}")


@query(REG + f""", pick AS (SELECT * FROM reg ORDER BY md5(concat(complaint_id, 'dup')),
  complaint_id LIMIT 30),
copies AS (SELECT concat('CMP', cast(9000 + row_number() OVER (ORDER BY complaint_id) AS
  varchar)) AS complaint_id, {_CHANNELS}[{_pick('dupc', 6)} + 1] AS channel,
  created_date + to_days(cast({_pick('dupd', 3)} + 1 AS integer)) AS created_date,
  true AS is_duplicate, complaint_id AS duplicate_of, category FROM pick)
SELECT complaint_id, channel, epoch_us(created_date) AS created_us, is_duplicate, duplicate_of,
  category FROM reg
UNION ALL SELECT complaint_id, channel, epoch_us(created_date), is_duplicate, duplicate_of,
  category FROM copies""")
def inject_duplicates(spark, d):
    return feed.inject_duplicates(src.register(spark, d)).select(
        "complaint_id", "channel", F.unix_micros("created_date").alias("created_us"),
        "is_duplicate", "duplicate_of", "category")


_GRID = """, c AS (SELECT category, sentiment, severity, count(*) AS count FROM reg
  WHERE NOT is_duplicate GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT category FROM c), (SELECT DISTINCT sentiment FROM c),
  (SELECT DISTINCT severity FROM c))
SELECT g.*, coalesce(c.count, 0) AS count FROM grid g
  LEFT JOIN c USING (category, sentiment, severity)"""


@query(REG.rstrip() + _GRID)
def category_grid(spark, d):
    from ..operators.stats import category_grid as grid

    return grid(src.register(spark, d))


