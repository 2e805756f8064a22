"""Common table expressions of the check queries, in SQL that DuckDB runs on the tables."""

from __future__ import annotations

AS_OF = "2024-01-30 12:00:00"
HOURS = ("CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 24 WHEN 'Medium' THEN 72 "
         "WHEN 'Low' THEN 168 ELSE 72 END")

REG = """reg AS (
SELECT concat('CMP', cast(event_id AS varchar)) AS complaint_id,
  event_id, user_id, event_type AS category, ts AS created_date,
  CASE event_id % 5 WHEN 0 THEN 'Angry' WHEN 1 THEN 'Frustrated' WHEN 2 THEN 'Neutral'
    WHEN 3 THEN 'Disappointed' ELSE 'Urgent' END AS sentiment,
  CASE event_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High'
    ELSE 'Critical' END AS severity,
  CASE event_id % 7 WHEN 0 THEN 'Email' WHEN 1 THEN 'Branch Visit' WHEN 2 THEN 'Phone Call'
    WHEN 3 THEN 'Mobile App' WHEN 4 THEN 'Web Portal' ELSE 'Social Media' END AS channel,
  concat('branch_', cast(user_id % 12 AS varchar)) AS branch,
  CASE (event_id + user_id) % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress'
    WHEN 2 THEN 'Escalated' ELSE 'Resolved' END AS status,
  CASE WHEN (event_id + user_id) % 4 = 3 THEN cast(1 + event_id % 15 AS double) END
    AS resolution_days,
  (event_id % 19 = 0) AS is_duplicate,
  CASE WHEN event_id % 19 = 0 AND event_id > 0
    THEN concat('CMP', cast(event_id - 1 AS varchar)) END AS duplicate_of
FROM events)"""

TXT = """txt AS (
SELECT reg.*, d.text AS complaint_text FROM reg LEFT JOIN documents d
  ON d.doc_id = reg.event_id % (SELECT count(*) FROM documents))"""

COMM = """comm AS (
SELECT concat('CMP', cast(conv_id AS varchar)) AS complaint_id, turn AS seq,
  CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' ELSE 'system' END AS sender,
  text AS message, 'Internal' AS channel,
  TIMESTAMP '2024-01-31 00:00:00' + to_minutes(turn) AS ts,
  CASE WHEN role = 'assistant' AND turn >= 5 THEN 'auto_resolution' END AS type
FROM conversations)"""

ESCREQ = """escreq AS (
SELECT concat('CMP', cast(user_id * 97 AS varchar)) AS complaint_id, event_id AS seq,
  CASE WHEN value >= 20 THEN 'L1' WHEN value >= 5 THEN 'L2' END AS escalation_level,
  concat('props ', props) AS reason, concat('Desk ', cast(user_id % 5 AS varchar)) AS escalated_to,
  'Agent' AS escalated_by, ts AS escalated_at
FROM events WHERE event_type = 'error')"""

ESC = """esc AS (
SELECT *, 'Active' AS status FROM escreq WHERE complaint_id IN (SELECT complaint_id FROM reg)
QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY seq DESC) = 1)"""

EXTREQ = """extreq AS (
SELECT concat('CMP', cast(user_id * 61 AS varchar)) AS complaint_id, event_id AS seq,
  cast(1 + event_id % 96 AS bigint) AS extend_hours,
  concat('requested by user ', cast(user_id AS varchar)) AS reason, ts AS extended_at
FROM events WHERE event_type = 'signup')"""

EXTALL = f"""extall AS (
SELECT x.*, r.created_date + to_hours({HOURS}) + to_hours(x.extend_hours) AS due_date
FROM extreq x JOIN reg r USING (complaint_id))"""

EXT = """ext AS (
SELECT * FROM extall
QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY seq DESC) = 1)"""

VERD = """verd AS (
SELECT concat('CMP', cast(doc_id AS varchar)) AS complaint_id, quality = 1 AS can_auto_resolve,
  concat('quality ', cast(quality AS varchar)) AS reasoning,
  concat('toxic ', cast(toxic AS varchar)) AS resolution_note
FROM labels)"""

PRODUCT = """CASE p_partkey % 8 WHEN 0 THEN 'Credit reporting' WHEN 1 THEN 'Debt collection'
  WHEN 2 THEN 'Mortgage' WHEN 3 THEN 'Checking or savings account' WHEN 4 THEN 'Credit card'
  WHEN 5 THEN 'Money transfer' WHEN 6 THEN '' END"""

FEED = f"""feed AS (
SELECT p_partkey AS feed_id, {PRODUCT} AS product, p_name AS text FROM part),
mapped AS (SELECT *, CASE
  WHEN lower(coalesce(product, '')) LIKE '%credit card%'
    OR lower(coalesce(product, '')) LIKE '%credit reporting%' THEN 'Credit Card'
  WHEN lower(product) LIKE '%loan%' OR lower(product) LIKE '%mortgage%'
    OR lower(product) LIKE '%debt%' THEN 'Loan Services'
  WHEN lower(product) LIKE '%account%' OR lower(product) LIKE '%savings%' THEN 'Account Opening'
  WHEN lower(product) LIKE '%transfer%' OR lower(product) LIKE '%money%'
    THEN 'Fund Transfer / NEFT / RTGS'
  ELSE 'Customer Service' END AS category FROM feed)"""


def sla(source: str = "reg", out: str = "sla", overrides: bool = False) -> str:
    """CTE `out`: `source` with the deadline columns."""
    join = " LEFT JOIN ext USING (complaint_id)" if overrides else ""
    due = "created_date + to_hours(sla_hours)"
    if overrides:
        due = f"coalesce(ext.due_date, {due})"
    return f"""{out}_h AS (SELECT *, {HOURS} AS sla_hours FROM {source}),
{out}_d AS (SELECT h.*, {due} AS due_date FROM {out}_h h{join}),
{out}_r AS (SELECT *, (epoch_us(due_date) - epoch_us(TIMESTAMP '{AS_OF}')) / 3.6e9
  AS hours_remaining FROM {out}_d),
{out} AS (SELECT *, hours_remaining < 0 AS is_breached,
  CASE WHEN hours_remaining < 0 THEN 'Breached'
    WHEN hours_remaining < sla_hours * cast(0.2 AS double) THEN 'At Risk'
    ELSE 'On Track' END AS sla_status,
  CASE WHEN hours_remaining < 0 THEN cast(100 AS double)
    ELSE least(cast(100 AS double),
      (cast(1 AS double) - hours_remaining / sla_hours) * cast(100 AS double)) END
    AS completion_pct
  FROM {out}_r)"""


UNIT = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v)"""

NN = UNIT + """,
nn AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id,
  list_dot_product(a.e, b.e) / (a.n * b.n) AS similarity,
  row_number() OVER (PARTITION BY a.vec_id
    ORDER BY list_dot_product(a.e, b.e) / (a.n * b.n) DESC, b.vec_id) AS rank
  FROM u a JOIN u b ON a.vec_id <> b.vec_id)"""

NNSELF = NN.replace("nn AS", "nns AS").replace("a JOIN u b ON a.vec_id <> b.vec_id", "a, u b")


def pairs(k: int, threshold: float, max_sim: float | None) -> str:
    cut = "" if max_sim is None else f" AND similarity < {max_sim}"
    return NN + f""",
hits AS (SELECT * FROM nn WHERE rank <= {k} AND similarity >= {threshold}{cut}),
prs AS (SELECT query_id AS id_1, neighbour_id AS id_2, similarity AS similarity_score FROM hits
  QUALIFY row_number() OVER (PARTITION BY least(query_id, neighbour_id),
    greatest(query_id, neighbour_id) ORDER BY query_id) = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


TOKEN = r"[\p{L}\p{N}_]{2,}"


def term_ctes(stop: list[str] | None = None) -> str:
    """CTEs tf (doc_id, term, tf) over documents, words and pairs of adjacent words."""
    drop = ""
    if stop:
        drop = " WHERE t NOT IN (" + ", ".join(f"'{w}'" for w in stop) + ")"
    return f"""w0 AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM documents),
tok0 AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w0),
tok AS (SELECT * FROM tok0{drop}),
big AS (SELECT doc_id, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM tok),
terms AS (SELECT doc_id, t AS term FROM big
  UNION ALL SELECT doc_id, t || ' ' || nxt FROM big WHERE nxt IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
voc AS (SELECT term, cast(sum(tf) AS bigint) AS count, count(*) AS df FROM tf GROUP BY term
  ORDER BY count DESC, term LIMIT 5000),
idf AS (SELECT *, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df))
  + 1.0::DOUBLE AS idf FROM voc)"""
