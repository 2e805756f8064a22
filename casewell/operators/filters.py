"""Projections and filters over the register."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import contains_any, fill_template, strip


def is_original() -> Column:
    """Flag false; a missing flag is not an original."""
    return ~F.col("is_duplicate")


def is_unresolved() -> Column:
    """Null-safe: a missing status counts as not resolved."""
    return ~F.col("status").eqNullSafe("Resolved")


def originals(df: DataFrame) -> DataFrame:
    return df.where(is_original())


def not_resolved(df: DataFrame) -> DataFrame:
    return df.where(is_unresolved())


def _equality(df: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def blank_nulls(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Null → "" in every column (numbers become text); columns in `keep` stay as they are."""
    return df.select([
        F.col(c) if c in keep else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        for c in df.columns
    ])


def search_complaints(
    df: DataFrame,
    category: str | None = None,
    sentiment: str | None = None,
    severity: str | None = None,
    status: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """First `limit` originals by id that meet all given filters, as text, with `total` = the
    number of rows returned. The limit is a top-k per partition; only its rows are counted."""
    hits = _equality(originals(df), category=category, sentiment=sentiment,
                     severity=severity, status=status)
    page = hits.orderBy("complaint_id").limit(limit)
    page = page.withColumn("created_date", F.col("created_date").cast("string"))
    # at most `limit` rows reach this window
    from pyspark.sql import Window

    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return blank_nulls(page).withColumn("total", total)


def text_search(
    df: DataFrame,
    q: str,
    category: str | None = None,
    sentiment: str | None = None,
    severity: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Case-insensitive substring of the text or the id, with the four filters."""
    rows = _equality(df, category=category, sentiment=sentiment, severity=severity, status=status)
    if not q:
        return rows
    low = q.lower()
    return rows.where(
        F.coalesce(F.lower("complaint_text").contains(low), F.lit(False))
        | F.lower("complaint_id").contains(low)
    )


def match_counts(df: DataFrame, q: str, **filters: str | None) -> DataFrame:
    """Matched rows of all rows, in one pass."""
    low = q.lower()
    hit = (F.coalesce(F.lower("complaint_text").contains(low), F.lit(False))
           | F.lower("complaint_id").contains(low))
    for column, value in filters.items():
        if value:
            hit = hit & F.coalesce(F.col(column) == value, F.lit(False))
    return df.agg(F.count_if(hit).alias("matched"), F.count(F.lit(1)).alias("total"))


def low_risk_candidates(
    df: DataFrame,
    categories: Sequence[str] = tuple(S.AUTO_RESOLVE_CATEGORIES),
    severities: Sequence[str] = tuple(S.AUTO_RESOLVE_SEVERITIES),
    limit: int | None = 2,
) -> DataFrame:
    """Open originals of the low-risk categories; a run takes the first two by id."""
    rows = originals(df).where(
        (F.col("status") == "Open")
        & F.col("category").isin(list(categories))
        & F.col("severity").isin(list(severities))
    )
    return rows if limit is None else rows.orderBy("complaint_id").limit(limit)


def low_risk_by_text(
    df: DataFrame,
    keywords: Sequence[str] = tuple(S.AUTO_RESOLVE_KEYWORDS),
    severities: Sequence[str] = tuple(S.AUTO_RESOLVE_SEVERITIES),
) -> DataFrame:
    """Open or running originals of low severity whose text holds a known keyword."""
    return originals(df).where(
        F.col("status").isin("Open", "In Progress")
        & F.col("severity").isin(list(severities))
        & contains_any("complaint_text", keywords)
    )


def require_text(df: DataFrame, column: str = "complaint_text", blank_too: bool = False) -> DataFrame:
    rows = df.where(F.col(column).isNotNull())
    return rows.where(strip(column) != "") if blank_too else rows


def project_base(df: DataFrame) -> DataFrame:
    """Register without prediction and source columns."""
    return df.drop(*S.PREDICTION_COLUMNS, "source")


def agent_escalated_flag(df: DataFrame) -> DataFrame:
    flag = (F.col("severity") == "Critical") & (F.col("status") == "Escalated")
    return df.withColumn("agent_escalated", F.coalesce(flag, F.lit(False)))


def regulatory_keyword_flag(
    df: DataFrame,
    text: str = "complaint_text",
    policy_text: str = "policy_text",
    policy_source: str = "policy_source",
    severity: str = "severity",
    keywords: Sequence[str] = tuple(S.REGULATORY_KEYWORDS),
    known: Sequence[str] = (),
) -> DataFrame:
    """Keyword in the text or its best policy passage, or a high severity; with the reason. Columns
    `known` tell, for the texts of rows that share some, whether a keyword is in them; then no text
    is read here. That is the same for keywords without a blank, which lie in one of the texts."""
    if known:
        found = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in known])
    else:
        found = contains_any(
            F.concat_ws(" ", F.coalesce(F.col(text), F.lit("")), F.col(policy_text)), keywords)
    flag = found | F.coalesce(F.col(severity).isin("High", "Critical"), F.lit(False))
    source = F.col(policy_source)
    reason = (
        F.when(~flag, "")
        .when(source.isNotNull(), fill_template(S.REGULATORY_REASON_SOURCE, source=source))
        .otherwise(S.REGULATORY_REASON)
    )
    return df.withColumn("regulatory_flag", flag).withColumn("regulatory_reason", reason)
