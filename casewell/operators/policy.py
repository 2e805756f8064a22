"""Policy passages: chunking, retrieval, rule-based drafts, prompt texts and the parsing of
model answers. The call of a language model is not part of this library."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.text import (
    contains_any, ellipsis_if_longer, fill_template, hours_label, lookup, strip,
)
from .filters import originals, regulatory_keyword_flag
from .similarity import duplicate_found
from .stats import label_count_maps
from .vectors import knn


# -- corpus --------------------------------------------------------------------

def chunk_corpus(df: DataFrame, sep: str = "\n\n", min_len: int = 20) -> DataFrame:
    """(source, text) → (source, chunk_id, text): paragraphs longer than `min_len`, trimmed,
    numbered per source after the length test."""
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), re.escape(sep)), strip)
    long_ones = F.filter(parts, lambda p: F.char_length(p) > min_len)
    return (
        df.select("source", F.posexplode_outer(long_ones).alias("_n", "text"))
        .where(F.col("text").isNotNull())
        .select("source", F.concat_ws("_", "source", F.col("_n").cast("string"))
                .alias("chunk_id"), "text")
    )


def search_policies(queries: DataFrame, chunks: DataFrame, top_k: int = 3, id_col: str = "id",
                    vec_col: str = "embedding", **knn_options) -> DataFrame:
    """Best passages per query without a threshold: (query_id, rank, chunk_id, similarity,
    source, text). `chunks` holds (chunk_id, source, text, vector)."""
    near = knn(queries.select(F.col(id_col).alias("id"), vec_col),
               chunks.select(F.col("chunk_id").alias("id"), vec_col),
               top_k, None, "id", vec_col, exclude_self=False, **knn_options)
    return near.withColumnRenamed("neighbour_id", "chunk_id").join(
        chunks.select("chunk_id", "source", "text"), "chunk_id")


def best_policy(found: DataFrame) -> DataFrame:
    """Rank 1 per query as (query_id, policy_source, policy_text)."""
    return found.where(F.col("rank") == 1).select(
        "query_id", F.col("source").alias("policy_source"), F.col("text").alias("policy_text"))


# -- analysis and drafts -----------------------------------------------------------

def similar_lists(similar_rows: DataFrame, top_k: int) -> DataFrame:
    """Results per query as one ordered array of at most `top_k` structs."""
    entry = F.struct("rank", "complaint_id", "category", "severity",
                     F.bround("similarity", 3).alias("similarity"))
    return similar_rows.where(F.col("rank") <= top_k).groupBy("query_id").agg(
        F.sort_array(F.collect_list(entry)).alias("similar_complaints"))


def analyze(predicted: DataFrame, similar_rows: DataFrame, top_k: int = 3,
            id_col: str = "query_id") -> DataFrame:
    """One row per new complaint: predictions, similar complaints, duplicate flag, department
    and deadline text. `predicted` carries the predicted_* and *_confidence columns."""
    rows = predicted.withColumnRenamed(id_col, "query_id")
    flags = duplicate_found(rows, similar_rows.where(F.col("rank") <= top_k), "query_id")
    return (
        rows.join(similar_lists(similar_rows, top_k), "query_id", "left")
        .join(flags.select("query_id", "duplicate_found"), "query_id", "left")
        .withColumns({
            "suggested_department": lookup("predicted_category", S.DEPARTMENTS,
                                           S.DEFAULT_DEPARTMENT),
            "suggested_sla": hours_label(lookup("predicted_severity", S.SLA_HOURS,
                                                S.DEFAULT_SLA_HOURS)),
        })
    )


def action_items(category: Column, source: Column) -> Column:
    team = lookup(category, S.DEPARTMENTS, S.DEFAULT_DEPARTMENT)
    base = F.array(F.lit(S.ACTION_LOG), fill_template(S.ACTION_ASSIGN, team=team))
    follow = fill_template(S.ACTION_FOLLOW, source=source)
    return F.when(source.isNotNull(), F.array_append(base, follow)).otherwise(base)


def draft_response(predicted: DataFrame, best: DataFrame, similar_rows: DataFrame | None = None,
                   id_col: str = "query_id", top_k: int = 2, texts: DataFrame | None = None
                   ) -> DataFrame:
    """Rule-based draft per complaint from its predictions and best policy passage.

    The complaint texts are a column of `predicted`, or come from `texts` (text_key,
    complaint_text) by its column `text_key`: then they are joined last, so that no text that
    many complaints share is shuffled for each of them, and keywords are looked for once in each
    text and each passage."""
    once = texts is not None and not any(" " in w for w in S.REGULATORY_KEYWORDS)
    known = ("_in_text", "_in_policy") if once else ()
    if once:
        texts, best = (df.withColumn(c, contains_any(text, S.REGULATORY_KEYWORDS))
                       for df, c, text in zip((texts, best), known,
                                              ("complaint_text", "policy_text")))
    rows = predicted.withColumnRenamed(id_col, "query_id").join(best, "query_id", "left")
    name = (F.coalesce("customer_name", F.lit("Customer"))
            if "customer_name" in rows.columns else F.lit("Customer"))
    category, severity = F.col("predicted_category"), F.col("predicted_severity")
    source, policy = F.col("policy_source"), F.col("policy_text")

    def with_source(text: str, otherwise: str, **values: Column) -> Column:
        return F.when(source.isNotNull(), fill_template(text, source=source, **values)
                      ).otherwise(F.lit(otherwise))

    drafts = rows.withColumns({
        "draft_response": F.concat(
            fill_template(S.DRAFT_OPENING, name=name, category=category),
            with_source(S.DRAFT_WITH_POLICY, S.DRAFT_WITHOUT_POLICY)),
        "root_cause": F.concat(
            fill_template(S.ROOT_CAUSE, category=category),
            with_source(S.ROOT_CAUSE_SOURCE, "", snippet=ellipsis_if_longer(policy, 120))),
        "action_items": action_items(category, source),
        "escalate_to": lookup(category, S.DEPARTMENTS, S.DEFAULT_DEPARTMENT),
        "resolution_sla": hours_label(lookup(severity, S.SLA_HOURS, S.DEFAULT_SLA_HOURS)),
        "priority_score": lookup(severity, S.PRIORITY_SCORES, S.DEFAULT_PRIORITY),
        "customer_tone_tip": lookup("predicted_sentiment", S.TONE_TIPS, S.DEFAULT_TONE),
    })
    def flagged(df: DataFrame) -> DataFrame:
        return regulatory_keyword_flag(
            df, severity="predicted_severity", known=known).drop(*known)

    if texts is None:
        drafts = flagged(drafts)
    if similar_rows is not None:
        asked = drafts if texts is None else drafts.select("query_id", "text_key").join(
            texts.select("text_key"), "text_key", "left")  # a row per text, as with a column
        flags = duplicate_found(asked, similar_rows.where(F.col("rank") <= top_k), "query_id")
        drafts = drafts.join(similar_lists(similar_rows, top_k), "query_id", "left").join(
            flags.select("query_id", "duplicate_found"), "query_id", "left")
    return drafts if texts is None else flagged(drafts.join(texts, "text_key", "left"))


# -- prompt texts ----------------------------------------------------------------------

def joined_lines(rows: DataFrame, line: Column, out: str) -> DataFrame:
    """Lines of the ranked results of each query (top-k, so a few), joined in rank order."""
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))),
            lambda x: x["line"]), "\n").alias(out))


def policy_context(found: DataFrame) -> DataFrame:
    return joined_lines(found, F.concat(F.lit("- "), "source", F.lit(": "), "text"),
                        "policy_context")


def similar_context(rows: DataFrame, text: str = "complaint_text") -> DataFrame:
    return joined_lines(
        rows,
        F.concat(F.lit("- ID: "), "complaint_id", F.lit(", Category: "), "category",
                 F.lit("\n  Text: "), text),
        "similar_context")


def prompt_table(queries: DataFrame, policies: DataFrame, similar_rows: DataFrame | None = None,
                 id_col: str = "query_id") -> DataFrame:
    """Assistant prompt per query row (query[, complaint_id]) with retrieved context."""
    rows = queries.withColumnRenamed(id_col, "query_id").join(
        policy_context(policies), "query_id", "left")
    if similar_rows is None:
        rows = rows.withColumn("similar_context", F.lit(""))
    else:
        rows = rows.join(similar_context(similar_rows), "query_id", "left")
    about = F.col("complaint_id") if "complaint_id" in rows.columns else F.lit(None)
    return rows.withColumn("prompt", F.concat_ws(
        "\n",
        F.concat(F.lit("Officer query: "), "query"),
        F.concat(F.lit("Related complaint: "), F.coalesce(about.cast("string"), F.lit("None"))),
        F.lit("Relevant policies:"), F.coalesce("policy_context", F.lit("")),
        F.lit("Similar complaints:"), F.coalesce("similar_context", F.lit("")),
        F.lit("Answer as JSON with answer, citations, suggested_actions and "
              "draft_customer_reply."),
    ))


def resolution_prompts(candidates: DataFrame, policies: DataFrame) -> DataFrame:
    """Prompt per low-risk candidate (query_id, complaint_text, category)."""
    rows = candidates.join(policy_context(policies), "query_id", "left")
    return rows.withColumn("prompt", F.concat_ws(
        "\n",
        F.lit("Decide whether this complaint can be resolved automatically."),
        F.concat(F.lit("Complaint: "), F.coalesce("complaint_text", F.lit(""))),
        F.concat(F.lit("Category: "), F.coalesce("category", F.lit(""))),
        F.lit("Relevant policies:"), F.coalesce("policy_context", F.lit("")),
        F.lit("Answer as JSON with can_auto_resolve, reasoning and resolution_message."),
    ))


def trend_prompt(df: DataFrame) -> DataFrame:
    """One row: the label counts as the text of a trend-summary prompt."""
    maps = label_count_maps(df).agg(*[
        F.max(F.when(F.col("label") == n, F.col("counts"))).alias(n)
        for n in ("category", "sentiment", "severity", "top_branches")
    ])
    total = originals(df).agg(F.count(F.lit(1))).scalar()
    return maps.select(F.concat(
        F.lit("Summarise these complaints for management.\nData: total="), total.cast("string"),
        F.lit(", by_category="), "category", F.lit(", by_sentiment="), "sentiment",
        F.lit(", by_severity="), "severity", F.lit(", top_branches="), "top_branches",
    ).alias("prompt"))


# -- answers ---------------------------------------------------------------------------

def unfence(raw: Column) -> Column:
    """Text between the code fences, when an answer begins with one."""
    text = strip(raw)
    body = F.regexp_extract(text, r"(?s)^```(?:json)?(.*?)(?:```|$)", 1)
    return F.when(text.startswith("```"), strip(body)).otherwise(text)


ITEMS = T.ArrayType(T.StructType([
    T.StructField("complaint_text", T.StringType()),
    T.StructField("resolution_note", T.StringType()),
]))
DRAFT = T.StructType([
    T.StructField("draft_response", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("action_items", T.ArrayType(T.StringType())),
    T.StructField("escalate_to", T.StringType()),
    T.StructField("resolution_sla", T.StringType()),
    T.StructField("priority_score", T.LongType()),
    T.StructField("customer_tone_tip", T.StringType()),
])


def parse_llm_output(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Answers that hold a JSON array of complaints → one row per complaint; texts trimmed,
    blank ones dropped, unreadable answers give no rows."""
    items = F.from_json(unfence(F.col(raw)), ITEMS)
    keep = [c for c in df.columns if c != raw]
    rows = df.select(*keep, F.explode_outer(items).alias("_i"))
    return rows.select(
        *keep,
        strip(F.col("_i.complaint_text")).alias("complaint_text"),
        strip(F.coalesce("_i.resolution_note", F.lit(""))).alias("resolution_note"),
    ).where(F.col("complaint_text") != "")


def parse_record(df: DataFrame, schema: T.StructType, default: Mapping, raw: str = "raw"
                 ) -> DataFrame:
    """Answers that hold one JSON object → its fields; the default record where the text is
    missing or is no object. `parsed` tells which."""
    with_corrupt = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    text = unfence(F.col(raw))
    rows = df.withColumn(
        "_r", F.from_json(text, with_corrupt, {"columnNameOfCorruptRecord": "_bad"})
    ).withColumn(
        "parsed",
        F.coalesce(text.startswith("{"), F.lit(False)) & F.col("_r").isNotNull()
        & F.col("_r._bad").isNull(),
    )

    def value(f: T.StructField) -> Column:
        d = default[f.name]
        lit = F.array(*[F.lit(x) for x in d]) if isinstance(d, list) else F.lit(d)
        return F.when(F.col("parsed"), F.col(f"_r.{f.name}")).otherwise(lit.cast(f.dataType))

    return rows.withColumns({f.name: value(f) for f in schema.fields}).drop("_r", raw)


def parse_draft(df: DataFrame, raw: str = "raw") -> DataFrame:
    return parse_record(df, DRAFT, S.DEFAULT_DRAFT, raw)


TREND = T.StructType([
    T.StructField("executive_summary", T.StringType()),
    T.StructField("root_cause_analysis", T.StringType()),
    T.StructField("top_concerns", T.ArrayType(T.StringType())),
    T.StructField("recommended_actions", T.ArrayType(T.StringType())),
    T.StructField("risk_alert", T.StringType()),
    T.StructField("positive_note", T.StringType()),
])


def parse_trend(df: DataFrame, raw: str = "raw") -> DataFrame:
    empty = {"executive_summary": "", "root_cause_analysis": "", "top_concerns": [], "recommended_actions": [],
             "risk_alert": "", "positive_note": ""}
    return parse_record(df, TREND, empty, raw)


#: A verdict comes in one of two shapes; each field has a name in both.
VERDICT_NAMES = {"can_auto_resolve": "auto_resolve", "reasoning": "audit_reasoning",
                 "resolution_note": "resolution_message"}
VERDICT = T.StructType([
    T.StructField(name, field.dataType) for field in S.VERDICT_SCHEMA.fields[1:]
    for name in (field.name, VERDICT_NAMES[field.name])])


def parse_verdict(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Verdict answers in either shape; an unreadable one resolves nothing."""
    empty = {f.name: False if isinstance(f.dataType, T.BooleanType) else "" for f in VERDICT.fields}
    rows = parse_record(df, VERDICT, empty, raw)
    return rows.withColumns({a: F.coalesce(a, b) for a, b in VERDICT_NAMES.items()}).drop(
        *VERDICT_NAMES.values())
