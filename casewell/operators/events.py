"""Event logs keyed by complaint: threads, escalations, extensions, triage, resolutions.

The mutable stores of an application become append-only tables with a sequence number; the
current state is the last write per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import fill_template, lookup
from ..functions.time import add_hours, as_timestamp, format_minute
from .filters import is_original, originals
from .sla import Clock, sla_columns, sla_display

SEQ_SLICE = 1_000_000


def latest_per_id(events: DataFrame, key: str = "complaint_id", seq: str = "seq") -> DataFrame:
    """Last write wins. `max_by` is combined before the shuffle, so an id that holds a third
    of the log costs one row per map task."""
    rest = [c for c in events.columns if c != key]
    return (
        events.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
        .select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])
    )


def valid_events(events: DataFrame, register: DataFrame) -> DataFrame:
    """Events about an existing complaint."""
    return events.join(register.select("complaint_id"), "complaint_id", "left_semi")


def rejected_events(events: DataFrame, register: DataFrame) -> DataFrame:
    """The side output: events about no complaint."""
    return events.join(register.select("complaint_id"), "complaint_id", "left_anti")


def running_number(df: DataFrame, key: str, seq: str = "seq", width: int = SEQ_SLICE) -> DataFrame:
    """Position of each row among the rows of its key, by `seq`, as `position` (from 1).

    Sequence numbers are unique per key, so a slice of `width` numbers holds `width` rows at
    most: rows are numbered inside (key, slice), and the slices before add their counts. A
    hot key is thereby spread over many tasks; join and window share one partitioning."""
    sliced = df.withColumn("_slice", F.col(seq) - F.pmod(F.col(seq), F.lit(width)))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(key, "_slice", "_before")
    )
    inside = Window.partitionBy(key, "_slice").orderBy(seq)
    return (
        sliced.join(offsets, [key, "_slice"])
        .withColumn("position", F.row_number().over(inside) + F.col("_before"))
        .drop("_slice", "_before")
    )


# -- threads -----------------------------------------------------------------

def thread(register: DataFrame, communications: DataFrame) -> DataFrame:
    """Original complaint as message 0, then the history of each complaint."""
    first = register.select(
        "complaint_id",
        F.lit(-1).cast("bigint").alias("seq"),
        F.lit("customer").alias("sender"),
        F.col("complaint_text").alias("message"),
        "channel",
        F.col("created_date").alias("ts"),
        F.lit("original_complaint").alias("type"),
    )
    history = valid_events(communications, register).select(first.columns)
    return first.unionByName(history)


def thread_totals(register: DataFrame, communications: DataFrame) -> DataFrame:
    """Messages per complaint, the original included."""
    history = communications.groupBy("complaint_id").agg(F.count(F.lit(1)).alias("_n"))
    return register.select("complaint_id").join(history, "complaint_id", "left").select(
        "complaint_id", (F.coalesce("_n", F.lit(0)) + 1).alias("total_messages")
    )


def add_communications(
    register: DataFrame, store: DataFrame | None, events: DataFrame
) -> DataFrame:
    """Validated new messages with `total_messages` after each one: messages stored before,
    plus its position among the new ones, plus one for the original complaint."""
    new = running_number(
        valid_events(
            events.withColumn("channel", F.coalesce("channel", F.lit("Internal"))), register
        ),
        "complaint_id",
    )
    if store is None:
        return new.withColumn("total_messages", F.col("position") + 1).drop("position")
    old = store.groupBy("complaint_id").agg(F.count(F.lit(1)).alias("_old"))
    return (
        new.join(old, "complaint_id", "left")
        .withColumn("total_messages", F.col("position") + F.coalesce("_old", F.lit(0)) + 1)
        .drop("position", "_old")
    )


def auto_resolved_audit(register: DataFrame, communications: DataFrame) -> DataFrame:
    """Resolved originals with a message that is typed, or reads, as an auto-resolution."""
    proof = communications.where(
        (F.col("type") == "auto_resolution")
        | F.col("message").contains(S.AUTO_RESOLUTION_MARK)
    ).select("complaint_id").distinct()
    return originals(register).where(F.col("status") == "Resolved").join(
        proof, "complaint_id", "left_semi"
    )


# -- extensions --------------------------------------------------------------

def _extensions(register: DataFrame, events: DataFrame) -> DataFrame:
    hours = lookup("severity", S.SLA_HOURS, S.DEFAULT_SLA_HOURS)
    base = register.select(
        "complaint_id", add_hours("created_date", hours).alias("_base_due")
    )
    return events.join(base, "complaint_id").withColumn(
        "due_date", add_hours("_base_due", F.col("extend_hours"))
    ).drop("_base_due")


def extend_sla(register: DataFrame, events: DataFrame) -> DataFrame:
    """Deadline in force per extended complaint. Extensions do not add up: each counts from
    the base deadline, and the last one stands; so only the last request per id is joined."""
    return _extensions(register, latest_per_id(events)).select(
        "complaint_id", "due_date", F.col("extend_hours").alias("extended_by"), "reason",
        "extended_at",
    )


def extension_messages(register: DataFrame, events: DataFrame) -> DataFrame:
    """One system message per accepted extension request."""
    return _extensions(register, events).select(
        "complaint_id", "seq", F.lit("system").alias("sender"),
        fill_template(S.EXTENSION_MESSAGE, hours="extend_hours", reason="reason",
                      due=format_minute("due_date")).alias("message"),
        F.lit("System").alias("channel"), F.col("extended_at").alias("ts"),
        F.lit(None).cast("string").alias("type"),
    )


# -- escalations -------------------------------------------------------------

def escalate(register: DataFrame, events: DataFrame) -> DataFrame:
    """Current escalation per complaint; a later request replaces the earlier one. Requests
    are reduced to the last per id before they are matched with the register."""
    rows = events.withColumn("escalated_by", F.coalesce("escalated_by", F.lit("Agent")))
    return valid_events(latest_per_id(rows), register).withColumn("status", F.lit("Active"))


def escalation_messages(register: DataFrame, events: DataFrame) -> DataFrame:
    return valid_events(events, register).select(
        "complaint_id", "seq", F.lit("system").alias("sender"),
        fill_template(
            S.ESCALATION_MESSAGE, level=F.coalesce("escalation_level", F.lit("Unknown")),
            team="escalated_to", reason="reason").alias("message"),
        F.lit("System").alias("channel"), F.col("escalated_at").alias("ts"),
        F.lit("escalation").alias("type"),
    )


def with_escalation(df: DataFrame, escalations: DataFrame) -> DataFrame:
    """Flag `escalated` and `escalation_level` ("None" without one)."""
    current = escalations.select("complaint_id", F.lit(True).alias("_hit"), "escalation_level")
    return (
        df.join(current, "complaint_id", "left")
        .withColumn("escalated", F.col("_hit").isNotNull())
        .withColumn("escalation_level", F.coalesce("escalation_level", F.lit("None")))
        .drop("_hit")
    )


def not_yet_escalated(df: DataFrame, escalations: DataFrame) -> DataFrame:
    return df.join(escalations.select("complaint_id"), "complaint_id", "left_anti")


def active_escalations(escalations: DataFrame) -> DataFrame:
    return escalations.where(F.col("status") == "Active")


def lookup_complaint(
    register: DataFrame,
    complaint_id: str,
    as_of: Clock,
    communications: DataFrame,
    escalations: DataFrame,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """One complaint with deadline, escalation and message total; empty when unknown. The
    messages themselves are rows of `thread`, since one complaint may have very many."""
    same = F.col("complaint_id") == complaint_id
    row = register.where(same)
    full = sla_display(
        sla_columns(row, as_of, None if overrides is None else overrides.where(same))
    )
    full = with_escalation(full, escalations.where(same))
    totals = thread_totals(row, communications.where(same))
    return full.join(totals, "complaint_id")


# -- triage ------------------------------------------------------------------

def triage_candidates(df: DataFrame, as_of: Clock, overrides: DataFrame | None = None) -> DataFrame:
    """Open critical originals past their deadline."""
    rows = df.where(
        is_original() & (F.col("status") == "Open") & (F.col("severity") == "Critical")
    )
    return sla_columns(rows, as_of, overrides).where(F.col("is_breached"))


def auto_triage(
    df: DataFrame,
    as_of: Clock,
    escalations: DataFrame,
    overrides: DataFrame | None = None,
    escalated_by: str = "Auto-Triage Agent",
) -> DataFrame:
    """New L2 escalations; complaints already escalated are left out, so a second run over
    the grown store yields nothing."""
    todo = not_yet_escalated(triage_candidates(df, as_of, overrides), escalations)
    return todo.select(
        "complaint_id",
        F.lit(S.TRIAGE_LEVEL).alias("escalation_level"),
        F.lit(S.TRIAGE_REASON).alias("reason"),
        lookup("category", S.DEPARTMENTS, S.DEFAULT_DEPARTMENT).alias("escalated_to"),
        F.lit(escalated_by).alias("escalated_by"),
        as_timestamp(as_of).alias("escalated_at"),
        F.lit("Active").alias("status"),
    )


def triage_messages(escalated: DataFrame) -> DataFrame:
    return escalated.select(
        "complaint_id", F.lit("system").alias("sender"), F.lit(S.TRIAGE_MESSAGE).alias("message"),
        F.lit(S.TRIAGE_CHANNEL).alias("channel"), F.col("escalated_at").alias("ts"),
        F.lit(None).cast("string").alias("type"),
    )


# -- resolutions -------------------------------------------------------------

def _granted(verdicts: DataFrame) -> DataFrame:
    """Positive verdicts, one row per id, so that the join cannot multiply complaints."""
    return (
        verdicts.where(F.col("can_auto_resolve"))
        .groupBy("complaint_id")
        .agg(F.max(F.struct("reasoning", "resolution_note")).alias("_v"))
    )


def apply_resolutions(
    register: DataFrame, verdicts: DataFrame, candidates: DataFrame, set_note: bool = False
) -> DataFrame:
    """Register after the run: candidates with a positive verdict that are still unresolved
    become Resolved; `set_note` also writes one resolution day and the note."""
    granted = _granted(verdicts).join(candidates.select("complaint_id"), "complaint_id",
                                      "left_semi")
    joined = register.join(granted, "complaint_id", "left")
    hit = F.col("_v").isNotNull() & ~F.col("status").eqNullSafe("Resolved")
    columns = {"status": F.when(hit, "Resolved").otherwise(F.col("status"))}
    if set_note:
        columns["resolution_days"] = F.when(hit, F.lit(1.0)).otherwise(F.col("resolution_days"))
        if "resolution_note" in register.columns:
            # a verdict without a note leaves the note that is there
            note = F.when(hit & F.col("_v.resolution_note").isNotNull(),
                          F.col("_v.resolution_note")).otherwise(F.col("resolution_note"))
        else:
            note = F.when(hit, F.col("_v.resolution_note"))
        columns["resolution_note"] = note
    return joined.withColumns(columns).drop("_v")


def resolution_messages(verdicts: DataFrame, candidates: DataFrame, as_of: Clock) -> DataFrame:
    open_ones = candidates.where(~F.col("status").eqNullSafe("Resolved"))
    return _granted(verdicts).join(open_ones.select("complaint_id"), "complaint_id",
                                   "left_semi").select(
        "complaint_id", F.lit("system").alias("sender"),
        F.concat(F.lit(S.AUTO_RESOLUTION_PREFIX), F.col("_v.reasoning")).alias("message"),
        F.lit(S.TRIAGE_CHANNEL).alias("channel"), as_timestamp(as_of).alias("ts"),
        F.lit("auto_resolution").alias("type"),
    )
