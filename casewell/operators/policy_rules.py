"""Rules that the policy texts state in words: the escalation ladder, acknowledgement and final
deadlines, ageing by responsible stage, and penalties for late re-credit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import lookup
from ..functions.time import as_timestamp, hours_between
from ..session import materialize
from .filters import is_unresolved, originals
from .sla import Clock, sla_columns
from .timeline import SLICE_HOURS, next_after, valid_until

DAY = 86_400_000_000  # microseconds


def _days_after(ts: str | Column, days: Column | int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    days = F.lit(days) if isinstance(days, int) else days
    return ts.cast("timestamp") + F.make_dt_interval(days.cast("int"))


# -- escalation ladder ---------------------------------------------------------

def ladder_target(level: Column, department: Column) -> Column:
    """Who is told on a rung; the first one belongs to the department."""
    out = F.when(level == S.LADDER[0][1], F.concat(department, F.lit(S.LADDER[0][2])))
    for _, name, target in S.LADDER[1:]:
        out = out.when(level == name, F.lit(target))
    return out


def escalation_ladder(df: DataFrame, as_of: Clock, overrides: DataFrame | None = None
                      ) -> DataFrame:
    """Unresolved originals past their deadline with the rung they are on: level, target, hours
    of breach and whether the regulator is alerted. Rows without a creation date have no
    deadline and are on no rung."""
    rows = sla_columns(originals(df).where(is_unresolved()), as_of, overrides)
    over = -F.col("hours_remaining")
    level = F.lit(None).cast("string")
    for hours, name, _ in S.LADDER:  # the highest rung that is passed
        level = F.when(over > hours, F.lit(name)).otherwise(level)
    department = lookup("category", S.DEPARTMENTS, S.DEFAULT_DEPARTMENT)
    return (
        rows.withColumn("ladder_level", level).where("ladder_level is not null")
        .select("complaint_id", "ladder_level",
                ladder_target(F.col("ladder_level"), department).alias("escalated_to"),
                over.alias("hours_breached"),
                (F.col("ladder_level") == S.LADDER[-1][1]).alias("regulatory_alert"))
    )


# -- acknowledgement and final answer ------------------------------------------

def ack_and_final_deadlines(register: DataFrame, communications: DataFrame, as_of: Clock,
                            slice_hours: float = SLICE_HOURS) -> DataFrame:
    """Per complaint the first message of an agent at or after its creation, the hours until
    then, both deadlines and whether they were missed by `as_of`.

    An answer after `as_of` has not happened yet. A resolved complaint is late if it took more
    days than allowed (unknown days count as in time), an open one once its deadline has
    passed. Without a creation date the deadlines are null and nothing is late."""
    now = as_timestamp(as_of)
    agent = communications.where((F.col("sender") == "agent") & (F.col("ts") <= now))
    rows = next_after(
        register.select("complaint_id", "created_date", "status", "resolution_days"), agent,
        "created_date", "ts", out="acknowledged_at", slice_hours=slice_hours)
    rows = rows.withColumns({
        "ack_due": _days_after("created_date", S.ACKNOWLEDGE_DAYS),
        "final_due": _days_after("created_date", S.FINAL_DAYS),
    })
    resolved = F.col("status").eqNullSafe("Resolved")
    late_final = F.when(resolved, F.col("resolution_days") > S.FINAL_DAYS).otherwise(
        F.col("final_due") < now)
    return rows.select(
        "complaint_id", "acknowledged_at",
        hours_between(F.col("acknowledged_at"), F.col("created_date")).alias("ack_hours"),
        "ack_due", "final_due",
        F.coalesce(F.coalesce("acknowledged_at", now) > F.col("ack_due"), F.lit(False))
        .alias("ack_late"),
        F.coalesce(late_final, F.lit(False)).alias("final_late"))


# -- ageing by stage -----------------------------------------------------------

def status_log(register: DataFrame, escalations: DataFrame) -> DataFrame:
    """Changes of status (complaint_id, seq, status, changed_at): Open at creation, Escalated at
    each accepted request after it, Resolved after the resolution days."""
    created = register.select("complaint_id", "created_date")
    opened = created.select("complaint_id", F.lit(-1).cast("bigint").alias("seq"),
                            F.lit("Open").alias("status"), F.col("created_date").alias("changed_at"))
    raised = escalations.join(created, "complaint_id").where(
        "escalated_at >= created_date").select(
        "complaint_id", F.col("seq").cast("bigint"), F.lit("Escalated"), "escalated_at")
    done = register.where((F.col("status") == "Resolved") & F.col("resolution_days").isNotNull())
    done = done.select(
        "complaint_id", F.lit(2**62).cast("bigint"), F.lit("Resolved"),
        _days_after("created_date", F.col("resolution_days")))
    return opened.unionAll(raised).unionAll(done)


def stage_ageing(register: DataFrame, log: DataFrame, as_of: Clock,
                 slice_hours: float = SLICE_HOURS) -> DataFrame:
    """(complaint_id, stage, status, micros, days): how long each complaint spent with each
    responsible stage and in each status until it was first resolved, or until `as_of`.

    The log of changes becomes intervals; those are cut at the borders of the stages, which
    count from creation. The parts of a complaint add up to its age. Changes before creation
    or after the first resolution, and complaints created after `as_of`, add nothing."""
    created = register.where("created_date is not null").select("complaint_id", "created_date")
    ends = log.where("status = 'Resolved'").groupBy("complaint_id").agg(
        F.min("changed_at").alias("_resolved"))
    # stored, so that the join with a busy complaint's log can be split
    bounds = materialize(created.join(ends, "complaint_id", "left"))
    rows = valid_until(log, "changed_at", "seq", slice_hours=slice_hours).join(
        bounds, "complaint_id")
    origin = F.unix_micros(F.col("created_date").cast("timestamp"))

    def since(ts: Column) -> Column:
        return F.unix_micros(ts.cast("timestamp")) - origin

    stop = F.least(as_timestamp(as_of), F.col("_resolved"))  # least passes over nulls
    begin = F.greatest(since(F.col("changed_at")), F.lit(0))
    end = since(F.least(F.col("valid_until"), stop))
    borders = [0, *(days for _, days in S.STAGES[:-1]), None]
    parts = F.array(*[
        F.struct(
            F.lit(name).alias("stage"),
            ((end if upper is None else F.least(end, F.lit(upper * DAY)))
             - F.greatest(begin, F.lit(lower * DAY))).alias("micros"))
        for (name, _), lower, upper in zip(S.STAGES, borders, borders[1:], strict=False)])
    cut = rows.select("complaint_id", "status", F.inline(F.filter(parts, lambda p: p.micros > 0)))
    return cut.groupBy("complaint_id", "stage", "status").agg(
        F.sum("micros").alias("micros")).withColumn("days", F.col("micros") / F.lit(float(DAY)))


# -- penalties -----------------------------------------------------------------

def penalty_accrual(register: DataFrame, extensions: DataFrame, as_of: Clock,
                    limits: Mapping[str, int] = S.PENALTY_DAYS, per_day: int = S.PENALTY_PER_DAY,
                    slice_hours: float = SLICE_HOURS) -> DataFrame:
    """(complaint_id, penalty_days, penalty) of the complaints whose category has a limit.

    A day is charged at each full day after creation, up to `as_of` and up to the resolution,
    if the deadline then in force has passed. The deadline is the category's limit after
    creation; an accepted extension replaces it, from the time of the request on, by the limit
    plus its hours (extensions do not add up). Each version of the deadline is charged by
    counting the full days inside its interval, without a row per day."""
    limit = lookup("category", limits, None)
    rows = register.withColumn("_limit", limit).where(
        "_limit is not null and created_date is not null").select(
        "complaint_id", "created_date", "_limit",
        F.when(F.col("status") == "Resolved", F.col("resolution_days")).alias("_days"))
    first = rows.select("complaint_id", F.lit(-1).cast("bigint").alias("seq"),
                        F.lit(0).cast("bigint").alias("extend_hours"),
                        F.lit("0001-01-01 00:00:00").cast("timestamp").alias("extended_at"))
    asked = extensions.join(rows.select("complaint_id"), "complaint_id", "left_semi").select(
        "complaint_id", F.col("seq").cast("bigint"), F.col("extend_hours").cast("bigint"),
        "extended_at")
    versions = valid_until(first.unionAll(asked), "extended_at", "seq", slice_hours=slice_hours)
    dated = versions.join(rows, "complaint_id")
    origin = F.unix_micros(F.col("created_date").cast("timestamp"))

    def since(ts: Column) -> Column:
        return F.unix_micros(ts.cast("timestamp")) - origin

    due = F.col("_limit") * DAY + F.col("extend_hours") * (DAY // 24)
    last = F.least(since(as_timestamp(as_of)), (F.col("_days") * DAY).cast("bigint"))
    # full days k with max(begin, due + 1) <= k * DAY < min(end, last + 1)
    low = F.greatest(since(F.col("extended_at")), due + 1)
    high = F.least(since(F.col("valid_until")), last + 1)

    def full_days(x: Column) -> Column:
        """Number of the first full day at or after x, one at least."""
        return F.greatest(F.floor((x + (DAY - 1)) / F.lit(DAY)), F.lit(1)).cast("bigint")

    charged = F.greatest(full_days(high) - full_days(low), F.lit(0))
    return dated.groupBy("complaint_id").agg(F.sum(charged).alias("penalty_days")).withColumn(
        "penalty", F.col("penalty_days") * per_day)


def ladder_rungs() -> Sequence[tuple[str, int]]:
    """Levels with their distance from the deadline in milliseconds, for timers."""
    return [(name, hours * 3_600_000) for hours, name, _ in S.LADDER]
