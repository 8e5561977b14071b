"""Shared predicates: strong signals, policy, availability, health."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCLUDED_TYPES = ("TEMPORARY_INCIDENT", "SUPPORT_QUESTION", "USER_ERROR")
POLICY_FIELDS = ("access_method", "commercial_use_status", "retention_rules", "attribution_requirements", "quoting_rules", "deletion_requirements", "rate_limit_notes", "rights_reviewed_at")


def strong_signal(problem_type: Column, actor: Column, job: Column, context: Column, workaround: Column, quantified: Column, payment: Column, active: Column, switching: Column) -> Column:
    """An allowed problem with actor and job, a context or workaround, and some demand; three-valued like its inputs."""
    return ~problem_type.isin(*EXCLUDED_TYPES) & actor & job & (context | workaround) & (quantified | payment | active | switching)


def evidence_state(global_seen: Column, dach_seen: Column, sources: Column, items: Column) -> Column:
    return F.when(global_seen & dach_seen, "CROSS_MARKET").when(sources >= 2, "MULTI_SOURCE").when(items >= 3, "RECURRING").when(items >= 2, "EMERGING").otherwise("SINGLE_SIGNAL")


#: Evidence states from weakest to strongest.
STATES = ("SINGLE_SIGNAL", "EMERGING", "RECURRING", "MULTI_SOURCE", "CROSS_MARKET")


def state_strength(state: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STATES)), state).cast("int")


def completed(run_id: Column, status: Column) -> Column:
    """Rows of no run or of a completed one."""
    return run_id.isNull() | (status == "COMPLETED")


def approved(status: Column) -> Column:
    """Approved for use by prefix, whatever the spelling of the separator."""
    folded = F.upper(F.replace(F.trim(status), F.lit("-"), F.lit("_")))
    return F.coalesce((folded == "APPROVED") | folded.startswith("APPROVED_"), F.lit(False))


def missing_policy_fields(columns: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(n)) for n, c in columns.items())))


def iso_date(value: Column) -> Column:
    """Whether a text is an ISO date: ``2026-09-18`` or ``20260918``, and a real day."""
    shape = value.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{8})$")
    dashed = F.concat_ws("-", F.substring(F.replace(value, F.lit("-"), F.lit("")), 1, 4), F.substring(F.replace(value, F.lit("-"), F.lit("")), 5, 2), F.substring(F.replace(value, F.lit("-"), F.lit("")), 7, 2))
    return F.coalesce(shape & F.expr("true") & dashed.try_cast("date").isNotNull(), F.lit(False))


def health_status(result: Column, visible: Column, latest: Column, checked: Column, evidence: Column, covered: Column) -> Column:
    """One recent visible item proves activity; absence needs complete coverage."""
    month = checked - F.expr("INTERVAL 30 DAYS")
    return (
        F.when(result == "ACCESS_RESTRICTED", "ACCESS_RESTRICTED")
        .when(result == "SOURCE_NOT_FOUND", "SOURCE_UNAVAILABLE")
        .when(result == "PROVIDER_FAILED", "UNKNOWN")
        .when((result == "PUBLIC_CONTENT") & (visible > 0) & latest.isNotNull() & (latest >= month) & evidence, "ACTIVE")
        .when((result == "PUBLIC_NO_RECENT") & covered & (latest.isNull() | (latest < month)), "INACTIVE_OR_LOW_ACTIVITY")
        .otherwise("UNKNOWN")
    )
