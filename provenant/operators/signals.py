"""Observations with their evidence flags: one pre-aggregation per signal table instead of correlated lookups."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions.predicates import completed, strong_signal
from provenant.functions.text import fingerprint

#: Free-text impact fields of an observation; those that a table lacks count as unknown.
IMPACT_FIELDS = ("time_impact", "financial_impact", "revenue_impact", "error_impact", "delay_impact", "risk_impact")


def flags(observations: DataFrame, workarounds: DataFrame, impacts: DataFrame, payments: DataFrame, spans: DataFrame) -> DataFrame:
    """Observations with ``has_*`` flags and the null-keeping strong predicate of the store."""
    w = workarounds.groupBy("observation_id").agg(F.lit(True).alias("_w"))
    i = impacts.groupBy("observation_id").agg(F.lit(True).alias("_i"), F.bool_or("quantified").alias("_q"), F.count_if("quantified").alias("quantified_signals"))
    p = payments.groupBy("observation_id").agg(F.lit(True).alias("_p"), F.count("*").alias("payment_signals"))
    e = spans.filter("observation_id is not null").groupBy("observation_id").agg(F.lit(True).alias("_e"))
    out = observations
    for side in (w, i, p, e):
        out = out.join(side.withColumnRenamed("observation_id", "_oid"), F.col("id") == F.col("_oid"), "left").drop("_oid")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = out.select(
        *observations.columns,
        (F.col("actor").isNotNull() | F.col("actor_role").isNotNull()).alias("has_actor"),
        F.col("job_to_be_done").isNotNull().alias("has_job"),
        F.col("context").isNotNull().alias("has_context"),
        (F.col("current_workaround").isNotNull() | no("_w")).alias("has_workaround"),
        reduce(or_, (F.col(c).isNotNull() for c in IMPACT_FIELDS if c in observations.columns), no("_i")).alias("has_impact"),
        no("_q").alias("has_quantified"),
        (F.col("existing_spend").isNotNull() | F.col("paid_workaround").isNotNull() | no("_p")).alias("has_payment"),
        no("_e").alias("has_evidence"),
        F.coalesce("quantified_signals", F.lit(0)).alias("quantified_signals"),
        F.coalesce("payment_signals", F.lit(0)).alias("payment_signals"),
    )
    args = [F.col(c) for c in ("problem_type", "has_actor", "has_job", "has_context", "has_workaround", "has_quantified", "has_payment")]
    kept = strong_signal(*args, F.col("active_solution_search"), F.col("switching_intent"))
    plain = strong_signal(*args, F.coalesce("active_solution_search", F.lit(False)), F.coalesce("switching_intent", F.lit(False)))
    return out.withColumns({"strong_or_null": kept, "strong": F.coalesce(plain, F.lit(False))})


def in_completed_runs(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """Observations of no run or of a completed one; the run table is joined by its id."""
    status = runs.select(F.col("id").alias("_run"), F.col("status").alias("_status"))
    joined = observations.join(status, F.col("pipeline_run_id") == F.col("_run"), "left")
    return joined.filter(completed(F.col("pipeline_run_id"), F.col("_status"))).drop("_run", "_status")


def clusterable(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """Observations of no run, or of a completed or failed one."""
    status = runs.select(F.col("id").alias("_run"), F.col("status").alias("_status"))
    joined = observations.join(status, F.col("pipeline_run_id") == F.col("_run"), "left")
    return joined.filter(F.col("pipeline_run_id").isNull() | F.col("_status").isin("COMPLETED", "FAILED")).drop("_run", "_status")


def exact_clusters(observations: DataFrame) -> DataFrame:
    """``cluster_id, fingerprint, observation_id``: equal fingerprints share the least observation id.

    A table without ``root_cause`` counts as one that knows none.
    """
    cause = F.col("root_cause") if "root_cause" in observations.columns else F.lit(None).cast("string")
    marked = observations.select(F.col("id").alias("observation_id"), fingerprint(F.col("actor"), F.col("context"), F.col("job_to_be_done"), F.col("problem"), cause).alias("fingerprint"))
    clusters = marked.groupBy("fingerprint").agg(F.min("observation_id").alias("cluster_id"))
    return marked.join(clusters, "fingerprint").select("cluster_id", "fingerprint", "observation_id")
