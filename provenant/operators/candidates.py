"""Research candidates: explainable cluster roll-ups without a composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions.predicates import EXCLUDED_TYPES, evidence_state, state_strength

SORTS = ("strongest-evidence", "newest", "active-search", "payment-evidence", "manual-workarounds", "dach-evidence")


def roll_up(members: DataFrame, observations: DataFrame, items: DataFrame, cases: DataFrame, include_opened: bool = False) -> DataFrame:
    """One row per cluster from flagged observations (already filtered to completed runs)."""
    item = items.select(F.col("id").alias("_item"), "source_id", F.col("country_code").alias("_item_country"))
    rows = members.join(observations, members["observation_id"] == observations["id"]).join(item, F.col("source_item_id") == F.col("_item"))
    active, switching = F.coalesce("active_solution_search", F.lit(False)), F.coalesce("switching_intent", F.lit(False))
    dimensions = sum((c.cast("int") for c in (active, switching, *(F.col(x) for x in ("has_payment", "has_quantified", "has_workaround", "has_impact", "has_context")))), F.lit(0))
    complete = sum((F.col(c).cast("int") for c in ("has_actor", "has_job", "has_context", "has_evidence")), F.lit(0))
    country = F.coalesce("country_code", "_item_country")
    count = lambda c: F.count_if(c).cast("long")
    best = F.max_by(F.struct("has_actor", "has_job", "has_context", "has_evidence"), F.struct(complete, dimensions, F.col("created_at"), -F.col("id")))
    out = rows.groupBy("cluster_id").agg(
        F.count("*").alias("observation_count"),
        F.count_distinct("source_id").alias("source_count"),
        F.count_distinct("source_item_id").alias("item_count"),
        F.count_distinct(country).alias("country_count"),
        count(F.col("evidence_scope") == "GLOBAL").alias("global_observation_count"),
        count(F.col("evidence_scope") == "DACH").alias("dach_observation_count"),
        count(active).alias("active_search_count"),
        count(switching).alias("switching_intent_count"),
        count(F.col("has_quantified")).alias("quantified_impact_count"),
        count(F.col("has_payment")).alias("payment_evidence_count"),
        count(F.col("has_workaround")).alias("workaround_count"),
        count(F.col("strong")).alias("strong_signal_count"),
        F.bool_and(F.col("problem_type").isin(*EXCLUDED_TYPES)).alias("_excluded"),
        F.max_by("problem", F.struct(dimensions, F.col("created_at"), -F.col("id"))).alias("representative_problem"),
        F.count_distinct("problem_family").alias("_families"),
        F.min("problem_family").alias("_family"),
        best.alias("_best"),
        F.max("created_at").alias("latest_observation_at"),
    )
    opened = cases.groupBy(F.col("cluster_id").alias("_case_cluster")).agg(F.min("id").alias("existing_case_id"))
    out = out.join(opened, F.col("cluster_id") == F.col("_case_cluster"), "left").drop("_case_cluster")
    if not include_opened:
        out = out.filter("existing_case_id is null")
    state = evidence_state(F.col("global_observation_count") > 0, F.col("dach_observation_count") > 0, F.col("source_count"), F.col("item_count"))
    ready = ~F.col("_excluded") & ((F.col("item_count") >= 2) | (F.col("strong_signal_count") > 0))
    missing = F.array_compact(F.array(*(F.when(~F.col(f"_best.{c}"), F.lit(n)) for c, n in (("has_actor", "actor"), ("has_job", "job_to_be_done"), ("has_context", "context"), ("has_evidence", "exact_evidence_span")))))
    out = out.withColumns({"evidence_state": state, "research_ready": ready, "_missing": missing})
    return out.select(
        "cluster_id",
        "representative_problem",
        F.when(F.col("_families") == 1, F.col("_family")).alias("problem_family"),
        "evidence_state",
        "observation_count",
        "source_count",
        "item_count",
        "country_count",
        "global_observation_count",
        "dach_observation_count",
        "active_search_count",
        "switching_intent_count",
        "quantified_impact_count",
        "payment_evidence_count",
        "workaround_count",
        "strong_signal_count",
        "research_ready",
        F.when(F.col("_excluded"), "cluster contains only incidents, support questions, or user errors").when(~F.col("research_ready"), "no recurrence or strong individual signal established").alias("exclusion_reason"),
        F.array_join("_missing", ",").alias("missing_for_completion"),
        "latest_observation_at",
        "existing_case_id",
        F.array_join(reasons(), "; ").alias("reasons"),
    )


# The sentences of the reasons.
def reasons() -> Column:
    """Why a cluster is worth a look, in a fixed order."""
    counted = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    return F.array_compact(
        F.array(
            F.when(F.col("evidence_state") == "CROSS_MARKET", "global and DACH evidence are both present"),
            F.when(F.col("source_count") >= 2, F.concat(F.lit("confirmed across "), F.col("source_count").cast("string"), F.lit(" sources"))),
            F.when(F.col("item_count") >= 2, F.concat(F.lit("observed in "), F.col("item_count").cast("string"), F.lit(" source items"))),
            counted("strong_signal_count", " strong individual signal(s)"),
            counted("active_search_count", " active solution search signal(s)"),
            counted("switching_intent_count", " switching intent signal(s)"),
            counted("quantified_impact_count", " quantified impact signal(s)"),
            counted("payment_evidence_count", " payment evidence signal(s)"),
            counted("workaround_count", " documented workaround(s)"),
            F.when(F.size("_missing") == 0, "minimum problem evidence is complete"),
        )
    )


def ordered(candidates: DataFrame, sort_by: str) -> DataFrame:
    """Candidates with their ``position`` by one named dimension, all descending, the larger cluster id first among equals."""
    search = F.col("active_search_count") + F.col("switching_intent_count")
    common = [F.col("research_ready"), state_strength(F.col("evidence_state")), F.col("observation_count"), F.col("cluster_id")]
    first = {"newest": F.col("latest_observation_at"), "active-search": search, "payment-evidence": F.col("payment_evidence_count"), "manual-workarounds": F.col("workaround_count"), "dach-evidence": F.col("dach_observation_count")}
    if sort_by == "strongest-evidence":
        keys = [*common[:2], F.col("payment_evidence_count"), F.col("quantified_impact_count"), search, F.col("workaround_count"), F.col("strong_signal_count"), F.col("observation_count"), F.col("latest_observation_at"), F.col("cluster_id")]
    elif sort_by in first:
        keys = [first[sort_by], *common]
    else:
        raise ValueError(f"unknown candidate sort: {sort_by}")
    # one narrow row per cluster; the list is numbered as a whole
    return candidates.withColumn("position", F.row_number().over(Window.orderBy(*(k.desc() for k in keys)))).orderBy("position")
