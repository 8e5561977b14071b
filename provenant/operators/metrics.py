"""Source metrics, yields, rankings and family tables, from pre-aggregates joined once per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions.predicates import approved

SORTS = ("strong-signal-yield", "payment-yield", "active-search-yield", "cluster-yield", "cross-source-yield", "cost-per-strong-signal", "newest-evidence")


def per_thousand(count: Column, scanned: Column) -> Column:
    """Yield per thousand items; unknown where nothing was scanned."""
    return F.try_divide(count * F.lit(1000.0), scanned)


def snapshot(sources: DataFrame, items: DataFrame, observations: DataFrame, all_observations: DataFrame, members: DataFrame, runs: DataFrame, records: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Counters of every source.

    ``observations`` carry flags and are those of completed runs; clusters count
    observations of any run.  Costs are known only if every operation has one.
    """
    source_of = items.select(F.col("id").alias("source_item_id"), "source_id")
    own = observations.join(source_of, "source_item_id")
    by_item = items.groupBy("source_id").agg(F.count("*").alias("item_count"), F.min("first_seen_at").alias("first_item"), F.max("last_seen_at").alias("last_item"))
    by_observation = own.groupBy("source_id").agg(
        F.count("*").alias("pain_observations"),
        F.count_if("strong_or_null").alias("strong_single_signals"),
        F.count_if("active_solution_search").alias("active_search_signals"),
        F.sum("payment_signals").alias("payment_signals"),
        F.sum("quantified_signals").alias("quantified_impact_signals"),
        F.count_if(F.col("problem_type") == "TEMPORARY_INCIDENT").alias("temporary_incidents"),
        F.count_if(F.col("problem_type") == "SUPPORT_QUESTION").alias("support_questions"),
    )
    pairs = members.join(all_observations.select(F.col("id").alias("observation_id"), "source_item_id"), "observation_id").join(source_of, "source_item_id").select("cluster_id", "source_id").distinct()
    shared = pairs.groupBy("cluster_id").agg((F.count("*") > 1).alias("shared"))
    by_cluster = pairs.join(shared, "cluster_id").groupBy("source_id").agg(F.count("*").alias("problem_clusters_contributed"), F.count_if("shared").alias("cross_source_confirmations"))
    by_run = runs.groupBy("source_id").agg(F.sum("urls_discovered").alias("discovered_total"), F.sum("cost_usd").alias("run_cost"), F.count("*").alias("run_count"), F.count_if(F.col("cost_usd").isNull()).alias("run_unknown"))
    by_record = records.groupBy("source_id").agg(F.count_distinct("canonical_url").alias("discovered_unique"), F.min("discovered_at").alias("first_record"), F.max("discovered_at").alias("last_record"))
    taken = acquisitions.join(records.select(F.col("id").alias("discovery_id"), "source_id"), "discovery_id")
    texts = items.select(F.col("id").alias("source_item_id"), (F.length("raw_text") >= 40).alias("long_enough"))
    by_acquisition = taken.join(texts, "source_item_id", "left").groupBy("source_id").agg(
        F.count_distinct(F.when(F.col("completeness").isin("FULL", "PARTIAL") & F.col("long_enough"), F.col("source_item_id"))).alias("after_prefilter"),
        F.sum("cost_usd").alias("taken_cost"),
        F.count("*").alias("taken_count"),
        F.count_if(F.col("cost_usd").isNull()).alias("taken_unknown"),
    )
    out = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "lifecycle", "commercial_use_status")
    for side in (by_item, by_observation, by_cluster, by_run, by_record, by_acquisition):
        out = out.join(side, "source_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    found = F.col("discovered_unique").isNotNull()
    operations, unknown = n("run_count") + n("taken_count"), n("run_unknown") + n("taken_unknown")
    known = (operations > 0) & (unknown == 0)
    cost = F.coalesce("run_cost", F.lit(0.0)) + F.coalesce("taken_cost", F.lit(0.0))
    return out.select(
        "source_id",
        "source_name",
        "lifecycle",
        "commercial_use_status",
        F.least("first_record", "first_item").alias("measurement_start"),
        F.greatest("last_record", "last_item").alias("measurement_end"),
        F.when(found, F.col("discovered_unique")).otherwise(n("item_count")).alias("items_scanned"),
        F.when(found, n("after_prefilter")).alias("items_after_prefilter"),
        *(n(c).alias(c) for c in ("pain_observations", "strong_single_signals", "active_search_signals", "quantified_impact_signals", "payment_signals", "problem_clusters_contributed", "cross_source_confirmations")),
        F.when(found, F.greatest(F.lit(0), n("discovered_total") - F.col("discovered_unique"))).cast("long").alias("duplicate_items"),
        n("temporary_incidents").alias("temporary_incidents"),
        n("support_questions").alias("support_questions"),
        F.when(known, cost).alias("known_processing_cost_usd"),
        known.alias("processing_cost_complete"),
    )


def with_yields(snapshots: DataFrame) -> DataFrame:
    scanned = F.col("items_scanned")
    return snapshots.withColumns(
        {
            "strong_yield": per_thousand(F.col("strong_single_signals"), scanned),
            "payment_yield": per_thousand(F.col("payment_signals"), scanned),
            "active_search_yield": per_thousand(F.col("active_search_signals"), scanned),
            "cluster_yield": per_thousand(F.col("problem_clusters_contributed"), scanned),
            "cross_source_yield": per_thousand(F.col("cross_source_confirmations"), scanned),
            "cost_per_strong_signal": F.when(F.col("processing_cost_complete") & (F.col("strong_single_signals") > 0), F.col("known_processing_cost_usd") / F.col("strong_single_signals")),
            "production_ready": approved(F.col("commercial_use_status")),
        }
    )


def sort_keys(sort_by: str) -> list[Column]:
    """One dimension, unknown yields as 0 and unknown costs last; ties by name, then id."""
    yields = {"strong-signal-yield": "strong_yield", "payment-yield": "payment_yield", "active-search-yield": "active_search_yield", "cluster-yield": "cluster_yield", "cross-source-yield": "cross_source_yield"}
    ties = [F.lower("source_name").asc(), F.col("source_id").asc()]
    if sort_by in yields:
        return [F.coalesce(yields[sort_by], F.lit(0.0)).desc(), *ties]
    if sort_by == "cost-per-strong-signal":
        return [F.col("cost_per_strong_signal").asc_nulls_last(), *ties]
    if sort_by == "newest-evidence":
        return [F.coalesce("measurement_end", F.lit("")).desc(), *ties]
    raise ValueError(f"no such order of sources: {sort_by}")


def ranked(snapshots: DataFrame, sort_by: str, *, lifecycles: tuple[str, ...] = (), minimum_items: int = 0, production_ready_only: bool = False, limit: int | None = None) -> DataFrame:
    """Sources by one dimension with their position; sources are a small dimension table."""
    rows = with_yields(snapshots).filter(F.col("items_scanned") >= minimum_items)
    if lifecycles:
        rows = rows.filter(F.col("lifecycle").isin(*lifecycles))
    if production_ready_only:
        rows = rows.filter("production_ready")
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(*sort_keys(sort_by))))
    return rows if limit is None else rows.filter(F.col("position") <= limit)


def families(items: DataFrame, observations: DataFrame, payments: DataFrame, members: DataFrame) -> DataFrame:
    """Counters by source and problem family over observations of completed runs."""
    source_of = items.select(F.col("id").alias("source_item_id"), "source_id", "first_seen_at", "last_seen_at")
    member = members.select(F.col("observation_id").alias("id"), "cluster_id")
    own = observations.filter("problem_family is not null").join(source_of, "source_item_id").join(member, "id", "left")
    return own.groupBy("source_id", "problem_family").agg(
        F.count("*").alias("observation_count"),
        F.count_if("strong_or_null").alias("strong_signal_count"),
        F.count_if("active_solution_search").alias("active_search_count"),
        F.sum("payment_signals").cast("long").alias("payment_signal_count"),
        F.count_distinct("cluster_id").alias("cluster_count"),
        F.min("first_seen_at").alias("first_seen"),
        F.max("last_seen_at").alias("last_seen"),
    )


def take_budget(rows: DataFrame, order: list[Column], cap: Column, budget: int) -> DataFrame:
    """Greedy allocation in order: each row takes its cap or what is left; rows that get nothing go."""
    before = F.coalesce(F.sum(cap).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("allocated_items", F.greatest(F.lit(0), F.least(cap, F.lit(budget) - before)).cast("long")).filter("allocated_items > 0")


def budget_plan(snapshots: DataFrame, profiles: DataFrame, *, total: int, exploration: int, per_source_cap: int, minimum_items: int, sort_by: str = "strong-signal-yield") -> DataFrame:
    """Performance and exploration lanes of a scan budget."""
    field = {"strong-signal-yield": "strong_yield", "payment-yield": "payment_yield", "active-search-yield": "active_search_yield", "cluster-yield": "cluster_yield", "cross-source-yield": "cross_source_yield"}[sort_by]
    best = ranked(snapshots, sort_by, lifecycles=("CORE", "EXPLORATION"), minimum_items=minimum_items, production_ready_only=True).filter(F.col(field).isNotNull())
    performance = take_budget(best, [F.col("position")], F.lit(per_source_cap), total - exploration)
    performance = performance.select("source_id", "source_name", F.lit("PERFORMANCE").alias("lane"), "allocated_items", F.lit(per_source_cap).cast("long").alias("per_source_cap"), F.col(field).cast("double").alias("rank_value"))
    pilot = profiles.select("source_id", F.coalesce("strict_pilot_posts", "pilot_posts").alias("_pilot"))
    rest = snapshots.join(best.select("source_id"), "source_id", "left_anti").filter(F.col("lifecycle").isin("CANDIDATE", "EXPLORATION") & approved(F.col("commercial_use_status"))).join(pilot, "source_id", "left")
    cap = F.least(F.lit(per_source_cap).cast("long"), F.col("_pilot").cast("long"))
    rest = rest.withColumn("_cap", cap).filter("_cap > 0")
    explored = take_budget(rest, [F.col("items_scanned").asc(), F.lower("source_name").asc(), F.col("source_id").asc()], F.col("_cap"), exploration)
    explored = explored.select("source_id", "source_name", F.lit("EXPLORATION").alias("lane"), "allocated_items", F.col("_cap").alias("per_source_cap"), F.col("items_scanned").cast("double").alias("rank_value"))
    return performance.unionByName(explored)


#: Workarounds done by hand, and tools that people have built for themselves (fixed values).
BY_HAND = ("SPREADSHEET", "CSV", "EMAIL", "WHATSAPP", "PAPER", "MANUAL_ENTRY")
OWN_TOOLS = ("INTERNAL_SCRIPT", "CUSTOM_SOFTWARE")


def wave_rows(selections: DataFrame, sources: DataFrame, items: DataFrame, flagged: DataFrame, done: DataFrame, workarounds: DataFrame, impacts: DataFrame, payments: DataFrame, runs: DataFrame, records: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """One row per selected source with everything a wave is judged by; without a full item the research measures are unknown.

    ``selections`` holds ``source, category, target_items, health_status, policy_ready,
    acquisition_eligible``; ``flagged`` are all observations, ``done`` those of completed
    runs.  Model costs cannot be told apart by source, so they are unknown.
    """
    kind = lambda c, v: F.count_distinct(F.when(F.col("completeness") == v, F.col("canonical_url"))).alias(c)
    taken = acquisitions.join(records.select(F.col("id").alias("discovery_id"), "source_id", "canonical_url"), "discovery_id")
    called = F.get_json_object("metadata_json", "$.provider_invocation") == "true"
    long_enough = items.filter(F.length("raw_text") >= 40).select(F.col("id").alias("source_item_id"), F.lit(True).alias("_usable"))
    requested = F.col("requested_items") if "requested_items" in runs.columns else F.lit(None).cast("long")
    requests = F.col("search_requests") if "search_requests" in runs.columns else F.lit(1)
    searched = runs.groupBy("source_id").agg(F.sum(requests).cast("long").alias("search_requests"), F.sum("urls_discovered").cast("long").alias("discovered_urls"), F.when(F.count(requested) == F.count("*"), F.coalesce(F.sum(requested), F.lit(0))).cast("long").alias("requested_items"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("_run_cost"), (F.count("*") - F.count("cost_usd")).alias("_run_unknown"))
    unique = records.groupBy("source_id").agg(F.count_distinct("canonical_url").alias("unique_urls"))
    found = taken.join(long_enough, "source_item_id", "left").groupBy("source_id").agg(
        kind("full_items", "FULL"), kind("partial_items", "PARTIAL"), kind("metadata_only_items", "METADATA_ONLY"),
        F.count_if(F.col("state").isin("ACQUISITION_FAILED", "POLICY_BLOCKED")).alias("failed_acquisitions"),
        F.count_distinct(F.when((F.col("completeness") == "FULL") & F.col("_usable"), F.col("source_item_id"))).alias("items_after_prefilter"),
        F.sum(F.when(called, F.col("latency_ms"))).cast("long").alias("latency_ms"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("_acq_cost"), (F.count("*") - F.count("cost_usd")).alias("_acq_unknown"),
    )
    of = items.select(F.col("id").alias("source_item_id"), "source_id")
    own = done.join(of, "source_item_id")
    seen = own.groupBy("source_id").agg(F.count("*").alias("pain_observations"), F.count_if("strong_or_null").alias("strong_signals"), F.count_if("active_solution_search").alias("active_solution_searches"), F.sum("quantified_signals").cast("long").alias("quantified_impacts"), F.sum("payment_signals").cast("long").alias("payment_signals"))
    by_kind = lambda c, v: F.count_distinct(F.when(F.col("workaround_type").isin(*v), F.col("observation_id"))).alias(c)
    made = workarounds.join(flagged.select(F.col("id").alias("observation_id"), "source_item_id"), "observation_id").join(of, "source_item_id").groupBy("source_id").agg(by_kind("manual_workaround_signals", BY_HAND), by_kind("diy_internal_tool_signals", OWN_TOOLS))
    out = selections.join(sources.select(F.col("id").alias("source_id"), F.lower("name").alias("_k")), F.lower("source") == F.col("_k"), "left").drop("_k")
    for side in (searched, unique, found, seen, made):
        out = out.join(side, "source_id", "left")
    counts = ["search_requests", "discovered_urls", "unique_urls", "full_items", "partial_items", "metadata_only_items", "failed_acquisitions", "items_after_prefilter", "pain_observations", "strong_signals", "active_solution_searches", "quantified_impacts", "payment_signals", "manual_workaround_signals", "diy_internal_tool_signals", "_run_cost", "_run_unknown", "_acq_cost", "_acq_unknown"]
    out = out.fillna(0, counts).withColumn("requested_items", F.when(F.col("search_requests") == 0, F.lit(0)).otherwise(F.col("requested_items")).cast("long"))
    full = F.col("full_items")
    if_full = lambda c: F.when(full > 0, F.col(c)).alias(c)
    unknown = F.col("_run_unknown") + F.col("_acq_unknown")
    return out.select(  # fixed values: the names and the order of a wave's 36 columns
        "source", "category", "target_items", "health_status", "policy_ready", "acquisition_eligible", "search_requests", "requested_items", "discovered_urls", "unique_urls",
        (F.col("discovered_urls") - F.col("unique_urls")).alias("duplicates_removed"), "full_items", "partial_items", "metadata_only_items", "failed_acquisitions",
        F.try_divide(full.cast("double"), F.col("unique_urls")).alias("acquisition_success_rate"), full.alias("usable_items"),
        *(if_full(c) for c in ("items_after_prefilter", "pain_observations", "strong_signals", "active_solution_searches", "quantified_impacts", "payment_signals", "manual_workaround_signals", "diy_internal_tool_signals")),
        F.when((F.col("search_requests") > 0) & (unknown == 0), F.col("_run_cost") + F.col("_acq_cost")).alias("acquisition_cost_usd"), F.lit(None).cast("double").alias("processing_cost_usd"), unknown.alias("unknown_cost_records"), "latency_ms",
        *(per_thousand(F.col(c), full).alias(n) for c, n in (("pain_observations", "pain_per_1000_usable"), ("strong_signals", "strong_per_1000_usable"), ("active_solution_searches", "active_per_1000_usable"), ("payment_signals", "payment_per_1000_usable"))),
        F.lit(None).cast("double").alias("cost_per_strong_signal_usd"), F.when(full == 0, "UNMEASURED").otherwise("DESCRIPTIVE_ONLY").alias("research_quality"), full.alias("sample_size_usable"),
    )
