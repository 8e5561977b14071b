"""Queries over the research tables, each with an independent SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions.predicates import evidence_state, health_status
from provenant.operators import audits, candidates, cost, metrics, planning, rules, signals
from provenant.plans.registry import Registry
from provenant.sources.fixtures import TABLES, Domain

registry = Registry()


def flagged(d: Domain) -> DataFrame:
    return signals.flags(d.problem_observations, d.workarounds, d.impact_signals, d.payment_signals, d.evidence_spans)


#: SQL of the flagged observations; the run filter is added by the queries.
FLAGS = """
flags AS (
  SELECT o.*,
    (o.actor IS NOT NULL OR o.actor_role IS NOT NULL) AS has_actor,
    o.job_to_be_done IS NOT NULL AS has_job, o.context IS NOT NULL AS has_context,
    (o.current_workaround IS NOT NULL OR EXISTS (SELECT 1 FROM workarounds w WHERE w.observation_id = o.id)) AS has_workaround,
    (o.time_impact IS NOT NULL OR EXISTS (SELECT 1 FROM impact_signals i WHERE i.observation_id = o.id)) AS has_impact,
    EXISTS (SELECT 1 FROM impact_signals i WHERE i.observation_id = o.id AND i.quantified) AS has_quantified,
    (o.existing_spend IS NOT NULL OR o.paid_workaround IS NOT NULL OR EXISTS (SELECT 1 FROM payment_signals p WHERE p.observation_id = o.id)) AS has_payment,
    EXISTS (SELECT 1 FROM evidence_spans e WHERE e.observation_id = o.id) AS has_evidence,
    (SELECT count(*) FROM payment_signals p WHERE p.observation_id = o.id) AS payment_signals,
    (SELECT count(*) FROM impact_signals i WHERE i.observation_id = o.id AND i.quantified) AS quantified_signals
  FROM problem_observations o
), strong AS (
  SELECT f.*,
    (problem_type NOT IN ('TEMPORARY_INCIDENT','SUPPORT_QUESTION','USER_ERROR') AND has_actor AND has_job AND (has_context OR has_workaround)
     AND (has_quantified OR has_payment OR active_solution_search OR switching_intent)) AS strong_or_null,
    coalesce(problem_type NOT IN ('TEMPORARY_INCIDENT','SUPPORT_QUESTION','USER_ERROR') AND has_actor AND has_job AND (has_context OR has_workaround)
     AND (has_quantified OR has_payment OR coalesce(active_solution_search, FALSE) OR coalesce(switching_intent, FALSE)), FALSE) AS strong
  FROM flags f
), done AS (
  SELECT s.* FROM strong s LEFT JOIN pipeline_runs r ON r.id = s.pipeline_run_id WHERE s.pipeline_run_id IS NULL OR r.status = 'COMPLETED'
)"""
FLAG_TABLES = ("problem_observations", "workarounds", "impact_signals", "payment_signals", "evidence_spans", "pipeline_runs")


@registry.query(FLAG_TABLES + ("sources", "source_items"), FLAGS, """
SELECT s.name AS source, count(DISTINCT i.id) AS items, count(d.id) AS observations, count_if(d.strong_or_null) AS strong,
       CASE WHEN count(DISTINCT i.id) = 0 THEN NULL ELSE count_if(d.strong_or_null) * 1000.0::DOUBLE / count(DISTINCT i.id) END AS yield_per_1000
FROM sources s LEFT JOIN source_items i ON i.source_id = s.id LEFT JOIN done d ON d.source_item_id = i.id GROUP BY s.name""")
def source_strong_yield(d: Domain) -> DataFrame:
    """Items, observations, strong signals and yield by source."""
    done = signals.in_completed_runs(flagged(d), d.pipeline_runs).groupBy("source_item_id").agg(F.count("*").alias("n"), F.count_if("strong_or_null").alias("s"))
    rows = d.source_items.select("id", "source_id").join(done, F.col("id") == F.col("source_item_id"), "left")
    by_source = rows.groupBy("source_id").agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.coalesce(F.sum("s"), F.lit(0)).alias("strong"))
    out = d.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")).join(by_source, "source_id", "left").fillna(0, ["items", "observations", "strong"])
    return out.select("source", "items", "observations", "strong", metrics.per_thousand(F.col("strong"), F.col("items")).alias("yield_per_1000")).orderBy(F.desc("strong"), "source")


@registry.query(FLAG_TABLES, FLAGS, """
SELECT id, has_actor, has_workaround, has_impact, has_quantified, has_payment, has_evidence, strong, strong_or_null FROM strong""")
def strong_signal_flags(d: Domain) -> DataFrame:
    return flagged(d).select("id", "has_actor", "has_workaround", "has_impact", "has_quantified", "has_payment", "has_evidence", "strong", "strong_or_null")


@registry.query(("source_items", "acquisition_records"), "", """
SELECT DISTINCT i.id FROM source_items i JOIN acquisition_records a ON a.source_item_id = i.id WHERE a.completeness IN ('FULL','PARTIAL') AND length(i.raw_text) >= 40""")
def extraction_eligible(d: Domain) -> DataFrame:
    usable = d.acquisition_records.filter(F.col("completeness").isin("FULL", "PARTIAL")).select(F.col("source_item_id").alias("id"))
    return d.source_items.filter(F.length("raw_text") >= 40).join(usable, "id", "left_semi").select("id")


@registry.query(("source_items", "acquisition_records"), "", """
SELECT i.id FROM source_items i WHERE length(i.raw_text) >= 40 AND EXISTS (SELECT 1 FROM acquisition_records a WHERE a.source_item_id = i.id AND a.completeness = 'FULL')""")
def full_items(d: Domain) -> DataFrame:
    full = d.acquisition_records.filter("completeness = 'FULL'").select(F.col("source_item_id").alias("id"))
    return d.source_items.filter(F.length("raw_text") >= 40).join(full, "id", "left_semi").select("id")


@registry.query(("discovery_records", "acquisition_records"), "", """
SELECT r.id, r.canonical_url FROM discovery_records r WHERE NOT EXISTS (SELECT 1 FROM acquisition_records a WHERE a.discovery_id = r.id AND a.provider = 'archive')""")
def pending_discoveries(d: Domain) -> DataFrame:
    taken = d.acquisition_records.filter("provider = 'archive'").select(F.col("discovery_id").alias("id"))
    return d.discovery_records.join(taken, "id", "left_anti").select("id", "canonical_url")


@registry.query(("source_items", "acquisition_records"), "", """
SELECT i.id, i.external_id FROM source_items i
WHERE i.id IN (SELECT source_item_id FROM acquisition_records WHERE completeness = 'FULL')
  AND lower(i.external_id) NOT IN (SELECT 'doc:' || CAST(item_id * 3 AS VARCHAR) FROM benchmark)""")
def unseen_items(d: Domain) -> DataFrame:
    """Fully acquired items that are not in a baseline list of external ids."""
    baseline = d.benchmark.select(F.concat(F.lit("doc:"), (F.col("item_id") * 3).cast("string")).alias("seen"))
    full = d.acquisition_records.filter("completeness = 'FULL'").select(F.col("source_item_id").alias("id"))
    return d.source_items.join(full, "id", "left_semi").join(baseline, F.lower("external_id") == F.col("seen"), "left_anti").select("id", "external_id")


FINGERPRINT = r"""
norm AS (
  SELECT id, pipeline_run_id,
    nullif(trim(regexp_replace(replace(lower(actor), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')), '') AS a,
    nullif(trim(regexp_replace(replace(lower(context), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')), '') AS c,
    nullif(trim(regexp_replace(replace(lower(job_to_be_done), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')), '') AS j,
    nullif(trim(regexp_replace(replace(lower(problem), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')), '') AS p,
    nullif(trim(regexp_replace(replace(lower(root_cause), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')), '') AS rc
  FROM problem_observations
), prints AS (
  SELECT n.id AS observation_id, sha256('{"actor":' || coalesce('"' || a || '"', 'null') || ',"context":' || coalesce('"' || c || '"', 'null') || ',"job_to_be_done":' || coalesce('"' || j || '"', 'null')
         || ',"problem":' || coalesce('"' || p || '"', 'null') || ',"root_cause":' || coalesce('"' || rc || '"', 'null') || '}') AS fingerprint
  FROM norm n LEFT JOIN pipeline_runs r ON r.id = n.pipeline_run_id WHERE n.pipeline_run_id IS NULL OR r.status IN ('COMPLETED', 'FAILED')
)"""


@registry.query(("problem_observations", "pipeline_runs"), FINGERPRINT, """
SELECT min(observation_id) OVER (PARTITION BY fingerprint) AS cluster_id, fingerprint, observation_id FROM prints""")
def exact_clusters(d: Domain) -> DataFrame:
    """Clusters of equal fingerprints over observations of completed or failed runs."""
    return signals.exact_clusters(signals.clusterable(d.problem_observations, d.pipeline_runs))


@registry.query(("problem_observations", "pipeline_runs"), FINGERPRINT, """
SELECT min(observation_id) AS cluster_id, fingerprint, count(*) AS observations FROM prints GROUP BY fingerprint HAVING count(*) > 1""")
def duplicate_clusters(d: Domain) -> DataFrame:
    rows = signals.exact_clusters(signals.clusterable(d.problem_observations, d.pipeline_runs))
    return rows.groupBy("cluster_id", "fingerprint").agg(F.count("*").alias("observations")).filter("observations > 1")


CANDIDATES = FLAGS + """, rows AS (
  SELECT m.cluster_id, s.*, i.source_id, coalesce(s.country_code, i.country_code) AS country,
    coalesce(active_solution_search, FALSE) AS active, coalesce(switching_intent, FALSE) AS switching,
    CAST(coalesce(active_solution_search, FALSE) AS INT) + CAST(coalesce(switching_intent, FALSE) AS INT) + CAST(has_payment AS INT) + CAST(has_quantified AS INT) + CAST(has_workaround AS INT) + CAST(has_impact AS INT) + CAST(has_context AS INT) AS dims,
    CAST(has_actor AS INT) + CAST(has_job AS INT) + CAST(has_context AS INT) + CAST(has_evidence AS INT) AS complete
  FROM cluster_members m JOIN done s ON s.id = m.observation_id JOIN source_items i ON i.id = s.source_item_id
), ranked AS (
  SELECT r.*, row_number() OVER (PARTITION BY cluster_id ORDER BY dims DESC, created_at DESC, id) AS rep,
         row_number() OVER (PARTITION BY cluster_id ORDER BY complete DESC, dims DESC, created_at DESC, id) AS comp FROM rows r
), agg AS (
  SELECT cluster_id, max(CASE WHEN rep = 1 THEN problem END) AS representative_problem,
    CASE WHEN count(DISTINCT problem_family) = 1 THEN max(problem_family) END AS problem_family,
    count(*) AS observation_count, count(DISTINCT source_id) AS source_count, count(DISTINCT source_item_id) AS item_count, count(DISTINCT country) AS country_count,
    count_if(evidence_scope = 'GLOBAL') AS global_observation_count, count_if(evidence_scope = 'DACH') AS dach_observation_count,
    count_if(active) AS active_search_count, count_if(switching) AS switching_intent_count, count_if(has_quantified) AS quantified_impact_count,
    count_if(has_payment) AS payment_evidence_count, count_if(has_workaround) AS workaround_count, count_if(strong) AS strong_signal_count,
    bool_and(problem_type IN ('TEMPORARY_INCIDENT','SUPPORT_QUESTION','USER_ERROR')) AS excluded,
    concat_ws(',', max(CASE WHEN comp = 1 AND NOT has_actor THEN 'actor' END), max(CASE WHEN comp = 1 AND NOT has_job THEN 'job_to_be_done' END),
              max(CASE WHEN comp = 1 AND NOT has_context THEN 'context' END), max(CASE WHEN comp = 1 AND NOT has_evidence THEN 'exact_evidence_span' END)) AS missing_for_completion,
    max(created_at) AS latest_observation_at
  FROM ranked GROUP BY cluster_id
), stated AS (
  SELECT a.*, (SELECT min(c.id) FROM research_cases c WHERE c.cluster_id = a.cluster_id) AS existing_case_id,
    CASE WHEN global_observation_count > 0 AND dach_observation_count > 0 THEN 'CROSS_MARKET' WHEN source_count >= 2 THEN 'MULTI_SOURCE' WHEN item_count >= 3 THEN 'RECURRING' WHEN item_count >= 2 THEN 'EMERGING' ELSE 'SINGLE_SIGNAL' END AS evidence_state,
    NOT excluded AND (item_count >= 2 OR strong_signal_count > 0) AS research_ready FROM agg a
)"""
CANDIDATE_TABLES = FLAG_TABLES + ("source_items", "cluster_members", "research_cases")
#: What each sort looks at first, all descending.
CANDIDATE_ORDER = {
    "strongest-evidence": "research_ready, strength, payment_evidence_count, quantified_impact_count, active_search_count + switching_intent_count, workaround_count, strong_signal_count, observation_count, latest_observation_at, cluster_id",
    "newest": "latest_observation_at, research_ready, strength, observation_count, cluster_id",
    "active-search": "active_search_count + switching_intent_count, research_ready, strength, observation_count, cluster_id",
    "payment-evidence": "payment_evidence_count, research_ready, strength, observation_count, cluster_id",
    "manual-workarounds": "workaround_count, research_ready, strength, observation_count, cluster_id",
    "dach-evidence": "dach_observation_count, research_ready, strength, observation_count, cluster_id",
}
CANDIDATE_SQL = """
SELECT {position} AS position, cluster_id, representative_problem, problem_family, evidence_state, observation_count, source_count, item_count, country_count, global_observation_count, dach_observation_count,
  active_search_count, switching_intent_count, quantified_impact_count, payment_evidence_count, workaround_count, strong_signal_count, research_ready,
  CASE WHEN excluded THEN 'cluster contains only incidents, support questions, or user errors' WHEN NOT research_ready THEN 'no recurrence or strong individual signal established' END AS exclusion_reason,
  missing_for_completion, latest_observation_at, existing_case_id,
  concat_ws('; ', CASE WHEN evidence_state = 'CROSS_MARKET' THEN 'global and DACH evidence are both present' END,
    CASE WHEN source_count >= 2 THEN 'confirmed across ' || source_count || ' sources' END, CASE WHEN item_count >= 2 THEN 'observed in ' || item_count || ' source items' END,
    CASE WHEN strong_signal_count > 0 THEN strong_signal_count || ' strong individual signal(s)' END, CASE WHEN active_search_count > 0 THEN active_search_count || ' active solution search signal(s)' END,
    CASE WHEN switching_intent_count > 0 THEN switching_intent_count || ' switching intent signal(s)' END, CASE WHEN quantified_impact_count > 0 THEN quantified_impact_count || ' quantified impact signal(s)' END,
    CASE WHEN payment_evidence_count > 0 THEN payment_evidence_count || ' payment evidence signal(s)' END, CASE WHEN workaround_count > 0 THEN workaround_count || ' documented workaround(s)' END,
    CASE WHEN missing_for_completion = '' THEN 'minimum problem evidence is complete' END) AS reasons
FROM (SELECT *, CASE evidence_state WHEN 'CROSS_MARKET' THEN 5 WHEN 'MULTI_SOURCE' THEN 4 WHEN 'RECURRING' THEN 3 WHEN 'EMERGING' THEN 2 ELSE 1 END AS strength FROM stated WHERE existing_case_id IS NULL) s"""


def candidate_sql(sort_by: str) -> str:
    keys = ", ".join(f"{k} DESC" for k in CANDIDATE_ORDER[sort_by].split(", "))
    return CANDIDATE_SQL.replace("{position}", f"CAST(row_number() OVER (ORDER BY {keys}) AS INT)")


def case_candidates(d: Domain, sort_by: str = "strongest-evidence") -> DataFrame:
    """Clusters without a case, rolled up and ordered by one dimension."""
    done = signals.in_completed_runs(flagged(d), d.pipeline_runs)
    return candidates.ordered(candidates.roll_up(d.cluster_members, done, d.source_items, d.research_cases), sort_by)


for _sort in candidates.SORTS:
    registry.add(f"case_candidates_{_sort.replace('-', '_')}", lambda d, s=_sort: case_candidates(d, s), CANDIDATE_TABLES, CANDIDATES, candidate_sql(_sort))


@registry.query(("research_cases", "cluster_members", "problem_observations", "evidence_spans", "source_items"), "", """
SELECT c.id AS case_id, CASE WHEN bool_or(e.evidence_scope = 'GLOBAL') AND bool_or(e.evidence_scope = 'DACH') THEN 'CROSS_MARKET' WHEN count(DISTINCT i.source_id) >= 2 THEN 'MULTI_SOURCE'
  WHEN count(DISTINCT o.source_item_id) >= 3 THEN 'RECURRING' WHEN count(DISTINCT o.source_item_id) >= 2 THEN 'EMERGING' ELSE 'SINGLE_SIGNAL' END AS evidence_state
FROM research_cases c JOIN cluster_members m ON m.cluster_id = c.cluster_id JOIN problem_observations o ON o.id = m.observation_id JOIN evidence_spans e ON e.observation_id = o.id
JOIN source_items i ON i.id = o.source_item_id GROUP BY c.id""")
def case_evidence_state(d: Domain) -> DataFrame:
    """Evidence state of each case from the scopes of its spans, whatever the run."""
    spans = d.evidence_spans.groupBy("observation_id").agg(F.bool_or(F.col("evidence_scope") == "GLOBAL").alias("g"), F.bool_or(F.col("evidence_scope") == "DACH").alias("h"))
    own = d.problem_observations.select(F.col("id").alias("observation_id"), "source_item_id").join(spans, "observation_id")
    rows = d.research_cases.select(F.col("id").alias("case_id"), "cluster_id").join(d.cluster_members, "cluster_id").join(own, "observation_id").join(d.source_items.select(F.col("id").alias("source_item_id"), "source_id"), "source_item_id")
    state = evidence_state(F.bool_or("g"), F.bool_or("h"), F.count_distinct("source_id"), F.count_distinct("source_item_id"))
    return rows.groupBy("case_id").agg(state.alias("evidence_state"))


SNAPSHOT_TABLES = FLAG_TABLES + ("sources", "source_items", "cluster_members", "discovery_runs", "discovery_records", "acquisition_records", "source_registry_profiles")
SNAPSHOT = FLAGS + """, own AS (SELECT d.*, i.source_id FROM done d JOIN source_items i ON i.id = d.source_item_id
), pairs AS (SELECT DISTINCT m.cluster_id, i.source_id FROM cluster_members m JOIN problem_observations o ON o.id = m.observation_id JOIN source_items i ON i.id = o.source_item_id
), taken AS (SELECT a.*, r.source_id FROM acquisition_records a JOIN discovery_records r ON r.id = a.discovery_id
), raw AS (
  SELECT s.id AS source_id, s.name AS source_name, s.lifecycle, s.commercial_use_status,
    (SELECT count(*) FROM source_items i WHERE i.source_id = s.id) AS item_count,
    (SELECT count(DISTINCT canonical_url) FROM discovery_records r WHERE r.source_id = s.id) AS uniq,
    EXISTS (SELECT 1 FROM discovery_records r WHERE r.source_id = s.id) AS found,
    (SELECT coalesce(sum(urls_discovered), 0) FROM discovery_runs r WHERE r.source_id = s.id) AS total,
    least((SELECT min(discovered_at) FROM discovery_records r WHERE r.source_id = s.id), (SELECT min(first_seen_at) FROM source_items i WHERE i.source_id = s.id)) AS measurement_start,
    greatest((SELECT max(discovered_at) FROM discovery_records r WHERE r.source_id = s.id), (SELECT max(last_seen_at) FROM source_items i WHERE i.source_id = s.id)) AS measurement_end,
    (SELECT count(DISTINCT t.source_item_id) FROM taken t JOIN source_items i ON i.id = t.source_item_id WHERE t.source_id = s.id AND t.completeness IN ('FULL','PARTIAL') AND length(i.raw_text) >= 40) AS prefilter,
    (SELECT count(*) FROM own o WHERE o.source_id = s.id) AS pain_observations,
    (SELECT count_if(strong_or_null) FROM own o WHERE o.source_id = s.id) AS strong_single_signals,
    (SELECT count_if(active_solution_search) FROM own o WHERE o.source_id = s.id) AS active_search_signals,
    (SELECT coalesce(sum(quantified_signals), 0) FROM own o WHERE o.source_id = s.id) AS quantified_impact_signals,
    (SELECT coalesce(sum(payment_signals), 0) FROM own o WHERE o.source_id = s.id) AS payment_signals,
    (SELECT count(*) FROM pairs p WHERE p.source_id = s.id) AS problem_clusters_contributed,
    (SELECT count(*) FROM pairs p WHERE p.source_id = s.id AND p.cluster_id IN (SELECT cluster_id FROM pairs GROUP BY cluster_id HAVING count(*) > 1)) AS cross_source_confirmations,
    (SELECT count_if(problem_type = 'TEMPORARY_INCIDENT') FROM own o WHERE o.source_id = s.id) AS temporary_incidents,
    (SELECT count_if(problem_type = 'SUPPORT_QUESTION') FROM own o WHERE o.source_id = s.id) AS support_questions,
    (SELECT coalesce(sum(cost_usd), 0) FROM discovery_runs r WHERE r.source_id = s.id) + (SELECT coalesce(sum(cost_usd), 0) FROM taken t WHERE t.source_id = s.id) AS cost,
    (SELECT count(*) FROM discovery_runs r WHERE r.source_id = s.id) + (SELECT count(*) FROM taken t WHERE t.source_id = s.id) AS ops,
    (SELECT count_if(cost_usd IS NULL) FROM discovery_runs r WHERE r.source_id = s.id) + (SELECT count_if(cost_usd IS NULL) FROM taken t WHERE t.source_id = s.id) AS unknown
  FROM sources s
), snap AS (
  SELECT source_id, source_name, lifecycle, commercial_use_status, measurement_start, measurement_end,
    CAST(CASE WHEN found THEN uniq ELSE item_count END AS BIGINT) AS items_scanned, CASE WHEN found THEN prefilter END AS items_after_prefilter,
    pain_observations, CAST(strong_single_signals AS BIGINT) AS strong_single_signals, CAST(active_search_signals AS BIGINT) AS active_search_signals, CAST(quantified_impact_signals AS BIGINT) AS quantified_impact_signals,
    CAST(payment_signals AS BIGINT) AS payment_signals, problem_clusters_contributed, cross_source_confirmations, CAST(CASE WHEN found THEN greatest(0, total - uniq) END AS BIGINT) AS duplicate_items,
    CAST(temporary_incidents AS BIGINT) AS temporary_incidents, CAST(support_questions AS BIGINT) AS support_questions,
    CASE WHEN ops > 0 AND unknown = 0 THEN CAST(cost AS DOUBLE) END AS known_processing_cost_usd, (ops > 0 AND unknown = 0) AS processing_cost_complete
  FROM raw
), yields AS (
  SELECT *, CASE WHEN items_scanned > 0 THEN strong_single_signals * 1000.0::DOUBLE / items_scanned END AS strong_yield, CASE WHEN items_scanned > 0 THEN payment_signals * 1000.0::DOUBLE / items_scanned END AS payment_yield,
    CASE WHEN items_scanned > 0 THEN active_search_signals * 1000.0::DOUBLE / items_scanned END AS active_search_yield, CASE WHEN items_scanned > 0 THEN problem_clusters_contributed * 1000.0::DOUBLE / items_scanned END AS cluster_yield,
    CASE WHEN items_scanned > 0 THEN cross_source_confirmations * 1000.0::DOUBLE / items_scanned END AS cross_source_yield,
    CASE WHEN processing_cost_complete AND strong_single_signals > 0 THEN known_processing_cost_usd / strong_single_signals END AS cost_per_strong_signal,
    coalesce(upper(replace(trim(commercial_use_status), '-', '_')) = 'APPROVED' OR starts_with(upper(replace(trim(commercial_use_status), '-', '_')), 'APPROVED_'), FALSE) AS production_ready
  FROM snap
)"""


def snapshot(d: Domain) -> DataFrame:
    done = signals.in_completed_runs(flagged(d), d.pipeline_runs)
    return metrics.snapshot(d.sources, d.source_items, done, d.problem_observations, d.cluster_members, d.discovery_runs, d.discovery_records, d.acquisition_records)


registry.add("source_metric_snapshot", snapshot, SNAPSHOT_TABLES, SNAPSHOT, "SELECT * FROM snap")

_PERFORMANCE = ("source_id", "source_name", "items_scanned", "strong_yield", "payment_yield", "active_search_yield", "cluster_yield", "cross_source_yield", "cost_per_strong_signal", "measurement_end", "production_ready", "position")
_ORDER = {
    "strong-signal-yield": "coalesce(strong_yield, 0) DESC", "payment-yield": "coalesce(payment_yield, 0) DESC", "active-search-yield": "coalesce(active_search_yield, 0) DESC", "cluster-yield": "coalesce(cluster_yield, 0) DESC",
    "cross-source-yield": "coalesce(cross_source_yield, 0) DESC", "cost-per-strong-signal": "cost_per_strong_signal ASC NULLS LAST", "newest-evidence": "coalesce(measurement_end, '') DESC",
}
for _sort, _by in _ORDER.items():
    registry.add(
        f"source_performance_{_sort.replace('-', '_')}", lambda d, s=_sort: metrics.ranked(snapshot(d), s).select(*_PERFORMANCE), SNAPSHOT_TABLES, SNAPSHOT,
        f"SELECT {', '.join(_PERFORMANCE[:-1])}, CAST(row_number() OVER (ORDER BY {_by}, lower(source_name), source_id) AS INT) AS position FROM yields",
    )


@registry.query(FLAG_TABLES + ("source_items", "cluster_members"), FLAGS, """
SELECT i.source_id, d.problem_family, count(*) AS observation_count, count_if(d.strong_or_null) AS strong_signal_count, count_if(d.active_solution_search) AS active_search_count,
  CAST(sum(d.payment_signals) AS BIGINT) AS payment_signal_count, count(DISTINCT m.cluster_id) AS cluster_count, min(i.first_seen_at) AS first_seen, max(i.last_seen_at) AS last_seen
FROM done d JOIN source_items i ON i.id = d.source_item_id LEFT JOIN cluster_members m ON m.observation_id = d.id WHERE d.problem_family IS NOT NULL GROUP BY i.source_id, d.problem_family""")
def family_metrics(d: Domain) -> DataFrame:
    return metrics.families(d.source_items, signals.in_completed_runs(flagged(d), d.pipeline_runs), d.payment_signals, d.cluster_members)


@registry.query(SNAPSHOT_TABLES, SNAPSHOT, """
, best AS (SELECT *, row_number() OVER (ORDER BY strong_yield DESC, lower(source_name), source_id) AS p FROM yields
  WHERE lifecycle IN ('CORE','EXPLORATION') AND production_ready AND items_scanned >= 5 AND strong_yield IS NOT NULL
), perf AS (SELECT source_id, source_name, 'PERFORMANCE' AS lane, CAST(greatest(0, least(40, 60 - (p - 1) * 40)) AS BIGINT) AS allocated_items, CAST(40 AS BIGINT) AS per_source_cap, strong_yield AS rank_value FROM best
), rest AS (SELECT y.*, least(40, CASE WHEN r.strict_pilot_posts IS NOT NULL THEN r.strict_pilot_posts ELSE coalesce(r.pilot_posts, 40) END) AS cap FROM yields y LEFT JOIN source_registry_profiles r ON r.source_id = y.source_id
  WHERE y.source_id NOT IN (SELECT source_id FROM best) AND lifecycle IN ('CANDIDATE','EXPLORATION') AND production_ready
), lane AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY items_scanned, lower(source_name), source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rest WHERE cap > 0
), expl AS (SELECT source_id, source_name, 'EXPLORATION' AS lane, CAST(greatest(0, least(cap, 50 - before)) AS BIGINT) AS allocated_items, CAST(cap AS BIGINT) AS per_source_cap, CAST(items_scanned AS DOUBLE) AS rank_value FROM lane)
SELECT * FROM perf WHERE allocated_items > 0 UNION ALL SELECT * FROM expl WHERE allocated_items > 0""")
def budget_plan(d: Domain) -> DataFrame:
    return metrics.budget_plan(snapshot(d), d.source_registry_profiles, total=110, exploration=50, per_source_cap=40, minimum_items=5)


@registry.query(("discovery_runs", "acquisition_records"), "", """
SELECT provider, count(*) AS search_requests, count_if(availability = 'RESULTS') AS with_results, count_if(availability = 'NO_RESULTS') AS without_results, count_if(availability = 'SOURCE_UNAVAILABLE') AS unavailable,
  count(latency_ms) AS known_latency, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, count(cost_usd) AS known_cost, sum(cost_usd) AS cost_usd,
  (SELECT count(*) FROM acquisition_records a WHERE a.provider = r.provider) AS attempts, (SELECT count_if(a.state = 'CONTENT_COMPLETE') FROM acquisition_records a WHERE a.provider = r.provider) AS complete,
  (SELECT count_if(a.state = 'CONTENT_COMPLETE') * 1.0::DOUBLE / count(*) FROM acquisition_records a WHERE a.provider = r.provider) AS complete_rate
FROM discovery_runs r GROUP BY provider""")
def provider_report(d: Domain) -> DataFrame:
    """Search and acquisition roles of each provider; sums of what is known."""
    by = lambda v: F.count_if(F.col("availability") == v)
    search = d.discovery_runs.groupBy("provider").agg(
        F.count("*").alias("search_requests"), by("RESULTS").alias("with_results"), by("NO_RESULTS").alias("without_results"), by("SOURCE_UNAVAILABLE").alias("unavailable"),
        F.count("latency_ms").alias("known_latency"), F.sum("latency_ms").alias("latency_ms"), F.count("cost_usd").alias("known_cost"), F.sum("cost_usd").alias("cost_usd"),
    )
    taken = d.acquisition_records.groupBy("provider").agg(F.count("*").alias("attempts"), F.count_if(F.col("state") == "CONTENT_COMPLETE").alias("complete"))
    out = search.join(taken, "provider", "left")
    return out.select(*search.columns, F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("complete", F.lit(0)).alias("complete"), F.try_divide(F.col("complete").cast("double"), F.col("attempts")).alias("complete_rate"))


@registry.query(FLAG_TABLES + ("sources", "source_items", "discovery_runs", "discovery_records"), FLAGS, """
SELECT s.name AS community, (SELECT count_if(availability = 'RESULTS') FROM discovery_runs r WHERE r.source_id = s.id) AS results, (SELECT count_if(availability = 'NO_RESULTS') FROM discovery_runs r WHERE r.source_id = s.id) AS no_results,
  (SELECT count_if(availability = 'SOURCE_UNAVAILABLE') FROM discovery_runs r WHERE r.source_id = s.id) AS source_unavailable,
  (SELECT CAST(coalesce(sum(urls_discovered), 0) AS BIGINT) FROM discovery_runs r WHERE r.source_id = s.id) - (SELECT count(DISTINCT canonical_url) FROM discovery_records r WHERE r.source_id = s.id) AS duplicates,
  (SELECT count(*) FROM source_items i WHERE i.source_id = s.id) AS items,
  (SELECT count(*) FROM done o JOIN source_items i ON i.id = o.source_item_id WHERE i.source_id = s.id) AS observations,
  (SELECT count(*) FROM strong o JOIN source_items i ON i.id = o.source_item_id WHERE i.source_id = s.id) AS observations_of_any_run,
  coalesce((SELECT count(*) FROM done o JOIN source_items i ON i.id = o.source_item_id WHERE i.source_id = s.id) * 1000.0::DOUBLE / nullif((SELECT count(*) FROM source_items i WHERE i.source_id = s.id), 0), 0.0) AS per_thousand
FROM sources s""")
def community_report(d: Domain) -> DataFrame:
    """Availability, duplicates and observations of each community; a rate of nothing is 0 here."""
    kinds = ["RESULTS", "NO_RESULTS", "SOURCE_UNAVAILABLE"]
    found = d.discovery_runs.groupBy("source_id").pivot("availability", kinds).agg(F.count(F.lit(1))).withColumnsRenamed({k: k.lower() for k in kinds})
    total = d.discovery_runs.groupBy("source_id").agg(F.sum("urls_discovered").alias("total"))
    unique = d.discovery_records.groupBy("source_id").agg(F.count_distinct("canonical_url").alias("uniq"))
    items = d.source_items.groupBy("source_id").agg(F.count("*").alias("items"))
    source_of = d.source_items.select(F.col("id").alias("source_item_id"), "source_id")
    every = d.problem_observations.join(source_of, "source_item_id").groupBy("source_id").agg(F.count("*").alias("observations_of_any_run"))
    done = signals.in_completed_runs(d.problem_observations, d.pipeline_runs).join(source_of, "source_item_id").groupBy("source_id").agg(F.count("*").alias("observations"))
    out = d.sources.select(F.col("id").alias("source_id"), F.col("name").alias("community"))
    for side in (found, total, unique, items, every, done):
        out = out.join(side, "source_id", "left")
    out = out.fillna(0)
    rate = F.coalesce(F.try_divide(F.col("observations") * F.lit(1000.0), F.col("items")), F.lit(0.0))
    return out.select("community", *(k.lower() for k in kinds), (F.col("total") - F.col("uniq")).alias("duplicates"), "items", "observations", "observations_of_any_run", rate.alias("per_thousand"))


#: A total of millionths shared out among n, rounded half up to 12 places, without trailing zeros.
PER_ITEM = "regexp_replace(regexp_replace(CAST({n_} // 1000000000000 AS VARCHAR) || '.' || lpad(CAST({n_} % 1000000000000 AS VARCHAR), 12, '0'), '0+$', ''), '\\.$', '')".replace("{n_}", "((CAST({t} * 1000000 AS HUGEINT) * 2000000 + {n}) // (2 * {n}))")


@registry.query(("discovery_runs", "acquisition_records"), "", f"""
SELECT operation_count, discovery_run_count, acquisition_attempt_count, costed_operation_count, operation_count - costed_operation_count AS missing_cost_operation_count, acquired_source_items,
  regexp_replace(regexp_replace(CAST(known AS VARCHAR), '0+$', ''), '\\.$', '') AS known_cost_usd,
  CASE WHEN operation_count > 0 AND operation_count = costed_operation_count AND acquired_source_items > 0 THEN {PER_ITEM.format(t="known", n="acquired_source_items")} END AS cost_per_item_usd,
  concat_ws('; ', CASE WHEN operation_count = 0 THEN 'no operations recorded' END, CASE WHEN operation_count - costed_operation_count = 1 THEN '1 operation has unknown cost' WHEN operation_count > costed_operation_count THEN (operation_count - costed_operation_count) || ' operations have unknown cost' END,
    CASE WHEN acquired_source_items = 0 THEN 'no acquired source items recorded' END) AS unit_cost_reasons
FROM (SELECT count(*) AS operation_count, CAST(sum(d) AS BIGINT) AS discovery_run_count, CAST(sum(1 - d) AS BIGINT) AS acquisition_attempt_count, count(cost_usd) AS costed_operation_count, sum(CAST(cost_usd AS DECIMAL(18,6))) AS known,
      (SELECT count(DISTINCT source_item_id) FROM acquisition_records) AS acquired_source_items
      FROM (SELECT cost_usd, 1 AS d FROM discovery_runs UNION ALL SELECT cost_usd, 0 FROM acquisition_records) u) t""")
def acquisition_cost(d: Domain) -> DataFrame:
    return cost.acquisition_cost(d.discovery_runs, d.acquisition_records)


MONEY_TEXT = "CASE WHEN {0} IS NULL THEN NULL ELSE regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '0+$', ''), '\\.$', '') END"


@registry.query(("model_runs",), "", f"""
SELECT provider, CAST(sum(n) AS BIGINT) AS run_count, CAST(sum(done) AS BIGINT) AS completed_run_count, CAST(sum(n) - sum(done) AS BIGINT) AS failed_run_count, CAST(sum(costed) AS BIGINT) AS costed_run_count, CAST(sum(linked) AS BIGINT) AS pipeline_linked_run_count,
  CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(l) AS BIGINT) AS latency_ms, CAST(sum(p) AS BIGINT) AS items_processed,
  string_agg(currency || '=' || {MONEY_TEXT.format("a")}, ',' ORDER BY currency) AS known_cost_by_currency,
  concat_ws('; ', CASE WHEN sum(n) - sum(linked) = 1 THEN '1 model run lacks a pipeline_run_id' WHEN sum(n) > sum(linked) THEN CAST(sum(n) - sum(linked) AS BIGINT) || ' model runs lack a pipeline_run_id' END,
    CASE WHEN sum(n) - sum(costed) = 1 THEN '1 operation has unknown cost' WHEN sum(n) > sum(costed) THEN CAST(sum(n) - sum(costed) AS BIGINT) || ' operations have unknown cost' END,
    CASE WHEN count(currency) > 1 THEN 'measured costs use multiple currencies' END, CASE WHEN sum(p) = 0 THEN 'no processed items recorded' END) AS unit_cost_reasons
FROM (SELECT provider, currency, count(*) AS n, count_if(status = 'COMPLETED') AS done, count(amount) AS costed, count(pipeline_run_id) AS linked, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(latency_ms) AS l, sum(items_processed) AS p,
      sum(CAST(amount AS DECIMAL(18,6))) AS a FROM model_runs GROUP BY provider, currency) t GROUP BY provider""")
def model_cost(d: Domain) -> DataFrame:
    return cost.model_cost(d.model_runs)


@registry.query(("model_runs",), "", f"""
SELECT provider, items_processed AS size, CASE WHEN why = '' THEN 'AVAILABLE' ELSE 'UNKNOWN' END AS status, {MONEY_TEXT.format("total")} AS total, items, CASE WHEN why = '' THEN {PER_ITEM.format(t="total", n="items")} END AS cost_per_item, why AS reasons
FROM (SELECT *, concat_ws('; ', CASE WHEN n - costed = 1 THEN '1 operation has unknown cost' WHEN n > costed THEN (n - costed) || ' operations have unknown cost' END, CASE WHEN currencies > 1 THEN 'measured costs use multiple currencies' END, CASE WHEN items = 0 THEN 'no processed items recorded' END) AS why
  FROM (SELECT provider, items_processed, count(*) AS n, count(amount) AS costed, count(DISTINCT CASE WHEN amount IS NOT NULL THEN currency END) AS currencies, coalesce(sum(CAST(amount AS DECIMAL(18,6))), 0) AS total, CAST(sum(items_processed) AS BIGINT) AS items
    FROM model_runs WHERE coalesce(currency, 'EUR') = 'EUR' GROUP BY provider, items_processed) g) t""")
def unit_costs(d: Domain) -> DataFrame:
    """Cost per item of the runs in one currency, or of unknown cost, by provider and size."""
    rows = d.model_runs.filter(F.coalesce("currency", F.lit("EUR")) == "EUR").withColumn("size", F.col("items_processed"))
    return cost.unit_costs(rows, ("provider", "size"))


@registry.query(("model_runs",), "", f"""
SELECT provider, items_processed AS size, CASE WHEN why = '' THEN 'AVAILABLE' ELSE 'UNKNOWN' END AS status, {MONEY_TEXT.format("total")} AS total, items, CASE WHEN why = '' THEN {PER_ITEM.format(t="total", n="items")} END AS cost_per_item, why AS reasons
FROM (SELECT *, concat_ws('; ', CASE WHEN n - costed = 1 THEN '1 operation has unknown cost' WHEN n > costed THEN (n - costed) || ' operations have unknown cost' END, CASE WHEN currencies > 1 THEN 'measured costs use multiple currencies' END, CASE WHEN items = 0 THEN 'no processed items recorded' END) AS why
  FROM (SELECT provider, items_processed, count(*) AS n, count(amount) AS costed, count(DISTINCT CASE WHEN amount IS NOT NULL THEN currency END) AS currencies, coalesce(sum(CAST(amount AS DECIMAL(18,6))), 0) AS total, CAST(sum(items_processed) AS BIGINT) AS items FROM model_runs GROUP BY provider, items_processed) g) t""")
def unit_costs_all(d: Domain) -> DataFrame:
    """Cost per item of all runs by provider and size; groups of several currencies have none."""
    return cost.unit_costs(d.model_runs.withColumn("size", F.col("items_processed")), ("provider", "size"))


@registry.query(FLAG_TABLES + ("model_runs", "research_cases", "cluster_members"), FLAGS, """
, linked AS (SELECT DISTINCT provider, pipeline_run_id AS run FROM model_runs WHERE pipeline_run_id IS NOT NULL)
SELECT p.provider, (SELECT count(*) FROM linked l WHERE l.provider = p.provider) AS linked_runs,
  (SELECT count(*) FROM strong s JOIN linked l ON l.run = s.pipeline_run_id JOIN pipeline_runs r ON r.id = l.run WHERE l.provider = p.provider AND r.status = 'COMPLETED' AND s.strong_or_null) AS strong_signals,
  (SELECT count(DISTINCT c.id) FROM research_cases c JOIN cluster_members m ON m.cluster_id = c.cluster_id JOIN problem_observations o ON o.id = m.observation_id JOIN linked l ON l.run = o.pipeline_run_id WHERE l.provider = p.provider AND c.status = 'COMPLETE') AS complete_cases
FROM (SELECT DISTINCT provider FROM model_runs) p""")
def linked_outputs(d: Domain) -> DataFrame:
    """Strong signals and complete cases of the pipeline runs of each provider's model runs."""
    return cost.linked_outputs(d.model_runs, flagged(d), d.pipeline_runs, d.research_cases, d.cluster_members)


@registry.query(("model_runs",), "", """
SELECT provider, CAST(CAST(sum(input_tokens * 25 + output_tokens * 100) AS BIGINT) AS DECIMAL(38, 2)) / 10000000 AS price_usd FROM model_runs GROUP BY provider""")
def token_prices(d: Domain) -> DataFrame:
    """Price of all calls of a provider at 2.5 and 10 a million tokens."""
    price = cost.token_price(F.col("input_tokens"), F.col("output_tokens"), "2.5", "10")
    return d.model_runs.groupBy("provider").agg(F.sum(price).cast("double").alias("price_usd"))


@registry.query(("sources", "source_registry_profiles"), "", """
SELECT p.source_id, s.name, p.primary_industry, p.curation_priority, coalesce(p.strict_pilot_posts, p.pilot_posts) AS pilot_posts, coalesce(s.commercial_use_status = 'APPROVED', FALSE) AS production_ready,
  CAST(row_number() OVER (ORDER BY CASE p.curation_priority WHEN 'S' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'R' THEN 4 WHEN 'X' THEN 5 ELSE 6 END, p.primary_industry NULLS FIRST, lower(s.name), s.id) AS INT) AS position
FROM source_registry_profiles p JOIN sources s ON s.id = p.source_id WHERE p.scan_now AND s.lifecycle <> 'EXCLUDED'""")
def scan_plan(d: Domain) -> DataFrame:
    return planning.scan_plan(d.sources, d.source_registry_profiles)


PILOT = """plan AS (
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN p.strict_relevance = 'CORE' THEN 0 ELSE 1 END, CASE WHEN p.recommended_action IN ('SCAN_PILOT_NOW','SCAN_SMALL_PILOT') THEN 0 ELSE 1 END, lower(coalesce(p.primary_industry, '')), lower(s.name), s.id) AS INT) AS ordering,
  s.id AS source_id, s.name AS source_name, p.primary_industry AS category, p.strict_relevance, coalesce(p.recommended_action IN ('SCAN_PILOT_NOW','SCAN_SMALL_PILOT'), FALSE) AS ready,
  CAST(coalesce(p.strict_pilot_posts, p.pilot_posts, CASE WHEN p.strict_relevance = 'CORE' THEN 50 ELSE 25 END) AS BIGINT) AS pilot_size,
  coalesce(p.recommended_action IN ('SCAN_PILOT_NOW','SCAN_SMALL_PILOT'), FALSE) AND coalesce(coalesce(p.strict_pilot_posts, p.pilot_posts) = 0, FALSE) AS conflict
FROM source_registry_profiles p JOIN sources s ON s.id = p.source_id WHERE p.strict_relevance IN ('CORE','PILOT') AND s.lifecycle <> 'EXCLUDED')"""


@registry.query(("sources", "source_registry_profiles"), PILOT, "SELECT * FROM plan")
def pilot_plan(d: Domain) -> DataFrame:
    plan = planning.pilot_plan(d.sources, d.source_registry_profiles)
    return plan.withColumn("conflict", F.coalesce("conflict", F.lit(False)))


@registry.query(("sources", "source_registry_profiles"), PILOT, """
, turns AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ordering) AS turn FROM plan WHERE strict_relevance = 'CORE' AND ready AND NOT conflict AND pilot_size > 0)
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY turn, category) AS INT) AS position, source_id, source_name, category FROM turns) t WHERE position <= 5""")
def live_manifest(d: Domain) -> DataFrame:
    return planning.round_robin(planning.pilot_plan(d.sources, d.source_registry_profiles), 5)


HEALTH = """health AS (SELECT h.*, CASE WHEN access_result = 'ACCESS_RESTRICTED' THEN 'ACCESS_RESTRICTED' WHEN access_result = 'SOURCE_NOT_FOUND' THEN 'SOURCE_UNAVAILABLE' WHEN access_result = 'PROVIDER_FAILED' THEN 'UNKNOWN'
  WHEN access_result = 'PUBLIC_CONTENT' AND visible_item_count > 0 AND latest_visible_item_at IS NOT NULL AND CAST(latest_visible_item_at AS TIMESTAMP) >= CAST(checked_at AS TIMESTAMP) - INTERVAL 30 DAY AND has_evidence_url THEN 'ACTIVE'
  WHEN access_result = 'PUBLIC_NO_RECENT' AND coverage_complete AND (latest_visible_item_at IS NULL OR CAST(latest_visible_item_at AS TIMESTAMP) < CAST(checked_at AS TIMESTAMP) - INTERVAL 30 DAY) THEN 'INACTIVE_OR_LOW_ACTIVITY' ELSE 'UNKNOWN' END AS status FROM source_health_checks h)"""


def checked_health(d: Domain) -> DataFrame:
    t = lambda c: F.col(c).cast("timestamp_ntz")
    status = health_status(F.col("access_result"), F.col("visible_item_count"), t("latest_visible_item_at"), t("checked_at"), F.col("has_evidence_url"), F.col("coverage_complete"))
    return d.source_health_checks.withColumn("status", status)


registry.add("health_classification", lambda d: checked_health(d).groupBy("source_id", "status").agg(F.count("*").alias("checks")), ("source_health_checks",), HEALTH, "SELECT source_id, status, count(*) AS checks FROM health GROUP BY source_id, status")
registry.add(
    "latest_health", lambda d: planning.latest_health(checked_health(d)), ("source_health_checks",), HEALTH,
    "SELECT source_id, id, status, checked_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY checked_at DESC, id DESC) AS rn FROM health) t WHERE rn = 1",
)


@registry.query((), "", None)
def wave_selection(d: Domain) -> DataFrame:
    """Primary and backup sources of the wave slots, each used once."""
    latest = planning.latest_health(checked_health(d)).join(d.sources.select(F.col("id").alias("source_id"), "name"), "source_id").select("name", "status")
    names = d.sources.select("id", "name")
    slots = d.source_registry_profiles.select(F.col("source_id").alias("slot")).join(names.select(F.col("id").alias("slot"), F.col("name").alias("primary_name")), "slot")
    slots = slots.join(names.select((F.col("id") - 1).alias("slot"), F.col("name").alias("backup_name")), "slot")
    return planning.select_wave(slots, latest)


@registry.query(FLAG_TABLES + ("source_items",), FLAGS, """
SELECT source_id, id, strong, CAST(rn AS INT) AS rn FROM (SELECT i.source_id, s.id, s.strong, row_number() OVER (PARTITION BY i.source_id ORDER BY s.strong DESC, s.id) AS rn FROM strong s JOIN source_items i ON i.id = s.source_item_id) t WHERE rn <= 3""")
def review_top(d: Domain) -> DataFrame:
    """The first three observations of each source for review, strong ones first."""
    rows = flagged(d).join(d.source_items.select(F.col("id").alias("source_item_id"), "source_id"), "source_item_id")
    return planning.top_per_source(rows, [F.desc("strong"), F.col("id")], 3).select("source_id", "id", "strong", "rn")


POLICY = """counts AS (SELECT s.*, (SELECT count(*) FROM source_items i WHERE i.source_id = s.id) AS item_count, (SELECT count(*) FROM discovery_runs r WHERE r.source_id = s.id) AS discovery_count,
    (SELECT count(*) FROM evidence_spans e JOIN source_items i ON i.id = e.source_item_id WHERE i.source_id = s.id) AS evidence_span_count FROM sources s
), judged AS (SELECT id AS source_id, name AS source_name, item_count, discovery_count, evidence_span_count,
    concat_ws(',', CASE WHEN coalesce(trim(access_method), '') = '' THEN 'access_method' END, CASE WHEN coalesce(trim(commercial_use_status), '') = '' THEN 'commercial_use_status' END, CASE WHEN coalesce(trim(retention_rules), '') = '' THEN 'retention_rules' END,
      CASE WHEN coalesce(trim(attribution_requirements), '') = '' THEN 'attribution_requirements' END, CASE WHEN coalesce(trim(quoting_rules), '') = '' THEN 'quoting_rules' END, CASE WHEN coalesce(trim(deletion_requirements), '') = '' THEN 'deletion_requirements' END,
      CASE WHEN coalesce(trim(rate_limit_notes), '') = '' THEN 'rate_limit_notes' END, CASE WHEN coalesce(trim(rights_reviewed_at), '') = '' THEN 'rights_reviewed_at' END) AS missing_fields,
    coalesce(trim(rights_reviewed_at) <> '' AND try_cast(rights_reviewed_at AS DATE) IS NULL, FALSE) AS invalid_date,
    coalesce(upper(replace(trim(commercial_use_status), '-', '_')) = 'APPROVED' OR starts_with(upper(replace(trim(commercial_use_status), '-', '_')), 'APPROVED_'), FALSE) AS commercial_use_approved
  FROM counts WHERE item_count > 0 OR discovery_count > 0
), decided AS (SELECT *, (missing_fields = '' AND NOT invalid_date) AS complete, (missing_fields = '' AND NOT invalid_date AND commercial_use_approved) AS production_ready FROM judged)"""
POLICY_TABLES = ("sources", "source_items", "discovery_runs", "evidence_spans", "problem_observations")


def policy_decisions(d: Domain) -> DataFrame:
    return audits.policy_decisions(d.sources, d.source_items, d.discovery_runs, d.evidence_spans)


registry.add("policy_decisions", policy_decisions, POLICY_TABLES, POLICY, "SELECT * FROM decided")
registry.add(
    "policy_audit", lambda d: audits.policy_audit(policy_decisions(d)), POLICY_TABLES, POLICY,
    "SELECT count(*) AS source_count, count_if(complete) AS complete_policy_count, count_if(production_ready) AS production_ready_count, count_if(evidence_span_count > 0) AS evidence_source_count, count_if(evidence_span_count > 0 AND production_ready) AS display_ready_evidence_source_count, count_if(NOT complete) AS violations FROM decided",
)

AUDIT_TABLES = ("sources", "source_items", "problem_observations", "evidence_spans", "workarounds", "impact_signals", "payment_signals", "claims", "claim_evidence", "cluster_members", "research_cases", "research_passes", "research_unknowns", "validation_questions", "dach_assessments", "competitors", "counter_evidence", "opportunities", "opportunity_types", "opportunity_claims", "observation_revisions", "case_stakeholders", "competitor_evidence", "competitor_complaints", "competitor_complaint_evidence", "research_requirements", "saved_opportunities")
BROKEN = """
facts AS (SELECT c.id FROM claims c WHERE c.claim_kind = 'FACT' AND EXISTS (SELECT 1 FROM claim_evidence e WHERE e.claim_id = c.id)
), b_facts AS (SELECT id FROM claims WHERE claim_kind = 'FACT' AND id NOT IN (SELECT claim_id FROM claim_evidence)
), b_links AS (SELECT e.claim_id FROM claim_evidence e JOIN claims c ON c.id = e.claim_id JOIN evidence_spans s ON s.id = e.evidence_span_id WHERE c.observation_id IS NOT NULL AND s.observation_id IS DISTINCT FROM c.observation_id
), b_spans AS (SELECT e.id FROM evidence_spans e JOIN source_items i ON i.id = e.source_item_id LEFT JOIN problem_observations o ON o.id = e.observation_id
  WHERE e.start_offset < 0 OR e.end_offset <= e.start_offset OR e.end_offset > length(i.raw_text) OR e.excerpt <> substr(i.raw_text, e.start_offset + 1, e.end_offset - e.start_offset)
     OR (e.observation_id IS NOT NULL AND (o.id IS NULL OR o.source_item_id <> e.source_item_id OR o.evidence_scope <> e.evidence_scope))
), b_work AS (SELECT w.id FROM workarounds w LEFT JOIN evidence_spans e ON e.id = w.evidence_span_id WHERE e.observation_id IS DISTINCT FROM w.observation_id
), b_impact AS (SELECT w.id FROM impact_signals w LEFT JOIN evidence_spans e ON e.id = w.evidence_span_id WHERE e.observation_id IS DISTINCT FROM w.observation_id
), b_pay AS (SELECT w.id FROM payment_signals w LEFT JOIN evidence_spans e ON e.id = w.evidence_span_id WHERE e.observation_id IS DISTINCT FROM w.observation_id
), b_pass AS (SELECT case_id FROM research_passes WHERE status = 'SATISFIED' AND outcome = 'EVIDENCE_FOUND' AND (summary_claim_id IS NULL OR summary_claim_id NOT IN (SELECT id FROM facts))
), b_dach AS (SELECT case_id FROM research_passes WHERE pass_type = 'DACH_TRANSFER' AND status = 'SATISFIED' AND case_id NOT IN (SELECT case_id FROM dach_assessments)
), b_comp AS (SELECT case_id FROM research_passes WHERE pass_type = 'COMPETITION' AND status = 'SATISFIED' AND outcome = 'EVIDENCE_FOUND' AND case_id NOT IN (SELECT case_id FROM competitors)
), b_counter AS (SELECT case_id FROM research_passes WHERE pass_type = 'COUNTER_EVIDENCE' AND status = 'SATISFIED' AND outcome = 'EVIDENCE_FOUND' AND case_id NOT IN (SELECT case_id FROM counter_evidence)
), b_cfact AS (SELECT id FROM counter_evidence WHERE factual_claim_id NOT IN (SELECT id FROM facts)
), b_profile AS (SELECT id FROM competitors WHERE profile_claim_id NOT IN (SELECT id FROM facts)
), b_revision AS (SELECT w.id FROM observation_revisions w LEFT JOIN evidence_spans e ON e.id = w.evidence_span_id WHERE e.observation_id IS DISTINCT FROM w.observation_id
), b_stake AS (SELECT case_id FROM case_stakeholders WHERE knowledge = 'KNOWN' AND (factual_claim_id IS NULL OR factual_claim_id NOT IN (SELECT id FROM facts))
), b_cev AS (SELECT competitor_id FROM competitor_evidence WHERE claim_id NOT IN (SELECT id FROM facts)
), b_compl AS (SELECT id FROM competitor_complaints WHERE summary_claim_id NOT IN (SELECT id FROM facts)
), b_complev AS (SELECT complaint_id FROM competitor_complaint_evidence WHERE claim_id NOT IN (SELECT id FROM facts)
), b_req AS (SELECT case_id FROM research_requirements WHERE status = 'SATISFIED' AND (satisfied_by_claim_id IS NULL OR satisfied_by_claim_id NOT IN (SELECT id FROM facts))
), b_keep AS (SELECT id FROM research_cases WHERE status = 'COMPLETE' AND id NOT IN (SELECT case_id FROM dach_assessments)
), b_from AS (SELECT id FROM opportunities WHERE case_id NOT IN (SELECT id FROM research_cases WHERE status = 'COMPLETE')
), b_saved AS (SELECT opportunity_id FROM saved_opportunities WHERE opportunity_id NOT IN (SELECT id FROM opportunities WHERE status = 'REPORT_READY')
), b_case AS (SELECT c.id FROM research_cases c WHERE c.status = 'COMPLETE' AND (
    (SELECT count(*) FROM research_passes p WHERE p.case_id = c.id AND p.status = 'SATISFIED') <> 4 OR c.id NOT IN (SELECT case_id FROM research_unknowns) OR c.id NOT IN (SELECT case_id FROM validation_questions) OR c.id NOT IN (SELECT case_id FROM dach_assessments)
    OR NOT EXISTS (SELECT 1 FROM cluster_members m JOIN problem_observations o ON o.id = m.observation_id JOIN evidence_spans e ON e.observation_id = o.id WHERE m.cluster_id = c.cluster_id AND length(trim(coalesce(o.actor, ''))) > 0 AND length(trim(coalesce(o.job_to_be_done, ''))) > 0 AND length(trim(coalesce(o.context, ''))) > 0)
    OR c.id IN (SELECT case_id FROM b_pass)
    OR (EXISTS (SELECT 1 FROM research_passes p WHERE p.case_id = c.id AND p.pass_type = 'COMPETITION' AND p.outcome = 'EVIDENCE_FOUND') AND c.id NOT IN (SELECT case_id FROM competitors))
    OR (EXISTS (SELECT 1 FROM research_passes p WHERE p.case_id = c.id AND p.pass_type = 'COUNTER_EVIDENCE' AND p.outcome = 'EVIDENCE_FOUND') AND c.id NOT IN (SELECT case_id FROM counter_evidence)))
), b_ready AS (SELECT o.id FROM opportunities o LEFT JOIN research_cases c ON c.id = o.case_id WHERE o.status = 'REPORT_READY' AND (c.status IS NULL OR c.status <> 'COMPLETE' OR o.id NOT IN (SELECT opportunity_id FROM opportunity_types)
    OR o.id NOT IN (SELECT oc.opportunity_id FROM opportunity_claims oc WHERE oc.claim_role = 'PROBLEM' AND oc.claim_id IN (SELECT id FROM facts)))
)"""
_GUARD_CTES = {"fact_requires_evidence": "b_facts", "claim_evidence_observation_matches": "b_links", "evidence_span_valid": "b_spans", "workaround_evidence_matches": "b_work", "impact_evidence_matches": "b_impact", "payment_evidence_matches": "b_pay", "research_pass_fact": "b_pass", "research_pass_dach_assessment": "b_dach", "research_pass_competition_inventory": "b_comp", "research_pass_counter_evidence": "b_counter", "counter_evidence_fact": "b_cfact", "competitor_profile_fact": "b_profile", "observation_revision_evidence_matches": "b_revision", "case_stakeholder_fact": "b_stake", "competitor_evidence_fact": "b_cev", "competitor_complaint_fact": "b_compl", "competitor_complaint_evidence_fact": "b_complev", "research_requirement_fact": "b_req", "completed_case_keeps_dach_assessment": "b_keep", "opportunity_from_complete_case": "b_from", "saved_opportunity_ready": "b_saved", "research_case_completion": "b_case", "opportunity_report_ready": "b_ready"}


def audit_tables(d: Domain) -> audits.Tables:
    return {n: d.table(n) for n in AUDIT_TABLES}


registry.add("guard_violations", lambda d: audits.guard_violations(audit_tables(d)), AUDIT_TABLES, BROKEN, "SELECT guard, count(*) AS violations FROM (" + " UNION ALL ".join(f"SELECT '{g}' AS guard FROM {c}" for g, c in _GUARD_CTES.items()) + ") t GROUP BY guard")
registry.add(
    "integrity_audit", lambda d: audits.integrity_audit(audit_tables(d)), AUDIT_TABLES, BROKEN,
    """SELECT (SELECT count(*) FROM claims WHERE claim_kind = 'FACT') AS factual_claims, (SELECT count(*) FROM b_facts) AS unsupported_factual_claims, (SELECT count(*) FROM claim_evidence e JOIN claims c ON c.id = e.claim_id WHERE c.claim_kind = 'FACT') AS factual_claim_evidence_links,
    (SELECT count(*) FROM b_links) AS mismatched_observation_claim_links, (SELECT count(*) FROM b_spans) AS invalid_evidence_spans, (SELECT count(*) FROM b_work) + (SELECT count(*) FROM b_impact) + (SELECT count(*) FROM b_pay) AS mismatched_structured_signal_links,
    (SELECT count(*) FROM research_cases WHERE status = 'COMPLETE') AS complete_research_cases, (SELECT count(*) FROM b_case) AS invalid_complete_research_cases,
    (SELECT count(*) FROM opportunities WHERE status = 'REPORT_READY') AS report_ready_opportunities, (SELECT count(*) FROM b_ready) AS invalid_report_ready_opportunities""",
)



def _fixture_has(table: str, column: str) -> bool:
    """Whether a fixture table makes a column: its SELECT names it."""
    return table in TABLES and re.search(rf"\b{column}\b", TABLES[table]) is not None


_RULES = {n: rules.row_rules(n, lambda c, n=n: _fixture_has(n, c), json=False) for n in TABLES}
RULE_TABLES = tuple(n for n, r in _RULES.items() if r)
registry.add(
    "check_violations", lambda d: rules.check_violations({n: d.table(n) for n in RULE_TABLES}, json=False), RULE_TABLES, "",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{name}' AS rule, count_if(NOT ({sql})) AS violations FROM {n}" for n in RULE_TABLES for name, sql in _RULES[n].items()),
)

_KEYS = {n: rules.key_columns(n, lambda c, n=n: _fixture_has(n, c)) for n in TABLES}
KEY_TABLES = tuple(n for n, k in _KEYS.items() if k)


def _key_sql(table: str, columns: list[str], nullable: set[str]) -> str:
    by = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" if c in nullable else c for c in columns)
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns if c not in nullable)
    return f"SELECT '{table}' AS table_name, '{','.join(columns)}' AS key, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM {table} WHERE {known} GROUP BY {by}) x"


registry.add("key_violations", lambda d: rules.key_violations({n: d.table(n) for n in KEY_TABLES}), KEY_TABLES, "", " UNION ALL ".join(_key_sql(n, *k) for n in KEY_TABLES for k in _KEYS[n]))

_REFERENCES = rules.references(_fixture_has)
REFERENCE_TABLES = tuple(dict.fromkeys(n for t, _, o in _REFERENCES for n in (t, o)))
registry.add(
    "reference_violations", lambda d: rules.reference_violations({n: d.table(n) for n in REFERENCE_TABLES}), REFERENCE_TABLES, "",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS violations FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {o})" for t, c, o in _REFERENCES),
)
