"""Queries of discovery, acquisition, item merging, page accounting, waves and review samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators import evaluation, ingestion, metrics, planning, signals
from provenant.plans.registry import Registry
from provenant.plans.research import FLAG_TABLES, FLAGS, flagged
from provenant.sources.fixtures import Domain

registry = Registry()

#: Judged answers of the pending discoveries of the provider 'archive'.
JUDGED = """
pending AS (SELECT d.id AS discovery_id, d.source_id, d.canonical_url FROM discovery_records d WHERE NOT EXISTS (SELECT 1 FROM acquisition_records a WHERE a.discovery_id = d.id AND a.provider = 'archive')),
asked AS (SELECT p.*, coalesce(a.state, 'ACQUISITION_FAILED') AS state, a.completeness, a.text, a.latency_ms, a.cost_usd, coalesce(a.body_complete AND a.retrieved_at LIKE '%+%', FALSE) AS whole, row_number() OVER (PARTITION BY p.canonical_url ORDER BY p.discovery_id) > 1 AS reused
  FROM pending p LEFT JOIN answers a ON a.canonical_url = p.canonical_url),
judged AS (SELECT *, CASE WHEN state IN ('CONTENT_PARTIAL', 'CONTENT_COMPLETE') AND completeness IS NULL THEN 'a success names its completeness'
  WHEN state NOT IN ('CONTENT_PARTIAL', 'CONTENT_COMPLETE') AND completeness IS NOT NULL THEN 'a failure has no completeness'
  WHEN state = 'CONTENT_COMPLETE' AND completeness <> 'FULL' THEN 'complete content is full content'
  WHEN completeness = 'FULL' AND state <> 'CONTENT_COMPLETE' THEN 'full content comes complete, from a provider of full contents'
  WHEN state IN ('CONTENT_PARTIAL', 'CONTENT_COMPLETE') AND completeness <> 'METADATA_ONLY' AND trim(coalesce(text, '')) = '' THEN 'an acquired text is not empty'
  WHEN completeness = 'FULL' AND NOT whole THEN 'full content is attested whole, at a time with a zone' END AS refusal FROM asked)"""
ACQUIRING = ("discovery_records", "acquisition_records", "answers")


def acquired(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ingestion.acquired(d.discovery_records, d.acquisition_records, d.answers, "archive")


@registry.query(ACQUIRING, JUDGED, """
SELECT discovery_id, state, completeness, CASE WHEN NOT reused THEN latency_ms END AS latency_ms, CASE WHEN reused THEN 0.0 ELSE cost_usd END AS cost_usd,
  '{"provider_invocation":' || CASE WHEN reused THEN 'false' ELSE 'true' END || ',"reused_acquisition_url":' || CASE WHEN reused THEN '"' || canonical_url || '"' ELSE 'null' END || '}' AS metadata_json FROM judged WHERE refusal IS NULL""")
def acquire_pending(d: Domain) -> DataFrame:
    """Acquisitions of all pending discoveries from recorded answers; a URL is asked once."""
    return acquired(d)[0].select("discovery_id", "state", "completeness", "latency_ms", "cost_usd", "metadata_json")


@registry.query(ACQUIRING, JUDGED, "SELECT discovery_id, canonical_url, refusal FROM judged WHERE refusal IS NOT NULL")
def acquire_refused(d: Domain) -> DataFrame:
    """Answers that contradict themselves."""
    return acquired(d)[2]


@registry.query(ACQUIRING, JUDGED + """, contents AS (SELECT source_id, canonical_url AS external_id, discovery_id AS arrival, completeness, text FROM judged WHERE refusal IS NULL AND NOT reused AND completeness IN ('FULL', 'PARTIAL')),
old AS (SELECT DISTINCT source_id, canonical_url AS external_id, 'PARTIAL' AS completeness, 'text of old' AS text FROM discovery_records WHERE id % 2 = 0 UNION ALL SELECT DISTINCT source_id, canonical_url, 'FULL', 'whole of old' FROM discovery_records WHERE id % 2 = 0 AND source_id < 0)""", """
SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.external_id, n.external_id) AS external_id, CASE WHEN o.external_id IS NULL OR n.completeness = 'FULL' THEN n.completeness ELSE o.completeness END AS completeness,
  CASE WHEN o.external_id IS NULL OR n.completeness = 'FULL' THEN n.text ELSE o.text END AS raw_text, CAST(0 AS BIGINT) AS conflicts FROM old o FULL JOIN contents n ON n.source_id = o.source_id AND n.external_id = o.external_id""")
def acquired_items(d: Domain) -> DataFrame:
    """Items after the acquired contents came in: richer ones replace the texts that were there."""
    blank = {c: F.lit(None).cast("string") for c in ("title", "author_external_id", "published_at")}
    old = d.discovery_records.filter("id % 2 = 0").select("source_id", F.col("canonical_url").alias("external_id"), F.lit("PARTIAL").alias("completeness"), F.lit("text of old").alias("raw_text"), F.col("canonical_url").alias("url"), F.lit(0).cast("long").alias("conflicts")).distinct().withColumns(blank)
    return ingestion.merged_items(old, acquired(d)[1]).select("source_id", "external_id", "completeness", "raw_text", "conflicts")


@registry.query(("discovery_records", "acquisition_records"), "", """
SELECT d.id, coalesce((SELECT arg_max(a.state, a.id) FROM acquisition_records a WHERE a.discovery_id = d.id), 'DISCOVERED') AS state FROM discovery_records d""")
def discovery_states(d: Domain) -> DataFrame:
    """Discoveries with the state of their newest acquisition."""
    return ingestion.spread_state(d.discovery_records.withColumn("state", F.lit("DISCOVERED")), d.acquisition_records).select("id", "state")


@registry.query(("captured_posts", "source_items"), "", """
SELECT p.source_id, count(*) AS received, count_if(completeness = 'FULL') AS full, count_if(completeness = 'PARTIAL') AS partial, count_if(completeness = 'METADATA_ONLY') AS metadata_only, count_if(removal_state = 'REMOVED') AS removed, count_if(removal_state = 'DELETED') AS deleted,
  min(published_at) AS oldest, max(published_at) AS newest, count(DISTINCT CASE WHEN NOT EXISTS (SELECT 1 FROM source_items i WHERE i.source_id = p.source_id AND i.external_id = p.external_id) THEN p.external_id END) AS new_items,
  count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM source_items i WHERE i.source_id = p.source_id AND i.external_id = p.external_id) THEN p.external_id END) AS existing_items,
  CAST(epoch(TIMESTAMP '2026-03-01 00:00:00') - epoch(CAST(max(published_at) AS TIMESTAMP)) AS BIGINT) AS age_seconds FROM captured_posts p GROUP BY p.source_id""")
def page_accounting(d: Domain) -> DataFrame:
    """What a capture brought for each source: classes, removals, new and known items, age of the newest."""
    return ingestion.page_accounting(d.captured_posts, d.source_items, "2026-03-01 00:00:00")


SLOTS = """slots AS (SELECT id AS slot, name AS source, 'topic ' || CAST(id % 3 AS VARCHAR) AS category, id * 10 AS target_items, CASE WHEN id % 2 = 0 THEN 'ACTIVE' ELSE 'UNKNOWN' END AS health_status, id % 3 = 0 AS policy_ready FROM sources)"""


@registry.query(FLAG_TABLES + ("sources", "source_items", "discovery_runs", "discovery_records", "acquisition_records"), FLAGS + ", " + SLOTS, """
, taken AS (SELECT a.*, r.source_id, r.canonical_url FROM acquisition_records a JOIN discovery_records r ON r.id = a.discovery_id), m AS (SELECT t.*, s.id AS sid,
  (SELECT count(*) FROM discovery_runs r WHERE r.source_id = s.id) AS search_requests, (SELECT CAST(coalesce(sum(urls_discovered), 0) AS BIGINT) FROM discovery_runs r WHERE r.source_id = s.id) AS discovered_urls,
  (SELECT count(DISTINCT canonical_url) FROM discovery_records r WHERE r.source_id = s.id) AS unique_urls, (SELECT count(DISTINCT canonical_url) FROM taken a WHERE a.source_id = s.id AND completeness = 'FULL') AS full_items,
  (SELECT count(DISTINCT canonical_url) FROM taken a WHERE a.source_id = s.id AND completeness = 'PARTIAL') AS partial_items, (SELECT count(DISTINCT canonical_url) FROM taken a WHERE a.source_id = s.id AND completeness = 'METADATA_ONLY') AS metadata_only_items,
  (SELECT count(*) FROM taken a WHERE a.source_id = s.id AND a.state IN ('ACQUISITION_FAILED', 'POLICY_BLOCKED')) AS failed_acquisitions,
  (SELECT count(DISTINCT a.source_item_id) FROM taken a JOIN source_items i ON i.id = a.source_item_id WHERE a.source_id = s.id AND a.completeness = 'FULL' AND length(i.raw_text) >= 40) AS after_prefilter,
  (SELECT count(*) FROM done o JOIN source_items i ON i.id = o.source_item_id WHERE i.source_id = s.id) AS pains, (SELECT count_if(o.strong_or_null) FROM done o JOIN source_items i ON i.id = o.source_item_id WHERE i.source_id = s.id) AS strongs,
  (SELECT count_if(o.active_solution_search) FROM done o JOIN source_items i ON i.id = o.source_item_id WHERE i.source_id = s.id) AS actives, (SELECT CAST(coalesce(sum(o.quantified_signals), 0) AS BIGINT) FROM done o JOIN source_items i ON i.id = o.source_item_id WHERE i.source_id = s.id) AS impacts,
  (SELECT CAST(coalesce(sum(o.payment_signals), 0) AS BIGINT) FROM done o JOIN source_items i ON i.id = o.source_item_id WHERE i.source_id = s.id) AS payments,
  (SELECT count(DISTINCT w.observation_id) FROM workarounds w JOIN problem_observations o ON o.id = w.observation_id JOIN source_items i ON i.id = o.source_item_id WHERE i.source_id = s.id AND w.workaround_type IN ('SPREADSHEET','CSV','EMAIL','WHATSAPP','PAPER','MANUAL_ENTRY')) AS manual,
  (SELECT count(DISTINCT w.observation_id) FROM workarounds w JOIN problem_observations o ON o.id = w.observation_id JOIN source_items i ON i.id = o.source_item_id WHERE i.source_id = s.id AND w.workaround_type IN ('INTERNAL_SCRIPT','CUSTOM_SOFTWARE')) AS diy,
  (SELECT coalesce(sum(cost_usd), 0) FROM discovery_runs r WHERE r.source_id = s.id) + (SELECT coalesce(sum(cost_usd), 0) FROM taken a WHERE a.source_id = s.id) AS cost,
  (SELECT count(*) - count(cost_usd) FROM discovery_runs r WHERE r.source_id = s.id) + (SELECT count(*) - count(cost_usd) FROM taken a WHERE a.source_id = s.id) AS unknown_cost_records,
  (SELECT CAST(sum(CASE WHEN a.metadata_json LIKE '%true%' THEN a.latency_ms END) AS BIGINT) FROM taken a WHERE a.source_id = s.id) AS latency_ms
  FROM slots t JOIN sources s ON s.id = t.slot)
SELECT source, category, target_items, health_status, policy_ready, health_status = 'ACTIVE' AND policy_ready AS acquisition_eligible, search_requests, CAST(CASE WHEN search_requests = 0 THEN 0 END AS BIGINT) AS requested_items, discovered_urls, unique_urls, discovered_urls - unique_urls AS duplicates_removed,
  full_items, partial_items, metadata_only_items, failed_acquisitions, CASE WHEN unique_urls > 0 THEN CAST(full_items AS DOUBLE) / unique_urls END AS acquisition_success_rate, full_items AS usable_items, CASE WHEN full_items > 0 THEN after_prefilter END AS items_after_prefilter,
  CASE WHEN full_items > 0 THEN pains END AS pain_observations, CASE WHEN full_items > 0 THEN strongs END AS strong_signals, CASE WHEN full_items > 0 THEN actives END AS active_solution_searches, CASE WHEN full_items > 0 THEN impacts END AS quantified_impacts, CASE WHEN full_items > 0 THEN payments END AS payment_signals,
  CASE WHEN full_items > 0 THEN manual END AS manual_workaround_signals, CASE WHEN full_items > 0 THEN diy END AS diy_internal_tool_signals, CASE WHEN search_requests > 0 AND unknown_cost_records = 0 THEN cost END AS acquisition_cost_usd, CAST(NULL AS DOUBLE) AS processing_cost_usd, unknown_cost_records, latency_ms,
  CASE WHEN full_items > 0 THEN pains * 1000.0::DOUBLE / full_items END AS pain_per_1000_usable, CASE WHEN full_items > 0 THEN strongs * 1000.0::DOUBLE / full_items END AS strong_per_1000_usable, CASE WHEN full_items > 0 THEN actives * 1000.0::DOUBLE / full_items END AS active_per_1000_usable,
  CASE WHEN full_items > 0 THEN payments * 1000.0::DOUBLE / full_items END AS payment_per_1000_usable, CAST(NULL AS DOUBLE) AS cost_per_strong_signal_usd, CASE WHEN full_items = 0 THEN 'UNMEASURED' ELSE 'DESCRIPTIVE_ONLY' END AS research_quality, full_items AS sample_size_usable FROM m""")
def wave_metrics(d: Domain) -> DataFrame:
    """All measures of a wave, one row per selected source."""
    health = F.when(F.col("id") % 2 == 0, "ACTIVE").otherwise("UNKNOWN")
    slots = d.sources.select(F.col("name").alias("source"), F.concat(F.lit("topic "), (F.col("id") % 3).cast("string")).alias("category"), (F.col("id") * 10).alias("target_items"), health.alias("health_status"), (F.col("id") % 3 == 0).alias("policy_ready"), ((F.col("id") % 2 == 0) & (F.col("id") % 3 == 0)).alias("acquisition_eligible"))
    every = flagged(d)
    return metrics.wave_rows(slots, d.sources, d.source_items, every, signals.in_completed_runs(every, d.pipeline_runs), d.workarounds, d.impact_signals, d.payment_signals, d.discovery_runs, d.discovery_records, d.acquisition_records)


@registry.query(FLAG_TABLES + ("sources", "source_items", "acquisition_records"), FLAGS, """
, takers AS (SELECT source_item_id, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers FROM acquisition_records WHERE completeness = 'FULL' GROUP BY source_item_id), own AS (SELECT i.id, s.name AS source, t.providers FROM source_items i JOIN sources s ON s.id = i.source_id JOIN takers t ON t.source_item_id = i.id),
p AS (SELECT w.source, CASE WHEN coalesce(o.strong_or_null, FALSE) THEN 'STRONG_POSITIVE' ELSE 'WEAK_POSITIVE' END AS classification, w.id AS source_item_id, o.id AS observation_id, (SELECT arg_min(e.excerpt, e.id) FROM evidence_spans e WHERE e.observation_id = o.id) AS evidence_text,
  (SELECT arg_min(x.payment_type || ': ' || e.excerpt, x.id) FROM payment_signals x JOIN evidence_spans e ON e.id = x.evidence_span_id WHERE x.observation_id = o.id) AS payment_signal, w.providers FROM own w JOIN strong o ON o.source_item_id = w.id),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY classification, observation_id) AS place FROM p), n AS (SELECT w.source, 'NO_PAIN' AS classification, w.id AS source_item_id, CAST(NULL AS BIGINT) AS observation_id, CAST(NULL AS VARCHAR) AS evidence_text, CAST(NULL AS VARCHAR) AS payment_signal, w.providers, row_number() OVER (PARTITION BY w.source ORDER BY w.id) AS place FROM own w WHERE w.id % 4 = 1)
SELECT source, classification, CAST(place AS INT) AS place, source_item_id, observation_id, evidence_text, payment_signal, providers FROM r WHERE place <= 5 UNION ALL SELECT source, classification, CAST(place AS INT), source_item_id, observation_id, evidence_text, payment_signal, providers FROM n WHERE place <= 5""")
def review_export(d: Domain) -> DataFrame:
    """Rows for review: the first five observations and the first five items without a pain of each source."""
    selected = d.sources.select(F.col("name").alias("source"))
    negatives = d.source_items.filter("id % 4 = 1").select(F.col("id").alias("source_item_id"))
    out = evaluation.review_rows(selected, d.sources, d.source_items, flagged(d), d.evidence_spans, d.payment_signals, d.acquisition_records, negatives)
    return out.select("source", "classification", "place", "source_item_id", "observation_id", "evidence_text", "payment_signal", "providers")


@registry.query(("source_items", "problem_observations"), "", """
, o AS (SELECT i.id AS source_item_id, i.external_id, i.id AS ordering, CASE WHEN i.id % 2 = 0 THEN 'OBSERVATION' ELSE 'NO_PAIN' END AS status FROM source_items i), p AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY CASE WHEN status = 'NO_PAIN' THEN sha256(external_id) END, ordering) AS rn FROM o)
SELECT source_item_id, status FROM p WHERE (status = 'OBSERVATION' AND rn <= 30) OR (status = 'NO_PAIN' AND rn <= 25)""")
def holdout_sample(d: Domain) -> DataFrame:
    """The first 30 positives, and 25 negatives in the order of their digest."""
    rows = d.source_items.select(F.col("id").alias("source_item_id"), "external_id", F.col("id").alias("ordering"), F.when(F.col("id") % 2 == 0, "OBSERVATION").otherwise("NO_PAIN").alias("status"))
    return evaluation.review_sample(rows).select("source_item_id", "status")


@registry.query(("sources",), "", """
SELECT CAST(s.id AS BIGINT) AS source_id, s.name AS community, g.query_group, 'site:reddit.com/r/' || s.name || ' (' || g.terms || ') "last year"' AS query FROM sources s, (SELECT 'manual_work' AS query_group, '"copy paste" OR "by hand"' AS terms UNION ALL SELECT 'cost', '"too expensive"') g""")
def query_grid(d: Domain) -> DataFrame:
    """The query of every source and vocabulary."""
    return ingestion.query_grid(d.sources, {"manual_work": ("copy  paste", "by hand", "by hand"), "cost": ("too expensive",)}, "last year")


@registry.query((), "", """
SELECT CAST(n_nationkey AS BIGINT) AS slot, least(CAST(n_nationkey AS BIGINT) * 40 + 5, 250) AS items, CAST(2 * ceil(least(CAST(n_nationkey AS BIGINT) * 40 + 5, 250) / 100.0) AS BIGINT) AS estimated_requests FROM nation""")
def dry_run(d: Domain) -> DataFrame:
    """Requests that a run over slots would need."""
    slots = d.nation.select(F.col("n_nationkey").cast("long").alias("slot"), (F.col("n_nationkey").cast("long") * 40 + 5).alias("target_items"))
    return planning.dry_run(slots, 250, 100).select("slot", F.least("target_items", F.lit(250)).alias("items"), "estimated_requests")
