"""Queries of the write transforms, searches and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators import lifecycle
from provenant.plans.registry import Registry
from provenant.sources.fixtures import TABLES, Domain

registry = Registry()

INCOMING = """incoming AS (SELECT CASE WHEN id % 2 = 0 THEN normalized_key ELSE 'community:new' || CAST(id AS STRING) END AS normalized_key, upper(name) AS name,
  CASE WHEN id % 3 = 0 THEN 'CORE' ELSE NULL END AS lifecycle, CASE WHEN id % 4 = 0 THEN 'LICENSED_API' ELSE NULL END AS access_method, CAST(NULL AS STRING) AS commercial_use_status,
  CASE WHEN id % 5 = 1 THEN 'keep 7 days' ELSE NULL END AS retention_rules, CAST(NULL AS STRING) AS attribution_requirements, CAST(NULL AS STRING) AS quoting_rules,
  CASE WHEN id % 6 = 0 THEN 'delete in 24 h' ELSE NULL END AS deletion_requirements, CAST(NULL AS STRING) AS rate_limit_notes, CAST(NULL AS STRING) AS rights_reviewed_at FROM {sources})"""
_COALESCED = ", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in lifecycle.POLICY)


@registry.query(("sources",), INCOMING.replace("{sources}", "sources"), f"""
SELECT o.id, coalesce(n.normalized_key, o.normalized_key) AS normalized_key, coalesce(n.name, o.name) AS name, coalesce(n.lifecycle, o.lifecycle, 'CANDIDATE') AS lifecycle, {_COALESCED}
FROM sources o FULL JOIN incoming n ON n.normalized_key = o.normalized_key""")
def source_upsert_merge(d: Domain) -> DataFrame:
    """Sources after an upsert; ids of new sources are left out here, as they follow a hash."""
    incoming = d.spark.sql("WITH " + INCOMING + " SELECT * FROM incoming", sources=d.sources)
    merged = lifecycle.merge_sources(d.sources, incoming)
    return merged.withColumn("id", F.when(~F.col("normalized_key").startswith("community:new"), F.col("id")))


ARRIVALS = "arrivals AS (SELECT doc_id % 400 AS item_id, doc_id AS arrival, split_part('METADATA_ONLY,PARTIAL,FULL', ',', CAST(doc_id % 7 % 3 AS INT) + 1) AS completeness, text AS raw_text FROM documents)"


@registry.query((), ARRIVALS, """
, r AS (SELECT *, CASE completeness WHEN 'FULL' THEN 3 WHEN 'PARTIAL' THEN 2 ELSE 1 END AS k FROM arrivals), w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, arrival) AS rn, first_value(raw_text) OVER (PARTITION BY item_id ORDER BY k DESC, arrival) AS top, max(k) OVER (PARTITION BY item_id) AS mk FROM r)
SELECT item_id, max(CASE WHEN rn = 1 THEN completeness END) AS completeness, max(CASE WHEN rn = 1 THEN raw_text END) AS raw_text, max(CASE WHEN rn = 1 THEN arrival END) AS arrival, count_if(k = 3 AND mk = 3 AND raw_text IS DISTINCT FROM top) AS conflicts FROM w GROUP BY item_id""")
def completeness_merge(d: Domain) -> DataFrame:
    rows = d.documents.select((F.col("doc_id") % 400).alias("item_id"), F.col("doc_id").alias("arrival"), F.expr("split_part('METADATA_ONLY,PARTIAL,FULL', ',', cast(doc_id % 7 % 3 as int) + 1)").alias("completeness"), F.col("text").alias("raw_text"))
    return lifecycle.merge_content(rows)


#: Arrivals with a provider and metadata of keys that differ from row to row, some of them no object and some with conflicts of their own.
TOLD = """'{"z":{"b":' || CAST(doc_id AS STRING) || ',"a":[1,null]},"k' || CAST(doc_id % 3 AS STRING) || '":"é","acquired_at":"' || CAST(doc_id % 50 AS STRING) || '"' || CASE WHEN doc_id % 5 = 0 THEN ',"content_conflicts":[{"provider":"old","detected_at":null}]' ELSE '' END || '}'"""
RECORDED = f"arrivals AS (SELECT doc_id % 400 AS item_id, doc_id AS arrival, split_part('METADATA_ONLY,PARTIAL,FULL', ',', CAST(doc_id % 7 % 3 AS INT) + 1) AS completeness, text AS raw_text, 'p' || CAST(doc_id % 4 AS STRING) AS provider, CASE WHEN doc_id % 11 = 0 THEN '[1]' ELSE {TOLD} END AS metadata_json FROM documents)"


@registry.query((), RECORDED, """
, r AS (SELECT *, CASE completeness WHEN 'FULL' THEN 3 WHEN 'PARTIAL' THEN 2 ELSE 1 END AS k FROM arrivals), w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, arrival) AS rn, first_value(raw_text) OVER (PARTITION BY item_id ORDER BY k DESC, arrival) AS top FROM r),
c AS (SELECT * FROM w WHERE rn = 1), n AS (SELECT w.item_id, count(*) AS more, string_agg('{"detected_at":' || CASE WHEN w.arrival % 11 = 0 THEN 'null' ELSE '"' || w.arrival % 50 || '"' END || ',"provider":"' || w.provider || '"}', ',' ORDER BY w.arrival) AS rows FROM w JOIN c ON c.item_id = w.item_id WHERE c.k = 3 AND w.k = 3 AND w.raw_text IS DISTINCT FROM c.raw_text GROUP BY w.item_id),
l AS (SELECT c.*, coalesce(n.more, 0) + (c.arrival % 11 <> 0 AND c.arrival % 5 = 0)::INT AS conflicts, concat_ws(',', CASE WHEN c.arrival % 11 <> 0 AND c.arrival % 5 = 0 THEN '{"detected_at":null,"provider":"old"}' END, n.rows) AS listed FROM c LEFT JOIN n ON n.item_id = c.item_id)
SELECT item_id, completeness, raw_text, arrival, CAST(conflicts AS BIGINT) AS conflicts, CASE WHEN arrival % 11 = 0 THEN '{' ELSE '{"acquired_at":"' || arrival % 50 || '",' END || '"content_completeness":"' || completeness || '"' || CASE WHEN listed <> '' THEN ',"content_conflicts":[' || listed || ']' ELSE '' END
  || CASE WHEN arrival % 11 = 0 THEN '}' ELSE ',"k' || arrival % 3 || '":"é","z":{"a":[1,null],"b":' || arrival || '}}' END AS metadata_json FROM l""")
def content_records(d: Domain) -> DataFrame:
    """Items after all arrivals, with the merged metadata of the text that stands and a record of every conflict."""
    return lifecycle.merge_records(arrivals_of(d))


def arrivals_of(d: Domain) -> DataFrame:
    """The arrivals of :data:`RECORDED`."""
    completeness = F.expr("split_part('METADATA_ONLY,PARTIAL,FULL', ',', cast(doc_id % 7 % 3 as int) + 1)")
    metadata = F.when(F.col("doc_id") % 11 == 0, "[1]").otherwise(F.expr(TOLD))
    return d.documents.select((F.col("doc_id") % 400).alias("item_id"), F.col("doc_id").alias("arrival"), completeness.alias("completeness"), F.col("text").alias("raw_text"), F.concat(F.lit("p"), (F.col("doc_id") % 4).cast("string")).alias("provider"), metadata.alias("metadata_json"))


@registry.query(("cluster_members", "problem_observations"), "", """
, old AS (SELECT DISTINCT cluster_id AS id, md5(CAST(cluster_id AS VARCHAR)) AS fingerprint FROM cluster_members WHERE cluster_id % 2 = 0), want AS (SELECT md5(CAST(cluster_id AS VARCHAR)) AS fingerprint, count(*) AS members FROM cluster_members WHERE observation_id % 5 <> 0 GROUP BY cluster_id)
SELECT o.id, w.fingerprint, w.members FROM want w LEFT JOIN old o ON o.fingerprint = w.fingerprint""")
def cluster_replace_version(d: Domain) -> DataFrame:
    """Clusters after reassignment; new ids are left out here, as they follow a hash."""
    print_ = F.md5(F.col("cluster_id").cast("string")).alias("fingerprint")
    before = d.cluster_members.filter("cluster_id % 2 = 0").select(F.col("cluster_id").alias("id"), print_).distinct()
    after = lifecycle.replace_clusters(before, d.cluster_members.filter("observation_id % 5 <> 0").select(print_, "observation_id"))
    return after.join(before.select(F.col("id").alias("kept")), F.col("id") == F.col("kept"), "left").select(F.col("kept").alias("id"), "fingerprint", "members")


@registry.query(("discovery_records",), "", """
SELECT source_id, canonical_url, min(id) AS id FROM discovery_records GROUP BY source_id, canonical_url""")
def discovery_first_seen(d: Domain) -> DataFrame:
    """The first discovery of each URL by source."""
    rows = d.discovery_records.select("source_id", "canonical_url", "id", "discovered_at")
    return lifecycle.first_of_each(rows, ["source_id", "canonical_url"], [F.col("id")]).select("source_id", "canonical_url", "id")


@registry.query(("acquisition_records", "discovery_records"), "", """
, j AS (SELECT a.id, r.canonical_url, a.cost_usd, a.latency_ms, row_number() OVER (PARTITION BY r.canonical_url ORDER BY a.id) AS rn FROM acquisition_records a JOIN discovery_records r ON r.id = a.discovery_id)
SELECT id, canonical_url, CASE WHEN rn > 1 THEN 0.0 ELSE cost_usd END AS cost_usd, CASE WHEN rn > 1 THEN NULL ELSE latency_ms END AS latency_ms, rn > 1 AS reused FROM j""")
def acquisition_reuse(d: Domain) -> DataFrame:
    rows = d.acquisition_records.join(d.discovery_records.select(F.col("id").alias("discovery_id"), "canonical_url"), "discovery_id").select("id", "canonical_url", "cost_usd", "latency_ms")
    return lifecycle.reused_responses(rows)


@registry.query(("payment_signals", "impact_signals"), "", """
SELECT p.observation_id, p.amount FROM (SELECT DISTINCT observation_id, amount FROM payment_signals) p WHERE NOT EXISTS (SELECT 1 FROM impact_signals i WHERE i.observation_id IS NOT DISTINCT FROM p.observation_id AND i.value IS NOT DISTINCT FROM p.amount)""")
def signals_absent(d: Domain) -> DataFrame:
    """Signals whose null-safe key is not recorded yet."""
    known = d.impact_signals.select("observation_id", F.col("value").alias("amount"))
    return lifecycle.absent(d.payment_signals.select("observation_id", "amount").distinct(), known, ["observation_id", "amount"])


@registry.query(("model_runs",), "", """
SELECT a.id FROM model_runs a WHERE a.input_tokens % 2 = 1 AND a.latency_ms IS NOT NULL AND EXISTS (SELECT 1 FROM model_runs b WHERE b.id = a.id AND b.input_tokens % 7 = 0)""")
def model_run_conflicts(d: Domain) -> DataFrame:
    """Replayed operations whose values differ from the recorded ones."""
    current = d.model_runs.filter("input_tokens % 7 = 0").select("id", "input_tokens", "latency_ms")
    replay = d.model_runs.filter("input_tokens % 2 = 1 and latency_ms is not null").select("id", (F.col("input_tokens") + 1).alias("input_tokens"), "latency_ms")
    return lifecycle.conflicting_replays(replay, current, "id", ["input_tokens", "latency_ms"])


@registry.query(("cluster_members", "problem_observations"), "", """
SELECT c.cluster_id AS case_id, p.pass_type, 'PENDING' AS status FROM (SELECT DISTINCT cluster_id FROM cluster_members) c, (SELECT unnest(['WORKAROUND_RESEARCH', 'COMPETITION', 'DACH_TRANSFER', 'COUNTER_EVIDENCE']) AS pass_type) p""")
def case_passes(d: Domain) -> DataFrame:
    return lifecycle.open_cases(d.cluster_members.select("cluster_id").distinct())[1]


@registry.query(("problem_observations",), "revisions AS (SELECT doc_id + 1 AS observation_id, doc_id % 3 AS version, 'revised ' || CAST(doc_id % 3 AS VARCHAR) AS new_value FROM documents WHERE doc_id % 2 = 0)", """
SELECT o.id, coalesce((SELECT r.new_value FROM revisions r WHERE r.observation_id = o.id), o.context) AS context FROM problem_observations o""")
def revised_contexts(d: Domain) -> DataFrame:
    rows = d.documents.filter("doc_id % 2 = 0").select((F.col("doc_id") + 1).alias("observation_id"), (F.col("doc_id") % 3).alias("version"), F.concat(F.lit("revised "), (F.col("doc_id") % 3).cast("string")).alias("new_value"))
    return lifecycle.revise_field(d.problem_observations, rows, "context").select("id", "context")


CASE_TABLES = ("opportunities", "research_cases", "cluster_members", "problem_observations")


@registry.query(("opportunities", "research_passes", "competitors", "counter_evidence", "competitor_evidence", "competitor_complaints", "competitor_complaint_evidence"), "", """
SELECT DISTINCT o.id AS opportunity_id, x.claim_id, x.claim_role FROM opportunities o JOIN (
  SELECT case_id, summary_claim_id AS claim_id, CASE WHEN pass_type = 'COUNTER_EVIDENCE' THEN 'CONTRADICTING' ELSE 'SUPPORTING' END AS claim_role FROM research_passes WHERE summary_claim_id IS NOT NULL
  UNION SELECT case_id, profile_claim_id, 'CONTEXT' FROM competitors
  UNION SELECT c.case_id, e.claim_id, 'CONTEXT' FROM competitor_evidence e JOIN competitors c ON c.id = e.competitor_id
  UNION SELECT c.case_id, p.summary_claim_id, 'CONTEXT' FROM competitor_complaints p JOIN competitors c ON c.id = p.competitor_id
  UNION SELECT c.case_id, e.claim_id, 'CONTEXT' FROM competitor_complaint_evidence e JOIN competitor_complaints p ON p.id = e.complaint_id JOIN competitors c ON c.id = p.competitor_id
  UNION SELECT case_id, factual_claim_id, 'CONTRADICTING' FROM counter_evidence) x ON x.case_id = o.case_id""")
def opportunity_claim_roles(d: Domain) -> DataFrame:
    return lifecycle.opportunity_claims(d.opportunities, d.research_passes, d.competitors, d.counter_evidence, d.competitor_evidence, d.competitor_complaints, d.competitor_complaint_evidence)


@registry.query(("research_cases", "opportunities", "cluster_members", "problem_observations", "evidence_spans"), "", """
, p AS (SELECT c.id AS case_id, o.id AS observation_id, e.id AS evidence_span_id, o.problem AS text, row_number() OVER (PARTITION BY c.id ORDER BY o.id, e.id) AS rn
  FROM research_cases c JOIN cluster_members m ON m.cluster_id = c.cluster_id JOIN problem_observations o ON o.id = m.observation_id JOIN evidence_spans e ON e.observation_id = o.id WHERE length(trim(o.problem)) > 0)
SELECT c.id AS case_id, CASE WHEN c.status <> 'COMPLETE' THEN 'the case is not complete' WHEN o.status = 'REPORT_READY' THEN 'the opportunity is ready and stays as it is' WHEN o.id IS NULL AND p.case_id IS NULL THEN 'the case has no problem with evidence' END AS refusal,
  o.id AS existing_id, p.observation_id, p.evidence_span_id, p.text FROM research_cases c LEFT JOIN opportunities o ON o.case_id = c.id LEFT JOIN p ON p.case_id = c.id AND p.rn = 1""")
def opportunity_creation(d: Domain) -> DataFrame:
    """Which cases may get an opportunity, and the problem claim of each."""
    problems = lifecycle.problem_claims(d.research_cases, d.cluster_members, d.problem_observations, d.evidence_spans)
    return lifecycle.creatable_opportunities(d.research_cases, d.opportunities, problems).join(problems, "case_id", "left")


@registry.query(CASE_TABLES + ("opportunity_types",), "", """
SELECT o.id, o.title, o.status, o.evidence_state, o.updated_at, CAST(row_number() OVER (ORDER BY o.updated_at DESC, o.id DESC) AS INT) AS position FROM opportunities o
WHERE contains(lower(o.title), '100%_r') OR EXISTS (SELECT 1 FROM research_cases c JOIN cluster_members m ON m.cluster_id = c.cluster_id JOIN problem_observations p ON p.id = m.observation_id
  WHERE c.id = o.case_id AND (contains(lower(p.problem), '100%_r') OR contains(lower(p.actor), '100%_r') OR contains(lower(p.job_to_be_done), '100%_r') OR contains(lower(p.context), '100%_r')))
ORDER BY updated_at DESC, id DESC LIMIT 1000""")
def opportunity_search(d: Domain) -> DataFrame:
    """Opportunities that hold a literal with wildcard characters."""
    out = lifecycle.search_opportunities(d.opportunities, d.research_cases, d.cluster_members, d.problem_observations, query="100%_R", limit=1000)
    return out.select("id", "title", "status", "evidence_state", "updated_at", "position")


@registry.query(CASE_TABLES + ("opportunity_types", "saved_opportunities"), "", """
SELECT o.id, o.updated_at, CAST(row_number() OVER (ORDER BY o.updated_at DESC, o.id DESC) AS INT) AS position FROM opportunities o
WHERE o.status = 'REPORT_READY' AND o.evidence_state IN ('EMERGING', 'RECURRING') AND o.id IN (SELECT opportunity_id FROM opportunity_types WHERE opportunity_type = 'WORKFLOW_GAP' OR opportunity_type = 'INTEGRATION_GAP' OR opportunity_type = 'STRONG_SINGLE_SIGNAL') AND o.id IN (SELECT opportunity_id FROM saved_opportunities)""")
def opportunity_filters(d: Domain) -> DataFrame:
    """Saved, ready opportunities of some types and states, by all filters together."""
    types = d.opportunity_types.filter("opportunity_type in ('WORKFLOW_GAP', 'INTEGRATION_GAP', 'STRONG_SINGLE_SIGNAL')").select("opportunity_id", F.lit("any").alias("opportunity_type"))
    states = d.opportunities.filter("evidence_state in ('EMERGING', 'RECURRING')").withColumn("evidence_state", F.lit("young"))
    out = lifecycle.search_opportunities(states, d.research_cases, d.cluster_members, d.problem_observations, status="REPORT_READY", evidence_state="young", types=types, opportunity_type="any", saved=d.saved_opportunities, limit=None)
    return out.select("id", "updated_at", "position")


@registry.query(CASE_TABLES + ("saved_opportunities",), "", """
SELECT o.id, s.note, s.saved_at, CAST(row_number() OVER (ORDER BY s.saved_at DESC, o.id DESC) AS INT) AS position FROM saved_opportunities s JOIN opportunities o ON o.id = s.opportunity_id""")
def saved_list(d: Domain) -> DataFrame:
    return lifecycle.saved_list(d.saved_opportunities, d.opportunities, limit=None)


@registry.query(("case_stakeholders",), "", """
SELECT case_id, role, knowledge, party, CAST(row_number() OVER (PARTITION BY case_id ORDER BY CASE role WHEN 'END_USER' THEN 1 WHEN 'BUYER' THEN 2 WHEN 'DECISION_MAKER' THEN 3 WHEN 'GATEKEEPER' THEN 4 WHEN 'INFLUENCER' THEN 5 END) AS INT) AS position FROM case_stakeholders""")
def stakeholder_order(d: Domain) -> DataFrame:
    return lifecycle.stakeholders(d.case_stakeholders).select("case_id", "role", "knowledge", "party", "position")


@registry.query(("problem_observations", "source_items", "sources", "evidence_spans"), "", """
, r AS (SELECT o.id AS observation_id, e.id AS span_id, s.name AS community, o.problem, e.excerpt, (o.time_impact IS NOT NULL OR coalesce(o.active_solution_search, FALSE)) AS loud
  FROM problem_observations o JOIN source_items i ON i.id = o.source_item_id JOIN sources s ON s.id = i.source_id JOIN evidence_spans e ON e.observation_id = o.id), n AS (SELECT *, row_number() OVER (ORDER BY loud DESC, observation_id, span_id) AS rn FROM r)
SELECT observation_id, span_id, community, problem, excerpt, loud, CAST(rn AS INT) AS position FROM n WHERE rn <= 10""")
def sample_problems(d: Domain) -> DataFrame:
    """The ten problems that a community report shows."""
    return lifecycle.sample_problems(d.problem_observations, d.source_items, d.sources, d.evidence_spans)


REVISIONS = """revisions AS (SELECT id AS observation_id, CASE WHEN id % 7 = 0 THEN context ELSE 'checked by ' || CAST(id % 3 AS VARCHAR) END AS value, CASE WHEN id % 11 = 0 THEN ' ' ELSE 'read again' END AS reason,
  (id + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END) * 10 + 1 AS evidence_span_id, 'v1' AS revision_version FROM problem_observations WHERE id % 3 = 0)"""


@registry.query(("problem_observations", "evidence_spans", "cluster_members", "research_cases", "observation_revisions"), REVISIONS, """
SELECT r.observation_id, CASE WHEN trim(r.reason) = '' THEN 'a revision has a reason and a version' WHEN (SELECT max(e.observation_id) FROM evidence_spans e WHERE e.id = r.evidence_span_id) IS DISTINCT FROM r.observation_id THEN 'the evidence is of another observation'
  WHEN o.context IS NOT DISTINCT FROM r.value THEN 'the value is the same' WHEN EXISTS (SELECT 1 FROM cluster_members m JOIN research_cases c ON c.cluster_id = m.cluster_id WHERE m.observation_id = r.observation_id) THEN 'a case stands on the observation''s cluster' END AS refusal,
  CASE WHEN o.context IS NULL THEN 'null' ELSE '"' || o.context || '"' END AS old_value_json, CASE WHEN r.value IS NULL THEN 'null' ELSE '"' || r.value || '"' END AS new_value_json FROM revisions r JOIN problem_observations o ON o.id = r.observation_id""")
def revision_refusals(d: Domain) -> DataFrame:
    """Revisions of contexts with what stands against them and the values before and after as JSON."""
    of = d.problem_observations.filter("id % 3 = 0")
    value = F.when(F.col("id") % 7 == 0, F.col("context")).otherwise(F.concat(F.lit("checked by "), (F.col("id") % 3).cast("string")))
    span = (F.col("id") + F.when(F.col("id") % 13 == 0, 1).otherwise(0)) * 10 + 1
    rows = of.select(F.col("id").alias("observation_id"), value.alias("value"), F.when(F.col("id") % 11 == 0, " ").otherwise("read again").alias("reason"), span.alias("evidence_span_id"), F.lit("v1").alias("revision_version"))
    recorded = d.observation_revisions.select("observation_id", F.lit("actor").alias("field_name"), "revision_version", F.lit("null").alias("new_value_json"))
    judged = lifecycle.judged_revisions(rows, "context", d.problem_observations, d.evidence_spans, d.cluster_members, d.research_cases, recorded)
    return judged.select("observation_id", "refusal", "old_value_json", "new_value_json")


@registry.query(("problem_observations", "cluster_members", "research_cases"), "", """
SELECT m.cluster_id, count(*) AS members FROM cluster_members m WHERE m.observation_id % 2 = 1 GROUP BY m.cluster_id
UNION ALL SELECT c.cluster_id, 0 FROM research_cases c WHERE NOT EXISTS (SELECT 1 FROM cluster_members m WHERE m.cluster_id = c.cluster_id AND m.observation_id % 2 = 1)""")
def clusters_after_revision(d: Domain) -> DataFrame:
    """Clusters that stay after every second observation was revised, with their members; those with a case stay empty."""
    clusters = d.cluster_members.select(F.col("cluster_id").alias("id")).distinct()
    prints = d.cluster_members.select("observation_id", F.md5(F.col("cluster_id").cast("string")).alias("fingerprint"))
    kept, _, left = lifecycle.without_observations(d.cluster_members, prints, clusters, d.research_cases, d.problem_observations.filter("id % 2 = 0").select(F.col("id").alias("observation_id")))
    return left.select(F.col("id").alias("cluster_id")).join(kept.groupBy("cluster_id").agg(F.count("*").alias("members")), "cluster_id", "left").fillna(0, ["members"])


@registry.query(("research_cases", "cluster_members", "evidence_spans", "source_items", "sources"), "", """
SELECT c.id AS case_id, e.evidence_scope, count(DISTINCT e.observation_id) AS observations, count(DISTINCT e.source_item_id) AS items, count(DISTINCT i.source_id) AS sources,
  string_agg(DISTINCT s.name, ',' ORDER BY s.name) AS source_names, coalesce(string_agg(DISTINCT upper(i.country_code), ',' ORDER BY upper(i.country_code)), '') AS countries,
  count(DISTINCT CASE WHEN i.published_at IS NOT NULL THEN i.id END) AS dated_items, min(i.published_at) AS first_published, max(i.published_at) AS last_published
FROM research_cases c JOIN cluster_members m ON m.cluster_id = c.cluster_id JOIN evidence_spans e ON e.observation_id = m.observation_id JOIN source_items i ON i.id = e.source_item_id JOIN sources s ON s.id = i.source_id GROUP BY c.id, e.evidence_scope""")
def report_scope_summary(d: Domain) -> DataFrame:
    return lifecycle.scope_summary(d.research_cases, d.cluster_members, d.problem_observations, d.evidence_spans, d.source_items, d.sources)


@registry.query(tuple(TABLES), "", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES))
def table_stats(d: Domain) -> DataFrame:
    """The number of rows of every table."""
    return reduce(DataFrame.unionByName, (d.table(n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in TABLES))


VOCABULARIES = {"manual_work": ("copy  paste", "by hand", "by hand"), "tools": ("spreadsheet", "too many tools"), "cost": ("too expensive",)}
_QUERY_SQL = " UNION ALL ".join("SELECT '{0}' AS query_group, name AS community, 'site:reddit.com/r/' || name || ' ({1}) \"last year\"' AS query FROM sources".format(g, " OR ".join(f'"{t}"' for t in dict.fromkeys(" ".join(x.split()) for x in v))) for g, v in VOCABULARIES.items())


@registry.query(("sources",), "", _QUERY_SQL)
def search_queries(d: Domain) -> DataFrame:
    """Provider queries of every community and vocabulary."""
    groups = F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.array(*(F.lit(t) for t in v)).alias("v")) for g, v in VOCABULARIES.items())))
    terms = F.array_distinct(F.transform("v", lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))))
    quoted = F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")
    rows = d.sources.select("name", groups.alias("x")).select("name", "x.*")
    return rows.select(F.col("g").alias("query_group"), F.col("name").alias("community"), F.concat(F.lit("site:reddit.com/r/"), F.col("name"), F.lit(" ("), quoted, F.lit(') "last year"')).alias("query"))


