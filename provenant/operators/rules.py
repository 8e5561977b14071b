"""Row rules, uniqueness and references of the domain tables, as declarations.

A rule concerns a table only if the table has its columns; a rule that is
unknown (null) is not broken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.sources.fixtures import IMPACTS, OPPORTUNITY_TYPES, PAYMENTS, PROBLEM_FAMILIES, WORKAROUNDS

Tables = dict[str, DataFrame]

# Allowed members of columns.
MEMBERS = {
    "sources.lifecycle": "CANDIDATE,EXPLORATION,CORE,LOW_VALUE,EXCLUDED",
    "source_registry_profiles.audience_type": "PRACTITIONER,OWNER,BUYER,CONSUMER,FOUNDER,VENDOR,JOBSEEKER,GENERAL,MIXED",
    "source_health_checks.health_status": "ACTIVE,INACTIVE_OR_LOW_ACTIVITY,ACCESS_RESTRICTED,SOURCE_UNAVAILABLE,UNKNOWN",
    "source_health_checks.confidence": "HIGH,MEDIUM,LOW",
    "source_problem_family_metrics.problem_family": PROBLEM_FAMILIES,
    "discovery_runs.availability": "RESULTS,NO_RESULTS,SOURCE_UNAVAILABLE",
    "discovery_records.state": "DISCOVERED,CONTENT_PARTIAL,CONTENT_COMPLETE,ACQUISITION_FAILED,POLICY_BLOCKED",
    "acquisition_records.state": "CONTENT_PARTIAL,CONTENT_COMPLETE,ACQUISITION_FAILED,POLICY_BLOCKED",
    "acquisition_records.completeness": "FULL,PARTIAL,METADATA_ONLY",
    "pipeline_runs.stage": "EXTRACTION",
    "pipeline_runs.status": "RUNNING,COMPLETED,FAILED",
    "completed_pipeline_signatures.stage": "EXTRACTION",
    "model_runs.status": "COMPLETED,FAILED",
    "structured_inference_cache.stage": "SCREENING,EXTRACTION",
    "structured_inference_attempts.stage": "SCREENING,EXTRACTION",
    "problem_observations.problem_family": PROBLEM_FAMILIES,
    "problem_observations.evidence_scope": "GLOBAL,DACH",
    "evidence_spans.evidence_scope": "GLOBAL,DACH",
    "observation_revisions.field_name": "actor,actor_role,industry,job_to_be_done,context,root_cause,current_workaround,tools_used,frequency,time_impact,financial_impact,revenue_impact,error_impact,delay_impact,risk_impact,active_solution_search,switching_intent,existing_solution,existing_spend,paid_workaround,country_code,language_code",
    "workarounds.workaround_type": WORKAROUNDS,
    "impact_signals.impact_type": IMPACTS,
    "payment_signals.payment_type": PAYMENTS,
    "claims.claim_kind": "FACT,ANALYSIS,HYPOTHESIS",
    "research_cases.status": "OPEN,INVESTIGATING,REVIEW,COMPLETE,REJECTED",
    "competitors.solution_type": "DIRECT_SOFTWARE,INDIRECT_SOFTWARE,LEGACY_SOFTWARE,INTERNAL_TOOL,MANUAL_PROCESS,FREELANCER,AGENCY,SERVICE_PROVIDER,DIY_SCRIPT,NO_SOLUTION_FOUND",
    "competitor_evidence.evidence_role": "PROFILE,PRICING,FEATURE,INTEGRATION,AVAILABILITY,INCUMBENT_FIX_RISK",
    "counter_evidence.evidence_type": "TEMPORARY_PROBLEM,FEATURE_ALREADY_EXISTS,FEATURE_ANNOUNCED,FREE_WORKAROUND,SATISFIED_WITH_WORKAROUND,LOW_FREQUENCY,LOW_IMPACT,VERY_SMALL_SEGMENT,NO_PAYMENT_SIGNAL,HIGH_SWITCHING_COST,INCUMBENT_FIX_RISK,REGULATORY_BARRIER,DISTRIBUTION_DIFFICULTY,DEPENDENCY_RISK,WEAK_DACH_TRANSFER,CONTRADICTING_USERS,OTHER",
    "opportunities.status": "DRAFT,REPORT_READY",
    "opportunities.evidence_state": "SINGLE_SIGNAL,EMERGING,RECURRING,MULTI_SOURCE,CROSS_MARKET",
    "opportunity_types.opportunity_type": OPPORTUNITY_TYPES,
    "opportunity_claims.claim_role": "PROBLEM,SUPPORTING,CONTEXT,CONTRADICTING",
    "dach_assessments.actor_equivalence": "DIRECT,SIMILAR,DIFFERENT,UNCLEAR",
    "dach_assessments.workflow_equivalence": "DIRECT,LOCALIZED,MATERIALLY_DIFFERENT,UNKNOWN",
    "dach_assessments.transfer_type": "DIRECT_TRANSFER,LOCALIZATION_REQUIRED,LOCAL_FRICTION,WEAK_LOCAL_EVIDENCE,MATERIAL_DIFFERENCE,UNKNOWN",
    "dach_assessments.local_evidence_state": "NONE_FOUND,SINGLE_LOCAL_SIGNAL,MULTIPLE_LOCAL_SIGNALS,MULTI_SOURCE_LOCAL_SIGNALS",
    "case_stakeholders.role": "END_USER,BUYER,DECISION_MAKER,GATEKEEPER,INFLUENCER",
    "case_stakeholders.knowledge": "KNOWN,UNKNOWN",
    "research_requirements.requirement_type": "COMPETITION,COUNTER_EVIDENCE",
    "research_requirements.status": "PENDING,SATISFIED",
    "research_passes.pass_type": "WORKAROUND_RESEARCH,COMPETITION,DACH_TRANSFER,COUNTER_EVIDENCE",
    "research_passes.status": "PENDING,SATISFIED",
    "research_passes.outcome": "EVIDENCE_FOUND,NO_EVIDENCE_FOUND",
}
# Columns that are never negative, never blank, a JSON list, or a JSON value.
COUNTS = {
    "source_registry_profiles": "pilot_posts,strict_pilot_posts",
    "source_health_checks": "visible_item_count,latency_ms,cost_usd",
    "source_metrics": "items_scanned,items_after_prefilter,pain_observations,strong_single_signals,active_search_signals,quantified_impact_signals,payment_signals,problem_clusters_contributed,cross_source_confirmations,promo_items,duplicate_items,temporary_incidents,support_questions,known_processing_cost_usd",
    "source_problem_family_metrics": "observation_count,strong_signal_count,active_search_count,payment_signal_count,cluster_count",
    "discovery_runs": "search_requests,requested_items,results_returned,urls_discovered,latency_ms,cost_usd",
    "acquisition_records": "latency_ms,cost_usd",
    "pipeline_runs": "input_count,output_count",
    "model_runs": "input_tokens,output_tokens,latency_ms,items_processed",
    "structured_inference_attempts": "attempt_number",
    "evidence_spans": "start_offset",
    "dach_assessments": "dach_observation_count,dach_unique_author_count,dach_source_count",
}
# Columns that are not blank.
NOT_BLANK = {
    "source_items": "raw_text,external_id",
    "problem_observations": "problem",
    "observation_revisions": "reason,revision_version",
    "claims": "text",
    "competitors": "name",
    "competitor_complaints": "complaint_type,complaint_statement",
    "counter_evidence": "statement",
    "opportunities": "title",
    "saved_opportunities": "note",
    "dach_assessments": "actor_rationale,workflow_rationale,transfer_rationale",
    "case_stakeholders": "note",
    "research_unknowns": "statement",
    "validation_questions": "question",
}
# Columns that hold JSON lists.
JSON_LISTS = {
    "competitors": "features_json,integrations_json",
    "dach_assessments": "ecosystem_dependencies_json,regulatory_dependencies_json,switching_barriers_json,localization_gaps_json",
}
# Columns that hold JSON.
JSON_VALUES = {
    "source_health_checks": "evidence_urls_json,capture_json",
    "structured_inference_cache": "result_json",
    "observation_revisions": "old_value_json,new_value_json",
    "acquisition_records": "metadata_json",
}
#: Columns that are never null, by table.
# Columns that are always known.
REQUIRED = {
    "sources": "id,normalized_key,name,lifecycle",
    "source_items": "id,source_id,external_id,raw_text",
    "source_health_checks": "source_id,provider,checked_at",
    "discovery_runs": "id,source_id,provider,availability",
    "discovery_records": "id,source_id,canonical_url",
    "acquisition_records": "id,discovery_id,provider,state",
    "pipeline_runs": "id,status",
    "model_runs": "id,provider,status",
    "problem_observations": "id,source_item_id,problem_type,evidence_scope,problem",
    "evidence_spans": "id,source_item_id,start_offset,end_offset,excerpt,evidence_scope",
    "workarounds": "id,observation_id,workaround_type,evidence_span_id",
    "impact_signals": "id,observation_id,impact_type,quantified,evidence_span_id",
    "payment_signals": "id,observation_id,payment_type,evidence_span_id",
    "claims": "id,claim_kind,text",
    "claim_evidence": "claim_id,evidence_span_id",
    "cluster_members": "cluster_id,observation_id",
    "research_cases": "id,cluster_id,status",
    "competitors": "id,case_id,name,solution_type,profile_claim_id",
    "counter_evidence": "id,case_id,evidence_type,factual_claim_id",
    "opportunities": "id,case_id,title,status,evidence_state",
    "research_passes": "case_id,pass_type,status",
}
#: Rules over several columns: (table, name, columns, SQL).
# Rules over several columns.
TOGETHER = (
    ("impact_signals", "quantified_has_value_and_unit", "quantified,value,unit", "CASE WHEN quantified THEN value IS NOT NULL AND unit IS NOT NULL ELSE value IS NULL AND unit IS NULL END"),
    ("payment_signals", "amount_with_currency", "amount,currency", "(amount IS NULL) = (currency IS NULL)"),
    ("evidence_spans", "end_after_start", "start_offset,end_offset", "end_offset > start_offset"),
    ("source_health_checks", "http_status_range", "http_status", "http_status BETWEEN 100 AND 599"),
    ("competitors", "fix_risk_with_rationale", "incumbent_fix_risk,incumbent_fix_rationale", "(incumbent_fix_risk IS NULL) = (coalesce(trim(incumbent_fix_rationale), '') = '')"),
    ("case_stakeholders", "known_has_party_and_fact", "knowledge,party,factual_claim_id", "CASE WHEN knowledge = 'KNOWN' THEN coalesce(trim(party), '') <> '' AND factual_claim_id IS NOT NULL ELSE party IS NULL AND factual_claim_id IS NULL END"),
    ("research_requirements", "satisfied_by_a_claim", "status,satisfied_by_claim_id", "(status = 'SATISFIED') = (satisfied_by_claim_id IS NOT NULL)"),
    ("research_passes", "outcome_of_status", "status,outcome,summary_claim_id", "CASE WHEN status = 'PENDING' THEN outcome IS NULL AND summary_claim_id IS NULL ELSE outcome IS NOT NULL AND (outcome = 'EVIDENCE_FOUND') = (summary_claim_id IS NOT NULL) END"),
    ("research_passes", "no_evidence_has_note", "outcome,note", "coalesce(outcome, '') <> 'NO_EVIDENCE_FOUND' OR coalesce(trim(note), '') <> ''"),
    (
        "dach_assessments", "counts_fit_the_state", "local_evidence_state,dach_observation_count,dach_unique_author_count,dach_source_count",
        "CASE local_evidence_state WHEN 'NONE_FOUND' THEN dach_observation_count + dach_unique_author_count + dach_source_count = 0 ELSE dach_unique_author_count >= 1 AND dach_observation_count >= CASE local_evidence_state WHEN 'SINGLE_LOCAL_SIGNAL' THEN 1 ELSE 2 END AND dach_source_count >= CASE local_evidence_state WHEN 'MULTI_SOURCE_LOCAL_SIGNALS' THEN 2 ELSE 1 END END",
    ),
)
#: Uniqueness keys by table, separated by semicolons; a column with ``?`` counts as empty where it is null, other rows with nulls are no key.
# Uniqueness keys.
KEYS = {
    "sources": "id; normalized_key",
    "source_items": "id; source_id,external_id",
    "source_registry_metadata": "source_id,namespace",
    "source_registry_profiles": "source_id",
    "source_health_checks": "id; source_id,provider,checked_at",
    "source_metrics": "source_id,measurement_key",
    "source_problem_family_metrics": "source_id,measurement_key,problem_family",
    "discovery_runs": "id",
    "discovery_records": "id; run_id,canonical_url",
    "acquisition_records": "id; discovery_id,provider",
    "pipeline_runs": "id",
    "completed_pipeline_signatures": "run_id; stage,version,input_signature",
    "model_runs": "id; operation_key; provider,external_run_id",
    "structured_inference_cache": "identity_key",
    "structured_inference_attempts": "model_run_id",
    "cost_events": "model_run_id",
    "problem_observations": "id",
    "evidence_spans": "id",
    "observation_revisions": "id; observation_id,field_name,revision_version",
    "workarounds": "id; observation_id,workaround_type,description,evidence_span_id",
    "impact_signals": "id; observation_id,impact_type,quantified,value?,unit?,frequency?,evidence_span_id",
    "payment_signals": "id; observation_id,payment_type,amount?,currency?,frequency?,evidence_span_id",
    "claims": "id",
    "claim_evidence": "claim_id,evidence_span_id",
    "observation_fingerprints": "observation_id,fingerprint_version",
    "problem_clusters": "id; algorithm_version,fingerprint",
    "cluster_members": "cluster_id,observation_id",
    "research_cases": "id",
    "competitors": "id; case_id,name",
    "competitor_evidence": "competitor_id,claim_id,evidence_role",
    "competitor_complaints": "id; competitor_id,complaint_type,complaint_statement",
    "competitor_complaint_evidence": "complaint_id,claim_id",
    "counter_evidence": "id; case_id,evidence_type,statement",
    "opportunities": "id; case_id",
    "opportunity_types": "opportunity_id,opportunity_type",
    "opportunity_claims": "opportunity_id,claim_id,claim_role",
    "saved_opportunities": "opportunity_id",
    "dach_assessments": "case_id",
    "case_stakeholders": "case_id,role",
    "research_requirements": "case_id,requirement_type",
    "research_passes": "case_id,pass_type",
    "research_unknowns": "id; case_id,statement",
    "validation_questions": "id; case_id,question",
}
#: Columns that name a row of another table by its id, by the table that they name.
# References.
NAMED_BY = {
    "sources": "source_items.source_id, source_registry_metadata.source_id, source_registry_profiles.source_id, source_health_checks.source_id, source_metrics.source_id, source_problem_family_metrics.source_id, discovery_runs.source_id, discovery_records.source_id",
    "discovery_runs": "discovery_records.run_id",
    "discovery_records": "acquisition_records.discovery_id",
    "source_items": "acquisition_records.source_item_id, structured_inference_cache.source_item_id, structured_inference_attempts.source_item_id, problem_observations.source_item_id, evidence_spans.source_item_id",
    "pipeline_runs": "completed_pipeline_signatures.run_id, model_runs.pipeline_run_id, problem_observations.pipeline_run_id",
    "model_runs": "structured_inference_cache.model_run_id, structured_inference_attempts.model_run_id, cost_events.model_run_id",
    "problem_observations": "structured_inference_cache.observation_id, evidence_spans.observation_id, observation_revisions.observation_id, workarounds.observation_id, impact_signals.observation_id, payment_signals.observation_id, claims.observation_id, observation_fingerprints.observation_id, cluster_members.observation_id",
    "evidence_spans": "observation_revisions.evidence_span_id, workarounds.evidence_span_id, impact_signals.evidence_span_id, payment_signals.evidence_span_id, claim_evidence.evidence_span_id",
    "claims": "claim_evidence.claim_id, competitors.profile_claim_id, competitor_evidence.claim_id, competitor_complaints.summary_claim_id, competitor_complaint_evidence.claim_id, counter_evidence.factual_claim_id, opportunity_claims.claim_id, case_stakeholders.factual_claim_id, research_requirements.satisfied_by_claim_id, research_passes.summary_claim_id",
    "problem_clusters": "cluster_members.cluster_id, research_cases.cluster_id",
    "research_cases": "competitors.case_id, counter_evidence.case_id, opportunities.case_id, dach_assessments.case_id, case_stakeholders.case_id, research_requirements.case_id, research_passes.case_id, research_unknowns.case_id, validation_questions.case_id",
    "competitors": "competitor_evidence.competitor_id, competitor_complaints.competitor_id",
    "competitor_complaints": "competitor_complaint_evidence.complaint_id",
    "opportunities": "opportunity_types.opportunity_id, opportunity_claims.opportunity_id, saved_opportunities.opportunity_id",
}


def _listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def row_rules(table: str, has: Callable[[str], bool], json: bool = True) -> dict[str, str]:
    """Rules of a table by name, as SQL that must not be false; ``has`` tells which columns there are."""
    out: dict[str, str] = {}
    for column in filter(has, _listed(REQUIRED.get(table, ""))):
        out[f"{column} is known"] = f"{column} IS NOT NULL"
    for place, members in MEMBERS.items():
        owner, column = place.split(".")
        if owner == table and has(column):
            out[f"{column} is a member"] = f"{column} IN ({', '.join(repr(m) for m in _listed(members))})"
    for column in filter(has, _listed(COUNTS.get(table, ""))):
        out[f"{column} is not negative"] = f"{column} >= 0"
    for column in filter(has, _listed(NOT_BLANK.get(table, ""))):
        out[f"{column} is not blank"] = f"length(trim({column})) > 0"
    if json:
        for column in filter(has, _listed(JSON_VALUES.get(table, ""))):
            out[f"{column} is JSON"] = f"{column} IS NULL OR try_parse_json({column}) IS NOT NULL"
        for column in filter(has, _listed(JSON_LISTS.get(table, ""))):
            out[f"{column} is a JSON list"] = f"{column} IS NULL OR coalesce(schema_of_variant(try_parse_json({column})) LIKE 'ARRAY%', FALSE)"
    for owner, name, columns, sql in TOGETHER:
        if owner == table and all(has(c) for c in _listed(columns)):
            out[name] = sql
    return out


def key_columns(table: str, has: Callable[[str], bool]) -> list[tuple[list[str], set[str]]]:
    """The uniqueness keys of a table whose columns there are, and which of their columns may be null."""
    out = []
    for key in KEYS.get(table, "").split(";"):
        names = _listed(key)
        columns = [n.rstrip("?") for n in names]
        if columns and all(has(c) or n.endswith("?") for c, n in zip(columns, names, strict=True)):
            kept = [(c, n) for c, n in zip(columns, names, strict=True) if has(c)]
            out.append(([c for c, _ in kept], {c for c, n in kept if n.endswith("?")}))
    return out


def references(has: Callable[[str, str], bool]) -> list[tuple[str, str, str]]:
    """(table, column, named table) of all references whose column there is."""
    out = []
    for named, places in NAMED_BY.items():
        for place in _listed(places):
            table, column = place.split(".")
            if has(table, column) and has(named, "id"):
                out.append((table, column, named))
    return out


def _columns(t: Tables) -> Callable[[str, str], bool]:
    return lambda table, column: table in t and column in t[table].columns


def check_violations(t: Tables, json: bool = True) -> DataFrame:
    """``table_name, rule, violations`` of every row rule: one pass over each table."""
    has = _columns(t)
    found = []
    for table in t:
        rules = row_rules(table, lambda c, n=table: has(n, c), json)
        if rules:
            counts = t[table].agg(*(F.count_if(F.expr(f"NOT ({sql})")).alias(f"r{i}") for i, sql in enumerate(rules.values())))
            listed = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)))
            found.append(counts.select(F.lit(table).alias("table_name"), F.inline(listed)))
    return reduce(DataFrame.unionByName, found)


def key_violations(t: Tables) -> DataFrame:
    """``table_name, key, violations``: how many rows repeat the key of another one."""
    has = _columns(t)
    found = []
    for table in t:
        for columns, nullable in key_columns(table, lambda c, n=table: has(n, c)):
            rows = t[table].select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in nullable else F.col(c) for c in columns)).dropna(subset=columns)
            more = rows.groupBy(*columns).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"))
            found.append(more.select(F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("key"), "violations"))
    return reduce(DataFrame.unionByName, found)


def reference_violations(t: Tables, changed: set[str] | None = None) -> DataFrame:
    """``table_name, column_name, violations``: rows whose reference meets nothing, of references that a changed table makes or takes."""
    found = []
    for table, column, named in references(_columns(t)):
        if changed is not None and not changed & {table, named}:
            continue
        lost = t[table].filter(F.col(column).isNotNull()).join(t[named].select(F.col("id").alias("_there")), F.col(column) == F.col("_there"), "left_anti")
        found.append(lost.agg(F.count("*").alias("violations")).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "violations"))
    return reduce(DataFrame.unionByName, found)


def _row_key(table: str, columns: list[str]) -> Column:
    """What names a row: its first uniqueness key, where the columns of one are there, else all its columns."""
    known = key_columns(table, lambda c: c in columns)
    named = known[0][0] if known else ["id"] if "id" in columns else columns
    return F.to_json(F.struct(*named))


def broken_rows(t: Tables, wanted: set[tuple[str, str]]) -> DataFrame | None:
    """``rule, key`` of the rows that break some of the rules, keys and references, named by table and rule; None if there are none such."""
    has = _columns(t)
    found = []
    keep = lambda table, rule, rows, key: found.append(rows.select(F.lit(f"{table}: {rule}").alias("rule"), key.alias("key")))
    for table in sorted({x for x, _ in wanted} & set(t)):
        for rule, sql in row_rules(table, lambda c, n=table: has(n, c)).items():
            if (table, rule) in wanted:
                keep(table, rule, t[table].filter(f"NOT ({sql})"), _row_key(table, t[table].columns))
        for columns, nullable in key_columns(table, lambda c, n=table: has(n, c)):
            if (table, rule := ",".join(columns)) in wanted:
                rows = t[table].select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in nullable else F.col(c) for c in columns)).dropna(subset=columns)
                more = rows.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("_k", F.explode(F.sequence(F.lit(2).cast("long"), F.col("_n"))))
                keep(table, rule, more, F.to_json(F.struct(*columns, "_k")))
    for table, column, named in references(has):
        if (table, column) in wanted:
            lost = t[table].filter(F.col(column).isNotNull()).join(t[named].select(F.col("id").alias("_there")), F.col(column) == F.col("_there"), "left_anti")
            keep(table, column, lost, F.concat_ws("|", _row_key(table, t[table].columns), F.col(column).cast("string")))
    return reduce(DataFrame.unionByName, found) if found else None


def broken(t: Tables, changed: Iterable[str]) -> DataFrame:
    """``table_name, rule, violations`` of all broken rules, keys and references that a change of some tables concerns."""
    names = set(changed)
    own = {n: df for n, df in t.items() if n in names}
    near = names | {named for table, _, named in references(_columns(t)) if table in names} | {table for table, _, named in references(_columns(t)) if named in names}
    if not own:
        return next(iter(t.values())).sparkSession.createDataFrame([], "table_name string, rule string, violations long")
    parts = []
    if any(row_rules(n, lambda c, n=n: c in own[n].columns) for n in own):
        parts.append(check_violations(own))
    if any(key_columns(n, lambda c, n=n: c in own[n].columns) for n in own):
        parts.append(key_violations(own).withColumnRenamed("key", "rule"))
    around = {n: df for n, df in t.items() if n in near}
    if any(table in names or named in names for table, _, named in references(_columns(around))):
        parts.append(reference_violations(around, names).withColumnRenamed("column_name", "rule"))
    if not parts:
        return next(iter(t.values())).sparkSession.createDataFrame([], "table_name string, rule string, violations long")
    return reduce(DataFrame.unionByName, parts).filter("violations > 0")
