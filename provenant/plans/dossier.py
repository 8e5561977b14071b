"""Queries of the whole documents of cases and opportunities: their contents, list by list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.operators import dossier
from provenant.plans.registry import Registry
from provenant.sources.fixtures import Domain

registry = Registry()

READ = (
    "research_cases", "cluster_members", "problem_observations", "evidence_spans", "source_items", "sources", "research_passes", "claims", "claim_evidence", "workarounds", "impact_signals", "payment_signals", "competitors", "competitor_evidence", "competitor_complaints",
    "competitor_complaint_evidence", "counter_evidence", "dach_assessments", "case_stakeholders", "research_unknowns", "validation_questions",
)
OF_CASE = """
m AS (SELECT c.id AS case_id, x.observation_id FROM research_cases c JOIN cluster_members x ON x.cluster_id = c.cluster_id), o AS (SELECT m.case_id, p.* FROM m JOIN problem_observations p ON p.id = m.observation_id),
cite AS (SELECT e.id, e.observation_id, e.source_item_id, i.source_id, s.name, e.excerpt, e.evidence_scope, i.country_code, i.published_at FROM evidence_spans e JOIN source_items i ON i.id = e.source_item_id JOIN sources s ON s.id = i.source_id),
own AS (SELECT m.case_id, cite.* FROM m JOIN cite ON cite.observation_id = m.observation_id), passed AS (SELECT DISTINCT p.case_id, cite.* FROM research_passes p JOIN claim_evidence x ON x.claim_id = p.summary_claim_id JOIN cite ON cite.id = x.evidence_span_id WHERE p.status = 'SATISFIED'),
cited AS (SELECT *, 0 AS part FROM own UNION ALL SELECT *, 1 FROM passed p WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.case_id = p.case_id AND own.id = p.id))"""


def documents(d: Domain) -> DataFrame:
    return dossier.case_dossiers({n: d.table(n) for n in READ})


def _in_order(column: str, rows: str = "o", order: str = "id") -> str:
    """SQL for the different values of a case, in the order in which they come first."""
    return f"(SELECT coalesce(string_agg(v, '|' ORDER BY f), '') FROM (SELECT trim({column}) AS v, min({order}) AS f FROM {rows} r WHERE r.case_id = c.id AND trim({column}) <> '' GROUP BY 1) x)"


def _joined(column: str, by: str = "|") -> Column:
    return F.array_join(column, by).alias(column)


@registry.query(READ, OF_CASE, f"""
, w AS (SELECT m.case_id, x.workaround_type AS label FROM m JOIN workarounds x ON x.observation_id = m.observation_id),
i AS (SELECT m.case_id, x.id, x.impact_type AS t, x.impact_type || ': ' || CASE WHEN x.quantified THEN x.value || ' ' || x.unit ELSE 'qualitative impact recorded' END AS label FROM m JOIN impact_signals x ON x.observation_id = m.observation_id),
y AS (SELECT m.case_id, x.id, x.payment_type AS t, x.payment_type || ': ' || CASE WHEN x.amount IS NULL THEN 'amount unknown' ELSE x.amount || ' ' || x.currency END AS label FROM m JOIN payment_signals x ON x.observation_id = m.observation_id)
SELECT c.id AS case_id, {_in_order('problem')} AS problems, {_in_order('actor')} AS actors, {_in_order('job_to_be_done')} AS jobs_to_be_done, {_in_order('context')} AS contexts,
  CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.case_id = c.id) THEN (SELECT string_agg(DISTINCT label, '|' ORDER BY label) FROM w WHERE w.case_id = c.id) ELSE {_in_order('current_workaround')} END AS workarounds,
  {_in_order('label', 'i', "t || lpad(CAST(id AS VARCHAR), 20, '0')")} AS impacts, {_in_order('label', 'y', "t || lpad(CAST(id AS VARCHAR), 20, '0')")} AS payment_evidence FROM research_cases c""")
def dossier_profiles(d: Domain) -> DataFrame:
    """What each case's observations say: different values in the order in which they come."""
    return documents(d).select("case_id", *map(_joined, ("problems", "actors", "jobs_to_be_done", "contexts", "workarounds", "impacts", "payment_evidence")))


@registry.query(READ, OF_CASE, """
, k AS (SELECT case_id, max((evidence_scope = 'GLOBAL')::INT) AS g, max((evidence_scope = 'DACH')::INT) AS h, count(DISTINCT source_id) AS s, count(DISTINCT source_item_id) AS i FROM own GROUP BY case_id),
z AS (SELECT case_id, evidence_scope AS scope, count(DISTINCT observation_id) AS observations, count(*) AS spans, count(DISTINCT source_item_id) AS items, count(DISTINCT source_id) AS sources, string_agg(DISTINCT name, ',' ORDER BY lower(name)) AS source_names, string_agg(DISTINCT upper(country_code), ',' ORDER BY upper(country_code)) AS countries,
  count(DISTINCT CASE WHEN trim(published_at) <> '' THEN source_item_id END) AS dated_items, min(published_at) AS earliest, max(published_at) AS latest FROM cited GROUP BY case_id, evidence_scope),
a AS (SELECT case_id, string_agg(id || ':' || name || ':' || excerpt, '|' ORDER BY part, id) AS citations FROM cited GROUP BY case_id)
SELECT c.id AS case_id, x.scope, CASE WHEN k.g = 1 AND k.h = 1 THEN 'CROSS_MARKET' WHEN k.s >= 2 THEN 'MULTI_SOURCE' WHEN k.i >= 3 THEN 'RECURRING' WHEN k.i >= 2 THEN 'EMERGING' WHEN k.i = 1 THEN 'SINGLE_SIGNAL' END AS evidence_state, coalesce(z.observations, 0) AS observations, coalesce(z.spans, 0) AS spans,
  coalesce(z.items, 0) AS items, coalesce(z.sources, 0) AS sources, coalesce(z.source_names, '') AS source_names, coalesce(z.countries, '') AS countries, coalesce(z.dated_items, 0) AS dated_items, z.earliest, z.latest, coalesce(a.citations, '') AS citations
FROM research_cases c CROSS JOIN (SELECT 'GLOBAL' AS scope UNION ALL SELECT 'DACH') x LEFT JOIN k ON k.case_id = c.id LEFT JOIN z ON z.case_id = c.id AND z.scope = x.scope LEFT JOIN a ON a.case_id = c.id""")
def dossier_evidence(d: Domain) -> DataFrame:
    """Each case's citations, its evidence state, and what the evidence of either scope comes to."""
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["span_id"].cast("string"), c["source_name"], c["excerpt"])), "|").alias("citations")
    rows = documents(d).select("case_id", "evidence_state", F.explode(F.array("global_evidence", "dach_evidence")).alias("e"), cited)
    return rows.select("case_id", "evidence_state", "citations", "e.*").withColumns({c: F.array_join(c, ",") for c in ("source_names", "countries")})


@registry.query(READ, OF_CASE, """
, kc AS (SELECT competitor_id, claim_id FROM competitor_evidence UNION SELECT id, profile_claim_id FROM competitors), pc AS (SELECT complaint_id, claim_id FROM competitor_complaint_evidence UNION SELECT id, summary_claim_id FROM competitor_complaints),
p AS (SELECT competitor_id, string_agg(complaint_statement || '(' || (SELECT string_agg(claim_id, '+' ORDER BY claim_id) FROM pc WHERE pc.complaint_id = x.id) || ')', ';' ORDER BY id) AS complaints FROM competitor_complaints x GROUP BY competitor_id),
k AS (SELECT case_id, string_agg(name || '/' || solution_type || '/' || coalesce(pricing, '-') || '[' || (SELECT string_agg(claim_id, '+' ORDER BY claim_id) FROM kc WHERE kc.competitor_id = v.id) || ']{' || coalesce(p.complaints, '') || '}', '|' ORDER BY name, id) AS competitors FROM competitors v LEFT JOIN p ON p.competitor_id = v.id GROUP BY case_id),
f AS (SELECT p.case_id, string_agg(p.pass_type || '=' || p.outcome || '=' || coalesce(t.text, '-'), '|' ORDER BY p.pass_type) AS findings FROM research_passes p LEFT JOIN claims t ON t.id = p.summary_claim_id WHERE p.status = 'SATISFIED' GROUP BY p.case_id),
n AS (SELECT case_id, string_agg(evidence_type || ':' || factual_claim_id, '|' ORDER BY evidence_type, id) AS counter_evidence FROM counter_evidence GROUP BY case_id), s AS (SELECT case_id, string_agg(role || ':' || knowledge || ':' || coalesce(party, '-'), '|' ORDER BY CASE role WHEN 'END_USER' THEN 1 ELSE 3 END) AS stakeholders FROM case_stakeholders GROUP BY case_id)
SELECT c.id AS case_id, coalesce(competitors, '') AS competitors, coalesce(findings, '') AS findings, coalesce(counter_evidence, '') AS counter_evidence, coalesce(stakeholders, '') AS stakeholders, a.transfer_type, coalesce((SELECT string_agg(statement, '|' ORDER BY id) FROM research_unknowns u WHERE u.case_id = c.id), '') AS unknowns,
  coalesce((SELECT string_agg(question, '|' ORDER BY id) FROM validation_questions q WHERE q.case_id = c.id), '') AS questions FROM research_cases c LEFT JOIN k ON k.case_id = c.id LEFT JOIN f ON f.case_id = c.id LEFT JOIN n ON n.case_id = c.id LEFT JOIN s ON s.case_id = c.id LEFT JOIN dach_assessments a ON a.case_id = c.id""")
def dossier_research(d: Domain) -> DataFrame:
    """What research has found of each case: competitors with their complaints and claims, findings, and the rest."""
    plus = lambda claims: F.array_join(claims, "+")
    complaint = lambda x: F.concat(x["statement"], F.lit("("), plus(x["claims"]), F.lit(")"))
    competitor = lambda x: F.concat(x["name"], F.lit("/"), x["solution_type"], F.lit("/"), F.coalesce(x["pricing"], F.lit("-")), F.lit("["), plus(x["claims"]), F.lit("]{"), F.array_join(F.transform(x["complaints"], complaint), ";"), F.lit("}"))
    said = lambda c, f: F.array_join(F.transform(c, f), "|").alias(c)
    return documents(d).select(
        "case_id", said("competitors", competitor), said("findings", lambda x: F.concat_ws("=", x["requirement"], x["outcome"], F.coalesce(x["claim_text"], F.lit("-")))), said("counter_evidence", lambda x: F.concat_ws(":", x["type"], x["claim_id"].cast("string"))),
        said("stakeholders", lambda x: F.concat_ws(":", x["role"], x["knowledge"], F.coalesce(x["party"], F.lit("-")))), F.col("assessment.transfer_type").alias("transfer_type"), _joined("unknowns"), said("questions", lambda x: x["question"]),
    )


@registry.query((*READ, "opportunities", "opportunity_types"), "", """
SELECT o.id AS opportunity_id, o.case_id, o.title, c.status, o.status AS opportunity_status, o.evidence_state, coalesce((SELECT string_agg(DISTINCT opportunity_type, ',' ORDER BY opportunity_type) FROM opportunity_types t WHERE t.opportunity_id = o.id), '') AS types, (SELECT count(*) FROM competitors k WHERE k.case_id = o.case_id) AS competitors
FROM opportunities o JOIN research_cases c ON c.id = o.case_id""")
def opportunity_dossiers(d: Domain) -> DataFrame:
    """The documents of opportunities over those of their cases."""
    rows = dossier.opportunity_dossiers(documents(d), d.opportunities, d.opportunity_types)
    return rows.select("opportunity_id", "case_id", "title", "status", "opportunity_status", "evidence_state", F.array_join("opportunity_types", ",").alias("types"), F.size("competitors").cast("long").alias("competitors"))
