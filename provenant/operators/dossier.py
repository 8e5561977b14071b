"""The whole document of every research case, with its opportunity: nested lists at several levels, built in one grouping.

Every part of a document is an entry of its case: a section, a place in it and a body.
All entries are put together and grouped by case once; lists are then ordered and the
inner ones (a competitor's complaints, a complaint's claims) are found within the row.
A document is one value, as large as its case; cases do not meet each other anywhere.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.text import impact_label, payment_label
from provenant.operators.candidates import evidence_state
from provenant.operators.lifecycle import ROLES

Tables = Mapping[str, DataFrame]

CITATION = "struct<span_id: bigint, observation_id: bigint, source_item_id: bigint, source_id: bigint, source_name: string, url: string, excerpt: string, scope: string, commercial_use_status: string, quoting_rules: string, rights_reviewed_at: string, country_code: string, published_at: string>"
FINDING = "struct<requirement: string, outcome: string, claim_text: string, note: string>"
COMPETITOR = "struct<id: bigint, name: string, url: string, solution_type: string, target_customer: string, market: string, pricing: string, pricing_model: string, features: array<string>, integrations: array<string>, dach_available: boolean, dach_specific: boolean, incumbent_fix_risk: boolean, incumbent_fix_rationale: string, profile_claim_id: bigint>"
COMPLAINT = "struct<id: bigint, competitor_id: bigint, type: string, statement: string, segment: string, frequency: string, summary_claim_id: bigint>"
CLAIM_OF = "struct<of: bigint, claim_id: bigint>"
COUNTER = "struct<id: bigint, type: string, statement: string, claim_id: bigint>"
ASSESSMENT = "struct<actor_equivalence: string, actor_rationale: string, workflow_equivalence: string, workflow_rationale: string, transfer_type: string, transfer_rationale: string, local_evidence_state: string, localization_gaps: array<string>, ecosystem_dependencies: array<string>, regulatory_dependencies: array<string>, switching_barriers: array<string>, buyer_structure: string>"
STAKEHOLDER = "struct<role: string, knowledge: string, party: string, note: string>"
QUESTION = "struct<question: string, rationale: string>"
PROFILE = {"problems": "problem", "actors": "actor", "jobs_to_be_done": "job_to_be_done", "contexts": "context", "tools_used": "tools_used", "stated_workarounds": "current_workaround"}


def _have(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _list(df: DataFrame, name: str) -> Column:
    """A list kept as JSON, or none."""
    return F.from_json(F.col(f"{name}_json"), "array<string>") if f"{name}_json" in df.columns else F.col(name) if name in df.columns else F.array().cast("array<string>")


def entry(rows: DataFrame, section: str, body: Column, by: Column | None = None, at: Column | None = None) -> DataFrame:
    """Entries of a section: ``case_id, section, by, at, body``; they stand in the order of ``by`` and ``at``."""
    return rows.select("case_id", F.lit(section).alias("section"), (F.lit("") if by is None else by).cast("string").alias("by"), (F.lit(0) if at is None else at).cast("long").alias("at"), body.alias("body"))


def _named(df: DataFrame, shape: str, **given: Column) -> Column:
    """A struct of a shape as JSON: the given columns, else those of the same name, else null."""
    fields = [f.strip().split(": ", 1) for f in shape.removeprefix("struct<").removesuffix(">").split(", ")]
    return F.to_json(F.struct(*((given[n] if n in given else _have(df, n)).cast(k).alias(n) for n, k in fields)), {"ignoreNullFields": "false"})


def citations(spans: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Spans with their texts' sources: ``span_id`` and the body of a citation."""
    i = items.select(F.col("id").alias("source_item_id"), "source_id", _have(items, "url").alias("url"), _have(items, "country_code").alias("country_code"), _have(items, "published_at").alias("published_at"))
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), *(_have(sources, c).alias(c) for c in ("commercial_use_status", "quoting_rules", "rights_reviewed_at")))
    rows = spans.select(F.col("id").alias("span_id"), "observation_id", "source_item_id", "excerpt", F.col("evidence_scope").alias("scope")).join(i, "source_item_id").join(s, "source_id")
    return rows.select("span_id", "observation_id", _named(rows, CITATION).alias("body"))


def entries(t: Tables) -> DataFrame:
    """All entries of all cases."""
    cases = t["research_cases"]
    of_case = cases.select(F.col("id").alias("case_id"), "cluster_id").join(t["cluster_members"], "cluster_id").select("case_id", "observation_id")
    observations = of_case.join(t["problem_observations"].withColumnRenamed("id", "observation_id"), "observation_id")
    cited = citations(t["evidence_spans"], t["source_items"], t["sources"])
    passes = t["research_passes"].filter("status = 'SATISFIED'")
    told = t["claims"].select(F.col("id").alias("summary_claim_id"), F.col("text").alias("claim_text"))
    by_pass = passes.join(t["claim_evidence"].withColumnRenamed("claim_id", "summary_claim_id"), "summary_claim_id").select("case_id", F.col("evidence_span_id").alias("span_id")).distinct()
    found = passes.join(told, "summary_claim_id", "left")
    competitors, complaints = t["competitors"], t["competitor_complaints"]
    of_competitor = competitors.select(F.col("id").alias("competitor_id"), "case_id")
    of_complaint = complaints.select(F.col("id").alias("complaint_id"), "competitor_id").join(of_competitor, "competitor_id").select("complaint_id", "case_id")
    counter, stakeholders, assessed, questions = t["counter_evidence"], t["case_stakeholders"], t["dach_assessments"], t["validation_questions"]
    signals = {n: of_case.join(t[n], "observation_id") for n in ("workarounds", "impact_signals", "payment_signals")}
    impact, payment = signals["impact_signals"], signals["payment_signals"]
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    complained = complaints.join(of_competitor, "competitor_id")
    parts = [
        *(entry(observations.filter(F.trim(column) != ""), section, F.trim(column), at=F.col("observation_id")) for section, column in PROFILE.items() if column in observations.columns),
        entry(signals["workarounds"], "workarounds", F.concat_ws(": ", "workaround_type", _have(signals["workarounds"], "description")), by=F.concat_ws("|", "workaround_type", _have(signals["workarounds"], "description"))),
        entry(impact, "impacts", impact_label(F.col("impact_type"), F.col("quantified"), _have(impact, "value"), _have(impact, "unit"), _have(impact, "frequency")), by=F.col("impact_type"), at=F.col("id")),
        entry(payment, "payment_evidence", payment_label(F.col("payment_type"), _have(payment, "amount"), _have(payment, "currency"), _have(payment, "frequency")), by=F.col("payment_type"), at=F.col("id")),
        entry(of_case.join(cited, "observation_id"), "citations", F.col("body"), at=F.col("span_id")),
        entry(by_pass.join(cited, "span_id"), "pass_citations", F.col("body"), at=F.col("span_id")),
        entry(found, "findings", _named(found, FINDING, requirement=F.col("pass_type")), by=F.col("pass_type")),
        entry(competitors, "competitors", _named(competitors, COMPETITOR, features=_list(competitors, "features"), integrations=_list(competitors, "integrations")), by=F.col("name"), at=F.col("id")),
        entry(t["competitor_evidence"].join(of_competitor, "competitor_id"), "competitor_claims", F.to_json(F.struct(F.col("competitor_id").alias("of"), "claim_id")), at=F.col("claim_id")),
        entry(complained, "complaints", _named(complained, COMPLAINT, type=_have(complained, "complaint_type"), statement=F.col("complaint_statement"), segment=_have(complained, "affected_segment"), frequency=_have(complained, "frequency_observed")), at=F.col("id")),
        entry(t["competitor_complaint_evidence"].join(of_complaint, "complaint_id"), "complaint_claims", F.to_json(F.struct(F.col("complaint_id").alias("of"), "claim_id")), at=F.col("claim_id")),
        entry(counter, "counter_evidence", _named(counter, COUNTER, type=F.col("evidence_type"), claim_id=F.col("factual_claim_id")), by=F.col("evidence_type"), at=F.col("id")),
        entry(assessed, "assessment", _named(assessed, ASSESSMENT, **{c: _list(assessed, c) for c in ("localization_gaps", "ecosystem_dependencies", "regulatory_dependencies", "switching_barriers")})),
        entry(stakeholders, "stakeholders", _named(stakeholders, STAKEHOLDER), at=F.when(role > 0, role).otherwise(len(ROLES) + 1), by=F.lit("")),
        entry(t["research_unknowns"], "unknowns", F.col("statement"), at=F.col("id")),
        entry(questions, "questions", _named(questions, QUESTION), at=F.col("id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _evidence_summary(cited: Column, scope: str) -> Column:
    """What the citations of a scope come to."""
    rows = F.filter(cited, lambda c: c["scope"] == scope)
    known = lambda name: F.filter(F.transform(rows, lambda c: F.trim(c[name])), lambda v: v.isNotNull() & (v != ""))
    different = lambda name: F.size(F.array_distinct(F.filter(F.transform(rows, lambda c: c[name]), lambda v: v.isNotNull()))).cast("long")
    dated = F.filter(rows, lambda c: c["published_at"].isNotNull() & (F.trim(c["published_at"]) != ""))
    names = F.transform(F.array_sort(F.array_distinct(F.transform(rows, lambda c: F.struct(F.lower(c["source_name"]).alias("k"), c["source_name"].alias("v"))))), lambda x: x["v"])
    return F.struct(
        F.lit(scope).alias("scope"), different("observation_id").alias("observations"), F.size(rows).cast("long").alias("spans"), different("source_item_id").alias("items"), different("source_id").alias("sources"),
        names.alias("source_names"), F.array_sort(F.array_distinct(F.transform(known("country_code"), F.upper))).alias("countries"), F.size(F.array_distinct(F.transform(dated, lambda c: c["source_item_id"]))).cast("long").alias("dated_items"),
        F.array_min(known("published_at")).alias("earliest"), F.array_max(known("published_at")).alias("latest"),
    )


def case_dossiers(t: Tables) -> DataFrame:
    """One nested row per case; a case without an entry of a section has an empty list there."""
    grouped = entries(t).groupBy("case_id").agg(F.collect_list(F.struct("section", "by", "at", "body")).alias("all"))
    rows = t["research_cases"].select(F.col("id").alias("case_id"), _have(t["research_cases"], "title").alias("title"), "status").join(grouped, "case_id", "left")
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<section: string, by: string, at: bigint, body: string>>"))
    bodies = lambda s: F.transform(F.array_sort(F.filter("all", lambda e: e["section"] == s)), lambda e: e["body"])
    parsed = lambda s, shape: F.transform(bodies(s), lambda b: F.from_json(b, shape))
    rows = rows.withColumn("all", every)
    rows = rows.withColumns(
        {
            **{s: F.array_distinct(bodies(s)) for s in (*PROFILE, "workarounds", "impacts", "payment_evidence", "unknowns")}, "own_citations": parsed("citations", CITATION),
            "citations": F.transform(F.array_distinct(F.concat(bodies("citations"), bodies("pass_citations"))), lambda b: F.from_json(b, CITATION)), "findings": parsed("findings", FINDING), "_competitors": parsed("competitors", COMPETITOR),
            "_competitor_claims": parsed("competitor_claims", CLAIM_OF), "_complaints": parsed("complaints", COMPLAINT), "_complaint_claims": parsed("complaint_claims", CLAIM_OF), "counter_evidence": parsed("counter_evidence", COUNTER),
            "assessment": F.get(parsed("assessment", ASSESSMENT), 0), "stakeholders": parsed("stakeholders", STAKEHOLDER), "questions": parsed("questions", QUESTION),
        }
    )
    claims = lambda table, x, own: F.array_sort(F.array_distinct(F.concat(F.transform(F.filter(table, lambda c: c["of"] == x["id"]), lambda c: c["claim_id"]), F.array(own))))
    complaint = lambda c: F.struct(c["type"].alias("type"), c["statement"].alias("statement"), c["segment"].alias("segment"), c["frequency"].alias("frequency"), claims("_complaint_claims", c, c["summary_claim_id"]).alias("claims"))
    kept = [f.split(": ")[0].strip() for f in COMPETITOR.removeprefix("struct<").removesuffix(">").split(", ")][:-1]
    competitor = lambda x: F.struct(*(x[c].alias(c) for c in kept), claims("_competitor_claims", x, x["profile_claim_id"]).alias("claims"), F.transform(F.filter("_complaints", lambda c: c["competitor_id"] == x["id"]), complaint).alias("complaints"))
    own = F.col("own_citations")
    state = evidence_state(F.exists(own, lambda c: c["scope"] == "GLOBAL"), F.exists(own, lambda c: c["scope"] == "DACH"), F.size(F.array_distinct(F.transform(own, lambda c: c["source_id"]))), F.size(F.array_distinct(F.transform(own, lambda c: c["source_item_id"]))))
    none = F.array().cast("array<string>")
    have = lambda s: F.col(s) if s in rows.columns else none
    return rows.select(
        "case_id", "title", "status", F.when(F.size(own) > 0, state).alias("evidence_state"), *(have(s).alias(s) for s in list(PROFILE)[:-1]), F.when(F.size("workarounds") > 0, F.col("workarounds")).otherwise(have("stated_workarounds")).alias("workarounds"), "impacts", "payment_evidence",
        _evidence_summary(F.col("citations"), "GLOBAL").alias("global_evidence"), _evidence_summary(F.col("citations"), "DACH").alias("dach_evidence"), "citations", "findings", F.transform("_competitors", competitor).alias("competitors"), "counter_evidence", "assessment", "stakeholders", "unknowns", "questions",
    )


def opportunity_dossiers(dossiers: DataFrame, opportunities: DataFrame, types: DataFrame) -> DataFrame:
    """The documents of cases with an opportunity: its id, title, status, types and evidence state take the case's place."""
    kinds = types.groupBy(F.col("opportunity_id").alias("_o")).agg(F.array_sort(F.collect_set("opportunity_type")).alias("opportunity_types"))
    over = opportunities.select(F.col("id").alias("opportunity_id"), "case_id", F.col("title").alias("_title"), F.col("status").alias("opportunity_status"), F.col("evidence_state").alias("_state")).join(kinds, F.col("opportunity_id") == F.col("_o"), "left")
    rows = dossiers.join(over, "case_id")
    return rows.withColumns({"title": F.col("_title"), "evidence_state": F.col("_state"), "opportunity_types": F.coalesce("opportunity_types", F.array().cast("array<string>"))}).drop("_title", "_state", "_o")
