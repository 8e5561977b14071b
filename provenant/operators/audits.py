"""Audits and guards: every rule is a query for the rows that break it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions.predicates import POLICY_FIELDS, approved, iso_date, missing_policy_fields

Tables = dict[str, DataFrame]


def policy_decisions(sources: DataFrame, items: DataFrame, runs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per used source: counts, missing and invalid policy fields, and readiness."""
    n_items = items.groupBy("source_id").agg(F.count("*").alias("item_count"))
    n_runs = runs.groupBy("source_id").agg(F.count("*").alias("discovery_count"))
    n_spans = spans.join(items.select(F.col("id").alias("source_item_id"), "source_id"), "source_item_id").groupBy("source_id").agg(F.count("*").alias("evidence_span_count"))
    out = sources.withColumnRenamed("id", "source_id")
    for side in (n_items, n_runs, n_spans):
        out = out.join(side, "source_id", "left")
    out = out.fillna(0, ["item_count", "discovery_count", "evidence_span_count"]).filter("item_count > 0 or discovery_count > 0")
    missing = missing_policy_fields({c: F.col(c) for c in POLICY_FIELDS})
    date = F.trim("rights_reviewed_at")
    invalid = F.coalesce(date != "", F.lit(False)) & ~iso_date(date)
    out = out.withColumns({"_missing": missing, "invalid_date": invalid, "commercial_use_approved": approved(F.col("commercial_use_status"))})
    complete = (F.size("_missing") == 0) & ~F.col("invalid_date")
    return out.select(
        "source_id", F.col("name").alias("source_name"), "item_count", "discovery_count", "evidence_span_count", F.array_join("_missing", ",").alias("missing_fields"), "invalid_date", "commercial_use_approved",
        complete.alias("complete"), (complete & F.col("commercial_use_approved")).alias("production_ready"),
    )


def policy_audit(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("source_count"),
        F.count_if("complete").alias("complete_policy_count"),
        F.count_if("production_ready").alias("production_ready_count"),
        F.count_if(F.col("evidence_span_count") > 0).alias("evidence_source_count"),
        F.count_if((F.col("evidence_span_count") > 0) & F.col("production_ready")).alias("display_ready_evidence_source_count"),
        F.count_if(~F.col("complete")).alias("violations"),
    )


def facts(t: Tables) -> DataFrame:
    """Claims that are facts with at least one evidence link."""
    return t["claims"].filter("claim_kind = 'FACT'").join(t["claim_evidence"], F.col("id") == F.col("claim_id"), "left_semi")


def _keys(rows: DataFrame, column: str = "id") -> DataFrame:
    return rows.select(F.col(column).cast("string").alias("key"))


def unsupported_facts(t: Tables) -> DataFrame:
    return _keys(t["claims"].filter("claim_kind = 'FACT'").join(t["claim_evidence"], F.col("id") == F.col("claim_id"), "left_anti"))


def mismatched_claim_links(t: Tables) -> DataFrame:
    c = t["claims"].filter("observation_id is not null").select(F.col("id").alias("claim_id"), F.col("observation_id").alias("claimed"))
    s = t["evidence_spans"].select(F.col("id").alias("evidence_span_id"), "observation_id")
    return _keys(t["claim_evidence"].join(c, "claim_id").join(s, "evidence_span_id").filter(~F.col("observation_id").eqNullSafe(F.col("claimed"))), "claim_id")


def invalid_spans(t: Tables) -> DataFrame:
    i = t["source_items"].select(F.col("id").alias("_item"), "raw_text")
    o = t["problem_observations"].select(F.col("id").alias("_oid"), F.col("source_item_id").alias("_oitem"), F.col("evidence_scope").alias("_oscope"))
    rows = t["evidence_spans"].join(i, F.col("source_item_id") == F.col("_item")).join(o, F.col("observation_id") == F.col("_oid"), "left")
    a, b = F.col("start_offset"), F.col("end_offset")
    bad_text = (a < 0) | (b <= a) | (b > F.length("raw_text")) | (F.col("excerpt") != F.substring(F.col("raw_text"), (a + 1).cast("int"), (b - a).cast("int")))
    bad_owner = F.col("observation_id").isNotNull() & (F.col("_oid").isNull() | (F.col("_oitem") != F.col("source_item_id")) | (F.col("_oscope") != F.col("evidence_scope")))
    return _keys(rows.filter(F.coalesce(bad_text, F.lit(False)) | F.coalesce(bad_owner, F.lit(False))))


def mismatched_signals(table: str) -> Callable[[Tables], DataFrame]:
    def check(t: Tables) -> DataFrame:
        s = t["evidence_spans"].select(F.col("id").alias("_span"), F.col("observation_id").alias("_owner"))
        return _keys(t[table].join(s, F.col("evidence_span_id") == F.col("_span"), "left").filter(~F.col("_owner").eqNullSafe(F.col("observation_id"))))

    return check


def not_fact(table: str, claim: str, key: str, where: str | None = None) -> Callable[[Tables], DataFrame]:
    """Rows whose claim is not a fact with evidence."""

    def check(t: Tables) -> DataFrame:
        rows = t[table] if where is None else t[table].filter(where)
        return _keys(rows.join(facts(t).select(F.col("id").alias("_fact")), F.col(claim) == F.col("_fact"), "left_anti"), key)

    return check


def pass_without(pass_type: str, table: str, outcome: bool = True) -> Callable[[Tables], DataFrame]:
    """Satisfied passes of a type whose case lacks the structured record that they stand on."""

    def check(t: Tables) -> DataFrame:
        rows = t["research_passes"].filter((F.col("pass_type") == pass_type) & (F.col("status") == "SATISFIED"))
        if outcome:
            rows = rows.filter("outcome = 'EVIDENCE_FOUND'")
        return _keys(rows.join(t[table].select(F.col("case_id").alias("_case")), F.col("case_id") == F.col("_case"), "left_anti"), "case_id")

    return check


def incomplete_cases(t: Tables) -> DataFrame:
    """Complete cases that lack what completion asks for."""
    cases = t["research_cases"].filter("status = 'COMPLETE'")
    passes = t["research_passes"].groupBy(F.col("case_id").alias("_c")).agg(
        F.count_if(F.col("status") == "SATISFIED").alias("_satisfied"),
        F.bool_or((F.col("pass_type") == "COMPETITION") & (F.col("outcome") == "EVIDENCE_FOUND")).alias("_competition"),
        F.bool_or((F.col("pass_type") == "COUNTER_EVIDENCE") & (F.col("outcome") == "EVIDENCE_FOUND")).alias("_counter"),
    )
    out = cases.join(passes, F.col("id") == F.col("_c"), "left")
    for table, flag in (("research_unknowns", "_u"), ("validation_questions", "_q"), ("dach_assessments", "_d"), ("competitors", "_k"), ("counter_evidence", "_e")):
        known = t[table].groupBy(F.col("case_id").alias(f"{flag}c")).agg(F.lit(True).alias(flag))
        out = out.join(known, F.col("id") == F.col(f"{flag}c"), "left")
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    clear = t["problem_observations"].filter(filled("actor") & filled("job_to_be_done") & filled("context")).join(t["evidence_spans"].select(F.col("observation_id").alias("_o")), F.col("id") == F.col("_o"), "left_semi")
    clusters = t["cluster_members"].join(clear.select(F.col("id").alias("_o")), F.col("observation_id") == F.col("_o"), "left_semi").groupBy(F.col("cluster_id").alias("_mc")).agg(F.lit(True).alias("_clear"))
    unbacked = t["research_passes"].filter("status = 'SATISFIED' and outcome = 'EVIDENCE_FOUND'").join(facts(t).select(F.col("id").alias("_f")), F.col("summary_claim_id") == F.col("_f"), "left_anti").groupBy(F.col("case_id").alias("_bc")).agg(F.lit(True).alias("_unbacked"))
    out = out.join(clusters, F.col("cluster_id") == F.col("_mc"), "left").join(unbacked, F.col("id") == F.col("_bc"), "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    bad = (F.coalesce("_satisfied", F.lit(0)) != 4) | ~no("_u") | ~no("_q") | ~no("_d") | ~no("_clear") | no("_unbacked") | (no("_competition") & ~no("_k")) | (no("_counter") & ~no("_e"))
    return _keys(out.filter(bad))


def invalid_ready_opportunities(t: Tables) -> DataFrame:
    """Report-ready opportunities without a complete case, a type, or a factual problem claim."""
    ready = t["opportunities"].filter("status = 'REPORT_READY'")
    case = t["research_cases"].filter("status = 'COMPLETE'").select(F.col("id").alias("_case"), F.lit(True).alias("_done"))
    kinds = t["opportunity_types"].groupBy(F.col("opportunity_id").alias("_ot")).agg(F.lit(True).alias("_typed"))
    claims = t["opportunity_claims"].filter("claim_role = 'PROBLEM'").join(facts(t).select(F.col("id").alias("_f")), F.col("claim_id") == F.col("_f"), "left_semi").groupBy(F.col("opportunity_id").alias("_oc")).agg(F.lit(True).alias("_claimed"))
    out = ready.join(case, F.col("case_id") == F.col("_case"), "left").join(kinds, F.col("id") == F.col("_ot"), "left").join(claims, F.col("id") == F.col("_oc"), "left")
    return _keys(out.filter("_done is null or _typed is null or _claimed is null"))


def lacking(rows: str, where: str | None, table: str, on: tuple[str, str], other: str | None = None, key: str = "id") -> Callable[[Tables], DataFrame]:
    """Rows (that meet a condition) without a counterpart (that meets another) in a table."""

    def check(t: Tables) -> DataFrame:
        left = t[rows].filter(where) if where else t[rows]
        right = t[table].filter(other) if other else t[table]
        return _keys(left.join(right.select(F.col(on[1]).alias("_there")), F.col(on[0]) == F.col("_there"), "left_anti"), key)

    return check


#: Guards over committed state, by name.
GUARDS: dict[str, Callable[[Tables], DataFrame]] = {
    "fact_requires_evidence": unsupported_facts,
    "claim_evidence_observation_matches": mismatched_claim_links,
    "evidence_span_valid": invalid_spans,
    "workaround_evidence_matches": mismatched_signals("workarounds"),
    "impact_evidence_matches": mismatched_signals("impact_signals"),
    "payment_evidence_matches": mismatched_signals("payment_signals"),
    "research_pass_fact": not_fact("research_passes", "summary_claim_id", "case_id", "status = 'SATISFIED' and outcome = 'EVIDENCE_FOUND'"),
    "research_pass_dach_assessment": pass_without("DACH_TRANSFER", "dach_assessments", outcome=False),
    "research_pass_competition_inventory": pass_without("COMPETITION", "competitors"),
    "research_pass_counter_evidence": pass_without("COUNTER_EVIDENCE", "counter_evidence"),
    "counter_evidence_fact": not_fact("counter_evidence", "factual_claim_id", "id"),
    "competitor_profile_fact": not_fact("competitors", "profile_claim_id", "id"),
    "observation_revision_evidence_matches": mismatched_signals("observation_revisions"),
    "case_stakeholder_fact": not_fact("case_stakeholders", "factual_claim_id", "case_id", "knowledge = 'KNOWN'"),
    "competitor_evidence_fact": not_fact("competitor_evidence", "claim_id", "competitor_id"),
    "competitor_complaint_fact": not_fact("competitor_complaints", "summary_claim_id", "id"),
    "competitor_complaint_evidence_fact": not_fact("competitor_complaint_evidence", "claim_id", "complaint_id"),
    "research_requirement_fact": not_fact("research_requirements", "satisfied_by_claim_id", "case_id", "status = 'SATISFIED'"),
    "completed_case_keeps_dach_assessment": lacking("research_cases", "status = 'COMPLETE'", "dach_assessments", ("id", "case_id")),
    "opportunity_from_complete_case": lacking("opportunities", None, "research_cases", ("case_id", "id"), "status = 'COMPLETE'"),
    "saved_opportunity_ready": lacking("saved_opportunities", None, "opportunities", ("opportunity_id", "id"), "status = 'REPORT_READY'", "opportunity_id"),
    "research_case_completion": incomplete_cases,
    "opportunity_report_ready": invalid_ready_opportunities,
}


#: The tables that each guard reads, once that is known.
_READ_BY: dict[str, set[str]] = {}


class _Watched(dict):
    """Tables that remember which of them were asked for."""

    def __init__(self, tables: Tables) -> None:
        super().__init__(tables)
        self.asked: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        self.asked.add(name)
        return super().__getitem__(name)


def guarded(t: Tables, changed: set[str] | None = None, only: set[str] | None = None) -> DataFrame | None:
    """``guard, key`` of the rows that break a guard which reads a changed table (any table, if none are named).

    Guards over tables that are not there are left out; None if no guard remains.
    """
    found = []
    for name, check in GUARDS.items():
        if only is not None and name not in only:
            continue
        if name in _READ_BY and (not _READ_BY[name] <= set(t) or (changed is not None and not _READ_BY[name] & changed)):
            continue
        watched = _Watched(t)
        try:
            rows = check(watched)
        except KeyError:
            continue
        _READ_BY[name] = watched.asked
        if changed is None or watched.asked & changed:
            found.append(rows.select(F.lit(name).alias("guard"), "key"))
    return reduce(DataFrame.unionByName, found) if found else None


def guard_violations(t: Tables) -> DataFrame:
    """Guard name and number of rows that break it, for guards that are broken."""
    found = [check(t).select(F.lit(name).alias("guard"), "key") for name, check in GUARDS.items()]
    return reduce(DataFrame.unionByName, found).groupBy("guard").agg(F.count("*").alias("violations"))


def integrity_audit(t: Tables) -> DataFrame:
    """One row of ten counts."""
    signals = reduce(DataFrame.unionByName, (mismatched_signals(n)(t) for n in ("workarounds", "impact_signals", "payment_signals")))
    links = t["claim_evidence"].join(t["claims"].filter("claim_kind = 'FACT'"), F.col("claim_id") == F.col("id"), "left_semi")
    counted = {
        "factual_claims": t["claims"].filter("claim_kind = 'FACT'"),
        "unsupported_factual_claims": unsupported_facts(t),
        "factual_claim_evidence_links": links,
        "mismatched_observation_claim_links": mismatched_claim_links(t),
        "invalid_evidence_spans": invalid_spans(t),
        "mismatched_structured_signal_links": signals,
        "complete_research_cases": t["research_cases"].filter("status = 'COMPLETE'"),
        "invalid_complete_research_cases": incomplete_cases(t),
        "report_ready_opportunities": t["opportunities"].filter("status = 'REPORT_READY'"),
        "invalid_report_ready_opportunities": invalid_ready_opportunities(t),
    }
    rows = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("measure"), "n") for k, df in counted.items()))
    return rows.groupBy().pivot("measure", list(counted)).agg(F.first("n"))


def downgraded_facts(before: DataFrame, after: DataFrame, requirements: DataFrame) -> DataFrame:
    """Claims that were facts, are none now, and satisfy a requirement."""
    was = before.filter("claim_kind = 'FACT'").select("id")
    now = after.filter("claim_kind <> 'FACT'").join(was, "id", "left_semi")
    return now.join(requirements.filter("status = 'SATISFIED'").select(F.col("satisfied_by_claim_id").alias("id")), "id", "left_semi").select("id")


#: Legal moves of case and opportunity states.
CASE_MOVES = {("OPEN", "INVESTIGATING"), ("INVESTIGATING", "REVIEW"), ("REVIEW", "INVESTIGATING"), ("REVIEW", "COMPLETE"), ("OPEN", "REJECTED"), ("INVESTIGATING", "REJECTED"), ("REVIEW", "REJECTED")}
OPPORTUNITY_MOVES = {("DRAFT", "REPORT_READY")}


def illegal_moves(before: DataFrame, after: DataFrame, moves: set[tuple[str, str]], first: str) -> DataFrame:
    """Keys whose state moved where it may not, or that began in another state than ``first``."""
    old = before.select("id", F.col("status").alias("old"))
    both = after.select("id", F.col("status").alias("new")).join(old, "id", "left")
    allowed = F.concat_ws(">", "old", "new").isin(*[f"{a}>{b}" for a, b in moves])
    bad = F.when(F.col("old").isNull(), F.col("new") != first).otherwise((F.col("old") != F.col("new")) & ~allowed)
    return both.filter(bad).select("id", "old", "new")


def changed_after_evidence(before: DataFrame, after: DataFrame, spans: DataFrame) -> DataFrame:
    """Source items whose text changed although evidence stands on it."""
    old = before.select("id", F.col("raw_text").alias("old"))
    changed = after.join(old, "id").filter(~F.col("raw_text").eqNullSafe(F.col("old")))
    return changed.join(spans.select(F.col("source_item_id").alias("id")), "id", "left_semi").select("id")
