"""The whole documents of cases: nesting, order and the report made of them."""

import pytest

from provenant.operators import dossier
from provenant.plans.dossier import READ
from provenant.sources import reports
from provenant.sources.fixtures import Domain

SHAPES = {
    "research_cases": "id long, cluster_id long, title string, status string", "cluster_members": "cluster_id long, observation_id long", "sources": "id long, name string, commercial_use_status string",
    "problem_observations": "id long, problem string, actor string, job_to_be_done string, context string, tools_used string, current_workaround string", "evidence_spans": "id long, observation_id long, source_item_id long, excerpt string, evidence_scope string",
    "source_items": "id long, source_id long, url string, country_code string, published_at string", "research_passes": "case_id long, pass_type string, status string, outcome string, summary_claim_id long, note string", "claims": "id long, text string",
    "claim_evidence": "claim_id long, evidence_span_id long", "workarounds": "observation_id long, workaround_type string, description string", "impact_signals": "id long, observation_id long, impact_type string, quantified boolean, value string, unit string, frequency string",
    "payment_signals": "id long, observation_id long, payment_type string, amount string, currency string, frequency string", "competitors": "id long, case_id long, name string, solution_type string, features_json string, dach_available boolean, profile_claim_id long",
    "competitor_evidence": "competitor_id long, claim_id long", "competitor_complaints": "id long, competitor_id long, complaint_type string, complaint_statement string, summary_claim_id long", "competitor_complaint_evidence": "complaint_id long, claim_id long",
    "counter_evidence": "id long, case_id long, evidence_type string, statement string, factual_claim_id long", "dach_assessments": "case_id long, actor_equivalence string, transfer_type string, switching_barriers_json string", "case_stakeholders": "case_id long, role string, knowledge string, party string, note string",
    "research_unknowns": "id long, case_id long, statement string", "validation_questions": "id long, case_id long, question string, rationale string",
}
ROWS = {
    "research_cases": [(1, 10, "One", "COMPLETE"), (2, 20, "Empty", "OPEN")], "cluster_members": [(10, 1), (10, 2), (10, 3)], "sources": [(1, "beta", "APPROVED-LIMITED"), (2, "Alpha", "REVIEW")],
    "problem_observations": [(2, "p2", "a", None, " ", "t", "by hand"), (1, " p1 ", "a", "j", "c", None, None), (3, "p1", None, None, None, None, "twice")],
    "evidence_spans": [(5, 1, 1, "said here", "GLOBAL"), (4, 2, 2, "dort", "DACH"), (9, 3, 1, "again", "GLOBAL"), (7, None, 3, "from a pass", "GLOBAL")], "source_items": [(1, 1, "u1", "de", "2026-02"), (2, 2, None, " ", None), (3, 2, "u3", "AT", "2026-01")],
    "research_passes": [(1, "COMPETITION", "SATISFIED", "EVIDENCE_FOUND", 70, None), (1, "DACH_TRANSFER", "PENDING", None, None, None), (1, "COUNTER_EVIDENCE", "SATISFIED", "NO_EVIDENCE_FOUND", None, "looked")], "claims": [(70, "a claim")], "claim_evidence": [(70, 7), (70, 5)],
    "workarounds": [(2, "CSV", "exports"), (1, "CSV", "exports"), (1, "AGENCY", "b")], "impact_signals": [(2, 1, "TIME", True, "2", "hours", "daily"), (1, 2, "MONEY", False, None, None, None)], "payment_signals": [(1, 1, "EXPLICIT_BUDGET", None, None, None)],
    "competitors": [(2, 1, "B", "SAAS", '["f"]', True, 71), (1, 1, "A", "DIY", None, None, 72)], "competitor_evidence": [(2, 75), (2, 71)], "competitor_complaints": [(8, 2, "SPEED", "slow", 74), (6, 2, "PRICE", "dear", 73)], "competitor_complaint_evidence": [(8, 70), (8, 74)],
    "counter_evidence": [(1, 1, "LOW_IMPACT", "small", 70)], "dach_assessments": [(1, "DIRECT", "LOCALIZED", '["law"]')], "case_stakeholders": [(1, "BUYER", "KNOWN", "the office", "n"), (1, "END_USER", "UNKNOWN", None, "m")],
    "research_unknowns": [(2, 1, "later"), (1, 1, "first")], "validation_questions": [(1, 1, "who", None)],
}


@pytest.fixture(scope="module")
def documents(spark):
    tables = {n: spark.createDataFrame(ROWS[n], s) for n, s in SHAPES.items()}
    rows = dossier.case_dossiers(tables)
    over = spark.createDataFrame([(100, 1, "Opportunity", "REPORT_READY", "EMERGING"), (101, 2, "Draft", "DRAFT", "EMERGING")], "id long, case_id long, title string, status string, evidence_state string")
    kinds = spark.createDataFrame([(100, "WORKFLOW_GAP"), (100, "INCUMBENT_GAP")], "opportunity_id long, opportunity_type string")
    return {r["case_id"]: r for r in rows.collect()}, {r["opportunity_id"]: r for r in dossier.opportunity_dossiers(rows, over, kinds).collect()}


def test_lists_stand_in_order_and_once(documents):
    one = documents[0][1]
    assert (one["problems"], one["actors"], one["jobs_to_be_done"], one["contexts"], one["tools_used"]) == (["p1", "p2"], ["a"], ["j"], ["c"], ["t"])
    assert one["workarounds"] == ["AGENCY: b", "CSV: exports"] and one["impacts"] == ["MONEY: qualitative impact recorded", "TIME: 2 hours (daily)"] and one["payment_evidence"] == ["EXPLICIT_BUDGET: amount unknown"]
    assert [c["span_id"] for c in one["citations"]] == [4, 5, 9, 7] and one["evidence_state"] == "CROSS_MARKET"
    assert [(f["requirement"], f["claim_text"], f["note"]) for f in one["findings"]] == [("COMPETITION", "a claim", None), ("COUNTER_EVIDENCE", None, "looked")]
    assert one["unknowns"] == ["first", "later"] and [s["role"] for s in one["stakeholders"]] == ["END_USER", "BUYER"] and one["assessment"]["switching_barriers"] == ["law"]


def test_competitors_hold_complaints_and_claims(documents):
    a, b = documents[0][1]["competitors"]
    assert (a["name"], a["claims"], a["complaints"], b["features"], b["dach_available"]) == ("A", [72], [], ["f"], True)
    assert b["claims"] == [71, 75] and [(c["statement"], c["claims"]) for c in b["complaints"]] == [("dear", [73]), ("slow", [70, 74])]


def test_evidence_is_summed_up_by_scope(documents):
    world, local = documents[0][1]["global_evidence"], documents[0][1]["dach_evidence"]
    assert tuple(world)[1:] == (2, 3, 2, 2, ["Alpha", "beta"], ["AT", "DE"], 2, "2026-01", "2026-02")
    assert tuple(local)[1:] == (1, 1, 1, 1, ["Alpha"], [], 0, None, None)


def test_an_empty_case_has_empty_lists(documents):
    empty = documents[0][2]
    assert empty["evidence_state"] is None and empty["assessment"] is None and empty["global_evidence"]["spans"] == 0
    assert all(empty[c] == [] for c in ("problems", "workarounds", "citations", "findings", "competitors", "unknowns", "questions"))


def test_the_report(documents):
    found = documents[1]
    assert found[100]["title"] == "Opportunity" and found[100]["opportunity_types"] == ["INCUMBENT_GAP", "WORKFLOW_GAP"] and found[100]["evidence_state"] == "EMERGING"
    text = reports.opportunity_document(found[100])
    assert text.count("\n## ") == len(reports.SECTIONS) >= 14
    assert "“said here” — [beta](u1)" in text and "dort" not in text and reports.WITHHELD in text
    assert "B, SPEED: slow (unknown, unknown)" in text and "- law" in text and "NO_EVIDENCE_FOUND — looked" in text and "2026-01 – 2026-02 (2/2 dated)" in text
    assert "dort" in reports.opportunity_document(found[100], internal=True)
    assert "## Wechselhürden" in reports.opportunity_document(found[100], language="de")
    with pytest.raises(ValueError, match="report-ready"):
        reports.opportunity_document(found[101])


def test_over_the_fixture_no_case_is_lost(spark, sf_dir):
    d = Domain(spark, sf_dir)
    assert dossier.case_dossiers({n: d.table(n) for n in READ}).count() == d.research_cases.count()
