"""A whole life of a store: from an empty one over discovery, extraction, clusters and a case to a report-ready opportunity.

Some forty publishes, each checked in full, take many minutes on one machine: set ``RUN_SCENARIO=1`` to run the life.
"""

import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from provenant.engine import Engine
from provenant.sources.fixtures import TABLES, Domain

ANSWERS = "canonical_url string, state string, completeness string, text string, body_complete boolean, retrieved_at string, latency_ms long, cost_usd double"
PAIN = "We copy 40 invoices by hand every week and it costs us 2 hours"


@pytest.fixture(scope="module")
def engine(spark, sf_dir, tmp_path_factory):
    """Empty tables of the fixture's shapes, with the columns that a whole life needs."""
    made = Engine(spark, f"file://{tmp_path_factory.mktemp('life')}/store")
    domain = Domain(spark, sf_dir)
    shapes = {n: ", ".join(f"{c} {t}" for c, t in domain.table(n).dtypes) for n in TABLES}
    shapes["discovery_records"] += ", run_id string, submission_id string, comment_id string, provider string, title string, state string"
    shapes["source_items"] += ", url string, title string"
    shapes["pipeline_runs"] += ", input_count long, output_count long, error string"
    shapes["observation_revisions"] = "id long, observation_id long, field_name string, old_value_json string, new_value_json string, reason string, evidence_span_id long, revision_version string"
    made.init({n: spark.createDataFrame([], s) for n, s in shapes.items()} | {"inference_cache": spark.createDataFrame([], "identity string, answer string")})
    return made


@pytest.mark.skipif(not os.environ.get("RUN_SCENARIO"), reason="many minutes; set RUN_SCENARIO=1")
def test_a_life(engine, spark, tmp_path):
    # sources
    cols = "normalized_key string, name string, lifecycle string, access_method string, commercial_use_status string, retention_rules string, attribution_requirements string, quoting_rules string, deletion_requirements string, rate_limit_notes string, rights_reviewed_at string"
    engine.ingest_sources(spark.createDataFrame([("community:books", "Books", "CORE", *[None] * 8)], cols))
    # discovery and acquisition
    url = "https://www.reddit.com/r/books/comments/ab{}/"
    results = [{"url": url.format(i), "title": f"t{i}", "snippet": None} for i in (1, 2, 1)] + [{"url": "https://elsewhere.example/", "title": "x", "snippet": None}]
    captures = spark.createDataFrame([('site:reddit.com/r/Books ("by hand")', "RESULTS", results, 12, 0.5)], "query string, availability string, results array<struct<url: string, title: string, snippet: string>>, latency_ms long, cost_usd double")
    for _ in range(2):  # the second time nothing is added
        engine.discover(captures, {"work": ("by hand",), "other": ("nothing",)}, "search")
    runs = {r["availability"]: r for r in engine.table("discovery_runs").collect()}
    assert set(runs) == {"RESULTS", "SOURCE_UNAVAILABLE"} and (runs["RESULTS"]["results_returned"], runs["RESULTS"]["urls_discovered"]) == (4, 3)
    assert sorted(r["canonical_url"] for r in engine.table("discovery_records").collect()) == [url.format(1), url.format(2)]
    whole = ("CONTENT_COMPLETE", "FULL", PAIN, True, "2026-01-02T03:04:05Z", 30, 0.25)
    with pytest.raises(ValueError, match="contradicts itself"):
        engine.acquire(spark.createDataFrame([(url.format(1), "CONTENT_COMPLETE", "PARTIAL", "x", True, None, 1, 0.0)], ANSWERS), "archive")
    engine.acquire(spark.createDataFrame([(url.format(1), *whole)], ANSWERS), "archive")
    taken = {r["state"]: r for r in engine.table("acquisition_records").collect()}
    assert set(taken) == {"CONTENT_COMPLETE", "ACQUISITION_FAILED"}
    assert sorted(r["state"] for r in engine.table("discovery_records").collect()) == ["ACQUISITION_FAILED", "CONTENT_COMPLETE"]
    item = engine.table("source_items").collect()
    assert [(r["external_id"], r["raw_text"]) for r in item] == [("reddit:submission:ab1", PAIN)] and taken["CONTENT_COMPLETE"]["source_item_id"] == item[0]["id"]
    # a feed brings the same post (a conflict) and a new one
    post = "struct<canonical: string, submission_id: string, comment_id: string, community: string>"
    page = spark.createDataFrame([((url.format(1), "ab1", None, "books"), "FULL", "t1", "other words", "me", None), ((url.format(3), "ab3", None, "books"), "FULL", "t3", PAIN, "you", None), (None, "PARTIAL", "x", "y", None, None)], f"identity {post}, completeness string, title string, body string, author string, published_at string")
    engine.ingest_feed(page, item[0]["source_id"], "feed", "new")
    items = {r["external_id"]: r for r in engine.table("source_items").collect()}
    assert items["reddit:submission:ab1"]["raw_text"] == PAIN and items["reddit:submission:ab3"]["raw_text"] == f"t3\n\n{PAIN}"
    assert {r["external_id"]: r["conflicts"] for r in engine.table("item_contents").collect()} == {"reddit:submission:ab1": 1, "reddit:submission:ab3": 0}
    # extraction
    first, second = items["reddit:submission:ab1"]["id"], items["reddit:submission:ab3"]["id"]
    line = {"is_problem": True, "problem_type": "WORKFLOW_GAP", "problem_family": "RECONCILIATION", "evidence_scope": "GLOBAL", "problem": "invoices are copied by hand", "fields": {"actor": "clerk", "job_to_be_done": "close the books", "context": "month end", "active_solution_search": "true"}, "impact_signals": [{"type": "TIME", "quantified": True, "value": "2", "unit": "hours", "frequency": "weekly", "evidence_index": 0}]}
    rows = [line | {"source_item_id": first, "external_id": "reddit:submission:ab1", "evidence": [{"start": 3, "end": 19, "excerpt": PAIN[3:19]}]}, line | {"source_item_id": second, "external_id": "reddit:submission:ab3", "evidence": [{"start": 4, "end": 10, "excerpt": f"t3\n\n{PAIN}"[4:10]}]}]
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in [rows[0] | {"evidence": [{"start": 0, "end": 4, "excerpt": "none"}]}]))
    with pytest.raises(ValueError, match="does not match"):
        engine.extract(str(path), "v0")
    assert [(r["status"], r["output_count"]) for r in engine.table("pipeline_runs").collect()] == [("FAILED", 0)] and engine.table("problem_observations").isEmpty()
    path.write_text("\n".join(json.dumps(r) for r in rows))
    run = engine.extract(str(path), "v1")
    assert engine.extract(str(path), "v1") == run  # the same items and version are not extracted twice
    seen = engine.table("problem_observations").orderBy("id").collect()
    assert [(r["actor"], r["active_solution_search"], r["pipeline_run_id"]) for r in seen] == [("clerk", True, run)] * 2
    assert engine.table("evidence_spans").count() == engine.table("impact_signals").count() == 2
    engine.set_family(spark.createDataFrame([(seen[0]["id"], "INTEGRATION", "o2")], "observation_id long, problem_family string, ontology_version string"))
    assert engine.table("problem_observations").filter(F.col("id") == seen[0]["id"]).first()["problem_family"] == "INTEGRATION"
    # clusters keep their ids; a revision takes the membership back
    engine.cluster_exact()
    cluster = engine.table("cluster_members").collect()
    assert len({r["cluster_id"] for r in cluster}) == 1 and len(cluster) == 2
    span = {r["observation_id"]: r["id"] for r in engine.table("evidence_spans").collect()}
    shape = "observation_id long, value string, reason string, evidence_span_id long, revision_version string"
    other = seen[1]["id"]
    with pytest.raises(ValueError, match="another observation"):
        engine.revise(spark.createDataFrame([(other, "week end", "read again", span[seen[0]["id"]], "r1")], shape), "context")
    for _ in range(2):  # a replay changes nothing
        engine.revise(spark.createDataFrame([(other, "week end", "read again", span[other], "r1")], shape), "context")
    audit = engine.table("observation_revisions").collect()
    assert [(r["field_name"], r["old_value_json"], r["new_value_json"]) for r in audit] == [("context", '"month end"', '"week end"')]
    assert [r["observation_id"] for r in engine.table("cluster_members").collect()] == [seen[0]["id"]]
    engine.revise(spark.createDataFrame([(other, "month end", "a slip", span[other], "r2")], shape), "context")
    engine.cluster_exact()
    again = engine.table("cluster_members").collect()
    assert {r["cluster_id"] for r in again} == {cluster[0]["cluster_id"]} and len(again) == 2
    # a case
    case = cluster[0]["cluster_id"]
    engine.create_case(case, "Copied invoices")
    with pytest.raises(ValueError, match="a case stands"):
        engine.revise(spark.createDataFrame([(other, "x", "read", span[other], "r3")], shape), "context")
    with pytest.raises(ValueError, match="not complete"):
        engine.create_opportunity(case, ["WORKFLOW_GAP"])
    draft = "id long, observation_id long, claim_kind string, text string, evidence_span_ids array<long>"
    with pytest.raises(ValueError, match="FACT"):
        engine.create_claims(spark.createDataFrame([(1, None, "FACT", "no span", [])], draft))
    engine.create_claims(spark.createDataFrame([(i, None, "FACT", f"fact {i}", [span[other]]) for i in range(1, 6)], draft))
    engine.put("competitors", spark.createDataFrame([(1, case, "Vendor", "DIRECT_SOFTWARE", 1, None)], "id long, case_id long, name string, solution_type string, profile_claim_id long, pricing string"), ["id"])
    engine.put("counter_evidence", spark.createDataFrame([(1, case, "LOW_IMPACT", 2)], "id long, case_id long, evidence_type string, factual_claim_id long"), ["id"])
    engine.put("dach_assessments", spark.createDataFrame([(case, "DIRECT", "LOCALIZED", "LOCALIZATION_REQUIRED")], "case_id long, actor_equivalence string, workflow_equivalence string, transfer_type string"), ["case_id"])
    engine.put("research_unknowns", spark.createDataFrame([(1, case, "how often")], "id long, case_id long, statement string"), ["id"])
    engine.put("validation_questions", spark.createDataFrame([(1, case, "who pays")], "id long, case_id long, question string"), ["id"])
    with pytest.raises(ValueError, match="refused"):
        engine.put("competitors", spark.createDataFrame([(2, case, " ", "NO_SUCH_TYPE", 1, None)], "id long, case_id long, name string, solution_type string, profile_claim_id long, pricing string"), ["id"])
    kinds = ("WORKAROUND_RESEARCH", "COMPETITION", "DACH_TRANSFER", "COUNTER_EVIDENCE")
    engine.satisfy_passes(spark.createDataFrame([(case, k, "EVIDENCE_FOUND", i + 2) for i, k in enumerate(kinds)], "case_id long, pass_type string, outcome string, summary_claim_id long"))
    for state in ("INVESTIGATING", "REVIEW", "COMPLETE"):
        engine.transition_cases(spark.createDataFrame([(case, state)], "id long, status string"))
    # an opportunity
    opportunity = engine.create_opportunity(case, ["WORKFLOW_GAP", "WORKFLOW_GAP"])
    assert engine.create_opportunity(case, ["INTEGRATION_GAP"], "A better title") == opportunity
    row = engine.table("opportunities").first()
    assert (row["title"], row["status"], row["evidence_state"]) == ("A better title", "DRAFT", "EMERGING")
    assert engine.table("opportunity_types").count() == 2
    roles = {(r["claim_role"], r["claim_id"]) for r in engine.table("opportunity_claims").collect()}
    assert roles == {("PROBLEM", 6), ("SUPPORTING", 2), ("SUPPORTING", 3), ("SUPPORTING", 4), ("CONTRADICTING", 5), ("CONTRADICTING", 2), ("CONTEXT", 1)}
    assert engine.table("claims").filter("id = 6").first()["text"] == "invoices are copied by hand"
    engine.transition_opportunities(spark.createDataFrame([(opportunity, "REPORT_READY")], "id long, status string"))
    with pytest.raises(ValueError, match="ready and stays"):
        engine.create_opportunity(case, ["WORKFLOW_GAP"])
    engine.save(spark.createDataFrame([(opportunity, "watch", "2026-01-01")], "opportunity_id long, note string, saved_at string"))
    assert [r["position"] for r in engine.saved().collect()] == [1]
    assert [r["id"] for r in engine.search(query="INVOICES").collect()] == [opportunity]


def test_products_runs_and_models(engine, spark):
    engine.ingest_products(spark.createDataFrame([("a", "Tool", "freight load board", "2026-01-01")], "key string, name string, tagline string, seen_date string"))
    assert "logistics-freight" in engine.radar_board()
    shape = "id string, provider string, status string, pipeline_run_id string, input_tokens long, output_tokens long, latency_ms long, items_processed int, amount decimal(18,2), currency string"
    row = ("m1", "p", "COMPLETED", None, 1, 2, 3, 4, Decimal(5), "EUR")
    for _ in range(2):
        engine.record_model_runs(spark.createDataFrame([row], shape))
    assert engine.table("model_runs").count() == 1
    with pytest.raises(ValueError, match="other values"):
        engine.record_model_runs(spark.createDataFrame([(*row[:4], 9, *row[5:])], shape))
    with pytest.raises(ValueError, match="come together"):
        engine.record_model_runs(spark.createDataFrame([("m2", *row[1:9], None)], shape))
    assert [(r["status"], r["cost_per_item"]) for r in engine.unit_costs().collect()] == [("AVAILABLE", "1.25")]
    engine.cache_answers(spark.createDataFrame([(2, "k", "late", False), (1, "k", "early", False), (3, "n", None, False)], "id long, identity string, answer string, cached boolean"))
    assert [tuple(r) for r in engine.table("inference_cache").collect()] == [("k", "early")]
    with pytest.raises(ValueError, match="running"):
        engine.finish_runs(spark.createDataFrame([("none", "COMPLETED", 1)], "id string, status string, output_count long"))
    engine.store_metrics("wave-1")
    engine.store_metrics("wave-1")
    assert engine.table("source_metrics").count() == engine.table("sources").count()
