"""The engine's commands over a store of the fixture tables, and the extraction validators."""

import json

import pytest
from pyspark.sql import functions as F

from provenant.engine import Engine
from provenant.functions import text
from provenant.operators import extraction, lifecycle
from provenant.sources.fixtures import TABLES, Domain


@pytest.fixture(scope="module")
def engine(spark, sf_dir, tmp_path_factory):
    made = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}/store")
    domain = Domain(spark, sf_dir)
    made.init({n: domain.table(n) for n in TABLES} | {"inference_cache": spark.createDataFrame([], "identity string, answer string")})
    return made


def test_reads(engine):
    assert engine.stats()["pipeline_runs"] == 3
    assert engine.case_candidates("newest").count() > 0
    assert engine.source_performance("payment-yield", limit=3).count() == 3
    assert engine.budget_plan(total=50, exploration=20, per_source_cap=20, minimum_items=1).count() >= 0
    assert engine.scan_plan(limit=2).count() <= 2 and engine.pilot_plan().count() > 0
    assert engine.integrity_audit().first()["factual_claims"] > 0
    assert engine.policy_audit().count() == engine.acquisition_cost().count() == 1
    assert engine.case_report().filter("evidence is not null").count() > 0
    assert "# Costs" in engine.report("Costs", {"models": engine.model_cost()})


def test_item_text_is_immutable_once_evidence_stands(engine):
    items = engine.table("source_items")
    held = items.join(engine.table("evidence_spans").select(F.col("source_item_id").alias("id")), "id", "left_semi").orderBy("id").limit(1)
    with pytest.raises(ValueError, match="evidence stands on never changes"):
        engine.ingest_items(held.withColumn("raw_text", F.lit("other")).select(items.columns))
    count = items.count()
    engine.ingest_items(held.withColumn("country_code", F.lit("XX")).select(items.columns))
    assert engine.table("source_items").count() == count
    assert engine.table("source_items").join(held.select("id"), "id").first()["country_code"] == "XX"


def test_ingest_jsonl(engine, tmp_path):
    path = tmp_path / "i.jsonl"
    path.write_text(json.dumps({"external_id": "New-1", "text": "hello"}))
    before = engine.table("source_items").agg(F.max("id")).first()[0]
    engine.ingest_jsonl(str(path), 1, "2026-01-01 00:00:00")
    engine.ingest_jsonl(str(path), 1, "2026-02-01 00:00:00")
    got = engine.table("source_items").filter("external_id = 'new-1'").collect()
    assert [(r["id"], r["first_seen_at"], r["last_seen_at"]) for r in got] == [(before + 1, "2026-01-01 00:00:00", "2026-02-01 00:00:00")]
    path.write_text("{}")
    with pytest.raises(ValueError, match="missing or blank"):
        engine.ingest_jsonl(str(path), 1, "x")


def test_cases_move_only_as_allowed(engine, spark):
    cases = engine.table("research_cases")
    opened = cases.filter("status = 'OPEN'").first()["id"]
    with pytest.raises(ValueError, match="invalid transition"):
        engine.transition_cases(spark.createDataFrame([(opened, "COMPLETE")], "id long, status string"))
    with pytest.raises(ValueError, match="no such row"):
        engine.transition_cases(spark.createDataFrame([(-1, "OPEN")], "id long, status string"))


def test_case_creation_opens_four_passes(engine):
    free = engine.table("cluster_members").join(engine.table("research_cases").select("cluster_id"), "cluster_id", "left_anti").first()["cluster_id"]
    engine.create_case(free, "A case")
    assert engine.table("research_passes").filter(F.col("case_id") == free).count() == 4


def test_saving_needs_a_ready_opportunity(engine, spark):
    draft = engine.table("opportunities").filter("status = 'DRAFT'").first()
    if draft:
        with pytest.raises(ValueError, match="report-ready"):
            engine.save(spark.createDataFrame([(draft["id"], "n", "t")], "opportunity_id long, note string, saved_at string"))
    ready = engine.table("saved_opportunities").first()
    engine.save(spark.createDataFrame([(ready["opportunity_id"], "again", "later")], "opportunity_id long, note string, saved_at string"))
    now = engine.table("saved_opportunities").filter(F.col("opportunity_id") == ready["opportunity_id"]).first()
    assert (now["note"], now["saved_at"]) == ("again", ready["saved_at"])
    engine.unsave(ready["opportunity_id"])
    assert engine.table("saved_opportunities").filter(F.col("opportunity_id") == ready["opportunity_id"]).isEmpty()


def test_facts_need_a_span_of_their_observation(engine, spark):
    span = engine.table("evidence_spans").first()
    shape = "id long, observation_id long, claim_kind string, text string, evidence_span_ids array<long>"
    with pytest.raises(ValueError, match="FACT"):
        engine.create_claims(spark.createDataFrame([(10**9, span["observation_id"] + 1, "FACT", "t", [span["id"]])], shape))
    claims, links, refused = lifecycle.create_claims(spark.createDataFrame([(1, span["observation_id"], "FACT", "t", [span["id"]]), (2, None, "ANALYSIS", "t", [])], shape), engine.table("evidence_spans"))
    assert (claims.count(), links.count(), refused.count()) == (2, 1, 0)


def test_health_is_appended_once(spark):
    shape = "source_id long, provider string, checked_at string, status string"
    old = spark.createDataFrame([(1, "p", "t", "A")], shape)
    rows, bad = lifecycle.append_health(old, spark.createDataFrame([(1, "p", "t", "A"), (2, "p", "t", "B")], shape))
    assert rows.count() == 2 and bad.isEmpty()
    assert lifecycle.append_health(old, spark.createDataFrame([(1, "p", "t", "B")], shape))[1].count() == 1


def test_products_and_claims_merge(spark):
    shape = "key string, name string, tagline string, pain_hits string, seen_date string"
    got = lifecycle.merge_products(spark.createDataFrame([("a", "A", "old", "[]", "d1")], shape), spark.createDataFrame([("a", "A2", None, "[x]", "d2"), ("b", "B", "t", "[]", "d2")], shape))
    assert [tuple(r) for r in got.orderBy("key").collect()] == [("a", "A2", "old", "[x]", "d1", False), ("b", "B", "t", "[]", "d2", True)]


TEXT = "We copy 12 invoices by hand every day"


def claim(**more):
    return {"field": "problem_statement", "value": "copy 12 invoices", "start": 3, "end": 19, "excerpt": "copy 12 invoices", "strength": "FIRST_PERSON", "signal_type": "NONE", "quantity_value": None, "quantity_unit": None, "frequency": None} | more


@pytest.mark.parametrize(
    ("kind", "claims", "want"),
    [
        ("WORKFLOW_GAP", [claim()], None), ("NOPE", [claim()], extraction.INVALID), ("WORKFLOW_GAP", [], extraction.UNSUPPORTED), ("WORKFLOW_GAP", [claim(), claim()], extraction.INVALID), ("WORKFLOW_GAP", [claim(excerpt="made up")], extraction.UNSUPPORTED),
        ("WORKFLOW_GAP", [claim(value="13 invoices")], extraction.UNSUPPORTED), ("WORKFLOW_GAP", [claim(strength="VENDOR_CLAIM")], extraction.UNSUPPORTED), ("WORKFLOW_GAP", [claim(signal_type="TIME")], extraction.INVALID),
        ("WORKFLOW_GAP", [claim(), claim(field="quantified_impact", signal_type="TIME", quantity_value="12", quantity_unit="invoices")], None),
        ("WORKFLOW_GAP", [claim(), claim(field="quantified_impact", signal_type="TIME", quantity_value="99", quantity_unit="invoices")], extraction.UNSUPPORTED),
        ("WORKFLOW_GAP", [claim(), claim(field="manual_workaround", signal_type="MANUAL_ENTRY")], None), ("WORKFLOW_GAP", [claim(start=0, end=4)], None),
    ],
)
def test_extraction_answers(spark, kind, claims, want):
    df = spark.createDataFrame([(TEXT, json.dumps({"problem_type": kind, "problem_family": "OTHER", "claims": claims}))], "t string, j string").withColumn("v", F.from_json("j", extraction.EXTRACTION))
    assert df.select(extraction.extraction_failure(F.col("t"), F.col("v.problem_type"), F.col("v.problem_family"), F.col("v.claims"))).first()[0] == want


def test_model_is_asked_only_for_what_is_not_cached(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, raw_text string")
    cache = spark.createDataFrame([("A", "known")], "identity string, answer string")
    got = extraction.answers(items, cache, lambda t: f"asked {t}", F.upper("raw_text"))
    assert sorted((r["id"], r["answer"], r["cached"]) for r in got.collect()) == [(1, "known", True), (2, "asked b", False)]


def test_predictions_become_drafts(spark):
    items = spark.createDataFrame([(1, TEXT)], "id long, raw_text string")
    evidence = "array<struct<start: int, end: int, excerpt: string>>"
    shape = f"source_item_id long, external_id string, is_problem boolean, problem_type string, problem_family string, evidence_scope string, problem string, fields map<string,string>, evidence {evidence}, workarounds array<struct<type: string, description: string, evidence_index: int>>, impact_signals array<struct<type: string, evidence_index: int>>, payment_signals array<struct<type: string, evidence_index: int>>"
    rows = spark.createDataFrame([(1, "x", True, "WORKFLOW_GAP", "OTHER", "GLOBAL", "p", {}, [(3, 7, "copy")], [("CSV", "d", 0), ("CSV", "d", 4)], [], None), (9, "y", False, None, None, None, None, None, None, None, None, None)], shape)
    accepted, refused = extraction.replay_predictions(rows, items)
    assert [tuple(r) for r in refused.collect()] == [(9, "unknown source item")]
    drafts = extraction.observation_drafts(accepted)
    assert drafts["evidence_spans"].count() == 1
    assert sorted(r["has_span"] for r in drafts["workarounds"].collect()) == [False, True]


def test_signature_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, raw_text string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id long, raw_text string")
    c = spark.createDataFrame([(2, "y"), (1, "z")], "id long, raw_text string")
    one, two, three = (extraction.input_signature(x).first()[0] for x in (a, b, c))
    assert one == two != three


def test_gate_and_salvage(spark):
    df = spark.createDataFrame([(True, False, True, "POLICY_BLOCKED")], "a boolean, c boolean, v boolean, r string")
    assert df.select(text.run_gate_reasons(*(F.col(x) for x in "acvr"))).first()[0] == ["provider credentials are not available in the environment", "rights status is POLICY_BLOCKED, not PRODUCTION_APPROVED"]
    answers = ['note\n{"a":1}', "```json\n{\"a\": 1}\n```", 'x {"a": 1} y', "none", ""]
    assert [bool(r[0]) for r in spark.createDataFrame([(x,) for x in answers], "v string").select(text.salvaged_json(F.col("v"))).collect()] == [True, True, True, False, False]


def test_filters_give_all_opportunities_in_order(spark):
    from types import SimpleNamespace

    from provenant.plans import writes

    n = 2500
    found = spark.range(n).select("id", F.lit("t").alias("title"), F.lit("REPORT_READY").alias("status"), F.lit("EMERGING").alias("evidence_state"), (F.col("id") % 7).cast("string").alias("updated_at"))
    kinds = found.select(F.col("id").alias("opportunity_id"), F.lit("WORKFLOW_GAP").alias("opportunity_type"))
    saved = found.select(F.col("id").alias("opportunity_id"), F.lit("n").alias("note"), F.col("updated_at").alias("saved_at"))
    domain = SimpleNamespace(opportunities=found, opportunity_types=kinds, saved_opportunities=saved, research_cases=None, cluster_members=None, problem_observations=None)
    want = sorted(((str(i % 7), i) for i in range(n)), reverse=True)
    got = sorted((r["position"], r["updated_at"], r["id"]) for r in writes.opportunity_filters(domain).collect())
    assert got == [(k, *row) for k, row in enumerate(want, 1)]
    assert sorted((r["position"], r["id"]) for r in writes.saved_list(domain).collect()) == [(k, i) for k, (_, i) in enumerate(want, 1)]
    with pytest.raises(ValueError):
        lifecycle.search_opportunities(found, None, None, None, limit=1001)
