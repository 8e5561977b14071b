"""Commands of the engine over a small store: plain observations, records of providers, products, readiness, typed records."""

import json

import pytest
from pyspark.sql import functions as F

from provenant.engine import Engine
from provenant.sources import providers
from provenant.sources.fixtures import Domain

NEEDED = (
    "sources", "source_items", "pipeline_runs", "problem_observations", "evidence_spans", "workarounds", "impact_signals", "payment_signals", "discovery_runs", "discovery_records", "acquisition_records", "claims", "claim_evidence", "research_cases", "research_passes", "competitors",
    "competitor_evidence", "research_unknowns", "source_health_checks",
)
MORE = {"discovery_records": "run_id string, submission_id string, comment_id string, provider string, title string, state string", "source_items": "url string, title string"}


@pytest.fixture(scope="module")
def engine(spark, sf_dir, tmp_path_factory):
    """A store with one source, one item with evidence, one fact, and one open case; else empty tables."""
    made = Engine(spark, f"file://{tmp_path_factory.mktemp('commands')}/store")
    domain = Domain(spark, sf_dir)
    tables = {n: spark.createDataFrame([], ", ".join([*(f"{c} {t}" for c, t in domain.table(n).dtypes), *([MORE[n]] if n in MORE else [])])) for n in NEEDED}
    given = {
        "sources": [{"id": 1, "source_type": "COMMUNITY", "name": "r/books", "normalized_key": "community:books", "lifecycle": "CORE"}],
        "source_items": [{"id": 1, "source_id": 1, "external_id": "e1", "raw_text": "We copy 40 invoices by hand every week, every single week"}],
        "problem_observations": [{"id": 1, "source_item_id": 1, "problem_type": "WORKFLOW_GAP", "problem_family": "REPORTING", "evidence_scope": "GLOBAL", "problem": "copying"}],
        "evidence_spans": [{"id": 1, "source_item_id": 1, "observation_id": 1, "start_offset": 0, "end_offset": 7, "excerpt": "We copy", "evidence_scope": "GLOBAL"}],
        "claims": [{"id": 1, "observation_id": 1, "claim_kind": "FACT", "text": "they copy"}, {"id": 2, "observation_id": 1, "claim_kind": "HYPOTHESIS", "text": "they pay"}],
        "claim_evidence": [{"claim_id": 1, "evidence_span_id": 1}],
        "research_cases": [{"id": 1, "cluster_id": 1, "title": "Case", "status": "OPEN"}],
        "research_passes": [{"case_id": 1, "pass_type": "COUNTER_EVIDENCE", "status": "PENDING"}],
    }
    for name, rows in given.items():
        shape = {c: t for c, t in tables[name].dtypes if c in rows[0]}
        tables[name] = made._fit(spark.createDataFrame([tuple(r[c] for c in shape) for r in rows], ", ".join(f"{c} {t}" for c, t in shape.items())), tables[name])
    made.init(tables)
    return made


def test_plain_observations_need_no_span(engine, spark):
    shape = "source_item_id long, problem_type string, problem_family string, evidence_scope string, problem string, fields_json string"
    plain = lambda fields, problem="typing": spark.createDataFrame([(1, "WORKFLOW_GAP", "REPORTING", "GLOBAL", problem, fields)], shape)
    engine.insert_observations(plain('{"actor":"clerk","switching_intent":true}'))
    row = engine.table("problem_observations").filter("problem = 'typing'").first()
    assert (row["actor"], row["switching_intent"], row["id"]) == ("clerk", True, 2)
    for fields, why in (('{"actor":1}', "wrong type: actor"), ('{"colour":"x"}', "unknown fields: colour"), ("[1]", "must be an object")):
        with pytest.raises(ValueError, match=why):
            engine.insert_observations(plain(fields))
    with pytest.raises(ValueError, match="states its problem"):
        engine.insert_observations(plain(None, " "))


def test_records_of_a_provider_come_in(engine, spark):
    url = "https://www.reddit.com/r/{}/comments/{}/t/"
    feed = spark.createDataFrame([("f1", url.format("books", "zz1"), "Title", "a", "2026-01-01", "own words\n\nin two parts"), ("f2", url.format("books", "zz2"), "Link", "a", None, None)], "id string, url string, title string, author string, published_at string, text string")
    page = providers.normalized(providers.feed_records(feed, F.lit("r/books")), "feed", "2026-01-02T03:04:05Z")
    engine.ingest_records(page, "feed", "new", 1)
    item = engine.table("source_items").filter("external_id = 'reddit:submission:zz1'").first()
    assert item["raw_text"] == "Title\n\nown words\n\nin two parts"
    assert {r["completeness"] for r in engine.table("acquisition_records").collect()} == {"FULL", "METADATA_ONLY"} and engine.table("source_items").filter("external_id like '%zz2'").count() == 0
    elsewhere = providers.normalized(providers.feed_records(feed.withColumn("url", F.lit(url.format("other", "zz3"))), F.lit("r/books")), "feed", "2026-01-02T03:04:05Z")
    with pytest.raises(ValueError, match="does not come from"):
        engine.ingest_records(elsewhere, "feed", "newer", 1)
    assert [r["id"] for r in engine.items(spark.createDataFrame([(1,), (77,)], "id long")).collect()] == [1]


def test_typed_records_stand_on_facts(engine, spark):
    shape = "case_id long, name string, solution_type string, profile_claim_id long"
    engine.record("competitor", spark.createDataFrame([(1, " Rival ", "AGENCY", 1)], shape))
    engine.record("competitor", spark.createDataFrame([(1, "Rival", "FREELANCER", 1)], shape))
    assert [(r["id"], r["name"], r["solution_type"]) for r in engine.table("competitors").collect()] == [(1, "Rival", "FREELANCER")]
    assert [(r["competitor_id"], r["claim_id"], r["evidence_role"]) for r in engine.table("competitor_evidence").collect()] == [(1, 1, "PROFILE")]
    with pytest.raises(ValueError, match="refused: .*fact"):
        engine.record("competitor", spark.createDataFrame([(1, "Guess", "AGENCY", 2)], shape))
    engine.record("unknown", spark.createDataFrame([(1, "how often")], "case_id long, statement string"))
    assert engine.table("research_unknowns").count() == 1
    with pytest.raises(ValueError, match="not empty"):
        engine.record("unknown", spark.createDataFrame([(1, " ")], "case_id long, statement string"))
    with pytest.raises(ValueError, match="has a note"):
        engine.complete_without_evidence(spark.createDataFrame([(1, "COUNTER_EVIDENCE", "")], "case_id long, pass_type string, note string"))


def test_health_of_pages_is_recorded(engine, spark):
    posts = spark.createDataFrame([("r/books", 0, "/p/1", 1000.0, False)], "source string, place int, permalink string, created_utc double, removed boolean")
    checks = spark.createDataFrame([("r/books", "archive", "2026-01-02 03:04:05", 3, None, None)], "source string, provider string, checked_at string, latency_ms long, failure string, message string")
    engine.check_health(posts, checks)
    (row,) = engine.table("source_health_checks").collect()
    assert (row["source_id"], row["access_result"], row["visible_item_count"], row["coverage_complete"], row["has_evidence_url"]) == (1, "PUBLIC_CONTENT", 1, True, True)


def test_products_funnel_and_readiness(engine, spark, tmp_path):
    (tmp_path / "feed.xml").write_text('<feed><entry><id>p1</id><title>Rent book</title><link href="https://x.example"/><published>2026-02-03T00:00:00Z</published><content>For every landlord</content></entry></feed>')
    engine.ingest_launches(str(tmp_path / "feed.xml"))
    assert [(r["key"], r["name"], r["seen_date"]) for r in engine.table("products").collect()] == [("launch:p1", "Rent book", "2026-02-03")]
    (counts,) = engine.funnel(spark.createDataFrame([(1,)], "id long")).collect()
    assert counts["screened"] == 1 and counts["items"] >= 1 and counts["observations"] >= 1
    (tmp_path / "gates.json").write_text(json.dumps({"version": "1", "suites": [{"name": "s", "kind": "k", "minimum_coverage": {"cases": 5}, "minimum_metrics": {"f1": 0.8}}]}))
    told = lambda v: spark.createDataFrame([("s", "f1", v)], "suite string, metric string, value double")
    cases = spark.createDataFrame([("s", "cases", 6.0)], "suite string, metric string, value double")
    assert [(r["gates"], r["failed"], r["ready"]) for r in engine.readiness(cases, told(0.9), str(tmp_path / "gates.json")).collect()] == [(2, 0, True)]
    assert not engine.readiness(cases, told(0.7), str(tmp_path / "gates.json")).first()["ready"]
