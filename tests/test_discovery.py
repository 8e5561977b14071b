"""Two-stage discovery: identities, repeats, the ledger, runs that are interrupted, and frozen holdouts."""

import hashlib
import json
import os
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from provenant.engine import Engine
from provenant.operators import discovery, runs
from provenant.operators.discovery import CallFailed, Reply, Settings
from provenant.sources.fixtures import TABLES, Domain

SETTINGS = Settings(provider="p", model="m", pipeline_version="v1", retry_delay_seconds=0.0, input_usd_per_million="1.5", output_usd_per_million="2")
PAIN = "Every week we copy 40 invoices by hand into the second system, item "


def screen(text, **other):
    return json.dumps({"decision": "POTENTIAL_PAIN", "origin": "PRACTITIONER_EVIDENCE", "reason": "CONCRETE_WORKFLOW", "evidence_start": 0, "evidence_end": 10, "evidence_excerpt": text[:10]} | other)


def claim(field, text, a, b, **other):
    return {"field": field, "value": text[a:b], "start": a, "end": b, "excerpt": text[a:b], "strength": "FIRST_PERSON", "signal_type": "NONE", "quantity_value": None, "quantity_unit": None, "frequency": None} | other


def extraction(text, *claims):
    return json.dumps({"problem_type": "WORKFLOW_GAP", "problem_family": "REPORTING", "claims": [claim("problem_statement", text, 0, 30), *claims]})


def answering(request):
    """Reads what to do from the text: 'fail CODE n' fails n times first."""
    text = request.content
    if text.startswith("fail "):
        _, code, times = text.split()[:3]
        if request.attempt < int(times):
            raise CallFailed(code, "as told", 3, 0)
    if text.startswith("break"):
        raise KeyError("odd")
    if "nothing" in text:
        return Reply(screen(text, decision="NO_PAIN", evidence_start=None, evidence_end=None, evidence_excerpt=None), 10, 5)
    return Reply(screen(text) if request.stage == "SCREENING" else extraction(text), 10, 5, usage_reported=False)


def found(spark, texts, call=answering, settings=SETTINGS, cache=None):
    return discovery.discover(spark.createDataFrame(list(enumerate(texts)), "id long, raw_text string"), call, settings, "r", cache)


def test_identity_is_the_digest_of_sorted_json(spark):
    rows = discovery.keyed(spark.createDataFrame([(7, 'ä "quoted" text')], "id long, raw_text string"), "SCREENING", SETTINGS).collect()
    digest = lambda v: hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    config = digest({"temperature": 0.0, "max_output_tokens_screen": 300, "max_output_tokens_extract": 1800, "max_input_characters": 30000})
    want = digest({
        "source_item_id": 7, "content_hash": hashlib.sha256('ä "quoted" text'.encode()).hexdigest(), "stage": "SCREENING", "pipeline_version": "v1", "prompt_version": "prompt-1", "schema_version": "schema-1", "prompt_hash": digest(SETTINGS.screen_instructions),
        "schema_hash": digest(discovery.SCREEN_SCHEMA), "provider": "p", "model": "m", "endpoint_identity": "p", "model_config_hash": config,
    })
    assert rows[0]["identity_key"] == want


def test_repeats_failures_and_price(spark):
    texts = [PAIN + "0", "nothing here", "fail TIMEOUT 1 " + PAIN, "fail RATE_LIMITED 9 x", "fail CONTENT_TOO_LARGE 1 x", "break", "y" * 30_001, None, ""]
    got = found(spark, texts)
    states = {r["source_item_id"]: (r["status"], r["failure_code"]) for r in got.outcomes.collect()}
    assert states == {
        0: ("OBSERVATION", None), 1: ("NO_PAIN", None), 2: ("OBSERVATION", None), 3: ("MODEL_FAILURE", "RATE_LIMITED"), 4: ("MODEL_FAILURE", "CONTENT_TOO_LARGE"), 5: ("MODEL_FAILURE", "UNKNOWN_ERROR"),
        6: ("MODEL_FAILURE", "CONTENT_TOO_LARGE"), 8: ("MODEL_FAILURE", "EVIDENCE_VALIDATION_FAILED"),
    }
    tries = {(r["source_item_id"], r["stage"]): (r["attempts"], r["failed_attempts"], r["cost_usd"]) for r in discovery.attempts_by_identity(got.ledger).collect()}
    one = Decimal("0.000025")
    assert tries[0, "SCREENING"] == (1, 0, one) and tries[2, "SCREENING"] == (2, 1, one + Decimal("0.0000045")) and tries[2, "EXTRACTION"] == (2, 1, one + Decimal("0.0000045"))
    assert tries[3, "SCREENING"] == (3, 3, Decimal("0.0000135")) and tries[4, "SCREENING"][:2] == (1, 1) and tries[5, "SCREENING"] == (1, 1, None) and tries[6, "SCREENING"] == (0, 0, None)
    (m,) = discovery.run_metrics(got.outcomes, got.ledger).collect()
    assert (m["processed_items"], m["no_pain"], m["valid_observations"], m["inference_failures"], m["evidence_validation_failures"], m["pending"], m["cache_hits"]) == (8, 1, 2, 5, 1, 0, 0)
    assert (m["screening_calls"], m["extraction_calls"], m["retries"]) == (10, 3, 4)


def test_no_price_and_own_model(spark):
    free = Settings(provider="p", model="m", pipeline_version="v1", local_inference=True)
    unknown = Settings(provider="p", model="m", pipeline_version="v1")
    costs = lambda s: {r[0] for r in found(spark, [PAIN], settings=s).ledger.select("cost_usd").collect()}
    assert costs(free) == {Decimal(0)} and costs(unknown) == {None}
    with pytest.raises(ValueError, match="prices"):
        Settings(provider="p", model="m", pipeline_version="v1", input_usd_per_million="1")


def test_answers_are_judged(spark):
    good = PAIN + "7"

    def judged(reply):
        return found(spark, [good], lambda r: Reply(reply(r.content) if r.stage == "SCREENING" else extraction(r.content))).outcomes.first()

    assert judged(lambda t: screen(t))["status"] == "OBSERVATION"
    assert judged(lambda t: screen(t, evidence_start=3, evidence_end=9))["status"] == "OBSERVATION"  # the excerpt occurs once
    assert judged(lambda t: screen(t, evidence_excerpt="e", evidence_start=70, evidence_end=71))["failure_code"] == "EVIDENCE_VALIDATION_FAILED"  # and here more often
    assert judged(lambda t: screen(t, evidence_excerpt=" "))["failure_code"] == "EVIDENCE_VALIDATION_FAILED"
    assert judged(lambda t: screen(t, origin="VENDOR_OR_PROMOTIONAL"))["failure_code"] == "EVIDENCE_VALIDATION_FAILED"
    for odd in ({"reason": "BECAUSE"}, {"more": 1}, {"evidence_start": "0"}, {"decision": None}):
        assert judged(lambda t, odd=odd: screen(t, **odd))["failure_code"] == "INVALID_STRUCTURED_OUTPUT"
    assert judged(lambda t: "[1]")["failure_code"] == "INVALID_STRUCTURED_OUTPUT"


def test_claims_become_predictions(spark):
    more = [claim("actor", PAIN, 11, 13), claim("manual_workaround", PAIN, 14, 18, signal_type="MANUAL_ENTRY"), claim("quantified_impact", PAIN, 19, 30, signal_type="TIME", quantity_value="40", quantity_unit="invoices", frequency="weekly"), claim("payment_evidence", PAIN, 31, 38, signal_type="EMPLOYEE_LABOR"), claim("active_solution_search", PAIN, 42, 48)]
    got = found(spark, [PAIN], lambda r: Reply(screen(r.content) if r.stage == "SCREENING" else extraction(r.content, *more))).predictions.first()
    assert got["fields"] == {"actor": PAIN[11:13], "active_solution_search": "true", "extraction_version": f"v1:{got['identity_key'][:20]}"}
    assert [(e["start"], e["excerpt"]) for e in got["evidence"]] == [(0, PAIN[:30]), *((c["start"], c["excerpt"]) for c in more)]
    assert [(w["type"], w["evidence_index"]) for w in got["workarounds"]] == [("MANUAL_ENTRY", 2)]
    assert [(w["value"], w["unit"], w["frequency"], w["evidence_index"]) for w in got["impact_signals"]] == [("40", "invoices", "weekly", 3)]
    assert [(w["type"], w["amount"], w["evidence_index"]) for w in got["payment_signals"]] == [("EMPLOYEE_LABOR", None, 4)]


def test_the_cache_is_asked_first(spark):
    first = found(spark, [PAIN, "nothing"])
    calls = found(spark, [PAIN, "nothing"], cache=first.cache)
    assert calls.ledger.count() == 0 and {r["cache_hits"] for r in calls.outcomes.collect()} == {1, 2}
    other = found(spark, [PAIN, "nothing"], settings=Settings(provider="p", model="m2", pipeline_version="v1", retry_delay_seconds=0.0), cache=first.cache)
    assert other.ledger.count() == 3


def test_links(spark):
    cache = found(spark, [PAIN, "nothing"]).cache
    key = {(r["source_item_id"], r["stage"]): r["identity_key"] for r in cache.collect()}
    link = lambda *rows: discovery.linked(cache, spark.createDataFrame(list(rows), "identity_key string, observation_id long"))
    after, refused = link((key[0, "EXTRACTION"], 5))
    assert refused.count() == 0 and {r["identity_key"]: r["observation_id"] for r in after.collect()}[key[0, "EXTRACTION"]] == 5
    again, refused = discovery.linked(after, spark.createDataFrame([(key[0, "EXTRACTION"], 6)], "identity_key string, observation_id long"))
    assert refused.count() == 1
    for bad in ((key[1, "SCREENING"], 5), ("unknown", 5)):
        assert link(bad)[1].count() == 1
    assert link((key[0, "EXTRACTION"], 5), (key[0, "EXTRACTION"], 6))[1].count() == 1


def test_steps_move_by_compare_and_set(spark):
    states = runs.planned(spark.createDataFrame([("r", "a", "COMPLETE", None)], runs.STATES), spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c"), ("r", "c")], "run_id string, step string"))
    assert [(r["step"], r["state"]) for r in states.orderBy("step").collect()] == [("a", "COMPLETE"), ("b", "NEW"), ("c", "NEW")]
    asked = [("r", "a", "COMPLETE", "RUNNING", None), ("r", "b", "NEW", "RUNNING", "x"), ("r", "c", "RUNNING", "COMPLETE", None), ("r", "d", "NEW", "RUNNING", None)]
    after, refused = runs.moved(states, spark.createDataFrame(asked, "run_id string, step string, expected string, state string, detail string"))
    assert [(r["step"], r["state"], r["detail"]) for r in after.orderBy("step").collect()] == [("a", "COMPLETE", None), ("b", "RUNNING", "x"), ("c", "NEW", None)]
    assert {r["step"]: r["refusal"] for r in refused.collect()} == {"a": "no legal move", "c": "the step is NEW", "d": "there is no such step"}
    _, two = runs.moved(after, spark.createDataFrame([("r", "b", "RUNNING", "COMPLETE", None), ("r", "b", "RUNNING", "FAILED", None)], "run_id string, step string, expected string, state string, detail string"))
    assert {r["refusal"] for r in two.collect()} == {"several moves of one step"}


@pytest.fixture
def engine(spark, sf_dir, tmp_path):
    """A store with five whole items, one partial one, and else empty tables."""
    made = Engine(spark, f"file://{tmp_path}/store")
    domain = Domain(spark, sf_dir)
    tables = {n: spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in domain.table(n).dtypes)) for n in ("sources", "source_items", "pipeline_runs", "problem_observations", "evidence_spans", "workarounds", "impact_signals", "payment_signals", "model_runs", "discovery_records", "acquisition_records")}
    texts = [PAIN + "0", "nothing to see here", PAIN + "2", "fail TIMEOUT 9 x", PAIN + "4", PAIN + "5"]  # the last is partial
    items = spark.createDataFrame([(i + 1, 1, f"Post:{i}", t) for i, t in enumerate(texts)], "id long, source_id long, external_id string, raw_text string")
    taken = spark.createDataFrame([(i + 1, i + 1, "archive", i + 1, "PARTIAL" if i == 5 else "FULL", "CONTENT_PARTIAL" if i == 5 else "CONTENT_COMPLETE") for i in range(6)], "id long, discovery_id long, provider string, source_item_id long, completeness string, state string")
    found_ = spark.createDataFrame([(i + 1, 1, f"u{i}") for i in range(6)], "id long, source_id long, canonical_url string")
    source = spark.createDataFrame([(1, "COMMUNITY", "s", "community:s", "CORE")], "id long, source_type string, name string, normalized_key string, lifecycle string")
    for name, rows in (("source_items", items), ("acquisition_records", taken), ("discovery_records", found_), ("sources", source)):
        tables[name] = made._fit(rows, tables[name])
    made.init(tables)
    return made


def counting(folder):
    """A model that writes down every call."""

    def call(request):
        with open(os.path.join(folder, f"{hashlib.md5(request.content.encode()).hexdigest()}-{request.stage}-{request.attempt}"), "a") as f:
            f.write("x")
        return answering(request)

    return call


def test_an_interrupted_run_goes_on_and_asks_nothing_twice(engine, tmp_path, monkeypatch):
    folder = tmp_path / "calls"
    folder.mkdir()
    publish, times = engine._publish, Counter()

    def breaking(changes):
        times["publishes"] += 1
        if times["publishes"] in (4, 5):  # in the middle of a stage, after its model was asked
            raise ConnectionError("the driver goes down")
        return publish(changes)

    monkeypatch.setattr(engine, "_publish", breaking)
    for _ in range(2):
        with pytest.raises(ConnectionError):
            engine.discover_problems(counting(folder), SETTINGS, "run", chunks=2)
    (m,) = engine.discover_problems(counting(folder), SETTINGS, "run", chunks=2).collect()
    assert (m["processed_items"], m["valid_observations"], m["no_pain"], m["inference_failures"], m["pending"]) == (5, 3, 1, 1, 0)
    calls = {f: os.path.getsize(folder / f) for f in os.listdir(folder)}
    assert set(calls.values()) == {1} and len(calls) == 4 + 3 + 3  # four screenings, one of three tries, three extractions
    observations = engine.table("problem_observations").collect()
    assert sorted(r["source_item_id"] for r in observations) == [1, 3, 5] and {r["pipeline_run_id"] for r in observations} == {"run"}
    cache = engine.table("structured_inference_cache")
    linked = {r["observation_id"] for r in cache.filter("stage = 'EXTRACTION'").collect()}
    assert linked == {r["id"] for r in observations} and cache.filter("stage = 'SCREENING' and observation_id is not null").count() == 0
    assert engine.table("model_runs").count() == engine.table("structured_inference_attempts").count() == 10
    assert [r["status"] for r in engine.table("pipeline_runs").collect()] == ["COMPLETED"]
    spans = {r["excerpt"] for r in engine.table("evidence_spans").collect()}
    assert spans == {PAIN[:30]}
    # a complete run does nothing; another run finds all answers, and links to what is there
    version = engine.store.versions()[-1]
    engine.discover_problems(counting(folder), SETTINGS, "run", chunks=2)
    assert engine.store.versions()[-1] == version
    (again,) = engine.discover_problems(counting(folder), SETTINGS, "run 2", chunks=1).collect()
    assert (again["cache_hits"], again["screening_calls"], again["valid_observations"]) == (7, 3, 3)  # only the failed item is asked again
    assert engine.table("problem_observations").count() == 3
    state = tmp_path / "out" / "state.json"
    engine.write_run_state("run", str(state))
    assert set(json.loads(state.read_text()).values()) == {"COMPLETE"}


def test_a_holdout_never_asks_for_its_baseline(engine, spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    baseline = spark.createDataFrame([(" post:0",), ("POST:1",)], "external_id string")
    (m,) = engine.holdout_run(baseline, counting(folder), SETTINGS, "hold", most=2).collect()
    assert m["processed_items"] == 2
    asked = {f.split("-")[0] for f in os.listdir(folder)}
    assert asked == {hashlib.md5(t.encode()).hexdigest() for t in (PAIN + "2", "fail TIMEOUT 9 x")}
    with pytest.raises(ValueError, match="unseen"):
        engine.holdout_run(spark.createDataFrame([(f"post:{i}",) for i in range(6)], "external_id string"), answering, SETTINGS, "none")
    with pytest.raises(ValueError, match="whole"):
        engine.discover_problems(answering, SETTINGS, "partial", spark.createDataFrame([(6,)], "id long"))


def test_steps_go_on_after_a_failure(engine, spark):
    done = []

    def work(step):
        done.append(step)
        if step == "b" and done.count("b") == 1:
            raise OSError("no answer")
        return None

    assert engine.run_steps("pilot", ["a", "b", "c"], work) == {"a": "COMPLETE", "b": "FAILED", "c": "COMPLETE"}
    assert engine.run_steps("pilot", ["a", "b", "c"], work) == {"a": "SKIPPED", "b": "COMPLETE", "c": "SKIPPED"}
    assert done == ["a", "b", "c", "b"]
    with pytest.raises(ValueError, match="blocked: no key"):
        engine.run_steps("pilot", ["d"], work, ("no key",))


def test_a_repair_does_not_hide_a_new_violation(engine, spark):
    """As many rows break a rule as before, but others."""
    items = engine.table("source_items")
    broken = lambda i: items.withColumn("source_id", F.when(F.col("id") == i, F.lit(99)).otherwise(F.col("source_id")).cast("long"))
    engine.init({"source_items": broken(1)} | {n: t for n, t in engine.store.tables().items() if n != "source_items"})
    engine._publish({"source_items": broken(1).withColumn("language_code", F.lit("de"))})
    with pytest.raises(ValueError, match="source_id"):
        engine._publish({"source_items": broken(2)})
    engine._publish({"source_items": items})


def test_attempts_are_handed_on_many_at_a_time(monkeypatch):
    import pandas as pd

    from provenant.plans.discovery import SETTINGS, by_length

    n = 300
    items = pd.DataFrame({"source_item_id": range(n), "raw_text": ["x" * i for i in range(n)], "identity_key": [str(i) for i in range(n)]})
    whole = list(discovery.attempted(iter([items[:100], items[100:]]), by_length, discovery.SCREENING, SETTINGS))
    assert len(whole) == 1 and set(whole[0]["source_item_id"]) == set(range(n))
    monkeypatch.setattr(discovery, "HELD_ROWS", 50)
    parts = list(discovery.attempted(iter([items]), by_length, discovery.SCREENING, SETTINGS))
    assert 1 < len(parts) < n and pd.concat(parts, ignore_index=True).drop(columns="latency_ms").equals(whole[0].drop(columns="latency_ms"))
    assert list(discovery.attempted(iter([items[:0]]), by_length, discovery.SCREENING, SETTINGS)) == []
