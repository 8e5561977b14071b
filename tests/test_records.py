"""Typed case records, passes without evidence, health of pages, and the JSON schema check."""

import json

import pytest
from pyspark.sql import functions as F

from provenant.functions import schema
from provenant.operators import ingestion, records

COMPETITORS = "id long, case_id long, name string, solution_type string, profile_claim_id long, url string, features_json string, incumbent_fix_risk boolean, incumbent_fix_rationale string"
DRAFT = "case_id long, name string, solution_type string, profile_claim_id long, url string, features array<string>, incumbent_fix_risk boolean, incumbent_fix_rationale string, evidence array<struct<evidence_role: string, claim_id: bigint>>"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_a_competitor_keeps_its_id_and_gathers_evidence(spark):
    current = spark.createDataFrame([(3, 1, "Old", "DIY", 9, "u", "[]", None, None), (4, 2, "Old", "DIY", 9, None, "[]", None, None)], COMPETITORS)
    drafts = spark.createDataFrame([(1, " Old ", "SAAS", 10, "HTTP://X.example", [" a", "b", "a", " "], True, " they may ", [("PRICING", 11), ("PRICING", 11)]), (1, "New", "SAAS", 12, None, None, None, None, None)], DRAFT)
    clean = records.cleaned("competitor", drafts)
    assert records.refusals("competitor", clean).count() == 0
    after = records.merged("competitor", current, clean)
    found = {(r["case_id"], r["name"]): r for r in after.collect()}
    assert len(found) == 3 and found[1, "Old"]["id"] == 3 and found[1, "New"]["id"] == 5
    old = found[1, "Old"]
    assert (old["solution_type"], old["profile_claim_id"], old["url"], old["features_json"], old["incumbent_fix_risk"], old["incumbent_fix_rationale"]) == ("SAAS", 10, "http://x.example/", '["a","b"]', True, "they may")
    assert found[2, "Old"]["solution_type"] == "DIY"
    links = spark.createDataFrame([(3, 9, "PROFILE")], "competitor_id long, claim_id long, evidence_role string")
    more = records.evidence("competitor", after, clean, links)
    assert rows(more, "competitor_id", "claim_id") == [(3, 9, "PROFILE"), (3, 10, "PROFILE"), (3, 11, "PRICING"), (5, 12, "PROFILE")]
    again = records.evidence("competitor", records.merged("competitor", after, clean), clean, more)
    assert rows(again, "competitor_id", "claim_id") == rows(more, "competitor_id", "claim_id")


def test_refused_records(spark):
    bad = [(1, " ", "S", 1, None, None, None, None, None), (1, "a", "S", 1, None, None, True, None, None), (1, "b", "S", 1, None, None, None, " ", None), (1, "c", "S", 1, None, None, None, None, None), (1, " c", "S", 2, None, None, None, None, None)]
    found = records.refusals("competitor", records.cleaned("competitor", spark.createDataFrame(bad, DRAFT)))
    assert sorted((json.loads(r["key"])["name"], r["refusal"]) for r in found.collect()) == [("", "a record's text is not empty"), ("a", "a risk and its rationale come together"), ("c", "a record is given once")]
    complaint = spark.createDataFrame([(1, "t", "s", [])], "competitor_id long, complaint_type string, complaint_statement string, factual_claim_ids array<long>")
    assert [r["refusal"] for r in records.refusals("complaint", records.cleaned("complaint", complaint)).collect()] == ["a complaint has evidence"]


def test_the_first_unknown_stands_and_questions_change(spark):
    unknowns = spark.createDataFrame([(1, 1, "how", "first")], "id long, case_id long, statement string, note string")
    asked = spark.createDataFrame([(1, "how", "second"), (1, "when", "third")], "case_id long, statement string, note string")
    assert rows(records.merged("unknown", unknowns, asked), "id") == [(1, 1, "how", "first"), (2, 1, "when", "third")]
    questions = spark.createDataFrame([(1, 1, "who", "x")], "id long, case_id long, question string, rationale string")
    assert rows(records.merged("question", questions, spark.createDataFrame([(1, "who", None)], "case_id long, question string, rationale string")), "id") == [(1, 1, "who", None)]


def test_a_pass_ends_without_evidence_only_with_a_note(spark):
    passes = spark.createDataFrame([(1, "COMPETITION", "PENDING", None, None), (1, "DACH_TRANSFER", "SATISFIED", "EVIDENCE_FOUND", 5)], "case_id long, pass_type string, status string, outcome string, summary_claim_id long")
    note = lambda *r: records.completed_without_evidence(passes, spark.createDataFrame(list(r), "case_id long, pass_type string, note string"))
    after, refused = note((1, "DACH_TRANSFER", "looked twice"))
    assert refused.count() == 0 and rows(after, "pass_type") == [(1, "COMPETITION", "PENDING", None, None, None), (1, "DACH_TRANSFER", "SATISFIED", "NO_EVIDENCE_FOUND", None, "looked twice")]
    assert sorted(r["refusal"] for r in note((1, "COMPETITION", " "), (2, "COMPETITION", "x"))[1].collect()) == ["a result without evidence has a note", "there is no such requirement"]


def test_health_of_a_page(spark):
    posts = [("a", i, None if i == 2 else f"/p/{i}", 1000.0 + 10 * i + (0.5 if i == 9 else 0), i == 3) for i in range(10)] + [("full", i, f"/f/{i}", 5.0, False) for i in range(25)] + [("gone", 0, "/g/0", 7.0, True)]
    checks = [(s, "p", "now", 3, f, m) for s, f, m in (("a", None, None), ("full", None, None), ("gone", None, None), ("none", "SOURCE_NOT_COVERED", "no such"), ("down", "TIMEOUT", "late"))]
    got = {r["source"]: r for r in ingestion.page_health(spark.createDataFrame(posts, "source string, place int, permalink string, created_utc double, removed boolean"), spark.createDataFrame(checks, "source string, provider string, checked_at string, latency_ms long, failure string, message string")).collect()}
    a = got["a"]
    assert (a["access_result"], a["visible_item_count"], a["sample_window_start"], a["latest_visible_item_at"], a["coverage_complete"]) == ("PUBLIC_CONTENT", 8, "1970-01-01T00:16:40+00:00", "1970-01-01T00:18:10.500000+00:00", True)
    assert a["evidence_urls"] == [f"https://www.reddit.com/p/{i}" for i in (0, 1, 4, 5, 6)] and not got["full"]["coverage_complete"]
    assert (got["gone"]["access_result"], got["gone"]["sample_window_start"], got["gone"]["coverage_complete"], got["gone"]["evidence_urls"]) == ("PUBLIC_NO_RECENT", "now", True, [])
    assert [(got[s]["access_result"], got[s]["http_status"], got[s]["sample_window_end"], got[s]["reason"], got[s]["coverage_complete"]) for s in ("none", "down")] == [("SOURCE_NOT_FOUND", 404, None, "no such", False), ("PROVIDER_FAILED", None, None, "late", False)]


def fits(spark, shape, *texts):
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", schema.matches_schema(F.try_parse_json("t"), shape).alias("ok"))
    return [r["ok"] for r in found.orderBy("i").collect()]


@pytest.mark.parametrize(("kind", "good", "bad"), [("integer", ["1", "-0", "9" * 25, "2.0"], ["1.5", '"1"', "true", "null", "1e400"]), ("number", ["1", "1.5", "1e3"], ["true", '"1"']), ("string", ['"é"', '""'], ["1", "null"]), ("boolean", ["true"], ["0", '"true"']), ("null", ["null"], ["0", "[]"]), ("array", ["[]", "[1]"], ["{}"]), ("object", ["{}", '{"a":1}'], ["[]", "x", None])])
def test_types(spark, kind, good, bad):
    assert fits(spark, {"type": kind}, *good, *bad) == [True] * len(good) + [False] * len(bad)


def test_nested_schemas(spark):
    inner = {"type": "object", "properties": {"k": {"type": ["string", "null"], "enum": ["a", None]}}, "required": ["k"], "additionalProperties": False}
    shape = {"type": ["object", "array"], "properties": {"x": inner, "y": {"type": "array", "items": {"type": "array", "items": inner}}}, "required": ["x"], "items": {"type": "integer"}}
    good = ['{"x":{"k":"a"}}', '{"x":{"k":null},"more":1}', '{"x":{"k":"a"},"y":[[],[{"k":"a"},{"k":null}]]}', "[]", "[1,2]"]
    bad = ["{}", '{"x":{}}', '{"x":{"k":"b"}}', '{"x":{"k":"a","l":1}}', '{"x":{"k":"a"},"y":[{"k":"a"}]}', '{"x":{"k":"a"},"y":[[{"k":1}]]}', '[1,"2"]', '"x"']
    assert fits(spark, shape, *good, *bad) == [True] * len(good) + [False] * len(bad)
    assert fits(spark, {"type": "object", "additionalProperties": False}, "{}", '{"a":1}') == [True, False]


def test_endpoints_and_agents(spark):
    urls = {"http://localhost:1/v1": "loopback", "http://[::1]": "loopback", "https://192.168.1.2/": "private_network", "https://api.example/compatible-mode/v1/": "remote_or_unknown", "https://8.8.8.8": "remote_or_unknown", "ftp://localhost": None, "https://u:p@h/": None, "https://h/v2": None, "https://h/?q": None, "": None}
    found = spark.createDataFrame([(u,) for u in urls], "u string").select("u", schema.endpoint_class("u").alias("c")).collect()
    assert {r["u"]: r["c"] for r in found} == urls
    agents = {"study/1.0 (mail: a@b)": True, " a-b/2 (x) ": True, "study (x)": False, "study/1.0": False, "Mozilla/5.0 (x)": False, "reddit/1 (x)": False, "a/1 (Bot Rotation)": False, "": False}
    found = spark.createDataFrame([(a,) for a in agents], "a string").select("a", schema.valid_user_agent(F.col("a")).alias("v")).collect()
    assert {r["a"]: r["v"] for r in found} == agents
