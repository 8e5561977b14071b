"""Benchmark files that cannot be audited are refused; provider records in one form."""

import json

import pytest
from pyspark.sql import functions as F

from provenant.sources import benchmarks, providers, readers

SYNTHETIC = {"origin": "SYNTHETIC", "rights_status": "NOT_APPLICABLE", "source_url": None, "label_method": "UNREVIEWED", "reviewed_by": None, "reviewed_at": None}
PUBLIC = {"origin": "PUBLIC_SOURCE", "rights_status": "APPROVED", "source_url": "https://x.example/a", "label_method": "HUMAN", "reviewed_by": "me", "reviewed_at": "2026-02-28"}
NEGATIVE = {"id": "n", "text": "nothing to see", "is_problem": False, "provenance": SYNTHETIC}
POSITIVE = {"id": "p", "text": "we copy é rows", "is_problem": True, "problem_type": "WORKFLOW_GAP", "problem_family": "REPORTING", "evidence_scope": "GLOBAL", "problem": "copying", "fields": {"actor": "we", "switching_intent": True, "context": None}, "evidence": [{"start": 3, "end": 9, "excerpt": "copy é"}], "provenance": PUBLIC}


def wrong(spark, folder, kind, *cases, **options):
    path = folder / "cases.jsonl"
    path.write_text("\n".join(c if isinstance(c, str) else json.dumps(c) for c in cases), encoding="utf-8")
    parsed = benchmarks.read_benchmark(spark, str(path), kind, **options)
    return sorted((r["number"] or 0, r["problem"]) for r in parsed.errors.collect())


def test_good_detection_cases(spark, tmp_path):
    assert wrong(spark, tmp_path, "detection", NEGATIVE, "", POSITIVE) == []
    rows = readers.require_valid(benchmarks.read_benchmark(spark, str(tmp_path / "cases.jsonl"), "detection"))
    assert {r["metric"]: r["value"] for r in benchmarks.coverage(rows, "detection").collect()} == {"cases": 2, "sourced": 1, "permissioned": 1, "reviewed": 1, "positive": 1, "negative": 1}


@pytest.mark.parametrize(("change", "why"), [
    ({"evidence": [{"start": 3, "end": 9, "excerpt": "copy e"}]}, "an excerpt does not match the text at its offsets"), ({"evidence": [{"start": 3, "end": 99, "excerpt": "copy é"}]}, "an excerpt does not match the text at its offsets"), ({"evidence": []}, "a positive case has evidence"),
    ({"problem": " "}, "a positive case lacks problem"), ({"problem_type": "ODD"}, "problem_type is not known: ODD"), ({"fields": {"actor": 1, "switching_intent": "yes"}}, "fields of a wrong type: actor, switching_intent"), ({"fields": {"zeal": "x"}}, "unknown fields: zeal"), ({"fields": [1]}, "fields must be an object"),
    ({"provenance": PUBLIC | {"source_url": None}}, "a public source has its URL"), ({"provenance": PUBLIC | {"source_url": "x"}}, "source_url is no absolute URL"), ({"provenance": PUBLIC | {"rights_status": "NOT_APPLICABLE"}}, "a sourced case has a rights decision"),
    ({"provenance": PUBLIC | {"reviewed_at": "2026-02-30"}}, "reviewed_at is no ISO date"), ({"provenance": PUBLIC | {"reviewed_by": None}}, "a reviewed label names its reviewer and date"), ({"provenance": PUBLIC | {"label_method": "UNREVIEWED"}}, "an unreviewed label names no reviewer or date"),
    ({"provenance": PUBLIC | {"origin": "ELSEWHERE"}}, "origin, rights_status or label_method is not known"), ({"provenance": {k: v for k, v in PUBLIC.items() if k != "reviewed_at"}}, "provenance has exactly six keys"), ({"provenance": SYNTHETIC | {"source_url": "https://x.example"}}, "a synthetic case has no URL and no rights"),
])
def test_bad_detection_cases(spark, tmp_path, change, why):
    found = wrong(spark, tmp_path, "detection", NEGATIVE, POSITIVE | change)
    assert len(found) == 1 and found[0][0] == 2 and why in found[0][1]


def test_negatives_duplicates_and_empty_files(spark, tmp_path):
    assert wrong(spark, tmp_path, "detection", NEGATIVE | {"fields": {"actor": "x"}}) == [(0, "a detection benchmark has at least 1 cases"), (1, "a negative case has no labels")]
    assert wrong(spark, tmp_path, "detection", NEGATIVE, POSITIVE | {"id": "n"}, NEGATIVE) == [(2, "duplicate id n"), (3, "duplicate id n")]
    assert wrong(spark, tmp_path, "detection", "") == [(0, "a detection benchmark has at least 1 cases")]


def test_other_kinds(spark, tmp_path):
    cluster = {"id": "a", "problem_type": "WORKFLOW_GAP", "problem": "p", "fields": {"actor": "x", "context": None}, "expected_cluster": "c", "provenance": SYNTHETIC}
    assert wrong(spark, tmp_path, "clustering", cluster) == [(0, "a clustering benchmark has at least 2 cases")]
    assert wrong(spark, tmp_path, "clustering", cluster, cluster | {"id": "b", "fields": {"industry": "x"}}) == [(0, "a clustering benchmark has at least 2 cases"), (2, "unknown fields: industry")]
    solution = {"name": "Tool", "solution_type": "AGENCY", "url": None}
    rival = {"id": "a", "evidence_urls": ["https://x.example"], "solutions": [solution], "provenance": SYNTHETIC}
    assert wrong(spark, tmp_path, "competition", rival) == []
    assert wrong(spark, tmp_path, "competition", {"id": "a", "solutions": [solution]}, evidence=False, provenance=False) == []
    assert [w for _, w in wrong(spark, tmp_path, "competition", rival, rival | {"id": "b", "solutions": [solution, solution | {"name": " tool "}], "evidence_urls": []}, rival | {"id": "c", "solutions": [solution | {"solution_type": "MAGIC"}], "evidence_urls": ["x"]})] == ["a solution is named once; evidence_urls must not be empty", "a solution_type is not known; evidence_urls holds what is no absolute URL"]
    transfer = {"id": "a", "evidence_urls": ["https://x.example"], "actor_equivalence": "SIMILAR", "workflow_equivalence": "LOCALIZED", "transfer_type": "UNKNOWN", "local_evidence_state": "NONE_FOUND", "provenance": SYNTHETIC}
    assert wrong(spark, tmp_path, "transfer", transfer, transfer | {"id": "b", "transfer_type": "MAYBE"}) == [(2, "transfer_type is not known: MAYBE")]


def test_predictions_have_typed_fields(spark, tmp_path):
    line = {"source_item_id": 1, "external_id": "e", "is_problem": False, "fields": {"active_solution_search": "yes"}}
    (tmp_path / "p.jsonl").write_text(json.dumps(line))
    with pytest.raises(ValueError, match=r"p\.jsonl:1: fields of a wrong type: active_solution_search"):
        readers.require_valid(readers.read_json(spark, str(tmp_path / "p.jsonl"), "predictions"))


def test_archive_records(spark):
    post = "permalink string, url string, name string, id string, title string, selftext string, is_self boolean, author string, created_utc double, removed_by_category string, retrieved_on double"
    at = "/r/Books/comments/ab{}/t/"
    rows = [(at.format(1), "https://i.example/x.png", "t3_1", "1", "One", "the body", True, "me", 1000.0, None, 5.0), (at.format(2), None, None, "2", None, "[removed]", True, None, None, "moderator", None), (at.format(3), "https://else.example", None, "3", "Link", None, False, "me", 1.0, None, None), ("/r/other/comments/ab4/", None, None, "4", "x", "y", True, None, 1.0, None, None), (None, None, None, "5", "x", "y", True, None, 1.0, None, None)]
    got = providers.normalized(providers.archive_records(spark.createDataFrame(rows, post), F.lit("books")), "archive", "now").collect()
    of = {json.loads(r["provenance_json"])["provider_record_id"]: r for r in got}
    assert (of["t3_1"]["completeness"], of["t3_1"]["text"], of["t3_1"]["published_at"], of["t3_1"]["missing_fields"]) == ("FULL", "One\n\nthe body", "1970-01-01T00:16:40+00:00", [])
    told = json.loads(of["t3_1"]["provenance_json"])
    assert (told["canonical_source_url"], told["archive_retrieved_on"], told["body_complete"], list(told)) == ("https://www.reddit.com/r/books/comments/ab1/", "5", True, sorted(told))
    assert (of["2"]["completeness"], of["2"]["text"], of["2"]["missing_fields"], json.loads(of["2"]["provenance_json"])["removed_or_deleted"]) == ("METADATA_ONLY", None, ["title", "body", "timestamp"], True)
    assert of["3"]["completeness"] == "METADATA_ONLY" and of["3"]["failure"] is None and of["4"]["failure"] == "SOURCE_NOT_COVERED"
    assert (of["5"]["failure"], of["5"]["completeness"], of["5"]["missing_fields"]) == (None, "METADATA_ONLY", ["subreddit", "url"])


def test_feed_and_mention_records(spark):
    url = "https://www.reddit.com/r/books/comments/ab1/t/cd2/"
    feed = spark.createDataFrame([("f1", url, "T", "a", "2026", "own words"), ("f2", url, "T", "a", None, None)], "id string, url string, title string, author string, published_at string, text string")
    got = providers.normalized(providers.feed_records(feed, F.lit("r/books")), "feed", "now").orderBy("completeness").collect()
    assert [(r["completeness"], r["text"], r["missing_fields"]) for r in got] == [("FULL", "T\n\nown words", []), ("METADATA_ONLY", None, ["body", "timestamp"])]
    told = json.loads(got[0]["provenance_json"])
    assert (told["reddit_comment_id"], told["parent_thread_id"], told["provider_query_id"]) == ("cd2", "ab1", None)
    mentions = spark.createDataFrame([(1, url, "t", "snip", "d", None, "en"), (2, None, None, "snip", "d", None, "en")], "resourceId long, url string, title string, snippet string, date string, author string, language string")
    full = spark.createDataFrame([(2, "whole", url, "better")], "resourceId long, fullText string, url string, title string")
    got = providers.normalized(providers.mention_records(mentions, full, F.lit("books"), "q"), "licensed", "now").orderBy("completeness").collect()
    assert [(r["completeness"], r["text"]) for r in got] == [("FULL", "better\n\nwhole"), ("PARTIAL", "t\n\nsnip")]


def test_pages_that_bring_nothing(spark):
    pages = [(200, '{"data":[{"a":1}]}', None), (200, '{"data":[]}', None), (None, None, "PROVIDER_UNAVAILABLE"), (404, "x", "UNKNOWN_ERROR"), (400, "no json", "QUERY_CONFIGURATION_ERROR"), (200, '{"data":[null]}', "INVALID_FEED"), (200, '{"data":null}', "INVALID_FEED"), (200, "", "INVALID_FEED")]
    found = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(pages)], "i int, s int, b string").select("i", providers.page_failure(F.col("s"), F.col("b")).alias("f")).orderBy("i").collect()
    assert [r["f"]["failure"] if r["f"] else None for r in found] == [w for *_, w in pages]


def test_texts_shorter_than_the_excerpt_have_evidence_that_holds(spark, tmp_path):
    from provenant.plans import inputs
    from provenant.sources.fixtures import Domain

    rows = [(8, "A."), (20, ""), (13, "x"), (32, "long enough")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["problem"] for r in inputs.registry.queries()["benchmark_problems"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys((8, 20, 32), "problem_type is not known: NOPE")
