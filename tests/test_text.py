import hashlib
import json
import re
import unicodedata
from urllib.parse import urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenant.functions import predicates, text

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expression(F.col("v")).alias("x")).collect()]


@few
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_identifier_is_nfkc_casefold(spark, values):
    values = [v.replace("\x00", "") for v in values]
    want = [" ".join(unicodedata.normalize("NFKC", v).casefold().split()) or None for v in values]
    assert column(spark, values, text.normalize_identifier) == want


def test_fingerprint_is_the_digest_of_sorted_json(spark):
    rows = [("Ärger-Straße", None, "close!", 'say "x"\\', None), ("", "  ", "a_b", "é", "Zz")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, c string, j string, p string, r string").select(text.fingerprint(*(F.col(c) for c in "acjpr"))).collect()]

    def fold(v):
        return (re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", v).casefold()).strip() or None) if v else None

    want = [hashlib.sha256(json.dumps(dict(actor=fold(a), context=fold(c), job_to_be_done=fold(j), problem=fold(p), root_cause=fold(r)), ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest() for a, c, j, p, r in rows]
    assert got == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://User:pw@EXAMPLE.com:8080/Path?Q=1#frag", "http://example.com:8080/Path?Q=1"), ("https://example.com", "https://example.com/"), ("  https://a.b/c  ", "https://a.b/c"),
        ("ftp://example.com/x", None), ("no url", None), (None, None), ("https://", None),
    ],
)
def test_normalize_url(spark, url, want):
    assert column(spark, [url], text.normalize_url) == [want]


@pytest.mark.parametrize(
    ("url", "canonical", "submission", "comment", "community"),
    [
        ("https://www.reddit.com/r/SaaS/comments/AbC/some_slug/", "https://www.reddit.com/r/saas/comments/abc/", "abc", None, "SaaS"),
        ("https://old.reddit.com/de/r/SaaS/comments/abc/slug/Xy/?utm=1", "https://www.reddit.com/r/saas/comments/abc/_/xy/", "abc", "xy", "SaaS"),
        ("https://redd.it/AbC", "https://www.reddit.com/comments/abc/", "abc", None, None),
        ("https://m.reddit.com/comments/abc/def", "https://www.reddit.com/comments/abc/", "abc", None, None),
        ("https://www.reddit.com/r/a%2Bb/comments/x+y/s", "https://www.reddit.com/r/a+b/comments/x+y/", "x+y", None, "a+b"),
        ("https://example.com/r/a/comments/b", None, None, None, None),
        ("https://www.reddit.com/r/a/comments/", None, None, None, None),
    ],
)
def test_post_identity(spark, url, canonical, submission, comment, community):
    got = column(spark, [url], text.post_identity)[0]
    assert (got and tuple(got)) == (None if canonical is None else (canonical, submission, comment, community))


def test_a_post_identity_splits_its_path_once(spark):
    rows = spark.createDataFrame([("https://reddit.com/comments/a",)], "u string").select(text.post_identity(F.col("u")).alias("p")).select("p.canonical", "p.submission_id", "p.comment_id")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 and plan.count("array_position(") == 1  # one for short links, one for long ones


def test_evidence_is_rescued_only_from_its_single_occurrence(spark):
    rows = [("abc abc xyz", 8, 11, "xyz"), ("abc abc xyz", 0, 3, "xyz"), ("abc abc xyz", 5, 8, "abc"), ("a😀b", 1, 2, "😀"), ("abc", 0, 9, "abc"), ("abc", 0, 1, "")]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "t string, s int, e int, x string").select(text.exact_evidence(F.col("t"), F.col("s"), F.col("e"), F.col("x"))).collect()]
    assert got == [(8, 11), (8, 11), None, (1, 2), (0, 3), None]


def test_small_functions(spark):
    assert column(spark, ["100.5000", "-0", "1200", "0.10"], lambda c: text.decimal_text(c.cast("decimal(20,4)"))) == ["100.5", "0", "1200", "0.1"]
    assert column(spark, [0, 1, 4, 5, 9], text.backoff_seconds, "int") == [90, 180, 1440, 1800, 1800]
    assert column(spark, ["20260918", "2026-09-18", "2026-9-8", "2026-02-30", None], predicates.iso_date) == [True, True, False, False, False]
    assert column(spark, ["approved", " Approved-limited ", "NOT_APPROVED", None], predicates.approved) == [True, True, False, False]
    assert column(spark, ["<p>a &amp; <b>b</b></p><script>x</script>"], text.html_text) == ["a & b"]
    assert column(spark, ["10 EUR and 2,5"], lambda c: text.numbers_grounded(c, F.lit("10 or 2,5"))) == [True]
    assert urlsplit(column(spark, ["http://A.b?x=1"], text.normalize_url)[0]).netloc == "a.b"


def test_identifiers_hold_the_whole_text(spark, sf_dir):
    from provenant.plans.text import registry

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["identifier"] for r in registry.queries()["identifier_nfkc"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    some = [d for d in docs.values() if d["source"] is not None and d["text"] is not None and len(d["text"]) > 100][:20]
    want = column(spark, [f"{d['source']}  Ⅳ {d['text']}" for d in some], text.normalize_identifier)
    assert some and [got[d["doc_id"]] for d in some] == want
