"""Queries of strict inputs: what is wrong with benchmark cases, and provider records in one form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.plans.registry import Registry
from provenant.sources import benchmarks, providers, readers
from provenant.sources.fixtures import Domain

registry = Registry()


@registry.query((), "", """
SELECT doc_id, CASE doc_id % 12 WHEN 2 THEN 'an excerpt does not match the text at its offsets' WHEN 3 THEN 'a positive case lacks problem_family, problem' WHEN 4 THEN 'a negative case has no labels' WHEN 5 THEN 'a public source has its URL' WHEN 6 THEN 'a reviewed label names its reviewer and date' WHEN 7 THEN 'unknown fields: colour'
  WHEN 8 THEN 'problem_type is not known: NOPE' WHEN 9 THEN 'not a JSON object' WHEN 10 THEN 'fields of a wrong type: actor, switching_intent' WHEN 11 THEN 'provenance has exactly six keys' END AS problem FROM documents WHERE text IS NOT NULL AND doc_id % 12 > 1""")
def benchmark_problems(d: Domain) -> DataFrame:
    """What is wrong with labelled cases over the documents: offsets, labels, fields and provenance."""
    k = F.col("doc_id") % 12
    none = F.lit(None).cast("string")
    positive = k.isin(1, 2, 3, 7, 8, 10)
    text = F.concat(F.lit("Case "), F.col("text"))
    evidence = F.when(positive, F.array(F.struct(F.lit(0).alias("start"), F.least(F.lit(8), F.length(text)).alias("end"), F.when(k == 2, "#").otherwise(F.substring(text, 1, 8)).alias("excerpt"))))
    provenance = F.struct(F.when(k == 5, "PUBLIC_SOURCE").otherwise("SYNTHETIC").alias("origin"), F.when(k == 5, "APPROVED").otherwise("NOT_APPLICABLE").alias("rights_status"), none.alias("source_url"), F.when(k == 6, "HUMAN").otherwise("UNREVIEWED").alias("label_method"), none.alias("reviewed_by"), none.alias("reviewed_at"))
    case = F.to_json(
        F.struct(
            F.col("doc_id").cast("string").alias("id"), text.alias("text"), positive.alias("is_problem"), F.when(k == 8, "NOPE").when(positive | (k == 4), "WORKFLOW_GAP").alias("problem_type"), F.when(positive & (k != 3), "REPORTING").alias("problem_family"), F.when(positive, "GLOBAL").alias("evidence_scope"),
            F.when(positive & (k != 3), "copying").alias("problem"), evidence.alias("evidence"), provenance.alias("provenance"),
        ),
        {"ignoreNullFields": "false"},
    )
    fields = F.when(k == 7, '"fields":{"colour":"x","actor":1},').when(k == 10, '"fields":{"actor":1,"context":null,"switching_intent":"yes"},').otherwise("")
    line = F.when(k == 9, "[1]").when(k == 11, F.replace(case, F.lit('"reviewed_by":null,'), F.lit(""))).otherwise(F.concat(F.lit("{"), fields, F.substring(case, 2, 2**31 - 1)))
    lines = d.documents.filter("text is not null").select(line.alias("line"), F.lit("documents").alias("file"), F.col("doc_id").alias("number"))
    errors = readers.parse_json_lines(lines, readers.SPECS["detection"], lambda: benchmarks.problems("detection")).errors
    return errors.select(F.col("number").alias("doc_id"), "problem")


@registry.query((), """
r AS (SELECT doc_id, doc_id % 6 AS k, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 't' || doc_id END AS title, CASE WHEN doc_id % 6 IN (0, 1) THEN trim(text) END AS body, CASE WHEN doc_id % 6 IN (1, 2) THEN 'head' END AS snippet, CASE WHEN doc_id % 6 = 4 THEN NULL ELSE 'a' || doc_id END AS post FROM documents),
n AS (SELECT *, post IS NOT NULL AS there, CASE WHEN body <> '' AND post IS NOT NULL THEN 'FULL' WHEN snippet IS NOT NULL AND post IS NOT NULL THEN 'PARTIAL' ELSE 'METADATA_ONLY' END AS completeness FROM r)""", """
SELECT doc_id, completeness, CASE completeness WHEN 'FULL' THEN concat_ws(chr(10) || chr(10), title, body) WHEN 'PARTIAL' THEN concat_ws(chr(10) || chr(10), title, snippet) END AS text, concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN coalesce(body, '') = '' THEN 'body' END, CASE WHEN NOT there THEN 'subreddit,url' END, 'timestamp') AS missing_fields,
  CASE WHEN there AND k = 5 THEN 'SOURCE_NOT_COVERED' END AS failure, '{"acquired_at":"2026-01-02T03:04:05Z","archive_retrieved_on":null,"body_complete":' || CASE completeness WHEN 'FULL' THEN 'true' ELSE 'false' END || ',"canonical_source_url":' || coalesce('"https://www.reddit.com/r/' || CASE k WHEN 5 THEN 'other' ELSE 'books' END || '/comments/' || post || '/"', 'null') || ',"content_completeness":"' || completeness
  || '","original_platform":"REDDIT","parent_thread_id":null,"provider":"licensed","provider_query_id":"q1","provider_record_id":"' || doc_id || '","raw_retention":"DO_NOT_PERSIST","reddit_comment_id":null,"reddit_submission_id":' || coalesce('"' || post || '"', 'null') || ',"removed_or_deleted":false,"retrieved_at":"2026-01-02T03:04:05Z"}' AS provenance_json FROM n""")
def provider_records(d: Domain) -> DataFrame:
    """Licensed mentions over the documents in one form, with what they lack and where they come from."""
    k = F.col("doc_id") % 6
    url = F.when(k != 4, F.concat(F.lit("https://old.reddit.com/r/"), F.when(k == 5, "Other").otherwise("Books"), F.lit("/comments/A"), F.col("doc_id").cast("string"), F.lit("/slug/?utm=1")))
    none = F.lit(None).cast("string")
    mentions = d.documents.select(F.col("doc_id").alias("resourceId"), url.alias("url"), F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("title"), F.when(k.isin(1, 2), "head").alias("snippet"), none.alias("date"), none.alias("author"), none.alias("language"))
    full = d.documents.filter(k.isin(0, 1)).select(F.col("doc_id").alias("resourceId"), F.col("text").alias("fullText"))
    rows = providers.normalized(providers.mention_records(mentions, full, F.lit("r/books"), "q1"), "licensed", "2026-01-02T03:04:05Z")
    return rows.select(F.get_json_object("provenance_json", "$.provider_record_id").cast("long").alias("doc_id"), "completeness", "text", F.array_join("missing_fields", ",").alias("missing_fields"), "failure", "provenance_json")


@registry.query((), """
p AS (SELECT event_id, event_id % 9 AS k FROM events)""", """
SELECT event_id, CASE k WHEN 0 THEN 'RATE_LIMITED' WHEN 1 THEN 'QUERY_CONFIGURATION_ERROR' WHEN 2 THEN 'PROVIDER_UNAVAILABLE' WHEN 3 THEN 'UNKNOWN_ERROR' WHEN 8 THEN NULL ELSE 'INVALID_FEED' END AS failure,
  CASE k WHEN 0 THEN 'rate limited (429)' WHEN 1 THEN 'no such query' WHEN 2 THEN 'server error (503)' WHEN 3 THEN 'unexpected status (302)' WHEN 4 THEN 'the body is no JSON' WHEN 5 THEN 'the answer is no object' WHEN 6 THEN 'there is no list of data' WHEN 7 THEN 'a record is no object' END AS message FROM p""")
def page_failures(d: Domain) -> DataFrame:
    """Why provider pages bring no records."""
    k = F.col("event_id") % 9
    status = F.when(k == 0, 429).when(k == 1, 400).when(k == 2, 503).when(k == 3, 302).otherwise(200)
    body = F.when(k == 1, '{"error":"no such query"}').when(k == 4, "<html>").when(k == 5, "[1]").when(k == 6, '{"data":{"a":1}}').when(k == 7, '{"data":[{"a":1},2]}').otherwise(F.concat(F.lit('{"data":[{"id":"'), F.col("event_id").cast("string"), F.lit('"}]}')))
    return d.events.select("event_id", providers.page_failure(status, body).alias("f")).select("event_id", "f.failure", "f.message")
