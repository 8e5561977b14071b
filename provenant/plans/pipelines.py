"""Queries of the extraction, replay, report and streaming-shaped operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions import text
from provenant.operators import extraction, lifecycle
from provenant.plans.registry import Registry
from provenant.sources.fixtures import Domain
from provenant.streaming.ingest import windowed_counts

registry = Registry()

ANSWERS = """answers AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'NO_PAIN' WHEN doc_id % 11 = 0 THEN 'MAYBE' ELSE 'POTENTIAL_PAIN' END AS decision,
  CASE WHEN doc_id % 7 = 0 THEN 'VENDOR_OR_PROMOTIONAL' ELSE 'PRACTITIONER_EVIDENCE' END AS origin, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 3 END AS s, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 13 END AS e,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN substr(text, 30, 25) ELSE substr(text, 4, 10) END AS x FROM documents)"""


@registry.query((), ANSWERS, """
SELECT doc_id, CASE WHEN decision = 'MAYBE' THEN 'INVALID_STRUCTURED_OUTPUT' WHEN (x IS NOT NULL AND NOT found) OR (decision = 'POTENTIAL_PAIN' AND (x IS NULL OR origin = 'VENDOR_OR_PROMOTIONAL')) THEN 'EVIDENCE_VALIDATION_FAILED' END AS failure
FROM (SELECT *, coalesce((length(text) >= 13 AND substr(text, 4, 10) = x) OR (length(x) > 0 AND length(text) - length(replace(text, x, '')) = length(x)), FALSE) AS found FROM answers) t""")
def screen_validation(d: Domain) -> DataFrame:
    """Failure codes of screening answers."""
    n = F.col("doc_id")
    rows = d.documents.select(
        "doc_id", "text", F.when(n % 3 == 0, "NO_PAIN").when(n % 11 == 0, "MAYBE").otherwise("POTENTIAL_PAIN").alias("decision"), F.when(n % 7 == 0, "VENDOR_OR_PROMOTIONAL").otherwise("PRACTITIONER_EVIDENCE").alias("origin"),
        F.when(n % 5 != 0, 3).alias("s"), F.when(n % 5 != 0, 13).alias("e"), F.when(n % 5 == 0, None).when(n % 4 == 0, F.substring("text", 30, 25)).otherwise(F.substring("text", 4, 10)).alias("x"),
    )
    return rows.select("doc_id", extraction.screen_failure(F.col("text"), F.col("decision"), F.col("origin"), F.col("s"), F.col("e"), F.col("x")).alias("failure"))


@registry.query((), "", """
SELECT doc_id + 1 AS source_item_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'a negative prediction carries fields or evidence' END WHEN doc_id % 5 = 0 THEN 'a positive prediction lacks fields or evidence' WHEN doc_id % 7 = 0 AND substr(text, 3, 8) <> 'made up!' THEN 'evidence does not match the source text' END AS failure
FROM documents WHERE length(text) >= 12""")
def prediction_replay(d: Domain) -> DataFrame:
    """Replayed predictions with the reason of refusal."""
    n = F.col("doc_id")
    positive = n % 4 != 0
    evidence = F.array(F.struct(F.lit(2).alias("start"), F.lit(10).alias("end"), F.when(n % 7 == 0, F.lit("made up!")).otherwise(F.substring("text", 3, 8)).alias("excerpt")))
    rows = d.documents.filter(F.length("text") >= 12).select(
        (n + 1).alias("source_item_id"), positive.alias("is_problem"), F.when(positive | (n % 8 == 0), "WORKFLOW_GAP").alias("problem_type"), F.when(positive, "OTHER").alias("problem_family"), F.when(positive, "GLOBAL").alias("evidence_scope"),
        F.when(positive & (n % 5 != 0), "a problem").alias("problem"), F.when(positive, evidence).alias("evidence"),
    )
    items = d.documents.select((n + 1).alias("id"), F.col("text").alias("raw_text"))
    accepted, refused = extraction.replay_predictions(rows, items)
    return accepted.select("source_item_id", F.lit(None).cast("string").alias("failure")).unionByName(refused)


_UP = ", ".join(f"n{k + 1} AS (SELECT CAST(floor(id / 1024.0) AS BIGINT) AS id, sha256(string_agg(id || ':' || h, ',' ORDER BY id, h)) AS h FROM n{k} GROUP BY 1)" for k in range(7))


@registry.query(("source_items",), "", f"""
, n0 AS (SELECT id, sha256('{{"country_code":' || coalesce(to_json(country_code), 'null') || ',"external_id":' || to_json(external_id) || ',"id":' || id || ',"language_code":' || coalesce(to_json(language_code), 'null') || ',"raw_text":' || to_json(raw_text) || ',"source_id":' || source_id || '}}') AS h FROM source_items), {_UP}
SELECT sha256(string_agg(h, ',' ORDER BY h)) AS signature FROM n7""")
def input_signatures(d: Domain) -> DataFrame:
    """The digest of all items, by which an exact repetition of a run is known."""
    return extraction.input_signature(d.source_items)


@registry.query(("acquisition_records",), "", """
, more AS (SELECT discovery_id, provider, CASE WHEN id % 4 = 1 THEN NULL ELSE source_item_id END AS source_item_id, CASE WHEN id % 4 = 3 THEN 'FULL' END AS completeness, 'CONTENT_COMPLETE' AS state FROM acquisition_records WHERE id % 3 = 0 UNION ALL SELECT -discovery_id, provider, NULL, NULL, 'POLICY_BLOCKED' FROM acquisition_records WHERE id % 50 = 1)
SELECT coalesce(n.discovery_id, o.discovery_id) AS discovery_id, coalesce(n.provider, o.provider) AS provider, coalesce(n.source_item_id, o.source_item_id) AS source_item_id, coalesce(n.completeness, o.completeness) AS completeness, coalesce(n.state, o.state) AS state
FROM acquisition_records o FULL JOIN more n ON n.discovery_id = o.discovery_id AND n.provider = o.provider""")
def acquisition_merge(d: Domain) -> DataFrame:
    """Acquisitions after an upsert that keeps what the new rows do not know."""
    cols = ["discovery_id", "provider", "source_item_id", "completeness", "state"]
    now, i = d.acquisition_records, F.col("id")
    more = now.filter(i % 3 == 0).select("discovery_id", "provider", F.when(i % 4 != 1, F.col("source_item_id")).alias("source_item_id"), F.when(i % 4 == 3, "FULL").alias("completeness"), F.lit("CONTENT_COMPLETE").alias("state"))
    new = now.filter(i % 50 == 1).select((-F.col("discovery_id")).alias("discovery_id"), "provider", F.lit(None).cast("long").alias("source_item_id"), F.lit(None).cast("string").alias("completeness"), F.lit("POLICY_BLOCKED").alias("state"))
    return lifecycle.acquisition_upsert(now.select(cols), more.unionByName(new))


REPORT_TABLES = ("research_cases", "cluster_members", "problem_observations", "evidence_spans", "research_passes", "competitors", "counter_evidence", "research_unknowns", "validation_questions")


@registry.query(REPORT_TABLES, "", """
SELECT c.id AS case_id, c.status, (SELECT count(*) FROM cluster_members m JOIN problem_observations o ON o.id = m.observation_id LEFT JOIN evidence_spans e ON e.observation_id = o.id WHERE m.cluster_id = c.cluster_id) AS evidence,
  (SELECT count(*) FROM research_passes p WHERE p.case_id = c.id) AS passes, (SELECT count(*) FROM competitors p WHERE p.case_id = c.id) AS competitors, (SELECT min(name) FROM competitors p WHERE p.case_id = c.id) AS first_competitor,
  (SELECT count(*) FROM counter_evidence p WHERE p.case_id = c.id) AS counter_evidence, (SELECT count(*) FROM research_unknowns p WHERE p.case_id = c.id) AS unknowns, (SELECT count(*) FROM validation_questions p WHERE p.case_id = c.id) AS questions FROM research_cases c""")
def case_report_contents(d: Domain) -> DataFrame:
    """What the nested report of each case holds."""
    rows = lifecycle.case_report(*(d.table(n) for n in REPORT_TABLES))
    sizes = [F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long").alias(c) for c in ("evidence", "passes", "competitors", "counter_evidence", "unknowns", "questions")]
    return rows.select("case_id", "status", *sizes, F.get("competitors", 0)["name"].alias("first_competitor"))


@registry.query((), "", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def event_windows(d: Domain) -> DataFrame:
    """Events by hour and type, by the same plan that a stream runs."""
    rows = windowed_counts(d.events)
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "events", F.round("value", 4).alias("value"))


@registry.query((), "", """
SELECT event_id, CASE WHEN m % 6 = 0 THEN 'rate-limited' WHEN m % 6 = 1 THEN 'quota-exceeded' WHEN m % 6 = 2 THEN 'auth-failed' WHEN m % 6 = 3 THEN 'network' WHEN m % 6 = 4 THEN 'policy-blocked' ELSE 'unknown-error' END AS label,
  '{"k": ' || CAST(m AS VARCHAR) || '}' AS json FROM (SELECT event_id, event_id % 97 AS m FROM events) t""")
def provider_answers(d: Domain) -> DataFrame:
    """Labels of failure messages and the JSON of chatty answers."""
    m = F.col("event_id") % 97
    message = F.element_at(F.array(*(F.lit(x) for x in ("HTTP 429 Too Many Requests", "out of quota today", "Invalid API-key", "ECONNRESET", "Sandbox says no", "boom"))), (m % 6 + 1).cast("int"))
    body = F.concat(F.lit('{"k": '), m.cast("string"), F.lit("}"))
    answer = F.when(m % 3 == 0, F.concat(F.lit("Sure!\n"), body)).when(m % 3 == 1, body).otherwise(F.concat(F.lit("here: "), body, F.lit(" done")))
    return d.events.select("event_id", text.failure_label(message).alias("label"), text.salvaged_json(answer).alias("json"))
