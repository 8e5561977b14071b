"""Queries of two-stage discovery, with a model that is plain arithmetic on a text's length."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions import schema
from provenant.operators import discovery
from provenant.plans.registry import Registry
from provenant.sources.fixtures import Domain

registry = Registry()

SETTINGS = discovery.Settings(provider="arithmetic", model="length", pipeline_version="v1", retry_delay_seconds=0.0, input_usd_per_million="0.15", output_usd_per_million="0.60")


def by_length(request: discovery.Request) -> discovery.Reply:
    """Answers, failures and wrong offsets that the length of a text decides."""
    text, n = request.content, len(request.content)
    if request.stage == discovery.SCREENING:
        if n % 19 == 0:
            raise discovery.CallFailed("TIMEOUT", "no answer in time", input_tokens=n // 8)
        if n % 17 == 0 and request.attempt == 0:
            raise discovery.CallFailed("RATE_LIMITED")
        if n % 23 == 0:
            raise ZeroDivisionError
        pain = n % 3 != 0 and n >= 40
        start = 5 if n % 37 == 0 else 0
        answer = {"decision": "POTENTIAL_PAIN" if pain else "NO_PAIN", "origin": "VENDOR_OR_PROMOTIONAL" if n % 31 == 0 else "PRACTITIONER_EVIDENCE", "reason": "CONCRETE_WORKFLOW" if pain else "OTHER", **({"evidence_start": start, "evidence_end": start + 20, "evidence_excerpt": text[:20]} if pain else dict.fromkeys(("evidence_start", "evidence_end", "evidence_excerpt")))}
        return discovery.Reply("no JSON" if n % 29 == 0 else json.dumps(answer), n // 4, 30)
    if n % 13 == 0 and request.attempt < 2:
        raise discovery.CallFailed("MODEL_UNAVAILABLE")
    claim = lambda name, a, b: {"field": name, "value": "month end" if name == "context" else text[a:b], "start": a, "end": b, "excerpt": text[a:b], "strength": "FIRST_PERSON", "signal_type": "NONE", "quantity_value": None, "quantity_unit": None, "frequency": None}
    claims = [claim("context", 2, 22)] + ([] if n % 11 == 0 else [claim("problem_statement", 0, 20)]) + ([claim("context", 3, 23)] if n % 10 == 4 else [])
    return discovery.Reply(json.dumps({"problem_type": "SUPPORT_QUESTION" if n % 7 == 0 else "WORKFLOW_GAP", "problem_family": "REPORTING", "claims": claims}), n // 4, 100, usage_reported=n % 2 == 0)


#: The same arithmetic in SQL: one row a stage and item, with its attempts and how the last one ended.
ASKED = """
q AS (SELECT id, raw_text AS t, length(raw_text) AS n, substr(raw_text, 1, 20) AS ex FROM source_items WHERE raw_text IS NOT NULL),
s1 AS (SELECT *, n % 3 <> 0 AND n >= 40 AS pain, trim(ex) = '' AS blank, CASE WHEN n % 37 = 0 THEN substr(t, 6, 20) = ex AND n >= 25 ELSE n >= 20 END OR (length(ex) > 0 AND (length(t) - length(replace(t, ex, ''))) / length(ex) = 1) AS exact FROM q),
s AS (SELECT *, CASE WHEN n > 30000 THEN 0 WHEN n % 19 = 0 THEN 3 WHEN n % 17 = 0 THEN 2 ELSE 1 END AS tries,
  CASE WHEN n > 30000 THEN 'CONTENT_TOO_LARGE' WHEN n % 19 = 0 THEN 'TIMEOUT' WHEN n % 23 = 0 THEN 'UNKNOWN_ERROR' WHEN n % 29 = 0 THEN 'INVALID_STRUCTURED_OUTPUT' WHEN pain AND (blank OR NOT exact OR n % 31 = 0) THEN 'EVIDENCE_VALIDATION_FAILED' END AS failure FROM s1),
x AS (SELECT *, CASE WHEN n % 13 = 0 THEN 3 ELSE 1 END AS x_tries, CASE WHEN n % 7 = 0 OR n % 10 = 4 THEN 'INVALID_STRUCTURED_OUTPUT' WHEN trim(substr(t, 3, 20)) = '' OR n % 11 = 0 THEN 'EVIDENCE_VALIDATION_FAILED' END AS x_failure FROM s WHERE failure IS NULL AND pain),
asked AS (
  SELECT id, 'SCREENING' AS stage, n, tries, failure, CASE WHEN failure IN ('TIMEOUT', 'UNKNOWN_ERROR') THEN tries WHEN tries = 0 THEN 0 ELSE tries - (failure IS NULL)::INT END AS failed, CASE WHEN tries = 0 THEN 0 WHEN failure = 'TIMEOUT' THEN 3 * (n // 8) WHEN failure = 'UNKNOWN_ERROR' THEN 0 ELSE n // 4 END AS tin,
    CASE WHEN tries = 0 OR failure IN ('TIMEOUT', 'UNKNOWN_ERROR') THEN 0 ELSE 30 END AS tout, CASE WHEN tries = 0 THEN 0 WHEN failure = 'TIMEOUT' AND n >= 8 THEN 0 WHEN failure = 'TIMEOUT' THEN 3 WHEN failure = 'UNKNOWN_ERROR' THEN tries ELSE tries - 1 END AS unreported FROM s
  UNION ALL SELECT id, 'EXTRACTION', n, x_tries, x_failure, x_tries - (x_failure IS NULL)::INT, n // 4, 100, x_tries - 1 + n % 2 FROM x)"""
COST = "CASE WHEN sum(tin + tout) > 0 THEN CAST(sum(tin * 0.15 + tout * 0.60) / 1000000 AS DOUBLE) END"


def found(d: Domain) -> discovery.Found:
    return discovery.discover(d.source_items.select("id", "raw_text"), by_length, SETTINGS, "run-a")


@registry.query(("source_items",), ASKED, f"""
SELECT id AS source_item_id, stage, CAST(tries AS BIGINT) AS attempts, CAST(failed AS BIGINT) AS failed_attempts, failure AS failure_code, CAST(tin AS BIGINT) AS input_tokens, CAST(tout AS BIGINT) AS output_tokens, CAST(unreported AS BIGINT) AS unreported, {COST} AS cost_usd FROM asked GROUP BY ALL""")
def discovery_attempts(d: Domain) -> DataFrame:
    """The ledger of both stages by identity: attempts, failures, tokens and exact price."""
    return discovery.attempts_by_identity(found(d).ledger).drop("identity_key").withColumn("cost_usd", F.col("cost_usd").cast("double"))


@registry.query(("source_items",), ASKED, """
SELECT s.id AS source_item_id, CASE WHEN failure IS NOT NULL OR x_failure IS NOT NULL THEN 'MODEL_FAILURE' WHEN s.pain THEN 'OBSERVATION' ELSE 'NO_PAIN' END AS status, coalesce(failure, x_failure) AS failure_code FROM s LEFT JOIN (SELECT id, x_failure FROM x) y ON y.id = s.id""")
def discovery_outcomes(d: Domain) -> DataFrame:
    """What became of every item: no pain, an observation, or the model's failure."""
    return found(d).outcomes.drop("cache_hits")


@registry.query(("source_items",), ASKED, f"""
SELECT stage, CAST(sum(tries) AS BIGINT) AS calls, CAST(sum(tries - (tries > 0)::INT) AS BIGINT) AS retries, count(failure) AS failures, count_if(failure = 'EVIDENCE_VALIDATION_FAILED') AS evidence_failures, CAST(sum(unreported) AS BIGINT) AS unreported_usage_calls,
  CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens, {COST} AS cost_usd FROM asked GROUP BY stage""")
def discovery_stages(d: Domain) -> DataFrame:
    """Calls, repeats, failures, tokens and price of each stage."""
    return discovery.stage_totals(found(d).ledger).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@registry.query(("source_items",), ASKED, """
, ok AS (SELECT * FROM x WHERE x_failure IS NULL)
SELECT id AS source_item_id, ex AS problem, 'month end' AS context, 0 AS place, 2 AS "start", 22 AS "end", substr(t, 3, 20) AS excerpt FROM ok UNION ALL SELECT id, ex, 'month end', 1, 0, 20, ex FROM ok""")
def discovery_evidence(d: Domain) -> DataFrame:
    """The evidence of all answers that hold, claim by claim, with the statement and a plain field."""
    rows = found(d).predictions
    return rows.select("source_item_id", "problem", F.col("fields")["context"].alias("context"), F.posexplode("evidence").alias("place", "e")).select("source_item_id", "problem", "context", "place", "e.start", "e.end", "e.excerpt")


#: Nested answers over the conversations: most fit the schema, others miss or add a field, or hold a wrong type deep inside.
ANSWER = """'{"turn":' || CASE WHEN turn % 5 = 3 THEN '"' || CAST(turn AS STRING) || '"' ELSE CAST(turn AS STRING) END || ',"by":{"role":"' || role || '"' || CASE WHEN conv_id % 7 = 0 THEN ',"x":1' ELSE '' END || '},"parts":[' || CASE WHEN conv_id % 4 = 0 THEN '' WHEN conv_id % 4 = 1 THEN '{"n":1.5},{"n":null}' WHEN conv_id % 4 = 2 THEN '{"n":2},{"n":true}' ELSE '{}' END || ']' || CASE WHEN conv_id % 11 = 0 THEN '' ELSE '}' END"""
NESTED = {
    "type": "object", "additionalProperties": False, "required": ["turn", "by"],
    "properties": {
        "turn": {"type": "integer"}, "by": {"type": "object", "additionalProperties": False, "properties": {"role": {"type": "string", "enum": ["user", "assistant"]}}, "required": ["role"]},
        "parts": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": ["number", "null"]}}}},
    },
}


@registry.query((), "", """
SELECT conv_id, turn, coalesce(conv_id % 11 <> 0 AND turn % 5 <> 3 AND conv_id % 7 <> 0 AND role IN ('user', 'assistant') AND conv_id % 4 <> 2, FALSE) AS fits FROM conversations""")
def schema_matches(d: Domain) -> DataFrame:
    """Whether nested answers fit a schema of objects in objects and lists."""
    rows = d.conversations.select("conv_id", "turn", F.expr(ANSWER).alias("answer"))
    return rows.select("conv_id", "turn", schema.matches_schema(F.try_parse_json("answer"), NESTED).alias("fits"))


@registry.query((), """
h AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages)""", """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'loopback' WHEN page_id % 5 = 1 THEN 'private_network' WHEN page_id % 5 = 2 AND host <> '' AND host NOT SIMILAR TO '[0-9.]+' THEN 'remote_or_unknown' WHEN page_id % 5 = 4 THEN 'remote_or_unknown' END AS endpoint_class,
  page_id % 3 = 1 OR (page_id % 3 = 2 AND page_id % 2 = 0) AS valid_agent FROM h""")
def endpoints(d: Domain) -> DataFrame:
    """The class of model endpoints made from the pages' hosts, and which user agents are truthful."""
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    number = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://127.0.0.1:"), (F.col("page_id") % 60000 + 1).cast("string"), F.lit("/v1"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("http://10.1.2."), (F.col("page_id") % 250).cast("string"))).when(F.col("page_id") % 5 == 2, F.concat(F.lit("https://"), host, F.lit("/v1/"))).when(F.col("page_id") % 5 == 3, F.concat(F.lit("https://api.example/v2/"), number)).otherwise(F.lit("https://[2606:4700::1]/compatible-mode/v1"))
    agent = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Mozilla/5.0 (X11) "), number)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("study/1."), number, F.lit(" (mail to us)"))).when(F.col("page_id") % 2 == 0, F.lit(" study-2/2 (a page) ")).otherwise(F.lit("study (no version)"))
    return d.pages.select("page_id", schema.endpoint_class(url).alias("endpoint_class"), schema.valid_user_agent(agent).alias("valid_agent"))
