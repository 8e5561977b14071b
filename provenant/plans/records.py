"""Queries of typed case records, of passes without evidence, and of health read from provider pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.operators import ingestion, records
from provenant.plans.registry import Registry
from provenant.sources.fixtures import Domain

registry = Registry()

#: Drafts of each kind over the cases: some name what is there, with other values, others are new.
COMPETITORS = """drafts AS (SELECT c.id AS case_id, ' Vendor ' || v.k AS name, 'MANUAL_SERVICE' AS solution_type, c.id + 2 AS profile_claim_id, CASE WHEN c.id % 3 = 0 THEN 'flat' END AS pricing, c.id + 5 AS more FROM research_cases c, (SELECT 1 AS k UNION ALL SELECT 7) v WHERE c.id % 5 <> 0)"""


def competitor_drafts(d: Domain) -> DataFrame:
    rows = d.research_cases.filter("id % 5 <> 0").select(F.col("id").alias("case_id"), F.explode(F.array(F.lit(1), F.lit(7))).alias("k"))
    evidence = F.array(F.struct(F.lit("PRICING").alias("evidence_role"), (F.col("case_id") + 5).cast("long").alias("claim_id")), F.struct(F.lit("PRICING").alias("evidence_role"), (F.col("case_id") + 5).cast("long").alias("claim_id")))
    drafts = rows.select("case_id", F.concat(F.lit(" Vendor "), F.col("k").cast("string")).alias("name"), F.lit("MANUAL_SERVICE").alias("solution_type"), (F.col("case_id") + 2).alias("profile_claim_id"), F.when(F.col("case_id") % 3 == 0, "flat").alias("pricing"), evidence.alias("evidence"))
    return records.cleaned("competitor", drafts)


@registry.query(("research_cases", "competitors"), COMPETITORS, """
SELECT coalesce(o.case_id, n.case_id) AS case_id, coalesce(o.name, trim(n.name)) AS name, o.id, coalesce(n.solution_type, o.solution_type) AS solution_type, coalesce(n.profile_claim_id, o.profile_claim_id) AS profile_claim_id, CASE WHEN n.case_id IS NOT NULL THEN n.pricing ELSE o.pricing END AS pricing
FROM competitors o FULL JOIN drafts n ON n.case_id = o.case_id AND trim(n.name) = o.name""")
def competitor_records(d: Domain) -> DataFrame:
    """Competitors after drafts by case and name: what is there keeps its id and takes all values; ids of new ones are left out."""
    after = records.merged("competitor", d.competitors, competitor_drafts(d))
    known = d.competitors.select(F.col("id").alias("known"))
    return after.join(known, F.col("id") == F.col("known"), "left").select("case_id", "name", F.col("known").alias("id"), "solution_type", "profile_claim_id", "pricing")


@registry.query(("research_cases", "competitors", "competitor_evidence"), COMPETITORS, """
SELECT k.case_id, k.name, e.claim_id, e.evidence_role FROM competitor_evidence e JOIN competitors k ON k.id = e.competitor_id
UNION SELECT case_id, trim(name), profile_claim_id, 'PROFILE' FROM drafts UNION SELECT case_id, trim(name), more, 'PRICING' FROM drafts""")
def competitor_record_evidence(d: Domain) -> DataFrame:
    """The evidence of all competitors after the drafts, by case and name: absent rows are added, none goes."""
    drafts = competitor_drafts(d)
    after = records.merged("competitor", d.competitors, drafts)
    rows = records.evidence("competitor", after, drafts, d.competitor_evidence)
    return rows.join(after.select(F.col("id").alias("competitor_id"), "case_id", "name"), "competitor_id").select("case_id", "name", "claim_id", "evidence_role")


COMPLAINTS = """old AS (SELECT p.*, 'SPEED' AS complaint_type, CAST(NULL AS VARCHAR) AS affected_segment FROM competitor_complaints p),
drafts AS (SELECT k.id AS competitor_id, 'SPEED' AS complaint_type, CASE WHEN k.id % 2 = 0 THEN 'slow' ELSE 'slow ' || k.id % 4 END AS complaint_statement, 'small shops' AS affected_segment, k.profile_claim_id AS c1, k.profile_claim_id + 3 AS c2 FROM competitors k WHERE k.id % 7 <> 0)"""


def complaint_tables(d: Domain) -> tuple[DataFrame, DataFrame]:
    old = d.competitor_complaints.withColumns({"complaint_type": F.lit("SPEED"), "affected_segment": F.lit(None).cast("string")})
    said = F.when(F.col("id") % 2 == 0, "slow ").otherwise(F.concat(F.lit("slow "), (F.col("id") % 4).cast("string")))
    claims = F.array(F.col("profile_claim_id").cast("long"), (F.col("profile_claim_id") + 3).cast("long"))
    return old, records.cleaned("complaint", d.competitors.filter("id % 7 <> 0").select(F.col("id").alias("competitor_id"), F.lit("SPEED").alias("complaint_type"), said.alias("complaint_statement"), F.lit("small shops").alias("affected_segment"), claims.alias("factual_claim_ids")))


@registry.query(("competitors", "competitor_complaints", "competitor_complaint_evidence"), COMPLAINTS, """
, parents AS (SELECT coalesce(o.competitor_id, n.competitor_id) AS competitor_id, coalesce(o.complaint_statement, n.complaint_statement) AS complaint_statement, o.id, CASE WHEN n.c1 IS NOT NULL THEN n.affected_segment ELSE o.affected_segment END AS affected_segment, coalesce(n.c1, o.summary_claim_id) AS summary_claim_id, n.c1, n.c2
  FROM old o FULL JOIN drafts n ON n.competitor_id = o.competitor_id AND n.complaint_type = o.complaint_type AND n.complaint_statement = o.complaint_statement),
e AS (SELECT p.competitor_id, p.complaint_statement, x.claim_id FROM parents p JOIN competitor_complaint_evidence x ON x.complaint_id = p.id UNION SELECT competitor_id, complaint_statement, c1 FROM parents WHERE c1 IS NOT NULL UNION SELECT competitor_id, complaint_statement, c2 FROM parents WHERE c2 IS NOT NULL)
SELECT p.competitor_id, p.complaint_statement, p.id, p.affected_segment, p.summary_claim_id, (SELECT string_agg(e.claim_id, ',' ORDER BY e.claim_id) FROM e WHERE e.competitor_id = p.competitor_id AND e.complaint_statement = p.complaint_statement) AS claims FROM parents p""")
def complaint_records(d: Domain) -> DataFrame:
    """Complaints after drafts, each with all its claims."""
    old, drafts = complaint_tables(d)
    after = records.merged("complaint", old, drafts)
    proofs = records.evidence("complaint", after, drafts, d.competitor_complaint_evidence).groupBy(F.col("complaint_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("claim_id")), ",").alias("claims"))
    known = old.select(F.col("id").alias("known"))
    return after.join(proofs, "id", "left").join(known, F.col("id") == F.col("known"), "left").select("competitor_id", "complaint_statement", F.col("known").alias("id"), "affected_segment", "summary_claim_id", "claims")


@registry.query(("research_cases", "counter_evidence", "research_unknowns", "validation_questions"), "", """
, ce AS (SELECT case_id, evidence_type, 'said of ' || case_id % 3 AS statement, id, factual_claim_id FROM counter_evidence), cd AS (SELECT id AS case_id, 'LOW_IMPACT' AS evidence_type, 'said of ' || id % 3 AS statement, id + 1 AS factual_claim_id FROM research_cases WHERE id % 4 <> 0),
q AS (SELECT *, CAST(NULL AS VARCHAR) AS rationale FROM validation_questions), qd AS (SELECT id AS case_id, CASE WHEN id % 2 = 0 THEN 'who pays' ELSE 'who signs' END AS question, 'asked' AS rationale FROM research_cases), ud AS (SELECT id AS case_id, CASE WHEN id % 2 = 0 THEN 'how often' ELSE 'since when' END AS statement FROM research_cases)
SELECT 'counter_evidence' AS kind, coalesce(o.case_id, n.case_id) AS case_id, coalesce(o.statement, n.statement) AS said, o.id, CAST(coalesce(n.factual_claim_id, o.factual_claim_id) AS VARCHAR) AS value FROM ce o FULL JOIN cd n ON n.case_id = o.case_id AND n.evidence_type = o.evidence_type AND n.statement = o.statement
UNION ALL SELECT 'question', coalesce(o.case_id, n.case_id), coalesce(o.question, n.question), o.id, coalesce(n.rationale, o.rationale) FROM q o FULL JOIN qd n ON n.case_id = o.case_id AND n.question = o.question
UNION ALL SELECT 'unknown', coalesce(o.case_id, n.case_id), coalesce(o.statement, n.statement), o.id, NULL FROM research_unknowns o FULL JOIN ud n ON n.case_id = o.case_id AND n.statement = o.statement""")
def case_records(d: Domain) -> DataFrame:
    """Counter-evidence, questions and unknowns after drafts by their natural keys."""
    cases, i = d.research_cases, F.col("id")
    said = F.concat(F.lit("said of "), (F.col("case_id") % 3).cast("string"))
    out = []
    for kind, current, drafts, text, value in (
        ("counter_evidence", d.counter_evidence.withColumn("statement", said), cases.filter("id % 4 <> 0").select(i.alias("case_id"), F.lit("LOW_IMPACT").alias("evidence_type"), F.concat(F.lit("said of "), (i % 3).cast("string")).alias("statement"), (i + 1).alias("factual_claim_id")), "statement", F.col("factual_claim_id").cast("string")),
        ("question", d.validation_questions.withColumn("rationale", F.lit(None).cast("string")), cases.select(i.alias("case_id"), F.when(i % 2 == 0, "who pays").otherwise("who signs").alias("question"), F.lit("asked").alias("rationale")), "question", F.col("rationale")),
        ("unknown", d.research_unknowns, cases.select(i.alias("case_id"), F.when(i % 2 == 0, "how often").otherwise("since when").alias("statement")), "statement", F.lit(None).cast("string")),
    ):
        after = records.merged(kind, current, records.cleaned(kind, drafts))
        known = current.select(F.col("id").alias("known"))
        out.append(after.join(known, F.col("id") == F.col("known"), "left").select(F.lit(kind).alias("kind"), "case_id", F.col(text).alias("said"), F.col("known").alias("id"), value.alias("value")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@registry.query(("research_passes",), "", """
SELECT case_id, pass_type, CASE WHEN case_id % 2 = 0 AND pass_type <> 'COMPETITION' THEN 'SATISFIED' ELSE status END AS status, CASE WHEN case_id % 2 = 0 AND pass_type <> 'COMPETITION' THEN 'NO_EVIDENCE_FOUND' ELSE outcome END AS outcome,
  CASE WHEN NOT (case_id % 2 = 0 AND pass_type <> 'COMPETITION') THEN summary_claim_id END AS summary_claim_id, CASE WHEN case_id % 2 = 0 AND pass_type <> 'COMPETITION' THEN 'searched twice for ' || case_id END AS note FROM research_passes""")
def passes_without_evidence(d: Domain) -> DataFrame:
    """Research passes after some ended without evidence, with the note of what was looked for."""
    notes = d.research_passes.filter("case_id % 2 = 0 and pass_type <> 'COMPETITION'").select("case_id", "pass_type", F.concat(F.lit("searched twice for "), F.col("case_id").cast("string")).alias("note"))
    return records.completed_without_evidence(d.research_passes, notes)[0]


@registry.query((), """
posts AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place, epoch(ts) AS secs, event_id % 10 <> 0 AND event_type <> 'error' AS usable FROM events),
page AS (SELECT * FROM posts WHERE place <= 25 - user_id % 5 * 5 AND usable AND user_id % 7 NOT IN (3, 4)), seen AS (SELECT user_id, count(*) AS n, min(secs) AS lo, max(secs) AS hi FROM page GROUP BY user_id),
five AS (SELECT user_id, string_agg('https://www.reddit.com/p/' || event_id, ' ' ORDER BY place) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rn FROM page) x WHERE rn <= 5 GROUP BY user_id), asked AS (SELECT DISTINCT user_id FROM events)""", """
SELECT 'r/u' || a.user_id AS source, CASE WHEN a.user_id % 7 = 3 THEN 'SOURCE_NOT_FOUND' WHEN a.user_id % 7 = 4 THEN 'PROVIDER_FAILED' WHEN n > 0 THEN 'PUBLIC_CONTENT' ELSE 'PUBLIC_NO_RECENT' END AS access_result, CASE WHEN a.user_id % 7 = 3 THEN 404 WHEN a.user_id % 7 <> 4 THEN 200 END AS http_status,
  strftime(make_timestamp(CAST(round(hi * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN hi = floor(hi) THEN '' ELSE strftime(make_timestamp(CAST(round(hi * 1000000) AS BIGINT)), '.%f') END || '+00:00' AS latest_visible_item_at, CAST(coalesce(n, 0) AS INT) AS visible_item_count,
  CASE WHEN a.user_id % 7 NOT IN (3, 4) THEN coalesce(strftime(make_timestamp(CAST(round(lo * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN lo = floor(lo) THEN '' ELSE strftime(make_timestamp(CAST(round(lo * 1000000) AS BIGINT)), '.%f') END || '+00:00', '2026-03-01T00:00:00+00:00') END AS sample_window_start,
  CASE WHEN a.user_id % 7 NOT IN (3, 4) THEN '2026-03-01T00:00:00+00:00' END AS sample_window_end, a.user_id % 7 NOT IN (3, 4) AND coalesce(n, 0) < 25 AS coverage_complete, coalesce(urls, '') AS evidence_urls FROM asked a LEFT JOIN seen s ON s.user_id = a.user_id LEFT JOIN five f ON f.user_id = a.user_id""")
def page_health(d: Domain) -> DataFrame:
    """The health of every source that its page of newest posts shows; some pages are short, some did not come."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    events = d.events.select("user_id", "event_id", "event_type", "ts").withColumn("place", newest).filter(F.col("place") <= 25 - F.col("user_id") % 5 * 5)
    source = F.concat(F.lit("r/u"), F.col("user_id").cast("string"))
    seconds = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())) / 1_000_000  # the table's times have no zone: UTC
    came = ~(F.col("user_id") % 7).isin(3, 4)
    posts = events.filter(came).select(source.alias("source"), "place", F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("/p/"), F.col("event_id").cast("string"))).alias("permalink"), seconds.alias("created_utc"), (F.col("event_type") == "error").alias("removed"))
    failure = F.when(F.col("user_id") % 7 == 3, "SOURCE_NOT_COVERED").when(F.col("user_id") % 7 == 4, "TIMEOUT")
    checks = d.events.select("user_id").distinct().select(source.alias("source"), F.lit("archive").alias("provider"), F.lit("2026-03-01T00:00:00+00:00").alias("checked_at"), F.lit(5).cast("long").alias("latency_ms"), failure.alias("failure"), F.when(~came, "no page").alias("message"))
    out = ingestion.page_health(posts, checks)
    return out.select("source", "access_result", "http_status", "latest_visible_item_at", "visible_item_count", "sample_window_start", "sample_window_end", "coverage_complete", F.array_join("evidence_urls", " ").alias("evidence_urls"))
