"""Queries of the text, URL, evidence, tagging and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions import text
from provenant.operators import evaluation, radar
from provenant.plans.registry import Registry
from provenant.sources.fixtures import Domain

registry = Registry()


@registry.query((), "", r"""
SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^/?#]') THEN lower(regexp_extract(trim(url), '(?i)^(https?)://', 1)) || '://'
    || lower(regexp_extract(regexp_replace(regexp_extract(trim(url), '^[^:]*://([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1))
    || CASE WHEN regexp_matches(regexp_extract(trim(url), '^[^:]*://([^/?#]*)', 1), ':[0-9]+$') THEN ':' || regexp_extract(regexp_extract(trim(url), '^[^:]*://([^/?#]*)', 1), ':([0-9]+)$', 1) ELSE '' END
    || CASE WHEN regexp_extract(trim(url), '^[^:]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(trim(url), '^[^:]*://[^/?#]*([^?#]*)', 1) END
    || CASE WHEN regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) END END AS normalized_url
FROM pages""")
def url_normalized(d: Domain) -> DataFrame:
    return d.pages.select("page_id", text.normalize_url(F.col("url")).alias("normalized_url"))


POSTS = "posts AS (SELECT event_id, 'https://' || CASE event_id % 4 WHEN 0 THEN 'www.reddit.com' WHEN 1 THEN 'old.reddit.com' WHEN 2 THEN 'm.reddit.com' ELSE 'example.com' END || CASE WHEN event_id % 3 = 0 THEN '/de' ELSE '' END || '/r/Sub' || CAST(user_id AS VARCHAR) || '/comments/Ab' || CAST(event_id AS VARCHAR) || '/some_slug/' || CASE WHEN event_id % 5 = 0 THEN 'Xy' || CAST(event_id % 10 AS VARCHAR) || '/' ELSE '' END || '?utm=1' AS url FROM events)"


@registry.query((), POSTS, """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'https://www.reddit.com/r/' || lower(split_part(url, '/', CASE WHEN event_id % 3 = 0 THEN 6 ELSE 5 END)) || '/comments/ab' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 5 = 0 THEN '/_/xy' || CAST(event_id % 10 AS VARCHAR) || '/' ELSE '/' END END AS canonical,
  CASE WHEN event_id % 4 <> 3 THEN 'ab' || CAST(event_id AS VARCHAR) END AS submission_id, CASE WHEN event_id % 4 <> 3 AND event_id % 5 = 0 THEN 'xy' || CAST(event_id % 10 AS VARCHAR) END AS comment_id FROM posts""")
def post_identity(d: Domain) -> DataFrame:
    """Canonical identity of post URLs in their many spellings."""
    host = F.expr("CASE event_id % 4 WHEN 0 THEN 'www.reddit.com' WHEN 1 THEN 'old.reddit.com' WHEN 2 THEN 'm.reddit.com' ELSE 'example.com' END")
    locale, comment = F.expr("CASE WHEN event_id % 3 = 0 THEN '/de' ELSE '' END"), F.expr("CASE WHEN event_id % 5 = 0 THEN concat('Xy', event_id % 10, '/') ELSE '' END")
    url = F.concat(F.lit("https://"), host, locale, F.lit("/r/Sub"), F.col("user_id").cast("string"), F.lit("/comments/Ab"), F.col("event_id").cast("string"), F.lit("/some_slug/"), comment, F.lit("?utm=1"))
    return d.events.withColumn("_p", text.post_identity(url)).select("event_id", "_p.canonical", "_p.submission_id", "_p.comment_id")


@registry.query((), "", """
SELECT doc_id, CASE WHEN substr(text, 11, 12) = ex AND length(text) >= 22 THEN 10 WHEN len(ex) > 0 AND (length(text) - length(replace(text, ex, ''))) / length(ex) = 1 THEN instr(text, ex) - 1 END AS found_start
FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN substr(text, 11, 12) ELSE substr(text, 21, 15) END AS ex FROM documents) t""")
def evidence_rescue(d: Domain) -> DataFrame:
    """Where a stated excerpt lies: at its offsets, or at its only occurrence."""
    excerpt = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 11, 12)).otherwise(F.substring("text", 21, 15))
    found = text.exact_evidence(F.col("text"), F.lit(10), F.lit(22), excerpt)
    return d.documents.select("doc_id", found["start"].alias("found_start"))


@registry.query((), "", r"""
SELECT page_id, len(list_filter(regexp_extract_all(url, '([0-9]+(?:[.,][0-9]+)?)', 1), lambda n: NOT contains(regexp_replace(url, '\?.*$', ''), n))) = 0 AS grounded FROM pages""")
def numeric_grounding(d: Domain) -> DataFrame:
    """Whether all numbers of a URL stand before its query."""
    return d.pages.select("page_id", text.numbers_grounded(F.col("url"), F.regexp_replace("url", r"\?.*$", "")).alias("grounded"))


@registry.query((), "", None)
def identifier_nfkc(d: Domain) -> DataFrame:
    """Normalised identifiers of all sources and whole texts."""
    return d.documents.select("doc_id", text.normalize_identifier(F.concat(F.col("source"), F.lit("  Ⅳ "), F.col("text"))).alias("identifier"))


@registry.query((), "", None)
def page_text(d: Domain) -> DataFrame:
    """The text of every page without tags and entities."""
    return d.pages.select("page_id", text.html_text(F.col("html")).alias("text"))


@registry.query((), "", r"""
SELECT doc_id, CASE WHEN length(flat) > 200 THEN rtrim(substr(flat, 1, 199)) || '…' ELSE flat END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents) t""")
def short_excerpts(d: Domain) -> DataFrame:
    return d.documents.select("doc_id", text.shortened(F.col("text"), 200).alias("short"))


def _tag_sql(patterns: dict[str, str], column: str) -> str:
    return "rtrim(" + " || ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN '{n},' ELSE '' END" for n, p in patterns.items()) + ", ',')"


TAGGED = f"""tagged AS (SELECT *, {_tag_sql(radar.LEXICON, "said")} AS buckets, {_tag_sql(radar.PAIN_SEEDS, "said")} AS pain_hits FROM (SELECT id, name, tagline, seen_date, lower(name || ' ' || coalesce(tagline, '')) AS said FROM radar_products) t)"""


@registry.query(("radar_products",), TAGGED, "SELECT id, buckets, pain_hits FROM tagged")
def tag_buckets(d: Domain) -> DataFrame:
    """Buckets and pain seeds of every product."""
    return radar.classified(d.radar_products).select("id", F.array_join("buckets", ",").alias("buckets"), F.array_join("pain_hits", ",").alias("pain_hits"))


@registry.query(("radar_products",), TAGGED, "SELECT bucket, count(*) AS products FROM (SELECT unnest(string_split(buckets, ',')) AS bucket FROM tagged WHERE buckets <> '') t GROUP BY bucket")
def bucket_counts(d: Domain) -> DataFrame:
    return radar.bucket_counts(radar.classified(d.radar_products))


_NICHE_PAIRS = " UNION ALL ".join(f"SELECT '{n}' AS niche, '{b}' AS bucket" for n, bs in radar.NICHE_BUCKETS.items() for b in bs)


@registry.query(("radar_products",), TAGGED + f", pairs AS ({_NICHE_PAIRS})", """
, b AS (SELECT name, 1 + CASE WHEN pain_hits = '' THEN 0 ELSE len(string_split(pain_hits, ',')) END AS worth, unnest(string_split(buckets, ',')) AS bucket FROM tagged WHERE buckets <> ''), s AS (SELECT p.niche, b.name, CAST(sum(b.worth) AS BIGINT) AS score FROM b JOIN pairs p ON p.bucket = b.bucket GROUP BY p.niche, b.name)
SELECT * FROM (SELECT niche, name, score, CAST(row_number() OVER (PARTITION BY niche ORDER BY score DESC, name) AS INT) AS rn FROM s) t WHERE rn <= 10""")
def related_products(d: Domain) -> DataFrame:
    """The ten products that serve each niche best."""
    return radar.related(radar.classified(d.radar_products))


_NICHE_SQL = "CASE lower({c}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in radar.NICHES.items()) + " ELSE 'Community ' || {c} END"


@registry.query(("radar_pains",), "", f"""
, u AS (SELECT *, row_number() OVER (PARTITION BY url, substr(pain, 1, 60) ORDER BY id) AS rn, CASE WHEN coalesce(regexp_extract(url, '/r/([A-Za-z0-9_]+)', 1), '') = '' THEN 'unbekannt' ELSE regexp_extract(url, '/r/([A-Za-z0-9_]+)', 1) END AS community FROM radar_pains)
SELECT id, url, pain, community, {_NICHE_SQL.format(c="community")} AS niche FROM u WHERE rn = 1""")
def distinct_pains(d: Domain) -> DataFrame:
    """Pains without repetitions, with their communities and niches."""
    return radar.distinct_pains(d.radar_pains).select("id", "url", "pain", radar.community(F.col("url")).alias("community"), radar.niche(F.col("url")).alias("niche"))


@registry.query(("impact_signals", "payment_signals"), "", """
SELECT 'impact' AS kind, id, impact_type || ': ' || CASE WHEN quantified THEN value || ' ' || unit || CASE WHEN id % 3 = 0 THEN ' (daily)' ELSE '' END ELSE 'qualitative impact recorded' END AS label FROM impact_signals
UNION ALL SELECT 'payment', id, payment_type || ': ' || CASE WHEN amount IS NULL THEN 'amount unknown' ELSE amount || ' ' || currency END || CASE WHEN id % 3 = 0 THEN ' (daily)' ELSE '' END FROM payment_signals""")
def signal_labels(d: Domain) -> DataFrame:
    """Impacts and payments in words."""
    often = F.when(F.col("id") % 3 == 0, "daily")
    impacts = d.impact_signals.select(F.lit("impact").alias("kind"), "id", text.impact_label(F.col("impact_type"), F.col("quantified"), F.col("value"), F.col("unit"), often).alias("label"))
    return impacts.unionByName(d.payment_signals.select(F.lit("payment").alias("kind"), "id", text.payment_label(F.col("payment_type"), F.col("amount"), F.col("currency"), often).alias("label")))


JUDGED = "judged AS (SELECT l.doc_id, l.quality = 1 AS gold, length(d.text) >= 400 AS predicted, l.toxic = 1 AS gold_toxic FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)"
_RATIO = "CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"


@registry.query((), JUDGED + ", c AS (SELECT count_if(gold AND predicted) AS tp, count_if(NOT gold AND predicted) AS fp, count_if(gold AND NOT predicted) AS fn, count_if(NOT gold AND NOT predicted) AS tn FROM judged)", f"""
SELECT tp, fp, fn, tn, {_RATIO.format(a='tp', b='(tp + fp)')} AS precision, {_RATIO.format(a='tp', b='(tp + fn)')} AS recall, {_RATIO.format(a='2 * tp', b='(2 * tp + fp + fn)')} AS f1 FROM c""")
def detection_metrics(d: Domain) -> DataFrame:
    """Detection quality of a length rule against the quality labels."""
    rows = d.labels.join(d.documents.select("doc_id", "text"), "doc_id", "left").select((F.col("quality") == 1).alias("gold"), (F.length("text") >= 400).alias("predicted"))
    return evaluation.confusion(rows)


@registry.query((), r"""gold AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: length(w) > 5)) AS g FROM benchmark),
pred AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: length(w) > 4 AND NOT contains(w, 'in'))) AS p FROM benchmark),
c AS (SELECT CAST(sum(len(list_intersect(g, p))) AS BIGINT) AS tp, CAST(sum(len(p) - len(list_intersect(g, p))) AS BIGINT) AS fp, CAST(sum(len(g) - len(list_intersect(g, p))) AS BIGINT) AS fn FROM gold JOIN pred USING (item_id))""", f"""
SELECT tp, fp, fn, {_RATIO.format(a='tp', b='(tp + fp)')} AS precision, {_RATIO.format(a='tp', b='(tp + fn)')} AS recall, {_RATIO.format(a='2 * tp', b='(2 * tp + fp + fn)')} AS f1 FROM c""")
def span_metrics(d: Domain) -> DataFrame:
    """Set-valued extraction quality: items found, spurious and missed over all cases."""
    words = lambda keep: F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), keep))
    rows = d.benchmark.select(words(lambda w: F.length(w) > 5).alias("gold"), words(lambda w: (F.length(w) > 4) & ~F.contains(w, F.lit("in"))).alias("predicted"))
    return evaluation.set_quality(rows)


@registry.query((), "n AS (SELECT coalesce(source, '') AS gold, coalesce(lang, '') AS predicted FROM documents), ij AS (SELECT gold, predicted, count(*)::HUGEINT AS k FROM n GROUP BY ALL), i AS (SELECT gold, sum(k) AS k FROM ij GROUP BY gold), j AS (SELECT predicted, sum(k) AS k FROM ij GROUP BY predicted), s AS (SELECT (SELECT sum(k * (k - 1) // 2) FROM ij) AS tp, (SELECT sum(k * (k - 1) // 2) FROM j) AS pp, (SELECT sum(k * (k - 1) // 2) FROM i) AS gp, (SELECT sum(k) FROM ij) AS n)", f"""
SELECT CAST(tp AS BIGINT) AS tp, CAST(pp - tp AS BIGINT) AS fp, CAST(gp - tp AS BIGINT) AS fn, CAST(n * (n - 1) // 2 - pp - gp + tp AS BIGINT) AS tn, {_RATIO.format(a='tp', b='pp')} AS precision, {_RATIO.format(a='tp', b='gp')} AS recall, {_RATIO.format(a='2 * tp', b='(pp + gp)')} AS f1 FROM s""")
def pairwise_clustering(d: Domain) -> DataFrame:
    """Pairwise quality of one grouping against another, from contingency counts instead of pairs."""
    return evaluation.pairwise(d.documents.select(F.coalesce("source", F.lit("")).alias("gold"), F.coalesce("lang", F.lit("")).alias("predicted")))


@registry.query((), "g AS (SELECT o_custkey AS case_id, o_orderpriority AS name, o_orderstatus AS kind FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL), p AS (SELECT o_custkey AS case_id, o_orderpriority AS name, o_orderstatus AS kind FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL), c AS (SELECT count_if(g.case_id IS NOT NULL AND p.case_id IS NOT NULL) AS tp, count_if(g.case_id IS NULL) AS fp, count_if(p.case_id IS NULL) AS fn FROM g FULL JOIN p ON g.case_id = p.case_id AND g.name = p.name AND g.kind = p.kind)", f"""
SELECT tp, fp, fn, {_RATIO.format(a='tp', b='(tp + fp)')} AS precision, {_RATIO.format(a='tp', b='(tp + fn)')} AS recall, {_RATIO.format(a='2 * tp', b='(2 * tp + fp + fn)')} AS f1 FROM c""")
def competition_metrics(d: Domain) -> DataFrame:
    """Keyed record matching: a full join of gold and predicted keys."""
    keys = ["case_id", "name", "kind"]
    rows = d.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("kind"), "o_orderkey")
    return evaluation.keyed(rows.filter("o_orderkey % 3 <> 0").select(*keys).distinct(), rows.filter("o_orderkey % 4 <> 0").select(*keys).distinct(), keys)


ASSESSED = """guessed AS (SELECT case_id, CASE WHEN case_id % 3 = 0 THEN 'SIMILAR' ELSE actor_equivalence END AS actor_equivalence, CASE WHEN case_id % 4 = 0 THEN 'UNKNOWN' ELSE workflow_equivalence END AS workflow_equivalence, CASE WHEN case_id % 5 = 0 THEN 'DIRECT_TRANSFER' ELSE transfer_type END AS transfer_type FROM dach_assessments WHERE case_id % 7 <> 0)"""


@registry.query(("dach_assessments",), ASSESSED, """
SELECT avg(CAST(a AS INT)) AS actor_accuracy, avg(CAST(w AS INT)) AS workflow_accuracy, avg(CAST(t AS INT)) AS transfer_accuracy, avg(CAST(a AND w AND t AS INT)) AS exact FROM (
  SELECT coalesce(g.actor_equivalence = p.actor_equivalence, FALSE) AS a, coalesce(g.workflow_equivalence = p.workflow_equivalence, FALSE) AS w, coalesce(g.transfer_type = p.transfer_type, FALSE) AS t FROM dach_assessments g LEFT JOIN guessed p ON p.case_id = g.case_id) x""")
def transfer_accuracy(d: Domain) -> DataFrame:
    """Accuracy of assessments by dimension and as a whole; a case without one is wrong."""
    guessed = d.dach_assessments.filter("case_id % 7 <> 0").select(
        "case_id", F.when(F.col("case_id") % 3 == 0, "SIMILAR").otherwise(F.col("actor_equivalence")).alias("pa"), F.when(F.col("case_id") % 4 == 0, "UNKNOWN").otherwise(F.col("workflow_equivalence")).alias("pw"), F.when(F.col("case_id") % 5 == 0, "DIRECT_TRANSFER").otherwise(F.col("transfer_type")).alias("pt")
    )
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    a, w, t = same("actor_equivalence", "pa"), same("workflow_equivalence", "pw"), same("transfer_type", "pt")
    return evaluation.accuracy(d.dach_assessments.join(guessed, "case_id", "left"), {"actor_accuracy": a, "workflow_accuracy": w, "transfer_accuracy": t, "exact": a & w & t})


@registry.query(("dach_assessments",), ASSESSED, " UNION ALL ".join(f"""SELECT '{f}' AS field, count(*) AS compared, count_if(g.{f} IS NOT DISTINCT FROM p.{f}) AS exact, CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(count_if(g.{f} IS NOT DISTINCT FROM p.{f}) AS DOUBLE) / count(*) END AS exactness FROM dach_assessments g JOIN guessed p ON p.case_id = g.case_id""" for f in ("actor_equivalence", "workflow_equivalence", "transfer_type")))
def field_exactness(d: Domain) -> DataFrame:
    """How often each field of an assessment is exactly right."""
    guessed = d.dach_assessments.filter("case_id % 7 <> 0").select(
        "case_id", F.when(F.col("case_id") % 3 == 0, "SIMILAR").otherwise(F.col("actor_equivalence")).alias("actor_equivalence"), F.when(F.col("case_id") % 4 == 0, "UNKNOWN").otherwise(F.col("workflow_equivalence")).alias("workflow_equivalence"), F.when(F.col("case_id") % 5 == 0, "DIRECT_TRANSFER").otherwise(F.col("transfer_type")).alias("transfer_type")
    )
    return evaluation.field_exactness(d.dach_assessments, guessed, ["actor_equivalence", "workflow_equivalence", "transfer_type"])


@registry.query((), JUDGED + ", c AS (SELECT count_if(gold AND predicted) AS tp, count_if(NOT gold AND predicted) AS fp, count_if(gold AND NOT predicted) AS fn, count(*) AS n FROM judged), m AS (SELECT 'precision' AS metric, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS value FROM c UNION ALL SELECT 'recall', CAST(tp AS DOUBLE) / nullif(tp + fn, 0) FROM c UNION ALL SELECT 'cases', CAST(n AS DOUBLE) FROM c), g AS (SELECT 'precision' AS metric, 0.9 AS minimum UNION ALL SELECT 'recall', 0.85 UNION ALL SELECT 'cases', 100 UNION ALL SELECT 'kappa', 0.5)", """
SELECT g.metric, CAST(g.minimum AS DOUBLE) AS minimum, m.value, coalesce(m.value >= g.minimum, FALSE) AS passed FROM g LEFT JOIN m ON m.metric = g.metric""")
def readiness_gates(d: Domain) -> DataFrame:
    """Measured quality against required minima; a gate without a measure fails."""
    rows = d.labels.join(d.documents.select("doc_id", "text"), "doc_id", "left").select((F.col("quality") == 1).alias("gold"), (F.length("text") >= 400).alias("predicted"))
    measured = evaluation.confusion(rows).withColumn("cases", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return evaluation.gates(measured, {"precision": 0.9, "recall": 0.85, "cases": 100.0, "kappa": 0.5})


PROVENANCE = """labelled AS (SELECT b.item_id AS case_id, CASE WHEN b.item_id % 3 = 0 THEN 'SYNTHETIC' ELSE 'REAL' END AS origin, CASE WHEN b.item_id % 4 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS rights_status, CASE WHEN length(b.text) % 2 = 0 THEN 'REVIEWED' ELSE 'DRAFT' END AS review_status FROM benchmark b)"""


@registry.query((), PROVENANCE, """
SELECT count(*) AS cases, count_if(origin = 'REAL') AS real, count_if(origin <> 'REAL') AS synthetic, count_if(rights_status = 'APPROVED') AS rights_approved, count_if(review_status = 'REVIEWED') AS reviewed,
  count_if(origin = 'REAL' AND rights_status = 'APPROVED' AND review_status = 'REVIEWED') AS releasable FROM labelled""")
def provenance_summary(d: Domain) -> DataFrame:
    """Benchmark cases by origin, rights and review."""
    return evaluation.provenance(d.benchmark.select(F.when(F.col("item_id") % 3 == 0, "SYNTHETIC").otherwise("REAL").alias("origin"), F.when(F.col("item_id") % 4 == 0, "PENDING").otherwise("APPROVED").alias("rights_status"), F.when(F.length("text") % 2 == 0, "REVIEWED").otherwise("DRAFT").alias("review_status")))


SUITES = """measured AS (SELECT lang AS suite, count(*) AS n, avg(CAST(length(text) >= 400 AS INT)) AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang),
wanted AS (SELECT m.suite, g.gate, g.metric, CAST(g.minimum AS DOUBLE) AS minimum FROM (SELECT DISTINCT lang AS suite FROM documents WHERE lang IS NOT NULL) m, (SELECT 'coverage' AS gate, 'cases' AS metric, 60.0 AS minimum UNION ALL SELECT 'metrics', 'share', 0.5 UNION ALL SELECT 'metrics', 'kappa', 0.4) g)"""


@registry.query((), SUITES, """
SELECT suite, gate, metric, minimum, value, coalesce(value >= minimum, FALSE) AS passed FROM (SELECT w.*, CASE WHEN w.metric = 'cases' THEN CAST(m.n AS DOUBLE) WHEN w.metric = 'share' THEN m.share END AS value FROM wanted w LEFT JOIN measured m ON m.suite = w.suite) t""")
def suite_gates(d: Domain) -> DataFrame:
    """Coverage and measures of a suite for each language against required minima."""
    rows = d.documents.filter("lang is not null").groupBy(F.col("lang").alias("suite")).agg(F.count("*").cast("double").alias("n"), F.avg((F.length("text") >= 400).cast("int")).alias("share"))
    gate = F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(m).alias("metric"), F.lit(v).alias("minimum")) for g, m, v in (("coverage", "cases", 60.0), ("metrics", "share", 0.5), ("metrics", "kappa", 0.4)))))
    wanted = rows.select("suite", gate.alias("g")).select("suite", "g.*")
    return evaluation.suite_gates(rows.select("suite", F.lit("cases").alias("metric"), F.col("n").alias("value")), rows.select("suite", F.lit("share").alias("metric"), F.col("share").alias("value")), wanted)


@registry.query((), "", """
SELECT event_id, CASE WHEN s BETWEEN 200 AND 299 THEN NULL WHEN s IN (429, 502, 503) THEN 'RATE_LIMITED' WHEN s IN (408, 504) THEN 'TIMEOUT' WHEN s = 413 THEN 'CONTENT_TOO_LARGE' WHEN s = 400 THEN 'INVALID_STRUCTURED_OUTPUT' WHEN s IN (401, 403) OR s >= 500 THEN 'MODEL_UNAVAILABLE' ELSE 'UNKNOWN_ERROR' END AS failure,
  CAST(least(90 * power(2, event_id % 7), 1800) AS BIGINT) AS wait_seconds FROM (SELECT event_id, 200 + event_id % 330 AS s FROM events) t""")
def failure_taxonomy(d: Domain) -> DataFrame:
    """Failure class and waiting time of HTTP answers."""
    return d.events.select("event_id", text.http_failure(F.lit(200) + F.col("event_id") % 330).alias("failure"), text.backoff_seconds(F.col("event_id") % 7).alias("wait_seconds"))


@registry.query((), "", """
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'PRACTITIONER' WHEN 1 THEN 'MIXED' WHEN 2 THEN 'GENERAL' ELSE 'OWNER' END AS audience, n_name || '|Buchhalter|Controller' AS professions FROM nation""")
def audience_types(d: Domain) -> DataFrame:
    """Audience types and professions of free registry text."""
    value = F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'Praktiker / practitioner' WHEN 1 THEN 'Inhaber/ Vendor' WHEN 2 THEN 'niemand' ELSE 'OWNER' END")
    listed = F.concat(F.col("n_name"), F.lit(", Buchhalter und Controller sowie Buchhalter"))
    return d.nation.select("n_nationkey", text.audience(value).alias("audience"), F.array_join(text.professions(listed), "|").alias("professions"))


@registry.query((), r"""
f AS (SELECT doc_id, text, trim(regexp_replace(text, '[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS flat FROM documents)""", """
SELECT doc_id, CASE WHEN coalesce(text, '') <> '' THEN CASE WHEN length(flat) > 400 THEN substr(flat, 1, 400) || '…' ELSE flat END END AS excerpt FROM f""")
def context_excerpts(d: Domain) -> DataFrame:
    """The head of every text, for people who review."""
    return d.documents.select("doc_id", text.context_excerpt(F.col("text")).alias("excerpt"))


@registry.query(("model_runs",), "", """
, g AS (SELECT provider, items_processed AS size, count(*) AS n, count_if(status = 'FAILED') AS failed, CAST(sum(CASE WHEN latency_ms % 3 <> 0 THEN latency_ms END) AS BIGINT) AS latency, count_if(latency_ms % 3 = 0) AS unknown, sum(amount) AS cost, count_if(amount IS NULL) AS uncosted FROM model_runs GROUP BY ALL)
SELECT provider, size, CASE WHEN size = 4 THEN 'n/a' ELSE printf('%.1f%%', 100.0 * failed / n) END AS failed, CASE WHEN latency IS NULL OR unknown = n THEN 'unknown' ELSE CAST(latency AS VARCHAR) || CASE WHEN unknown > 0 THEN ' (' || unknown || ' unknown)' ELSE '' END END AS latency,
  CASE WHEN uncosted > 0 THEN 'unknown (' || uncosted || ' records)' ELSE printf('$%.4f', CAST(cost AS DOUBLE)) END AS cost FROM g""")
def cost_labels(d: Domain) -> DataFrame:
    """Shares, times and costs of model runs in words; what is not known is said to be unknown."""
    known = F.when(F.col("latency_ms") % 3 != 0, F.col("latency_ms"))
    g = d.model_runs.groupBy("provider", F.col("items_processed").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.sum(known).alias("latency"), F.count_if(known.isNull()).alias("unknown"), F.sum("amount").alias("cost"), F.count_if(F.col("amount").isNull()).alias("uncosted"))
    share = F.when(F.col("size") != 4, F.col("failed") / F.col("n"))
    return g.select("provider", "size", text.rate_label(share).alias("failed"), text.metric_label(F.col("latency"), F.col("unknown"), F.col("n")).alias("latency"), text.cost_label(F.col("cost"), F.col("uncosted")).alias("cost"))


@registry.query((), "", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) * 1000 WHEN 1 THEN (CAST(floor(epoch(ts)) AS BIGINT) - 7200) * 1000 WHEN 4 THEN CAST(floor(epoch(ts)) AS BIGINT) * 1000 + 250 WHEN 5 THEN (CAST(floor(epoch(ts)) AS BIGINT) + 19800) * 1000 END AS at FROM events""")
def utc_times(d: Domain) -> DataFrame:
    """Points in time, in milliseconds, of texts with and without a zone."""
    said = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 6
    value = F.when(k == 0, F.concat(said, F.lit("Z"))).when(k == 1, F.concat(said, F.lit("+02:00"))).when(k == 2, said).when(k == 3, "no time+00:00").when(k == 4, F.concat(said, F.lit(".250+00:00"))).otherwise(F.concat(F.replace(said, F.lit("T"), F.lit(" ")), F.lit("-0530")))
    return d.events.select("event_id", F.unix_millis(text.utc_timestamp(value)).alias("at"))


#: Texts that only Unicode rules fold, and what they become.
FOLDED = (("O\ufb03ce  \uff21\uff22\uff23", "office abc"), ("Stra\u00dfe \u00bd", "strasse 1 2"), ("A\u030angstro\u0308m", "\u00e5ngstr\u00f6m"), ("\u338f \u2167", "kg viii"), ("\u0130stanbul", "i stanbul"), ("plain Text_1", "plain text_1"))
_FOLDS = " ".join(f"WHEN {i} THEN '{folded}'" for i, (_, folded) in enumerate(FOLDED))


@registry.query((), "", f"""
SELECT doc_id, sha256('{{"actor":"' || CASE doc_id % 6 {_FOLDS} END || '","context":null,"job_to_be_done":null,"problem":"p' || doc_id % 50 || '","root_cause":null}}') AS fingerprint FROM documents""")
def unicode_fingerprints(d: Domain) -> DataFrame:
    """Fingerprints of texts with ligatures, full-width forms, fractions, combining marks and a dotted capital I."""
    k = F.col("doc_id") % 6
    actor = F.lit(FOLDED[-1][0])
    for i, (said, _) in enumerate(FOLDED[:-1]):
        actor = F.when(k == i, said).otherwise(actor)
    none = F.lit(None).cast("string")
    return d.documents.select("doc_id", text.fingerprint(actor, none, none, F.concat(F.lit("P"), (F.col("doc_id") % 50).cast("string")), none).alias("fingerprint"))
