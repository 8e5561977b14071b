import hashlib
import json

from pyspark.sql import functions as F

from provenant.operators import evaluation, ingestion, radar
from provenant.sources import reports


def test_radar_lexicon(spark):
    rows = [("Freight desk", "load board for brokers"), ("Étude", None), ("QuickBooks exit", "migrate invoices"), ("posé", "")]
    got = [(r["buckets"], r["pain_hits"]) for r in radar.classified(spark.createDataFrame(rows, "name string, tagline string")).collect()]
    assert got[0] == (["logistics-freight"], ["freight_broker_trust"])
    assert got[1] == got[3] == ([], [])
    assert got[2] == (["field-service", "bookkeeping-finance"], ["qb_migration"])
    assert (len(radar.LEXICON), len(radar.PAIN_SEEDS)) == (9, 12)


def test_niches(spark):
    urls = ["https://x.com/r/HVAC/comments/1", "https://x.com/r/Other_one/2", "https://x.com/", None]
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "url string").select(radar.community(F.col("url")), radar.niche(F.col("url"))).collect()]
    assert got == [("HVAC", "Handwerk (HLK)"), ("Other_one", "Community Other_one"), ("unbekannt", "Community unbekannt"), ("unbekannt", "Community unbekannt")]


def test_review_sample(spark):
    rows = [(i, i, "OBSERVATION" if i % 3 == 0 else "NO_PAIN" if i % 3 == 1 else "FAILED", None if i == 4 else f"t{i}") for i in range(150)]
    got = [r["source_item_id"] for r in evaluation.review_sample(spark.createDataFrame(rows, "source_item_id long, ordering long, status string, external_id string")).collect()]
    key = lambda r: hashlib.sha256((r[3] or str(r[0])).encode()).hexdigest()
    assert got[:30] == list(range(0, 90, 3))
    assert got[30:] == [r[0] for r in sorted((r for r in rows if r[2] == "NO_PAIN"), key=key)][:25]


def test_reports_of_waves_gates_captures_and_the_site(spark, tmp_path):
    names = dict.fromkeys(c for columns in reports.WAVE_SECTIONS.values() for c in columns)
    wave = spark.createDataFrame([{"source": "a", "strong_signals": 1}, {"source": "b", "strong_signals": 3}, {"source": "c", "strong_signals": None}], ", ".join(f"{c} {'long' if c == 'strong_signals' else 'string'}" for c in names))
    text = reports.wave_report(wave)
    assert [text.index(f"| {x} | unknown | unknown |") for x in "bac"] == sorted(text.index(f"| {x} | unknown | unknown |") for x in "abc") and "## Costs" in text
    gates = spark.createDataFrame([("s", "coverage", "cases", 5.0, 6.0, True), ("s", "metrics", "f1", 0.8, None, False)], "suite string, gate string, metric string, minimum double, value double, passed boolean")
    assert "NOT READY: 1 of 2" in reports.readiness_report(gates) and "READY: 1 of 1" in reports.readiness_report(gates.filter("passed"))
    assert "NOT READY: 0 of 0" in reports.readiness_report(gates.limit(0))
    posts = spark.createDataFrame([(1, "a", "FULL", None, "2026-01-01 00:00:00"), (1, "b", "PARTIAL", "REMOVED", None), (2, None, "FULL", "DELETED", None)], "source_id long, external_id string, completeness string, removal_state string, published_at string")
    counted = ingestion.page_accounting(posts, spark.createDataFrame([(1, "b")], "source_id long, external_id string"), "2026-01-01 00:01:00")
    one = counted.filter("source_id = 1").first()
    assert (one["new_items"], one["existing_items"], one["removed"], one["age_seconds"]) == (1, 1, 1, 60)
    assert "| 3 | 2 | 1 | 0 | 1 | 1 | 1 | 1 |" in reports.capture_report(counted)
    assert "| 2 | 5 |" in reports.community_markdown(spark.createDataFrame([("a", 2), ("b", 3)], "community string, items long"))
    products = radar.classified(spark.createDataFrame([("Desk", "freight load board", "d")], "name string, tagline string, seen_date string"))
    pains = spark.createDataFrame([(1, "https://x/r/logistics/1", "slow", "q"), (2, "https://x/r/freightbrokers/1", "slow", None), (3, "https://x/r/freightbrokers/1", "slow", None)], "id long, url string, pain string, quote string")
    site = json.loads(reports.site_payload(radar.site_payload(pains, products), products, "2026-01-02"))
    assert site["stats"] == {"pains": 2, "products": 1, "niches": 2, "quotes": 1}
    assert [p["related"] for p in site["pains"]] == [[], ["Desk"]]
    reports.holdout_outputs(spark.createDataFrame([(1, "x")], "source_item_id long, status string"), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/review.jsonl").count() == 1
