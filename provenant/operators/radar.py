"""Topic tags by ordered patterns, bucket counts, and links between pains and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.  Fields of products: name and the pattern that a lower-cased text must hold.
LEXICON = {
    "property/ho-admin": r"propert|landlord|tenant|rent|lease|inventar|immobil|housing|maintenance ticket",
    "restaurant-pos": r"restaurant|pos\b|point of sale|menu|table reservation|food service|kds\b|hospitality",
    "field-service": r"field service|plumber|trade|schedule|dispatch|invoice|job site|craftsman|contractor",
    "logistics-freight": r"freight|truck|broker|dispatch|load|carrier|logistic|tms\b",
    "bookkeeping-finance": r"bookkeep|accounting|invoic|financ|expense|tax|quickbooks|xero",
    "sales-crm": r"\bcrm\b|sales|lead|outreach|pipeline|prospect|deal",
    "phone-ai": r"answering|phone|call|ivr|voice agent|receptionist|missed call",
    "marketing-ads": r"marketing|ads\b|advertis|campaign|targeting|seo|social media",
    "construction": r"construct|builder|estimate|bid|blueprint|concrete|roof",
}

#: Fixed values.  Validated pains: name and the pattern of texts of products built for them.
PAIN_SEEDS = {
    "asset_inventory_small_pm": r"propert|landlord|tenant|inventar|asset track",
    "pos_ads_blocking": r"restaurant|pos\b|point of sale|kds\b",
    "vendor_lockin_exit": r"cancel|subscription manage|contract|lock-?in|offboarding",
    "phone_order_ai": r"answering|phone agent|voice ai|missed call|receptionist",
    "freight_broker_trust": r"freight|broker|carrier|load board|tms\b",
    "qb_migration": r"quickbooks|migrat|accounting",
    "pdf_to_data": r"\bocr\b|document extract|pdf to|data extract",
    "lead_followup_broken": r"lead|follow-?up|\bcrm\b|outreach",
    "menu_builder": r"menu|digital menu|qr code|restaurant website",
    "sales_forecast_why": r"sales|forecast|revenue|pipeline|deal analy",
    "impersonation_fraud": r"fraud|impersonat|phish|verify|authenticat",
    "gmb_phone_spam": r"google business|review|reputation|local seo",
}

#: Fixed values.  Names of the niches of communities, by the community in lower case.
NICHES = {
    "sweatystartup": "Kleingewerbe / Solo-Selbständige",
    "smallbusiness": "Kleingewerbe / Solo-Selbständige",
    "entrepreneur": "Gründer allgemein",
    "msp": "IT-Dienstleister (MSP)",
    "sysadmin": "IT-Administration",
    "propertymanagement": "Immobilienverwaltung",
    "commercialev": "Gewerbe-Immobilien",
    "logistics": "Logistik & Spedition",
    "freightbrokers": "Frachtenvermittlung / Logistik",
    "bookkeeping": "Buchhaltung",
    "quickbooks": "Buchhaltung",
    "accounting": "Buchhaltung / Steuer",
    "restaurants": "Gastronomie",
    "restaurantowners": "Gastronomie",
    "sales": "Vertrieb / Sales",
    "plumbing": "Handwerk (Sanitär)",
    "hvac": "Handwerk (HLK)",
    "construction": "Bau / Handwerk",
    "agency": "Agenturen",
    "pos": "Kassensysteme",
}
#: Fixed values.  Buckets of products that serve a niche.
NICHE_BUCKETS = {
    "Gastronomie": ("restaurant-pos",),
    "Buchhaltung / Steuer": ("bookkeeping-finance",),
    "Immobilienverwaltung": ("property/ho-admin",),
    "Frachtenvermittlung / Logistik": ("logistics-freight",),
    "Handwerk (HLK)": ("field-service", "construction"),
    "Handwerk (Sanitär)": ("field-service", "construction"),
    "Bau / Handwerk": ("field-service", "construction"),
    "Kleingewerbe / Solo-Selbständige": ("field-service", "sales-crm", "marketing-ads", "phone-ai"),
    "Vertrieb / Sales": ("sales-crm",),
    "Agenturen": ("marketing-ads", "sales-crm"),
    "Buchhaltung": ("bookkeeping-finance",),
}


def tags(text: Column, buckets: dict[str, str]) -> Column:
    """The names of all buckets whose pattern occurs."""
    lower = F.lower(text)
    return F.array_compact(F.array(*(F.when(lower.rlike(p), F.lit(n)) for n, p in buckets.items())))


def classified(products: DataFrame) -> DataFrame:
    """Products with ``buckets`` and ``pain_hits`` of their name and tagline."""
    text = F.concat_ws(" ", "name", F.coalesce("tagline", F.lit("")))
    whole = [{n: f"(?U){p}" for n, p in patterns.items()} for patterns in (LEXICON, PAIN_SEEDS)]  # word ends as in Unicode
    return products.withColumns({"buckets": tags(text, whole[0]), "pain_hits": tags(text, whole[1])})


def community(url: Column) -> Column:
    """The community that a URL names after ``/r/``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?U)/r/(\w+)", 1)
    return F.when(found == "", F.lit("unbekannt")).otherwise(found)


def niche(url: Column) -> Column:
    """The niche of a URL's community, or the community itself."""
    known = F.create_map(*(F.lit(x) for pair in NICHES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(community(url))), F.concat(F.lit("Community "), community(url)))


def bucket_counts(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("products"))


def distinct_pains(pains: DataFrame) -> DataFrame:
    """Pains (``id, url, pain`` and more) without repetitions: of those with one URL and the same first 60 characters the first stands."""
    others = [c for c in pains.columns if c != "url"]
    kept = pains.groupBy("url", F.substring("pain", 1, 60).alias("_head")).agg(F.min_by(F.struct(*others), "id").alias("p"))
    return kept.select("url", "p.*").select(*pains.columns)


def related(products: DataFrame, niche_buckets: dict[str, tuple[str, ...]] = NICHE_BUCKETS, most: int = 10) -> DataFrame:
    """``niche, name, score, rn``: the products that serve a niche best, ties by name.

    A product counts one and its pain hits for every bucket of the niche that it is in;
    products of one name add up.  Pains meet these by their niche, so no pain is ever
    paired with a product.
    """
    pairs = products.sparkSession.createDataFrame([(n, b) for n, bs in niche_buckets.items() for b in bs], "niche string, bucket string")
    scored = products.select("name", (F.lit(1) + F.size("pain_hits")).alias("worth"), F.explode("buckets").alias("bucket")).groupBy("bucket", "name").agg(F.sum("worth").alias("worth"))
    total = scored.join(F.broadcast(pairs), "bucket").groupBy("niche", "name").agg(F.sum("worth").cast("long").alias("score"))  # a fixed list of niches
    return total.withColumn("rn", F.row_number().over(Window.partitionBy("niche").orderBy(F.desc("score"), "name"))).filter(F.col("rn") <= most)


def site_payload(pains: DataFrame, products: DataFrame) -> DataFrame:
    """Pains (``id, url, pain, quote`` and more) with their ``niche`` and the names of related products in order."""
    best = related(products).groupBy("niche").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda r: r["name"]).alias("related"))
    rows = distinct_pains(pains).withColumn("niche", niche(F.col("url")))
    return rows.join(best, "niche", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
