"""Text, URL and label functions as native columns; Arrow functions only where Unicode folding needs them."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hosts, locale prefixes and vocabularies that the normalisers accept.
COMMUNITY_HOSTS = ("reddit.com", "old.reddit.com", "new.reddit.com", "np.reddit.com", "redd.it")
LOCALES = ("en", "de", "fr", "es", "it")


@F.pandas_udf(T.StringType())
def normalize_identifier(values: pd.Series) -> pd.Series:
    """NFKC, trimmed, case-folded, white space collapsed; empty becomes null."""
    return values.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).casefold().split()) or None, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc_folded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape_html(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def _plain(value: Column) -> Column:
    """Whether a text is ASCII, whose folding needs no Python."""
    return value.rlike(r"^\p{ASCII}*$")


def identifier(value: Column) -> Column:
    """:func:`normalize_identifier`, computed in the JVM for ASCII values."""
    native = F.nullif(F.trim(F.regexp_replace(F.lower(value), r"\s+", " ")), F.lit(""))
    return F.when(_plain(value), native).otherwise(normalize_identifier(F.when(~_plain(value), value)))


def fingerprint_text(value: Column) -> Column:
    """Words in NFKC, case-folded and joined by single spaces; null if nothing is left.  ASCII is folded in the JVM."""
    folded = F.when(_plain(value), F.lower(value)).otherwise(nfkc_folded(F.when(~_plain(value), value)))
    return F.nullif(F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " ")), F.lit(""))


def fingerprint(actor: Column, context: Column, job: Column, problem: Column, root_cause: Column) -> Column:
    """SHA-256 of the five normalised fields as compact JSON with sorted keys and explicit nulls."""
    fields = F.struct(*(fingerprint_text(c).alias(n) for n, c in (("actor", actor), ("context", context), ("job_to_be_done", job), ("problem", problem), ("root_cause", root_cause))))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def normalize_url(url: Column) -> Column:
    """Absolute http(s) URL without user info and fragment, scheme and host lower-cased; null if it is not one."""
    value = F.trim(url)
    pattern = r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    scheme, authority = F.lower(F.regexp_extract(value, pattern, 1)), F.regexp_extract(value, pattern, 2)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    host, port = F.lower(F.regexp_extract(host_port, r"^([^:]*)", 1)), F.regexp_extract(host_port, r":(\d+)$", 1)
    path, query = F.regexp_extract(value, pattern, 3), F.regexp_extract(value, pattern, 4)
    whole = F.concat(scheme, F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((scheme != "") & (host != ""), whole)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), body), 0)


def post_identity(url: Column) -> Column:
    """``struct(canonical, submission_id, comment_id, community)`` of a community post URL, or null."""
    none = F.lit(None).cast("string")

    def long_form(lower: Column, parts: Column, at: Column) -> Column:
        submission, comment = F.get(lower, at), F.get(lower, at + 2)
        community = F.when((at >= 3) & (F.get(lower, at - 3) == "r"), F.get(parts, at - 2))
        prefix = F.when(community.isNotNull(), F.concat(F.lit("/r/"), F.lower(community))).otherwise("")
        ending = F.when(comment.isNotNull(), F.concat(F.lit("/_/"), comment, F.lit("/"))).otherwise("/")
        canonical = F.concat(F.lit("https://www.reddit.com"), prefix, F.lit("/comments/"), submission, ending)
        return F.when((at > 0) & submission.isNotNull(), F.struct(canonical.alias("canonical"), submission.alias("submission_id"), comment.alias("comment_id"), community.alias("community")))

    def long_of(raw: Column) -> Column:
        decoded = F.transform(raw, lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))
        without = lambda d: F.when((F.size(d) >= 2) & F.lower(F.get(d, 0)).isin(*LOCALES), F.slice(d, 2, 1000)).otherwise(d)
        placed = lambda parts: once(F.transform(parts, F.lower), lambda lower: once(F.array_position(lower, "comments").cast("int"), lambda at: long_form(lower, parts, at)))
        return once(decoded, lambda d: once(without(d), placed))

    def short_of(raw: Column) -> Column:
        first = once(F.get(raw, 0), lambda p: F.lower(F.coalesce(F.try_url_decode(p), p)))
        return once(first, lambda short: F.when(short.isNotNull(), F.struct(F.concat(F.lit("https://www.reddit.com/comments/"), short, F.lit("/")).alias("canonical"), short.alias("submission_id"), none.alias("comment_id"), none.alias("community"))))

    def of(value: Column) -> Column:
        path = F.regexp_extract(value, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        raw = F.filter(F.split(path, "/"), lambda p: p != "")
        host = F.regexp_replace(F.lower(F.regexp_extract(value, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
        return once(host, lambda h: F.when(h == "redd.it", short_of(raw)).when(h.isin(*COMMUNITY_HOSTS) | h.endswith(".reddit.com"), long_of(raw)))

    return once(F.trim(url), of)


def impact_label(kind: Column, quantified: Column, value: Column, unit: Column, frequency: Column) -> Column:
    """An impact in words: its measure, or that it is told without one."""
    often = F.when(frequency.isNotNull(), F.concat(F.lit(" ("), frequency, F.lit(")"))).otherwise("")
    return F.concat(kind, F.lit(": "), F.when(quantified, F.concat(value, F.lit(" "), unit, often)).otherwise("qualitative impact recorded"))


def payment_label(kind: Column, amount: Column, currency: Column, frequency: Column) -> Column:
    """A payment in words; an amount that is not known is said to be unknown."""
    often = F.when(frequency.isNotNull(), F.concat(F.lit(" ("), frequency, F.lit(")"))).otherwise("")
    return F.concat(kind, F.lit(": "), F.when(amount.isNull(), "amount unknown").otherwise(F.concat(amount, F.lit(" "), currency)), often)


def exact_evidence(text: Column, start: Column, end: Column, excerpt: Column) -> Column:
    """Offsets of an excerpt: as stated if they match, else where it occurs if it occurs exactly once, else null."""
    stated = (start >= 0) & (end > start) & (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == excerpt)
    times = (F.length(text) - F.length(F.replace(text, excerpt, F.lit("")))) / F.length(excerpt)
    found = F.instr(text, excerpt) - 1
    rescued = (F.length(excerpt) > 0) & (times == 1)
    pair = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    return F.when(stated, pair(start, end)).when(rescued, pair(found, found + F.length(excerpt)))


def numbers_grounded(value: Column, excerpt: Column) -> Column:
    """Whether every number of a value occurs in the excerpt."""
    return F.forall(F.regexp_extract_all(value, F.lit(r"(\p{Nd}+(?:[.,]\p{Nd}+)?)"), 1), lambda n: F.contains(excerpt, n))


def shortened(value: Column, limit: int) -> Column:
    """White space collapsed, cut with an ellipsis beyond a limit."""
    flat = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def context_excerpt(value: Column, limit: int = 400) -> Column:
    """The head of a text with white space collapsed, and an ellipsis where more follows; null for an empty one."""
    flat = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    return F.when(F.coalesce(value, F.lit("")) != "", F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat))


def rate_label(value: Column) -> Column:
    """A share as a percentage with one place; ``n/a`` where it is not known."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.1f%%", value.cast("double") * 100))


def metric_label(value: Column, unknown: Column, requests: Column | None = None, decimals: int = 0) -> Column:
    """A number with how many records do not know theirs; ``unknown`` where none does (``requests``: how many there are)."""
    none = value.isNull() if requests is None else value.isNull() | (unknown == requests)
    shown = F.format_string(f"%.{decimals}f", value.cast("double"))
    return F.when(none, "unknown").when(unknown > 0, F.concat(shown, F.lit(" ("), unknown.cast("string"), F.lit(" unknown)"))).otherwise(shown)


def cost_label(cost: Column, unknown: Column) -> Column:
    """A cost in USD, or how many records keep it from being known."""
    return F.when(unknown > 0, F.concat(F.lit("unknown ("), unknown.cast("string"), F.lit(" records)"))).otherwise(F.concat(F.lit("$"), F.format_string("%.4f", cost.cast("double"))))


def utc_timestamp(value: Column) -> Column:
    """A point in time of an ISO text that names its zone; null without a zone, or where it is no time."""
    zoned = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(value))


def decimal_text(value: Column) -> Column:
    """A decimal without trailing zeros or exponent; minus zero is 0."""
    text = value.cast("string")
    plain = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(plain.isin("-0", ""), "0").otherwise(plain)


def html_text(value: Column) -> Column:
    """Text of an HTML fragment: tags dropped, entities resolved, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(value, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape_html(bare), r"\s+", " "))


# Audience names and what they stand for.
AUDIENCES = {"praktiker": "PRACTITIONER", "practitioner": "PRACTITIONER", "inhaber": "OWNER", "owner": "OWNER", "einkäufer": "BUYER", "buyer": "BUYER", "consumer": "CONSUMER", "verbraucher": "CONSUMER", "gründer": "FOUNDER", "founder": "FOUNDER", "anbieter": "VENDOR", "vendor": "VENDOR", "jobsuchende": "JOBSEEKER", "jobseeker": "JOBSEEKER", "allgemein": "GENERAL", "general": "GENERAL", "gemischt": "MIXED"}


def audience(value: Column) -> Column:
    """The audience type of a slash-separated list of names; several types are MIXED, none is GENERAL."""
    table = F.create_map(*(F.lit(x) for pair in AUDIENCES.items() for x in pair))
    types = F.array_distinct(F.array_compact(F.transform(F.split(F.lower(value), "/"), lambda p: table[F.trim(p)])))
    return F.when(F.size(types) == 1, types[0]).when(F.size(types) > 1, "MIXED").otherwise("GENERAL")


def professions(value: Column) -> Column:
    """Distinct professions of a list joined by commas, ``und`` or ``sowie``."""
    return F.array_distinct(F.filter(F.transform(F.split(value, r"\s*,\s*|\s+und\s+|\s+sowie\s+"), lambda p: F.trim(p)), lambda p: p != ""))


def backoff_seconds(attempt: Column, base: int = 90, most: int = 1800) -> Column:
    """Exponential waiting time with a ceiling."""
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt), F.lit(most)).cast("long")


def http_failure(status: Column) -> Column:
    """The failure class of an HTTP status, null for success."""
    return (
        F.when(status.between(200, 299), F.lit(None).cast("string"))
        .when(status.isin(429, 502, 503), "RATE_LIMITED")
        .when(status.isin(408, 504), "TIMEOUT")
        .when(status == 413, "CONTENT_TOO_LARGE")
        .when(status == 400, "INVALID_STRUCTURED_OUTPUT")
        .when(status.isin(401, 403) | (status >= 500), "MODEL_UNAVAILABLE")
        .otherwise("UNKNOWN_ERROR")
    )


# Failure labels and the patterns that give them; the first that matches counts.
FAILURE_RULES = (
    ("rate-limited", r"rate.?limit|too many requests|429|usage limit|hit your.*limit|try again at"),
    ("quota-exceeded", r"insufficient.*(quota|credit)|quota exceeded|out of quota"),
    ("auth-failed", r"invalid api.?key|unauthorized|401|authentication failed|token.*expired"),
    ("access-denied", r"403|forbidden|no access"),
    ("network", r"network|connection|dns|timed? out|econn"),
    ("model-unavailable", r"model not found|unsupported model|unknown model"),
    ("policy-blocked", r"sandbox|policy"),
)


def failure_label(message: Column) -> Column:
    """A coarse label of a failure message that repeats nothing of it."""
    said = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown-error")
    for label, pattern in reversed(FAILURE_RULES):
        out = F.when(said.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def salvaged_json(answer: Column) -> Column:
    """The JSON object of a chatty answer: the last line that is one, else the whole, else the outermost braces; null if none is valid."""
    lines = F.filter(F.split(answer, "\n"), lambda line: F.ltrim(line).startswith("{"))
    candidates = F.array(F.element_at(F.when(F.size(lines) > 0, lines), -1), F.regexp_replace(F.trim(answer), r"(?s)^```(?:json)?\s*|\s*```$", ""), F.regexp_extract(answer, r"(?s)(\{.*\})", 1))
    return F.get(F.filter(candidates, lambda c: F.json_object_keys(c).isNotNull()), 0)


def run_gate_reasons(adapter_ready: Column, credentials: Column, configured: Column, rights: Column) -> Column:
    """Why a live run is not allowed; empty if it is."""
    return F.array_compact(
        F.array(
            F.when(~adapter_ready, "technical adapter is not ready"),
            F.when(~credentials, "provider credentials are not available in the environment"),
            F.when(~configured, "provider configuration (e.g. query IDs) is missing or invalid"),
            F.when(~rights.eqNullSafe(F.lit("PRODUCTION_APPROVED")), F.concat(F.lit("rights status is "), F.coalesce(rights, F.lit("UNKNOWN")), F.lit(", not PRODUCTION_APPROVED"))),
        )
    )
