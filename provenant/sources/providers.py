"""Records of providers in one form: what they hold, what they lack, and where they come from.

Nothing that is missing is reconstructed: a snippet is not a body, a removed text stays
out, and a record whose link leads elsewhere than where it was asked for is a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.schema import canonical_json
from provenant.functions.text import post_identity

#: What a provider's record is brought into first; a provider lacks what it does not know.
FIELDS = {"requested": "string", "url": "string", "record_id": "string", "query_id": "string", "title": "string", "body": "string", "snippet": "string", "author": "string", "published_at": "string", "language": "string", "removed": "boolean", "archived_at": "string"}
# Bodies that stand for a removed text.
REMOVED_MARKERS = ("[removed]", "[deleted]")


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def page_failure(status: Column, body: Column) -> Column:
    """``struct(failure, message)`` of a provider's page that brings no records, or null.

    A good page is a JSON object with a list ``data`` of objects.
    """
    value = F.try_parse_json(body)
    shape, of_data = F.schema_of_variant(value), F.schema_of_variant(F.try_variant_get(value, "$.data", "variant"))
    said = F.get_json_object(body, "$.error")
    objects = F.forall(F.try_variant_get(value, "$.data", "array<variant>"), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    fail = lambda code, message: F.struct(F.lit(code).alias("failure"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
    return (
        F.when(status == 429, fail("RATE_LIMITED", "rate limited (429)"))
        .when(status == 400, fail("QUERY_CONFIGURATION_ERROR", F.coalesce(said, F.lit("invalid request (400)"))))
        .when(status >= 500, fail("PROVIDER_UNAVAILABLE", F.concat(F.lit("server error ("), status.cast("string"), F.lit(")"))))
        .when(status.isNull(), fail("PROVIDER_UNAVAILABLE", "no answer"))
        .when(status != 200, fail("UNKNOWN_ERROR", F.concat(F.lit("unexpected status ("), status.cast("string"), F.lit(")"))))
        .when(value.isNull(), fail("INVALID_FEED", "the body is no JSON"))
        .when(~shape.startswith("OBJECT"), fail("INVALID_FEED", "the answer is no object"))
        .when(~F.coalesce(of_data.startswith("ARRAY"), F.lit(False)), fail("INVALID_FEED", "there is no list of data"))
        .when(~F.coalesce(objects, F.lit(True)), fail("INVALID_FEED", "a record is no object"))
    )


def archive_records(posts: DataFrame, requested: Column) -> DataFrame:
    """Archive posts as provider records: the permalink names them, a link's target does not."""
    permalink, body = _text(F.col("permalink")), F.col("selftext")
    removed = F.coalesce(body.isin(*REMOVED_MARKERS), F.lit(False)) | F.col("removed_by_category").isNotNull()
    name = F.coalesce(_text(F.col("name")), _text(F.col("id"))) if "name" in posts.columns else _text(F.col("id"))
    published = F.date_format(F.to_utc_timestamp(F.timestamp_seconds("created_utc"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return posts.select(
        requested.alias("requested"), F.when(permalink.isNotNull(), F.concat(F.lit("https://www.reddit.com"), permalink)).otherwise(_text(F.col("url"))).alias("url"), name.alias("record_id"), F.lit(None).cast("string").alias("query_id"), "title",
        F.when(F.col("is_self") & ~removed, body).alias("body"), F.lit(None).cast("string").alias("snippet"), "author", published.alias("published_at"), F.lit(None).cast("string").alias("language"), removed.alias("removed"), F.col("retrieved_on").cast("long").cast("string").alias("archived_at"),
    )


def mention_records(mentions: DataFrame, fulltexts: DataFrame, requested: Column, query_id: str) -> DataFrame:
    """Licensed mentions with their full texts, by resource id, as provider records; a snippet never passes for a text."""
    full = fulltexts.select(F.col("resourceId").alias("_id"), F.col("fullText").alias("_full"), *(F.col(c).alias(f"_{c}") for c in ("url", "title") if c in fulltexts.columns))
    rows = mentions.join(full, F.col("resourceId") == F.col("_id"), "left")
    either = lambda own, other: F.coalesce(_text(F.col(own)), _text(F.col(other))) if other in rows.columns else _text(F.col(own))
    title = F.coalesce(_text(F.col("_title")), _text(F.col("title"))) if "_title" in rows.columns else _text(F.col("title"))
    return rows.select(
        requested.alias("requested"), either("url", "_url").alias("url"), F.col("resourceId").cast("string").alias("record_id"), F.lit(query_id).alias("query_id"), title.alias("title"), F.col("_full").alias("body"), "snippet", "author", F.col("date").alias("published_at"), "language",
        F.lit(False).alias("removed"), F.lit(None).cast("string").alias("archived_at"),
    )


def feed_records(entries: DataFrame, requested: Column) -> DataFrame:
    """Feed entries (see :func:`readers.feed_entries`) as provider records."""
    none = F.lit(None).cast("string")
    return entries.select(requested.alias("requested"), "url", F.col("id").alias("record_id"), none.alias("query_id"), "title", F.col("text").alias("body"), none.alias("snippet"), "author", "published_at", none.alias("language"), F.lit(False).alias("removed"), none.alias("archived_at"))


def normalized(records: DataFrame, provider: str, acquired_at: str, raw_retention: str = "DO_NOT_PERSIST") -> DataFrame:
    """Provider records with identity, completeness, text, missing fields, provenance and failure.

    A body at a known post is FULL, a snippet PARTIAL, all else METADATA_ONLY without a
    text.  ``missing_fields`` lists what is not there of title, body, subreddit, url and
    timestamp.  ``provenance_json`` has its keys in order.  ``failure`` is SOURCE_NOT_COVERED
    where the link does not lead to the requested community.
    """
    have = set(records.columns)
    rows = records.select(*((_text(F.col(c)) if k == "string" else F.col(c)).alias(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in FIELDS.items())).withColumn("identity", post_identity(F.col("url")))
    community = F.regexp_replace("requested", "^r/", "")
    removed = F.coalesce("removed", F.lit(False))
    there = F.col("identity").isNotNull()
    elsewhere = F.col("url").isNotNull() & ~F.coalesce(F.lower("identity.community") == F.lower(community), F.lit(False))
    body = F.when(~removed, F.col("body"))
    completeness = F.when(body.isNotNull() & there, "FULL").when(~removed & F.col("snippet").isNotNull() & there, "PARTIAL").otherwise("METADATA_ONLY")
    rows = rows.withColumns({"body": body, "completeness": completeness})
    text = F.when(F.col("completeness") != "METADATA_ONLY", F.concat_ws("\n\n", "title", F.when(F.col("completeness") == "FULL", F.col("body")).otherwise(F.col("snippet"))))
    named = {"title": F.col("title"), "body": F.col("body"), "subreddit": F.col("identity.community"), "url": F.col("url"), "timestamp": F.col("published_at")}
    full = F.col("completeness") == "FULL"
    provenance = F.struct(
        F.lit("REDDIT").alias("original_platform"), F.lit(provider).alias("provider"), F.col("record_id").alias("provider_record_id"), F.col("query_id").alias("provider_query_id"), F.col("identity.canonical").alias("canonical_source_url"), F.lit(acquired_at).alias("acquired_at"),
        F.col("completeness").alias("content_completeness"), F.col("identity.submission_id").alias("reddit_submission_id"), F.col("identity.comment_id").alias("reddit_comment_id"), F.when(F.col("identity.comment_id").isNotNull(), F.col("identity.submission_id")).alias("parent_thread_id"),
        full.alias("body_complete"), F.lit(acquired_at).alias("retrieved_at"), F.lit(raw_retention).alias("raw_retention"), removed.alias("removed_or_deleted"), F.col("archived_at").alias("archive_retrieved_on"),
    )
    return rows.select(
        F.concat(F.lit("r/"), community).alias("source"), "identity", "completeness", text.alias("text"), "title", "author", "published_at", "language", F.array_compact(F.array(*(F.when(v.isNull(), F.lit(n)) for n, v in named.items()))).alias("missing_fields"),
        canonical_json(F.to_json(provenance, {"ignoreNullFields": "false"})).alias("provenance_json"), F.when(elsewhere, "SOURCE_NOT_COVERED").alias("failure"),
    )
