"""Discovery, acquisition and feed ingestion as plans over tables of recorded answers.

A provider is a table of answers (a capture, or what a client has fetched); no
step calls out.  Every function gives the rows to write and, where an answer
contradicts itself, the rows that refuse the write with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import text
from provenant.operators.lifecycle import first_of_each
from provenant.sources.readers import replay_search

#: A time with a zone, as an ISO text.
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def attested(body_complete: Column, retrieved_at: Column) -> Column:
    """Whether a provider vouches for a whole body, retrieved at a time with a zone."""
    return F.coalesce(body_complete & F.rlike(F.trim(retrieved_at), F.lit(ZONED)) & F.try_to_timestamp(F.trim(retrieved_at)).isNotNull(), F.lit(False))


def external_id(identity: Column) -> Column:
    """The item id of a post or comment identity (see :func:`text.post_identity`)."""
    comment = F.concat(F.lit("reddit:comment:"), identity["submission_id"], F.lit(":"), identity["comment_id"])
    return F.when(identity["comment_id"].isNotNull(), comment).otherwise(F.concat(F.lit("reddit:submission:"), identity["submission_id"]))


def query_grid(sources: DataFrame, vocabularies: dict[str, tuple[str, ...]], time_context: str | None = None) -> DataFrame:
    """``source_id, community, query_group, query`` for every source and vocabulary; both are small."""
    groups = F.explode(F.array(*(F.struct(F.lit(g).alias("query_group"), F.array(*(F.lit(t) for t in v)).alias("terms")) for g, v in vocabularies.items())))
    clean = F.array_distinct(F.filter(F.transform("terms", lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != ""))
    quoted = F.array_join(F.transform(clean, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")
    when = f' "{time_context}"' if time_context else ""
    rows = sources.select(F.col("id").alias("source_id"), F.regexp_replace("name", "^r/", "").alias("community"), groups.alias("g")).select("source_id", "community", "g.*")
    return rows.select("source_id", "community", "query_group", F.concat(F.lit("site:reddit.com/r/"), F.col("community"), F.lit(" ("), quoted, F.lit(f"){when}")).alias("query"))


def discovered(grid: DataFrame, captures: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """Discovery runs and their records from recorded answers of exact queries.

    ``captures`` holds ``query, availability, results`` (an array of structs with
    ``url`` and ``title``) and optionally ``latency_ms, cost_usd``.  A query without
    an answer is a run that was unavailable.  Results that are no post of the
    queried community are counted, not recorded; a URL is recorded once a run.
    """
    extra = [c for c in ("latency_ms", "cost_usd") if c in captures.columns]
    answers = replay_search(captures.select("query", "availability", "results", *extra), grid)
    run = F.sha2(F.concat_ws("\u0001", F.lit(provider), F.col("source_id").cast("string"), F.col("query")), 256)
    answers = answers.withColumns({"run_id": run, "provider": F.lit(provider), "results": F.coalesce("results", F.array().cast(captures.schema["results"].dataType))})
    hits = answers.select("run_id", "source_id", "community", "provider", "query", F.posexplode("results").alias("place", "r"))
    named = hits.withColumn("identity", text.post_identity(F.col("r.url"))).filter(F.lower("identity.community") == F.lower("community"))
    records = first_of_each(
        named.select("run_id", F.col("identity.canonical").alias("canonical_url"), "source_id", "provider", "query", F.col("r.url").alias("url"), F.col("identity.submission_id").alias("submission_id"), F.col("identity.comment_id").alias("comment_id"), F.col("r.title").alias("title"), "place", F.lit("DISCOVERED").alias("state")),
        ["run_id", "canonical_url"], [F.col("place")],
    ).drop("place")
    known = named.groupBy("run_id").agg(F.count("*").alias("urls_discovered"))
    runs = answers.join(known, "run_id", "left").select(
        F.col("run_id").alias("id"), "source_id", "provider", "query", "availability", F.size("results").cast("long").alias("results_returned"), F.coalesce("urls_discovered", F.lit(0)).alias("urls_discovered"),
        *(F.col(c) if c in extra else F.lit(None).cast(t).alias(c) for c, t in (("latency_ms", "long"), ("cost_usd", "double"))),
    )
    return runs, records


ANSWER_FIELDS = {"state": "string", "completeness": "string", "text": "string", "title": "string", "author_external_id": "string", "published_at": "string", "body_complete": "boolean", "retrieved_at": "string", "latency_ms": "long", "cost_usd": "double", "error": "string"}


def acquired(discoveries: DataFrame, acquisitions: DataFrame, answers: DataFrame, provider: str, full_content: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Acquisition rows, item contents, and refused answers of all discoveries that a provider has not tried.

    ``answers`` is keyed by ``canonical_url`` (see :func:`readers.replay_acquisition`).
    One URL is asked once: later discoveries of it reuse the answer at no cost and
    unknown latency.
    """
    tried = acquisitions.filter(F.col("provider") == provider).select(F.col("discovery_id").alias("id"))
    pending = discoveries.join(tried, "id", "left_anti").select(F.col("id").alias("discovery_id"), "source_id", "canonical_url")
    known = [c for c in ANSWER_FIELDS if c in answers.columns]
    given = answers.select("canonical_url", *known).withColumns({c: F.lit(None).cast(t) for c, t in ANSWER_FIELDS.items() if c not in known})
    turn = F.row_number().over(Window.partitionBy("canonical_url").orderBy("discovery_id"))
    rows = pending.join(given, "canonical_url", "left").withColumns({"state": F.coalesce("state", F.lit("ACQUISITION_FAILED")), "reused": turn > 1})
    rows = rows.withColumn("refusal", answer_refusal(F.col("state"), F.col("completeness"), F.col("text"), attested(F.col("body_complete"), F.col("retrieved_at")), full_content))
    refused = rows.filter("refusal is not null").select("discovery_id", "canonical_url", "refusal")
    fine = rows.filter("refusal is null")
    identity = text.post_identity(F.col("canonical_url"))
    with_text = fine.filter("not reused and completeness in ('FULL', 'PARTIAL')").withColumn("external_id", F.coalesce(external_id(identity), F.col("canonical_url")))
    contents = with_text.select("source_id", "external_id", F.col("discovery_id").alias("arrival"), "completeness", F.col("text").alias("raw_text"), F.col("canonical_url").alias("url"), "title", "author_external_id", "published_at")
    metadata = F.to_json(F.struct((~F.col("reused")).alias("provider_invocation"), F.when(F.col("reused"), F.col("canonical_url")).alias("reused_acquisition_url")), {"ignoreNullFields": "false"})
    written = fine.select(
        "discovery_id", "source_id", F.when(F.col("completeness").isin("FULL", "PARTIAL"), F.coalesce(external_id(identity), F.col("canonical_url"))).alias("external_id"), F.lit(provider).alias("provider"), "state", "completeness",
        F.when(~F.col("reused"), F.col("latency_ms")).alias("latency_ms"), F.when(F.col("reused"), F.lit(0.0)).otherwise(F.col("cost_usd")).alias("cost_usd"), "error", metadata.alias("metadata_json"),
    )
    return written, contents, refused


def answer_refusal(state: Column, completeness: Column, content: Column, whole: Column, full_content: bool = True) -> Column:
    """Why an answer contradicts itself: its state, completeness, text and attestation must agree; null if they do."""
    success = state.isin("CONTENT_PARTIAL", "CONTENT_COMPLETE")
    blank = F.coalesce(F.trim(content), F.lit("")) == ""
    full = F.coalesce(completeness == "FULL", F.lit(False))
    complete = state == "CONTENT_COMPLETE"
    return (
        F.when(success & completeness.isNull(), "a success names its completeness")
        .when(~success & completeness.isNotNull(), "a failure has no completeness")
        .when(success & complete & ~full, "complete content is full content")
        .when(full & (~complete | F.lit(not full_content)), "full content comes complete, from a provider of full contents")
        .when(success & (completeness != "METADATA_ONLY") & blank, "an acquired text is not empty")
        .when(full & ~whole, "full content is attested whole, at a time with a zone")
    )


def spread_state(discoveries: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Discoveries with the state of their newest acquisition (the largest id); others keep theirs."""
    last = acquisitions.groupBy("discovery_id").agg(F.max_by("state", "id").alias("_state")).withColumnRenamed("discovery_id", "_d")
    return discoveries.join(last, F.col("id") == F.col("_d"), "left").withColumn("state", F.coalesce("_state", "state")).select(*discoveries.columns)


def merged_items(current: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Items by (source, external id) after arrivals: a richer text replaces a poorer one, full texts that differ are counted.

    ``current`` holds ``source_id, external_id, completeness, raw_text, conflicts`` and
    ``url, title, author_external_id, published_at``; ``arrivals`` also ``arrival``.  Of
    equally rich texts the first stands, and what is stored stands before all arrivals.
    """
    keys = ["source_id", "external_id"]
    carried = ["completeness", "raw_text", "url", "title", "author_external_id", "published_at"]
    old = current.select(*keys, *carried, F.lit(None).cast("long").alias("arrival"), F.col("conflicts").cast("long").alias("held"))
    new = arrivals.select(*keys, *carried, F.col("arrival").cast("long").alias("arrival"), F.lit(0).cast("long").alias("held"))
    rank = F.array_position(F.array(F.lit("METADATA_ONLY"), F.lit("PARTIAL"), F.lit("FULL")), F.col("completeness"))
    order = F.struct(-rank, F.coalesce("arrival", F.lit(-(2**63))))
    rows = old.unionByName(new)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*carried), order).alias("b"), F.sum("held").alias("held"))
    fulls = rows.filter("completeness = 'FULL'").select(*keys, "raw_text")
    differing = fulls.join(best.filter("b.completeness = 'FULL'").select(*keys, F.col("b.raw_text").alias("_kept")), keys).filter(~F.col("raw_text").eqNullSafe(F.col("_kept"))).groupBy(*keys).agg(F.count("*").alias("more"))
    out = best.join(differing, keys, "left")
    return out.select(*keys, *(F.col(f"b.{c}").alias(c) for c in carried), (F.col("held") + F.coalesce("more", F.lit(0))).alias("conflicts"))


def feed_rows(records: DataFrame, source_id: int, provider: str, query: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Run, discoveries, acquisitions and contents of one page of provider records.

    ``records`` holds ``identity`` (see :func:`text.post_identity`), ``completeness,
    title, body, author, published_at``.  Records that are no post are left out; two
    records of one post share its discovery.
    """
    known = records.filter("identity is not null").withColumn("arrival", F.monotonically_increasing_id())
    run = F.lit(f"{provider}:{source_id}:{query}")
    discoveries = first_of_each(known.select(F.col("identity.canonical").alias("canonical_url"), "arrival", run.alias("run_id"), F.lit(source_id).cast("long").alias("source_id"), F.lit(provider).alias("provider"), F.col("identity.submission_id").alias("submission_id"), F.col("identity.comment_id").alias("comment_id"), "title", F.lit("DISCOVERED").alias("state")), ["canonical_url"], [F.col("arrival")]).drop("arrival")
    counts = records.agg(F.count("*").alias("results_returned"), F.count("identity").alias("urls_discovered"))
    runs = counts.select(run.alias("id"), F.lit(source_id).cast("long").alias("source_id"), F.lit(provider).alias("provider"), F.lit(query).alias("query"), F.when(F.col("urls_discovered") > 0, "RESULTS").otherwise("NO_RESULTS").alias("availability"), "results_returned", "urls_discovered")
    full = F.col("completeness") == "FULL"
    acquisitions = known.select(F.col("identity.canonical").alias("canonical_url"), F.lit(provider).alias("provider"), F.when(full, "CONTENT_COMPLETE").otherwise("CONTENT_PARTIAL").alias("state"), "completeness", external_id(F.col("identity")).alias("external_id"))
    said = F.concat_ws("\n\n", F.nullif("title", F.lit("")), F.nullif("body", F.lit("")))
    contents = known.filter(F.trim(said) != "").select(F.lit(source_id).cast("long").alias("source_id"), external_id(F.col("identity")).alias("external_id"), "arrival", "completeness", said.alias("raw_text"), F.col("identity.canonical").alias("url"), "title", F.col("author").alias("author_external_id"), "published_at")
    return runs, discoveries, acquisitions, contents


def page_accounting(posts: DataFrame, known: DataFrame, at: str) -> DataFrame:
    """One row per source of what a page brought: ``posts`` holds ``source_id, external_id, completeness, removal_state, published_at``.

    ``known`` are the external ids (``source_id, external_id``) from before; ``at`` is the
    time of retrieval, from which the age of the newest post is told.
    """
    counted = posts.groupBy("source_id").agg(
        F.count("*").alias("received"),
        *(F.count_if(F.col("completeness") == c).alias(c.lower()) for c in ("FULL", "PARTIAL", "METADATA_ONLY")),
        F.count_if(F.col("removal_state") == "REMOVED").alias("removed"),
        F.count_if(F.col("removal_state") == "DELETED").alias("deleted"),
        F.min("published_at").alias("oldest"),
        F.max("published_at").alias("newest"),
    )
    ids = posts.filter("external_id is not null").select("source_id", "external_id").distinct()
    seen = known.select("source_id", "external_id", F.lit(True).alias("_seen")).distinct()
    new = ids.join(seen, ["source_id", "external_id"], "left").groupBy("source_id").agg(F.count_if(F.col("_seen").isNull()).alias("new_items"), F.count("_seen").alias("existing_items"))
    age = F.unix_micros(F.to_timestamp(F.lit(at))) - F.unix_micros(F.to_timestamp("newest"))
    return counted.join(new, "source_id", "left").fillna(0, ["new_items", "existing_items"]).withColumn("age_seconds", (age / 1_000_000).cast("long"))


def utc_text(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO text in UTC, with microseconds only where there are some."""
    at = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.when(seconds == F.floor(seconds), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def page_health(posts: DataFrame, checks: DataFrame, page_size: int = 25) -> DataFrame:
    """A health capture of every checked source, from one page of its newest posts.

    ``checks`` holds ``source, provider, checked_at, latency_ms`` and, where the page did not
    come, ``failure`` (its class) and ``message``; ``posts`` holds ``source, place``
    (the place on the page), ``permalink, created_utc, removed``.  A post counts if it has a link
    and a time and is not removed.  The window that is covered begins at the oldest post of
    the page; it is covered whole only if the page was not full.
    """
    usable = posts.filter((F.coalesce("permalink", F.lit("")) != "") & (F.coalesce("created_utc", F.lit(0.0)) != 0) & ~F.coalesce("removed", F.lit(False)))
    link = F.struct("place", F.concat(F.lit("https://www.reddit.com"), F.col("permalink")).alias("url"))
    pages = usable.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n"), F.min("created_utc").alias("first"), F.max("created_utc").alias("last"), F.slice(F.array_sort(F.collect_list(link)), 1, 5).alias("links"))  # a page is bounded
    rows = checks.join(pages, F.col("source") == F.col("_s"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    failed, seen = F.col("failure").isNotNull(), F.col("failure").isNull() & (F.col("n") > 0)
    unknown = F.col("failure") == "SOURCE_NOT_COVERED"
    return rows.select(
        "source", "provider", "checked_at",
        F.when(unknown, "SOURCE_NOT_FOUND").when(failed, "PROVIDER_FAILED").when(seen, "PUBLIC_CONTENT").otherwise("PUBLIC_NO_RECENT").alias("access_result"),
        F.when(unknown, 404).when(~failed, 200).alias("http_status"),
        F.when(seen, utc_text(F.col("last"))).alias("latest_visible_item_at"),
        F.when(seen, F.col("n")).otherwise(0).cast("int").alias("visible_item_count"),
        F.when(seen, utc_text(F.col("first"))).when(~failed, F.col("checked_at")).alias("sample_window_start"),
        F.when(~failed, F.col("checked_at")).alias("sample_window_end"),
        (~failed & (F.col("n") < page_size)).alias("coverage_complete"),
        F.when(failed, F.col("message")).when(seen, "the search gave recent posts").otherwise("the archive answers, without a usable post").alias("reason"),
        F.when(seen, F.transform("links", lambda x: x["url"])).otherwise(F.array().cast("array<string>")).alias("evidence_urls"),
        "latency_ms", F.lit(0.0).alias("cost_usd"),
    )
