"""Writes as transforms of snapshots: merges, first-wins inserts, versioned replacement, and their conflicts.

Nothing here changes a table in place.  Each function takes the current rows and
the incoming ones and gives the next rows, or the rows that forbid the change.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions.schema import canonical_json
from provenant.sources.scratch import written

POLICY = ("access_method", "commercial_use_status", "retention_rules", "attribution_requirements", "quoting_rules", "deletion_requirements", "rate_limit_notes", "rights_reviewed_at")
COMPLETENESS = ("METADATA_ONLY", "PARTIAL", "FULL")
PASS_TYPES = ("WORKAROUND_RESEARCH", "COMPETITION", "DACH_TRANSFER", "COUNTER_EVIDENCE")


def with_new_ids(rows: DataFrame, current: DataFrame, key: str, blocks: int = 64) -> DataFrame:
    """Give rows without an id the next ones, in blocks of their key's hash, so that no sort holds all rows.

    Ids start after the largest one in use; a replay gives the same ids.
    """
    fresh = rows.filter("id is null").withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    counts = fresh.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # as many rows as blocks
    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    numbered = fresh.withColumn("_rank", rank).join(F.broadcast(starts), "_block").crossJoin(F.broadcast(top))
    numbered = numbered.withColumn("id", (F.col("_top") + F.col("_start") + F.col("_rank")).cast("long")).select(*rows.columns)
    return rows.filter("id is not null").unionByName(numbered)


def merge_sources(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by normalised key: the name is replaced, policy fields only by known values, the lifecycle only if given."""
    new = incoming.select(*(F.col(c).alias(f"n_{c}") for c in incoming.columns))
    both = current.join(new, F.col("normalized_key") == F.col("n_normalized_key"), "full_outer")
    keep = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c)
    rows = both.select("id", keep("normalized_key"), keep("name"), F.coalesce("n_lifecycle", "lifecycle", F.lit("CANDIDATE")).alias("lifecycle"), *(keep(c) for c in POLICY))
    return with_new_ids(rows, current, "normalized_key")


def fill_policy_defaults(sources: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Fill policy fields that are unknown or marked for review; a reviewed decision stays."""
    open_ = lambda c: F.col(c).isNull() | (F.upper(F.replace(F.trim(c), F.lit("-"), F.lit("_"))) == "REQUIRES_REVIEW")
    return sources.withColumns({c: F.when(open_(c), F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()})


def merge_profiles(current: DataFrame, incoming: DataFrame, always: tuple[str, ...], arrays: tuple[str, ...], key: str = "source_id") -> DataFrame:
    """Coalescing merge: fields in ``always`` are replaced, empty arrays count as missing."""
    new = incoming.select(*(F.col(c).alias(f"n_{c}") for c in incoming.columns))
    both = current.join(new, F.col(key) == F.col(f"n_{key}"), "full_outer")

    def value(c: str) -> Column:
        n = F.col(f"n_{c}")
        if c in always:
            return F.when(F.col(f"n_{key}").isNotNull(), n).otherwise(F.col(c)).alias(c)
        return F.coalesce(F.when(F.size(n) > 0, n) if c in arrays else n, F.col(c)).alias(c)

    return both.select(*(value(c) for c in current.columns))


def completeness_rank(value: Column) -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in COMPLETENESS)), value).cast("int")


def merge_content(arrivals: DataFrame) -> DataFrame:
    """The content of each item after all arrivals (``item_id, arrival, completeness, raw_text``).

    A richer arrival replaces a poorer one, never the other way; among equals the
    first stands.  Further full texts that differ are counted as conflicts.
    """
    rank = completeness_rank(F.col("completeness"))
    full = F.col("completeness") == "FULL"
    best = F.max_by(F.struct("completeness", "raw_text", "arrival"), F.struct(rank, -F.col("arrival"))).alias("b")
    first_full = F.min_by(F.when(full, F.col("raw_text")), F.when(full, F.col("arrival"))).alias("first_full")
    chosen = arrivals.groupBy("item_id").agg(best, first_full)
    differing = arrivals.filter(full).join(chosen.select("item_id", "first_full"), "item_id").filter(~F.col("raw_text").eqNullSafe(F.col("first_full"))).groupBy("item_id").agg(F.count("*").alias("conflicts"))
    return chosen.join(differing, "item_id", "left").select("item_id", "b.completeness", "b.raw_text", "b.arrival", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


CONFLICT = "array<struct<detected_at: string, provider: string>>"


def merge_records(arrivals: DataFrame) -> DataFrame:
    """:func:`merge_content` with the metadata of the text that stands, and a record of every conflict in them.

    ``arrivals`` also holds ``provider, metadata_json``.  The metadata of the chosen arrival
    replace older ones; ``content_completeness`` is set, and each further full text that
    differs is appended to ``content_conflicts`` with its provider and the ``acquired_at``
    of its metadata, in the order of arrival, after those that the metadata held already.
    Metadata that are no JSON object count as empty.  Keys are in order at every depth.
    Texts are compared by digest, so only the chosen ones are moved whole.
    """
    rank, full = completeness_rank(F.col("completeness")), F.col("completeness") == "FULL"
    rows = arrivals.withColumn("_digest", F.sha2("raw_text", 256))
    best = F.max_by(F.struct("completeness", "raw_text", "arrival", "metadata_json", "_digest"), F.struct(rank, -F.col("arrival"))).alias("b")
    chosen = rows.groupBy("item_id").agg(best)
    kept = chosen.filter("b.completeness = 'FULL'").select("item_id", F.col("b._digest").alias("_kept"))
    told = F.get_json_object("metadata_json", "$.acquired_at")
    others = rows.filter(full).select("item_id", "arrival", "provider", told.alias("detected_at"), "_digest").join(kept, "item_id").filter(~F.col("_digest").eqNullSafe(F.col("_kept")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("arrival", "detected_at", "provider"))), lambda x: F.struct(x["detected_at"].alias("detected_at"), x["provider"].alias("provider")))
    records = others.groupBy("item_id").agg(listed.alias("_new"))
    out = chosen.join(records, "item_id", "left").select("item_id", "b.completeness", "b.raw_text", "b.arrival", F.col("b.metadata_json").alias("_metadata"), "_new")
    old = F.coalesce(F.from_json(F.get_json_object("_metadata", "$.content_conflicts"), CONFLICT), F.array().cast(CONFLICT))
    conflicts = F.concat(old, F.coalesce("_new", F.array().cast(CONFLICT)))
    held = out.withColumn("_conflicts", conflicts)
    own = F.when(F.size("_conflicts") > 0, F.to_json(F.struct(F.col("completeness").alias("content_completeness"), F.col("_conflicts").alias("content_conflicts")), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct(F.col("completeness").alias("content_completeness"))))
    return held.select("item_id", "completeness", "raw_text", "arrival", F.size("_conflicts").cast("long").alias("conflicts"), merged_json(F.col("_metadata"), own).alias("metadata_json"))


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects as one: the new one's values stand where both have a key; keys are in order at every depth.

    What is no JSON object counts as an empty one.
    """
    fields = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), F.try_variant_get(F.parse_json(F.lit("{}")), "$", "map<string,variant>"))
    kept = F.map_filter(fields(old), lambda k, _: ~F.array_contains(F.map_keys(fields(new)), k))
    return canonical_json(F.to_json(F.map_concat(kept, fields(new))))


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order: a single aggregation, no window."""
    others = [c for c in rows.columns if c not in keys]
    chosen = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return chosen.select(*keys, "_r.*")


def reused_responses(requests: DataFrame) -> DataFrame:
    """Only the first request of a URL costs; later ones reuse its answer at no cost and unknown latency."""
    turn = F.row_number().over(Window.partitionBy("canonical_url").orderBy("id"))
    reused = turn > 1
    return requests.withColumn("reused", reused).withColumns({"cost_usd": F.when(F.col("reused"), F.lit(0.0)).otherwise(F.col("cost_usd")), "latency_ms": F.when(F.col("reused"), F.lit(None)).otherwise(F.col("latency_ms"))})


def absent(incoming: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet; nulls in keys are equal."""
    known = current.select(*(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = one if same is None else same & one
    return incoming.join(known, same, "left_anti")


def conflicting_replays(incoming: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that are replayed with other values than recorded."""
    old = current.select(F.col(key), F.struct(*fields).alias("_old"))
    return incoming.join(old, key).filter(~F.struct(*fields).eqNullSafe(F.col("_old"))).select(key)


def replace_clusters(before: DataFrame, assignments: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Clusters of a version after reassignment: surviving fingerprints keep their ids, empty clusters go.

    ``before`` holds ``id, fingerprint``; ``assignments`` ``fingerprint, observation_id``;
    new ids follow those of ``taken`` (of ``before``, if that is not given).
    """
    wanted = assignments.groupBy("fingerprint").agg(F.count("*").alias("members"))
    rows = wanted.join(before.select("id", "fingerprint"), "fingerprint", "left").select("id", "fingerprint", "members")
    return with_new_ids(rows, before if taken is None else taken, "fingerprint")


def open_cases(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New cases and their four pending passes."""
    cases = clusters.select(F.col("cluster_id").alias("id"), "cluster_id", F.lit("OPEN").alias("status"))
    passes = cases.select(F.col("id").alias("case_id"), F.explode(F.array(*(F.lit(p) for p in PASS_TYPES))).alias("pass_type"), F.lit("PENDING").alias("status"))
    return cases, passes


def revise_field(observations: DataFrame, revisions: DataFrame, field: str) -> DataFrame:
    """Observations with the latest audited value of a field (``observation_id, version, new_value``)."""
    last = revisions.groupBy("observation_id").agg(F.max_by("new_value", "version").alias("_new"), F.lit(True).alias("_revised"))
    out = observations.join(last.withColumnRenamed("observation_id", "_oid"), F.col("id") == F.col("_oid"), "left")
    return out.withColumn(field, F.when(F.col("_revised"), F.col("_new")).otherwise(F.col(field))).select(*observations.columns)


def judged_revisions(revisions: DataFrame, field: str, observations: DataFrame, spans: DataFrame, members: DataFrame, cases: DataFrame, recorded: DataFrame) -> DataFrame:
    """Revisions with ``old_value_json, new_value_json, replayed`` and the ``refusal`` that stands against one.

    ``revisions`` holds ``observation_id, value, reason, evidence_span_id,
    revision_version``.  A revision needs a reason, a version, a span of its own
    observation and a new value; none is made once a case stands on the cluster; the
    same version with the same value is a replay.
    """
    as_json = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', "$1"))
    rows = revisions.join(observations.select(F.col("id").alias("observation_id"), F.col(field).alias("_old"), F.lit(True).alias("_known")), "observation_id", "left")
    rows = rows.join(spans.select(F.col("id").alias("evidence_span_id"), F.col("observation_id").alias("_owner")), "evidence_span_id", "left")
    before = recorded.filter(F.col("field_name") == field).select("observation_id", "revision_version", F.col("new_value_json").alias("_recorded"))
    rows = rows.join(before, ["observation_id", "revision_version"], "left")
    locked = members.join(cases.select("cluster_id").distinct(), "cluster_id", "left_semi").select("observation_id", F.lit(True).alias("_locked")).distinct()
    rows = rows.join(locked, "observation_id", "left").withColumns({"old_value_json": as_json(F.col("_old")), "new_value_json": as_json(F.col("value"))})
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    replayed = F.col("_recorded").isNotNull() & (F.col("_recorded") == F.col("new_value_json"))
    why = (
        F.when(F.col("_known").isNull(), "there is no such observation")
        .when(blank("reason") | blank("revision_version"), "a revision has a reason and a version")
        .when(~F.col("_owner").eqNullSafe(F.col("observation_id")), "the evidence is of another observation")
        .when(F.col("_recorded").isNotNull() & ~replayed, "the version is recorded with another value")
        .when(~replayed & F.col("_old").eqNullSafe(F.col("value")), "the value is the same")
        .when(~replayed & F.coalesce("_locked", F.lit(False)), "a case stands on the observation's cluster")
    )
    return rows.withColumns({"field_name": F.lit(field), "replayed": replayed, "refusal": why}).drop("_old", "_known", "_owner", "_recorded", "_locked")


def without_observations(members: DataFrame, fingerprints: DataFrame, clusters: DataFrame, cases: DataFrame, revised: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memberships, fingerprints and clusters after some observations (``observation_id``) changed: theirs go, and clusters left empty without a case."""
    gone = revised.select("observation_id").distinct()
    kept = members.join(gone, "observation_id", "left_anti").select(*members.columns)
    used = kept.select(F.col("cluster_id").alias("id")).unionByName(cases.select(F.col("cluster_id").alias("id"))).distinct()
    return kept, fingerprints.join(gone, "observation_id", "left_anti").select(*fingerprints.columns), clusters.join(used, "id", "left_semi").select(*clusters.columns)


def set_family(observations: DataFrame, changes: DataFrame) -> DataFrame:
    """Observations with new families and ontology versions (``observation_id, problem_family, ontology_version``)."""
    new = changes.select(F.col("observation_id").alias("_o"), F.col("problem_family").alias("_f"), F.col("ontology_version").alias("_v"))
    out = observations.join(new, F.col("id") == F.col("_o"), "left")
    there = F.col("_o").isNotNull()
    named = {"problem_family": "_f", "ontology_version": "_v"}
    return out.withColumns({c: F.when(there, F.col(n)).otherwise(F.col(c)) for c, n in named.items() if c in observations.columns}).select(*observations.columns)


def assigned_clusters(clusters: DataFrame, fingerprints: DataFrame, members: DataFrame, cases: DataFrame, marked: DataFrame, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters, fingerprints and memberships after a version is assigned anew from ``observation_id, fingerprint``.

    Fingerprints that stay keep their cluster's id, new ones get the next ids; a
    cluster of the version that is left empty goes unless a case stands on it.
    Other versions stay as they are.
    """
    own = clusters.filter(F.col("algorithm_version") == version)
    placed = replace_clusters(own, marked, clusters).select("id", "fingerprint")
    with_case = own.join(cases.select(F.col("cluster_id").alias("id")), "id", "left_semi").join(placed.select("id"), "id", "left_anti").select("id", "fingerprint")
    after = clusters.filter(F.col("algorithm_version") != version).select("id", "algorithm_version", "fingerprint").unionByName(placed.unionByName(with_case).select("id", F.lit(version).alias("algorithm_version"), "fingerprint"))
    prints = fingerprints.filter(F.col("fingerprint_version") != version).unionByName(marked.select("observation_id", F.lit(version).alias("fingerprint_version"), "fingerprint"))
    of_version = members.join(own.select(F.col("id").alias("cluster_id")), "cluster_id", "left_anti").select("cluster_id", "observation_id")
    return after, prints, of_version.unionByName(marked.join(placed, "fingerprint").select(F.col("id").alias("cluster_id"), "observation_id"))


def model_run_refusal(amount: Column, currency: Column, measured_by: Column) -> Column:
    """Why a model run's cost is refused: amount, currency and source of the measure come together, the currency has three letters; null if fine."""
    given = sum((F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) != "", 1).otherwise(0) for c in (amount, currency, measured_by)), F.lit(0))
    number = amount.try_cast("decimal(38,12)")
    return F.when(~given.isin(0, 3), "amount, currency and source come together").when(given == 0, F.lit(None)).when(~F.rlike(currency, F.lit("^[A-Z]{3}$")), "a currency has three capital letters").when(number.isNull() | (number < 0), "an amount is a number that is not negative")


def opportunity_claims(opportunities: DataFrame, passes: DataFrame, competitors: DataFrame, counter: DataFrame, competitor_evidence: DataFrame | None = None, complaints: DataFrame | None = None, complaint_evidence: DataFrame | None = None) -> DataFrame:
    """Claims of each opportunity by role, each once.

    Summaries of passes support, those of the counter-evidence pass contradict, as do
    its findings; context comes from competitors: their profiles, evidence, complaints
    and the evidence of those.
    """
    of = opportunities.select(F.col("id").alias("opportunity_id"), "case_id")
    vendor = competitors.select(F.col("id").alias("competitor_id"), "case_id")
    role = F.when(F.col("pass_type") == "COUNTER_EVIDENCE", "CONTRADICTING").otherwise("SUPPORTING")
    parts = [passes.filter("summary_claim_id is not null").select("case_id", F.col("summary_claim_id").alias("claim_id"), role.alias("claim_role")), counter.select("case_id", F.col("factual_claim_id").alias("claim_id"), F.lit("CONTRADICTING").alias("claim_role"))]
    context = [competitors.select("case_id", F.col("profile_claim_id").alias("claim_id"))]
    if competitor_evidence is not None:
        context.append(competitor_evidence.join(vendor, "competitor_id").select("case_id", "claim_id"))
    if complaints is not None:
        context.append(complaints.join(vendor, "competitor_id").select("case_id", F.col("summary_claim_id").alias("claim_id")))
        if complaint_evidence is not None:
            own = complaints.select(F.col("id").alias("complaint_id"), "competitor_id").join(vendor, "competitor_id")
            context.append(complaint_evidence.join(own, "complaint_id").select("case_id", "claim_id"))
    parts += [c.filter("claim_id is not null").withColumn("claim_role", F.lit("CONTEXT")) for c in context]
    return reduce(DataFrame.unionByName, parts).join(of, "case_id").select("opportunity_id", "claim_id", "claim_role").distinct()


def problem_claims(cases: DataFrame, members: DataFrame, observations: DataFrame, spans: DataFrame) -> DataFrame:
    """``case_id, observation_id, evidence_span_id, text``: the first observation of a case that states a problem and has a span, with its first span."""
    stated = observations.filter(F.length(F.trim("problem")) > 0).select(F.col("id").alias("observation_id"), "problem")
    first = spans.filter("observation_id is not null").groupBy("observation_id").agg(F.min("id").alias("evidence_span_id"))
    rows = cases.select(F.col("id").alias("case_id"), "cluster_id").join(members.select("cluster_id", "observation_id"), "cluster_id").join(stated, "observation_id").join(first, "observation_id")
    chosen = rows.groupBy("case_id").agg(F.min_by(F.struct("observation_id", "evidence_span_id", F.col("problem").alias("text")), "observation_id").alias("p"))
    return chosen.select("case_id", "p.*")


def creatable_opportunities(cases: DataFrame, opportunities: DataFrame, problems: DataFrame) -> DataFrame:
    """``case_id, refusal, existing_id`` of cases: only complete ones with an evidenced problem get an opportunity, and a ready one is not made anew."""
    old = opportunities.select("case_id", F.col("id").alias("existing_id"), F.col("status").alias("_old"))
    rows = cases.select(F.col("id").alias("case_id"), "status").join(old, "case_id", "left").join(problems.select("case_id", F.lit(True).alias("_problem")), "case_id", "left")
    why = F.when(F.col("status") != "COMPLETE", "the case is not complete").when(F.col("_old") == "REPORT_READY", "the opportunity is ready and stays as it is").when(F.col("existing_id").isNull() & F.col("_problem").isNull(), "the case has no problem with evidence")
    return rows.select("case_id", why.alias("refusal"), "existing_id")


def search_opportunities(opportunities: DataFrame, cases: DataFrame, members: DataFrame, observations: DataFrame, *, query: str | None = None, status: str | None = None, evidence_state: str | None = None, types: DataFrame | None = None, opportunity_type: str | None = None, saved: DataFrame | None = None, limit: int | None = 100) -> DataFrame:
    """Opportunities by filters and a literal text over title, problem, actor, job and context; newest first (all of them, if ``limit`` is None)."""
    if limit is not None and not 1 <= limit <= 1000:
        raise ValueError("a search gives 1 to 1000 opportunities")
    out = opportunities
    if status:
        out = out.filter(F.col("status") == status)
    if evidence_state:
        out = out.filter(F.col("evidence_state") == evidence_state)
    if opportunity_type and types is not None:
        out = out.join(types.filter(F.col("opportunity_type") == opportunity_type).select(F.col("opportunity_id").alias("id")), "id", "left_semi")
    if saved is not None:
        out = out.join(saved.select(F.col("opportunity_id").alias("id")), "id", "left_semi")
    if query and query.strip():
        needle = F.lit(query.strip().lower())
        said = None
        for c in ("problem", "actor", "job_to_be_done", "context"):
            one = F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
            said = one if said is None else said | one
        hits = observations.filter(said).select(F.col("id").alias("observation_id"))
        found = cases.select(F.col("id").alias("case_id"), "cluster_id").join(members.join(hits, "observation_id", "left_semi").select("cluster_id").distinct(), "cluster_id", "left_semi").select("case_id", F.lit(True).alias("_hit"))
        out = out.join(found, "case_id", "left").filter(F.contains(F.lower("title"), needle) | F.coalesce("_hit", F.lit(False))).drop("_hit")
    return ordered(out, limit, F.desc("updated_at"), F.desc("id"))


def ordered(rows: DataFrame, limit: int | None, *keys: Column) -> DataFrame:
    """The first rows in order (all, if ``limit`` is None), with their ``position``; no task sees more than ``limit`` rows of each partition, or one range of all."""
    if limit is None:
        return numbered(rows, *keys)
    top = rows.orderBy(*keys).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*keys)))


def numbered(rows: DataFrame, *keys: Column) -> DataFrame:
    """All rows with their ``position`` in order: ranges of rows are kept, and a row's place in its range is added to the rows of the ranges before."""
    ranged = written(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_here"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = counts.select("_range", F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)))
    return placed.join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_before") + F.col("_place")).cast("int").alias("position"))


def saved_list(saved: DataFrame, opportunities: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Bookmarks that name an opportunity, the latest first (all of them, if ``limit`` is None)."""
    rows = saved.withColumnRenamed("opportunity_id", "id").join(opportunities.select("id"), "id")
    return ordered(rows.select("id", "note", "saved_at"), limit, F.desc("saved_at"), F.desc("id"))


# Stakeholder roles in the order of a report.
ROLES = ("END_USER", "BUYER", "DECISION_MAKER", "GATEKEEPER", "INFLUENCER")


def stakeholders(rows: DataFrame) -> DataFrame:
    """Stakeholders of each case with their ``position`` in the order of their roles."""
    place = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col("role"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy(place, "role")))


def sample_problems(observations: DataFrame, items: DataFrame, sources: DataFrame, spans: DataFrame, limit: int = 10) -> DataFrame:
    """The first evidenced problems, those with an impact or an active search before the others."""
    impact = [F.col(c).isNotNull() for c in ("time_impact", "financial_impact") if c in observations.columns]
    loud = reduce(or_, impact, F.coalesce("active_solution_search", F.lit(False)))
    rows = observations.select(F.col("id").alias("observation_id"), "problem", "source_item_id", loud.alias("loud"))
    rows = rows.join(items.select(F.col("id").alias("source_item_id"), "source_id"), "source_item_id").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("community")), "source_id")
    rows = rows.join(spans.select("observation_id", F.col("id").alias("span_id"), "excerpt"), "observation_id")
    return ordered(rows.select("observation_id", "span_id", "community", "problem", "excerpt", "loud"), limit, F.desc("loud"), F.col("observation_id"), F.col("span_id"))


def scope_summary(cases: DataFrame, members: DataFrame, observations: DataFrame, spans: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence of each case by scope: distinct observations, items and sources, their names and countries, dated items."""
    rows = cases.select(F.col("id").alias("case_id"), "cluster_id").join(members, "cluster_id").join(spans.select("observation_id", "source_item_id", "evidence_scope"), "observation_id")
    rows = rows.join(items.select(F.col("id").alias("source_item_id"), "source_id", "country_code", "published_at"), "source_item_id").join(sources.select(F.col("id").alias("source_id"), "name"), "source_id")
    return rows.groupBy("case_id", "evidence_scope").agg(
        F.count_distinct("observation_id").alias("observations"),
        F.count_distinct("source_item_id").alias("items"),
        F.count_distinct("source_id").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("name")), ",").alias("source_names"),
        F.array_join(F.array_sort(F.collect_set(F.upper("country_code"))), ",").alias("countries"),
        F.count_distinct(F.when(F.col("published_at").isNotNull(), F.col("source_item_id"))).alias("dated_items"),
        F.min("published_at").alias("first_published"),
        F.max("published_at").alias("last_published"),
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Replace rows by key; nulls in keys are equal, other rows stay."""
    return absent(current, incoming, keys).unionByName(incoming.select(*current.columns))


def set_status(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with new statuses (``key, status``); unchanged ones stay."""
    new = changes.select(F.col(key).alias("_k"), F.col("status").alias("_s"))
    return rows.join(new, F.col(key) == F.col("_k"), "left").withColumn("status", F.coalesce("_s", "status")).select(*rows.columns)


def unknown_keys(changes: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Keys of changes that meet no row."""
    return changes.select(key).join(rows.select(key), key, "left_anti")


def upsert_items(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Source items by (source, external id): new texts and columns win, the first sighting stays."""
    keys = ["source_id", "external_id"]
    new = incoming.select(*(F.col(c).alias(f"n_{c}") for c in incoming.columns))
    both = current.join(new, (F.col("source_id") == F.col("n_source_id")) & (F.col("external_id") == F.col("n_external_id")), "full_outer")
    first = F.coalesce("first_seen_at", "n_first_seen_at").alias("first_seen_at")
    pick = lambda c: F.when(F.col("n_source_id").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    merged = both.select("id", *(first if c == "first_seen_at" else pick(c) for c in current.columns if c not in ("id",)))
    named = merged.withColumn("_key", F.concat_ws("\u0001", F.col("source_id").cast("string"), "external_id"))  # equal ids of two sources are two items
    return with_new_ids(named.select("_key", *current.columns), current, "_key").select(*current.columns)


def acquisition_upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Acquisitions by (discovery, provider): item and completeness are kept where the new ones are unknown."""
    new = incoming.select(*(F.col(c).alias(f"n_{c}") for c in incoming.columns))
    both = current.join(new, (F.col("discovery_id") == F.col("n_discovery_id")) & (F.col("provider") == F.col("n_provider")), "full_outer")
    kept = ("source_item_id", "completeness")
    there = F.col("n_discovery_id").isNotNull()
    return both.select(*(F.coalesce(f"n_{c}", c).alias(c) if c in kept else F.when(there, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns))


def satisfy_passes(passes: DataFrame, results: DataFrame) -> DataFrame:
    """Passes with their results (``case_id, pass_type, outcome, summary_claim_id``)."""
    new = results.select(F.col("case_id").alias("_c"), F.col("pass_type").alias("_p"), F.col("outcome").alias("_o"), F.col("summary_claim_id").alias("_s"))
    done = F.col("_c").isNotNull()
    out = passes.join(new, (F.col("case_id") == F.col("_c")) & (F.col("pass_type") == F.col("_p")), "left")
    return out.withColumns({"status": F.when(done, "SATISFIED").otherwise(F.col("status")), "outcome": F.when(done, F.col("_o")).otherwise(F.col("outcome")), "summary_claim_id": F.when(done, F.col("_s")).otherwise(F.col("summary_claim_id"))}).select(*passes.columns)


def save_opportunities(saved: DataFrame, notes: DataFrame) -> DataFrame:
    """Bookmarks with new notes (``opportunity_id, note, saved_at``); the first time of saving stays."""
    new = notes.select(F.col("opportunity_id").alias("_o"), F.col("note").alias("_n"), F.col("saved_at").alias("_t"))
    both = saved.join(new, F.col("opportunity_id") == F.col("_o"), "full_outer")
    return both.select(F.coalesce("opportunity_id", "_o").alias("opportunity_id"), F.when(F.col("_o").isNotNull(), F.col("_n")).otherwise(F.col("note")).alias("note"), F.coalesce("saved_at", "_t").alias("saved_at"))


def append_health(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History with new checks, and checks that repeat a (source, provider, time) with another payload."""
    keys = ["source_id", "provider", "checked_at"]
    fields = [c for c in incoming.columns if c not in keys]
    old = current.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*fields).alias("_old"))
    same = None
    for k in keys:
        one = F.col(k) == F.col(f"_{k}")
        same = one if same is None else same & one
    conflicts = incoming.join(old, same).filter(~F.struct(*fields).eqNullSafe(F.col("_old"))).select(*keys)
    return current.select(*incoming.columns).unionByName(absent(incoming, current, keys)), conflicts


def merge_products(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Products by key: a tagline is kept where the new one is unknown, hits are replaced; ``is_new`` marks first sightings."""
    new = incoming.select(*(F.col(c).alias(f"n_{c}") for c in incoming.columns))
    both = current.join(new, F.col("key") == F.col("n_key"), "full_outer")
    there = F.col("n_key").isNotNull()
    return both.select(
        F.coalesce("key", "n_key").alias("key"), F.when(there, F.col("n_name")).otherwise(F.col("name")).alias("name"), F.coalesce("n_tagline", "tagline").alias("tagline"),
        F.when(there, F.col("n_pain_hits")).otherwise(F.col("pain_hits")).alias("pain_hits"), F.coalesce("seen_date", "n_seen_date").alias("seen_date"), F.col("key").isNull().alias("is_new"),
    )


def create_claims(drafts: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims and links of drafts (``id, observation_id, claim_kind, text, evidence_span_ids``), and facts that lack a span of their own observation."""
    links = drafts.select(F.col("id").alias("claim_id"), "observation_id", F.explode("evidence_span_ids").alias("evidence_span_id"))
    owned = links.join(spans.select(F.col("id").alias("evidence_span_id"), F.col("observation_id").alias("_owner")), "evidence_span_id").filter(F.col("observation_id").isNull() | F.col("observation_id").eqNullSafe(F.col("_owner"))).select("claim_id", "evidence_span_id").distinct()
    refused = drafts.filter("claim_kind = 'FACT'").join(owned.select(F.col("claim_id").alias("id")), "id", "left_anti").select("id")
    return drafts.select("id", "observation_id", "claim_kind", "text").join(refused, "id", "left_anti"), owned, refused


def case_report(cases: DataFrame, members: DataFrame, observations: DataFrame, spans: DataFrame, passes: DataFrame, competitors: DataFrame, counter: DataFrame, unknowns: DataFrame, questions: DataFrame) -> DataFrame:
    """One nested row per case with all that a report shows; each list is gathered once and joined."""

    def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    evidence = members.join(observations.select(F.col("id").alias("observation_id"), "problem", "actor", "evidence_scope"), "observation_id").join(spans.select("observation_id", F.col("id").alias("span_id"), "excerpt"), "observation_id", "left")
    own = cases.select(F.col("id").alias("case_id"), "cluster_id").join(evidence, "cluster_id")
    out = cases.select(F.col("id").alias("case_id"), "title", "status")
    for side in (listed(own, "evidence", "observation_id", "span_id", "problem", "actor", "evidence_scope", "excerpt"), listed(passes, "passes", "pass_type", "status", "outcome", "summary_claim_id"), listed(competitors, "competitors", "name", "solution_type", "pricing"), listed(counter, "counter_evidence", "evidence_type", "factual_claim_id"), listed(unknowns, "unknowns", "statement"), listed(questions, "questions", "question")):
        out = out.join(side, "case_id", "left")
    return out


def funnel(items: DataFrame, screened: DataFrame, observations: DataFrame, strong: Column) -> DataFrame:
    """Counts of each stage, one row."""
    parts = [items.agg(F.count("*").alias("items")), screened.agg(F.count("*").alias("screened")), observations.agg(F.count("*").alias("observations"), F.count_if(strong).alias("strong"))]
    return parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))  # three single rows


def finish_runs(runs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with their results (``id, status, output_count``), and results of runs that are not running."""
    new = results.select(F.col("id").alias("_r"), F.col("status").alias("_s"), F.col("output_count").alias("_o"))
    refused = results.join(runs.filter("status = 'RUNNING'").select("id"), "id", "left_anti").select("id")
    ends = (F.col("status") == "RUNNING") & F.col("_r").isNotNull()
    out = runs.join(new, F.col("id") == F.col("_r"), "left")
    return out.withColumns({"output_count": F.when(ends, F.col("_o")).otherwise(F.col("output_count")), "status": F.when(ends, F.col("_s")).otherwise(F.col("status"))}).select(*runs.columns), refused


def replace_snapshot(current: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """A versioned table in which one version is replaced as a whole."""
    return current.filter(F.col(key) != value).unionByName(rows.withColumn(key, F.lit(value)).select(*current.columns))
