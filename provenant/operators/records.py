"""Typed records of a research case: a parent row is merged by its natural key, and its evidence is added beside it.

A draft names its record by key, never by id; the record that is there keeps its id and
takes all values of the draft, unknown ones included.  Evidence rows are added if they
are absent, so a replay changes nothing.  Whether the claims are facts is for the guards
of the publish (see :mod:`audits`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.text import normalize_url
from provenant.operators.lifecycle import absent, with_new_ids


@dataclass(frozen=True)
class Kind:
    """A kind of record: its table, natural key, texts that must not be blank, and the table of its evidence."""

    table: str
    key: tuple[str, ...]
    texts: tuple[str, ...]
    evidence: str | None = None
    owner: str | None = None
    first_stands: bool = False


KINDS = {
    "competitor": Kind("competitors", ("case_id", "name"), ("name",), "competitor_evidence", "competitor_id"),
    "complaint": Kind("competitor_complaints", ("competitor_id", "complaint_type", "complaint_statement"), ("complaint_type", "complaint_statement"), "competitor_complaint_evidence", "complaint_id"),
    "counter_evidence": Kind("counter_evidence", ("case_id", "evidence_type", "statement"), ("statement",)),
    "unknown": Kind("research_unknowns", ("case_id", "statement"), ("statement",), first_stands=True),
    "question": Kind("validation_questions", ("case_id", "question"), ("question",)),
}


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def string_list(values: Column) -> Column:
    """A list of texts as JSON: trimmed, without blanks and repeats, in order."""
    return F.to_json(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")))


def cleaned(kind: str, drafts: DataFrame) -> DataFrame:
    """Drafts as they are stored: keys trimmed, URLs normalised, lists as JSON, the first claim of a complaint as its summary."""
    have = set(drafts.columns)
    out = drafts.withColumns({c: F.trim(c) for c in KINDS[kind].texts if kind in ("competitor", "complaint", "counter_evidence")})
    if kind == "competitor":
        changes = {f"{c}_json": string_list(F.col(c)) for c in ("features", "integrations") if c in have}
        if "url" in have:
            changes["url"] = normalize_url(F.col("url"))
        if "incumbent_fix_rationale" in have:
            changes["incumbent_fix_rationale"] = F.nullif(F.trim("incumbent_fix_rationale"), F.lit(""))
        out = out.withColumns(changes) if changes else out
    if kind == "complaint":
        out = out.withColumn("summary_claim_id", F.get("factual_claim_ids", 0))
    return out


def refusals(kind: str, drafts: DataFrame) -> DataFrame:
    """The drafts (cleaned) that cannot be recorded, with the reason: ``key, refusal``."""
    spec, have = KINDS[kind], set(drafts.columns)
    why = F.when(sum((_blank(F.col(c)).cast("int") for c in spec.texts), F.lit(0)) > 0, "a record's text is not empty")
    if {"incumbent_fix_risk", "incumbent_fix_rationale"} <= have:
        why = why.when(F.col("incumbent_fix_risk").isNull() != F.col("incumbent_fix_rationale").isNull(), "a risk and its rationale come together")
    if kind == "complaint":
        why = why.when(F.col("summary_claim_id").isNull(), "a complaint has evidence")
    key = F.to_json(F.struct(*spec.key))
    single = drafts.select(key.alias("key"), why.alias("refusal")).filter("refusal is not null")
    twice = drafts.groupBy(*spec.key).count().filter("count > 1").select(key.alias("key"), F.lit("a record is given once").alias("refusal"))
    return single.unionByName(twice)


def merged(kind: str, current: DataFrame, drafts: DataFrame) -> DataFrame:
    """The parent table after some cleaned drafts; new records get the next ids."""
    spec = KINDS[kind]
    told = [c for c in current.columns if c in drafts.columns and c not in (*spec.key, "id")]
    new = drafts.select(*(F.col(c).alias(f"_n_{c}") for c in (*spec.key, *told)), F.lit(True).alias("_given"))
    same = None
    for c in spec.key:
        one = F.col(c) == F.col(f"_n_{c}")
        same = one if same is None else same & one
    both = current.join(new, same, "full_outer")
    take = F.col("_given") & (F.col("id").isNull() if spec.first_stands else F.lit(True))
    value = {c: F.when(take, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in told} | {c: F.coalesce(c, f"_n_{c}") for c in spec.key}
    rows = both.select(*(value.get(c, F.col(c)).alias(c) for c in current.columns))
    order = F.to_json(F.struct(*spec.key))
    return with_new_ids(rows.withColumn("_key", order), current, "_key").select(*current.columns)


def evidence(kind: str, parents: DataFrame, drafts: DataFrame, current: DataFrame) -> DataFrame | None:
    """The evidence table after some cleaned drafts, whose records are in ``parents``; None for a kind without one."""
    spec = KINDS[kind]
    if spec.evidence is None:
        return None
    if kind == "competitor":
        more = F.col("evidence") if "evidence" in drafts.columns else F.array().cast("array<struct<evidence_role: string, claim_id: bigint>>")
        rows = F.concat(F.array(F.struct(F.lit("PROFILE").alias("evidence_role"), F.col("profile_claim_id").cast("long").alias("claim_id"))), F.coalesce(more, F.array().cast("array<struct<evidence_role: string, claim_id: bigint>>")))
    else:
        rows = F.transform("factual_claim_ids", lambda c: F.struct(c.cast("long").alias("claim_id")))
    named = drafts.select(*(F.col(c).alias(f"_{c}") for c in spec.key), F.inline(rows))
    same = None
    for c in spec.key:
        one = F.col(c) == F.col(f"_{c}")
        same = one if same is None else same & one
    of = parents.select(F.col("id").alias(spec.owner), *spec.key)
    found = named.join(of, same).select(*current.columns).distinct()
    return current.unionByName(absent(found, current, list(current.columns)))


def completed_without_evidence(passes: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passes that end without evidence (``case_id, pass_type, note``), and the notes that are refused with the reason.

    The summary claim goes, the note says what was looked for.
    """
    keys = ["case_id", "pass_type"]
    known = notes.join(passes.select(*keys, F.lit(True).alias("_there")), keys, "left")
    why = F.when(_blank(F.col("note")), "a result without evidence has a note").when(F.col("_there").isNull(), "there is no such requirement")
    refused = known.withColumn("refusal", why).filter("refusal is not null").select(*keys, "refusal")
    fine = notes.filter(~_blank(F.col("note"))).groupBy(*keys).agg(F.max("note").alias("_note"))
    out = passes if "note" in passes.columns else passes.withColumn("note", F.lit(None).cast("string"))
    done = F.col("_note").isNotNull()
    after = out.join(fine, keys, "left").withColumns({"status": F.when(done, "SATISFIED").otherwise(F.col("status")), "outcome": F.when(done, "NO_EVIDENCE_FOUND").otherwise(F.col("outcome")), "summary_claim_id": F.when(~done, F.col("summary_claim_id")), "note": F.coalesce("_note", "note")})
    return after.select(*out.columns), refused
