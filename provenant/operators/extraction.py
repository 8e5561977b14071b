"""Extraction: validated model answers and replayed predictions become observations with exact evidence.

A model is any Python function of a text; it runs in Arrow batches, only for
items that are not in the cache.  Every answer is judged by column predicates
that give a failure code or none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.text import exact_evidence, numbers_grounded
from provenant.sources.fixtures import IMPACTS, PAYMENTS, PROBLEM_FAMILIES, PROBLEM_TYPES

# Members of the answer vocabularies.
DECISIONS = ("NO_PAIN", "POTENTIAL_PAIN")
ORIGINS = ("PRACTITIONER_EVIDENCE", "VENDOR_OR_PROMOTIONAL", "UNCLEAR")
STRENGTHS = ("FIRST_PERSON", "DIRECT_WORKFLOW_DESCRIPTION", "ACTIVE_SOLUTION_SEARCH", "THIRD_PARTY_DESCRIPTION", "VENDOR_CLAIM")
INVALID, UNSUPPORTED = "INVALID_STRUCTURED_OUTPUT", "EVIDENCE_VALIDATION_FAILED"

CLAIM = "struct<field: string, value: string, start: int, end: int, excerpt: string, strength: string, signal_type: string, quantity_value: string, quantity_unit: string, frequency: string>"
SCREEN = "decision string, origin string, reason string, evidence_start int, evidence_end int, evidence_excerpt string"
EXTRACTION = f"problem_type string, problem_family string, claims array<{CLAIM}>"


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def screen_failure(text: Column, decision: Column, origin: Column, start: Column, end: Column, excerpt: Column) -> Column:
    """Failure code of a screening answer: exact evidence for potential pain, and not from vendors alone."""
    stated = start.isNotNull() | end.isNotNull() | excerpt.isNotNull()
    found = exact_evidence(text, start, end, excerpt).isNotNull()
    pain = decision == "POTENTIAL_PAIN"
    return F.when(_no(decision.isin(*DECISIONS)) | _no(origin.isin(*ORIGINS)), INVALID).when((stated & ~found) | (pain & ~stated) | (pain & (origin == "VENDOR_OR_PROMOTIONAL")), UNSUPPORTED)


def claim_failure(text: Column, c: Column) -> Column:
    """Failure code of one claim."""
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    quantities = [c["quantity_value"], c["quantity_unit"], c["frequency"]]
    any_quantity = quantities[0].isNotNull() | quantities[1].isNotNull() | quantities[2].isNotNull()
    field, signal, excerpt = c["field"], c["signal_type"], c["excerpt"]
    impact, payment = field == "quantified_impact", field == "payment_evidence"
    manual, own_tool = field == "manual_workaround", field == "diy_or_internal_tool"
    bad_signal = (
        F.when(impact, _no(signal.isin(*IMPACTS.split(","))) | blank(quantities[0]) | blank(quantities[1]))
        .when(payment, _no(signal.isin(*PAYMENTS.split(","))) | any_quantity)
        .when(manual, _no(signal == "MANUAL_ENTRY"))
        .when(own_tool, _no(signal.isin("INTERNAL_SCRIPT", "CUSTOM_SOFTWARE")))
        .otherwise(_no(signal == "NONE") | any_quantity)
    )
    unsupported = exact_evidence(text, c["start"], c["end"], excerpt).isNull() | _no(numbers_grounded(c["value"], excerpt)) | (impact & (_no(F.contains(excerpt, quantities[0])) | _no(F.contains(excerpt, quantities[1]))))
    return F.when(blank(field) | blank(c["value"]) | _no(c["strength"].isin(*STRENGTHS)) | bad_signal, INVALID).when(unsupported, UNSUPPORTED)


def extraction_failure(text: Column, problem_type: Column, family: Column, claims: Column) -> Column:
    """Failure code of an extraction answer: each field once, every claim exact, a grounded problem statement."""
    fields = F.transform(claims, lambda c: c["field"])
    statement = F.filter(claims, lambda c: c["field"] == "problem_statement")
    first = F.get(F.array_compact(F.transform(claims, lambda c: claim_failure(text, c))), 0)
    return (
        F.when(_no(problem_type.isin(*PROBLEM_TYPES.split(","))) | _no(family.isin(*PROBLEM_FAMILIES.split(","))) | claims.isNull(), INVALID)
        .when(F.size(F.array_distinct(fields)) != F.size(fields), INVALID)
        .when(first.isNotNull(), first)
        .when((F.size(statement) == 0) | (F.get(statement, 0)["strength"] == "VENDOR_CLAIM"), UNSUPPORTED)
    )


def answers(items: DataFrame, cache: DataFrame, model: Callable[[str], str | None], identity: Column) -> DataFrame:
    """``id, identity, answer, cached`` of every item; the model is asked only for identities that are not cached.

    ``items`` holds ``id, raw_text``; ``cache`` ``identity, answer``.
    """
    keyed = items.select("id", "raw_text", identity.alias("identity"))
    known = keyed.join(cache.select("identity", "answer"), "identity").select("id", "identity", "answer", F.lit(True).alias("cached"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "identity": pdf["identity"], "answer": [model(t) for t in pdf["raw_text"]], "cached": False})

    asked = keyed.join(cache.select("identity"), "identity", "left_anti").select("id", "raw_text", "identity").mapInPandas(ask, "id long, identity string, answer string, cached boolean")
    return known.unionByName(asked)


def prediction_failure(item_text: Column, is_problem: Column, problem_type: Column, family: Column, scope: Column, problem: Column, evidence: Column) -> Column:
    """Why a replayed prediction is refused: positive rows need type, family, scope, problem and exact spans, negative ones carry none."""
    given = [problem_type, family, scope, problem]
    spans = F.coalesce(F.size(evidence), F.lit(0))
    missing = F.greatest(*(F.coalesce(F.trim(c), F.lit("")) == "" for c in given)) | (spans <= 0)
    extra = F.greatest(*(c.isNotNull() for c in given)) | (spans > 0)
    inexact = ~F.forall(evidence, lambda e: F.substring(item_text, e["start"] + 1, e["end"] - e["start"]) == e["excerpt"])
    return F.when(is_problem & missing, "a positive prediction lacks fields or evidence").when(~is_problem & extra, "a negative prediction carries fields or evidence").when(is_problem & inexact, "evidence does not match the source text")


def replay_predictions(predictions: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted predictions, and refused ones with the reason; unknown items are refused too."""
    joined = predictions.join(items.select(F.col("id").alias("source_item_id"), "raw_text"), "source_item_id", "left")
    why = F.when(F.col("raw_text").isNull(), "unknown source item").otherwise(prediction_failure(F.col("raw_text"), F.col("is_problem"), F.col("problem_type"), F.col("problem_family"), F.col("evidence_scope"), F.col("problem"), F.col("evidence")))
    judged = joined.withColumn("failure", why)
    return judged.filter("failure is null").drop("failure", "raw_text"), judged.filter("failure is not null").select("source_item_id", "failure")


def observation_drafts(accepted: DataFrame) -> dict[str, DataFrame]:
    """Observations, spans and signals of accepted positive predictions, keyed by source item.

    Signals point at a span by its place; a place that does not exist shows as a
    signal without a span and is refused by the guards.
    """
    positive = accepted.filter("is_problem")
    spans = positive.select("source_item_id", "evidence_scope", F.posexplode("evidence").alias("evidence_index", "e")).select("source_item_id", "evidence_scope", "evidence_index", "e.start", "e.end", "e.excerpt")
    out = {"observations": positive.select("source_item_id", "problem_type", "problem_family", "evidence_scope", "problem", "fields"), "evidence_spans": spans}
    for name in ("workarounds", "impact_signals", "payment_signals"):
        rows = positive.select("source_item_id", F.explode(name).alias("s")).select("source_item_id", "s.*")
        out[name] = rows.join(spans.select("source_item_id", "evidence_index", F.lit(True).alias("has_span")), ["source_item_id", "evidence_index"], "left").withColumn("has_span", F.coalesce("has_span", F.lit(False)))
    return out


#: Ids of a run of the signature's tree, and its levels, which hold all 64-bit ids.
SIGNATURE_RUN, SIGNATURE_LEVELS = 1024, 7
#: What an item's signature covers.
SIGNED = ("country_code", "external_id", "id", "language_code", "raw_text", "source_id")


def item_payload(items: DataFrame) -> Column:
    """An item as compact JSON with sorted keys and explicit nulls; a column that is not there is null."""
    have = {c: F.col(c) if c in items.columns else F.lit(None).cast("string") for c in SIGNED}
    return F.to_json(F.struct(*(v.alias(c) for c, v in have.items())), {"ignoreNullFields": "false"})


def input_signature(items: DataFrame) -> DataFrame:
    """One digest of a set of items and all that is signed of them, the same for the same set in any order.

    An item's digest is that of its JSON; the digests of each run of consecutive ids are
    put in order and digested, then those of each run of runs, up to one.  A run holds no
    more than its ids, so nothing grows with the table but the number of runs.
    """
    nodes = items.select(F.col("id").cast("long").alias("id"), F.sha2(item_payload(items), 256).alias("h"))
    for _ in range(SIGNATURE_LEVELS):
        run = F.array_sort(F.collect_list(F.struct("id", "h")))
        nodes = nodes.groupBy(F.floor(F.col("id") / SIGNATURE_RUN).alias("up")).agg(run.alias("run")).select(F.col("up").alias("id"), F.sha2(F.array_join(F.transform("run", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["h"])), ","), 256).alias("h"))
    return nodes.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("signature"))  # two nodes at most: ids below and above zero
