"""Two-stage discovery: a model screens every item, and reads the claims of those that look like a pain.

A stage is one plan: items whose answer is not known yet are asked for, in Arrow
batches, with bounded repeats; every attempt is a row beside the answer it brought.
The rows are written before anything is made of them, so nothing is asked twice.
Answers are judged by columns, and the ledger of attempts, the cache of answers, the
observations and all counts are plans over the written rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from decimal import Decimal
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.schema import canonical_json, matches_schema
from provenant.functions.text import exact_evidence
from provenant.operators.extraction import DECISIONS, INVALID, ORIGINS, STRENGTHS, UNSUPPORTED, extraction_failure, screen_failure
from provenant.operators.lifecycle import first_of_each
from provenant.sources.fixtures import IMPACTS, PAYMENTS, PROBLEM_FAMILIES, PROBLEM_TYPES, WORKAROUNDS
from provenant.sources.scratch import written

SCREENING, EXTRACTION = "SCREENING", "EXTRACTION"
# Reasons of a screening, fields of a claim and those that become plain columns, failures, and which of them are worth a repeat.
REASONS = ("CONCRETE_WORKFLOW", "CAREER_ONLY", "HOMEWORK_OR_HELP", "GENERIC_OPINION", "INTERPERSONAL", "PROMOTION", "MEME_OR_NEWS", "NO_CONCRETE_PROBLEM", "OTHER")
CLAIM_FIELDS = ("problem_statement", "actor", "job_to_be_done", "context", "current_workaround", "time_impact", "financial_impact", "error_impact", "delay_impact", "risk_impact", "active_solution_search", "payment_evidence", "manual_workaround", "diy_or_internal_tool", "quantified_impact")
PLAIN_FIELDS = ("actor", "job_to_be_done", "context", "current_workaround", "time_impact", "financial_impact", "error_impact", "delay_impact", "risk_impact")
TOO_LARGE, UNKNOWN = "CONTENT_TOO_LARGE", "UNKNOWN_ERROR"
REPEATED = ("MODEL_UNAVAILABLE", "RATE_LIMITED", "TIMEOUT")
#: Attempts, and characters of their texts, that a task hands on at once.
HELD_ROWS, HELD_CHARACTERS = 1000, 4 << 20
UNPROBLEMATIC = ("TEMPORARY_INCIDENT", "SUPPORT_QUESTION", "USER_ERROR", "GENERAL_COMPLAINT")

ATTEMPTS = "source_item_id long, identity_key string, stage string, attempt_number int, last boolean, failure_code string, message string, answer string, input_tokens long, output_tokens long, usage_reported boolean, external_run_id string, latency_ms long"


def _object(properties: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": properties, "required": list(properties)}


def _one_of(values) -> dict:
    return {"type": "string", "enum": list(values)}


def _or_null(kind: str) -> dict:
    return {"type": [kind, "null"]}


SIGNALS = sorted({"NONE", *WORKAROUNDS.split(","), *IMPACTS.split(","), *PAYMENTS.split(",")})
SCREEN_SCHEMA = _object({"decision": _one_of(DECISIONS), "origin": _one_of(ORIGINS), "reason": _one_of(REASONS), "evidence_start": _or_null("integer"), "evidence_end": _or_null("integer"), "evidence_excerpt": _or_null("string")})
CLAIM_SCHEMA = _object({
    "field": _one_of(sorted(CLAIM_FIELDS)), "value": {"type": "string"}, "start": {"type": "integer"}, "end": {"type": "integer"}, "excerpt": {"type": "string"}, "strength": _one_of(STRENGTHS), "signal_type": _one_of(SIGNALS),
    "quantity_value": _or_null("string"), "quantity_unit": _or_null("string"), "frequency": _or_null("string"),
})
EXTRACT_SCHEMA = _object({"problem_type": _one_of(t for t in PROBLEM_TYPES.split(",") if t not in UNPROBLEMATIC), "problem_family": _one_of(PROBLEM_FAMILIES.split(",")), "claims": {"type": "array", "items": CLAIM_SCHEMA}})
SCREEN_SHAPE = "struct<decision: string, origin: string, reason: string, evidence_start: int, evidence_end: int, evidence_excerpt: string>"
EXTRACT_SHAPE = "struct<problem_type: string, problem_family: string, claims: array<struct<field: string, value: string, start: int, end: int, excerpt: string, strength: string, signal_type: string, quantity_value: string, quantity_unit: string, frequency: string>>>"


@dataclass(frozen=True)
class Request:
    """What a model is asked: one item's whole text in one stage."""

    stage: str
    instructions: str
    content: str
    schema: dict
    max_output_tokens: int
    temperature: float
    timeout_seconds: float
    attempt: int


@dataclass(frozen=True)
class Reply:
    """What a model said: a JSON text, and what it reports of the call."""

    answer: str
    input_tokens: int = 0
    output_tokens: int = 0
    usage_reported: bool = True
    external_run_id: str | None = None
    latency_ms: int | None = None


class CallFailed(Exception):
    """A call that brought no answer, with its failure code and what it cost."""

    def __init__(self, code: str, message: str = "", input_tokens: int = 0, output_tokens: int = 0) -> None:
        super().__init__(message)
        self.code, self.input_tokens, self.output_tokens = code, input_tokens, output_tokens


@dataclass(frozen=True)
class Settings:
    """Everything that decides an answer, and the bounds of the calls."""

    provider: str
    model: str
    pipeline_version: str
    screen_instructions: str = "Say whether the text tells of a concrete problem at work, with one exact excerpt."
    extract_instructions: str = "Give each claim with an exact excerpt and its offsets; leave out what the text does not say."
    prompt_version: str = "prompt-1"
    schema_version: str = "schema-1"
    endpoint_identity: str | None = None
    endpoint_class: str = "unknown"
    local_inference: bool = False
    temperature: float = 0.0
    max_output_tokens_screen: int = 300
    max_output_tokens_extract: int = 1800
    max_input_characters: int = 30_000
    timeout_seconds: float = 30.0
    max_retries: int = 2
    retry_delay_seconds: float = 1.0
    calls_at_once: int | None = None
    input_usd_per_million: str | None = None
    output_usd_per_million: str | None = None
    stages: dict = field(default_factory=lambda: {SCREENING: SCREEN_SCHEMA, EXTRACTION: EXTRACT_SCHEMA}, repr=False)

    def __post_init__(self) -> None:
        if not self.pipeline_version.strip() or not 0 <= self.temperature <= 2 or min(self.max_output_tokens_screen, self.max_output_tokens_extract) <= 0:
            raise ValueError("a version, a temperature of 0 to 2 and positive output bounds are needed")
        if self.timeout_seconds <= 0 or min(self.max_retries, self.retry_delay_seconds) < 0 or self.max_input_characters < 40:
            raise ValueError("invalid timeout, repeats or input bound")
        prices = [None if p is None else Decimal(p) for p in (self.input_usd_per_million, self.output_usd_per_million)]
        if (prices[0] is None) != (prices[1] is None) or any(p is not None and (not p.is_finite() or p < 0) for p in prices):
            raise ValueError("both token prices are needed, finite and not negative, or none")

    def digest(self) -> str:
        """Digest of the settings that a model's answer depends on."""
        return _digest({k: asdict(self)[k] for k in ("temperature", "max_output_tokens_screen", "max_output_tokens_extract", "max_input_characters")})

    def instructions(self, stage: str) -> str:
        return self.screen_instructions if stage == SCREENING else self.extract_instructions


def _digest(value: object) -> str:
    return sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def identity_key(item_id: Column, text: Column, stage: str, s: Settings) -> Column:
    """Digest of all that decides an answer: the item and its text, stage, model, prompt, schema and settings; compact JSON with sorted keys."""
    fixed = {
        "endpoint_identity": s.endpoint_identity or s.provider, "model": s.model, "model_config_hash": s.digest(), "pipeline_version": s.pipeline_version, "prompt_hash": _digest(s.instructions(stage)), "prompt_version": s.prompt_version,
        "provider": s.provider, "schema_hash": _digest(s.stages[stage]), "schema_version": s.schema_version, "source_item_id": "\u0001", "stage": stage, "content_hash": "\u0002",
    }
    before, rest = json.dumps(fixed, sort_keys=True, separators=(",", ":")).split('"\\u0002"')
    middle, after = rest.split('"\\u0001"')
    return F.sha2(F.concat(F.lit(before + '"'), F.sha2(text, 256), F.lit('"' + middle), item_id.cast("string"), F.lit(after)), 256)


def keyed(items: DataFrame, stage: str, settings: Settings) -> DataFrame:
    """``source_item_id, raw_text, identity_key`` of some items (``id, raw_text``)."""
    return items.select(F.col("id").alias("source_item_id"), "raw_text", identity_key(F.col("id"), F.col("raw_text"), stage, settings).alias("identity_key"))


def attempted(batches: Iterator[pd.DataFrame], call: Callable[[Request], Reply], stage: str, settings: Settings) -> Iterator[pd.DataFrame]:
    """All attempts at the items of some batches, so many at a time: a table for each item costs more than its judging."""
    limit = settings.max_output_tokens_screen if stage == SCREENING else settings.max_output_tokens_extract
    table = lambda rows: pd.DataFrame(rows, columns=[*(c.split()[0] for c in ATTEMPTS.split(", ")), "raw_text"], dtype=object)
    rows, held = [], 0
    for pdf in batches:
        for item, text, key in zip(pdf["source_item_id"], pdf["raw_text"], pdf["identity_key"], strict=True):
            for attempt in range(settings.max_retries + 1):
                began = time.monotonic()
                said, code, why, used = None, None, None, (0, 0)
                try:
                    said = call(Request(stage, settings.instructions(stage), text, settings.stages[stage], limit, settings.temperature, settings.timeout_seconds, attempt))
                    used = (said.input_tokens, said.output_tokens)
                except CallFailed as failed:
                    code, why, used = failed.code, str(failed), (failed.input_tokens, failed.output_tokens)
                except Exception as odd:  # noqa: BLE001 - any adapter may break; the item fails, the run goes on
                    code, why = UNKNOWN, type(odd).__name__
                took = said.latency_ms if said is not None and said.latency_ms is not None else round((time.monotonic() - began) * 1000)
                again = code in REPEATED and attempt < settings.max_retries
                rows.append((item, key, stage, attempt, not again, code, why, said.answer if said else None, *used, said.usage_reported if said else any(used), said.external_run_id if said else None, took, text if said else None))
                if not again:
                    break
                time.sleep(settings.retry_delay_seconds * (attempt + 1))
            held += len(text)
            if len(rows) >= HELD_ROWS or held >= HELD_CHARACTERS:
                yield table(rows)
                rows, held = [], 0
    if rows:
        yield table(rows)


def asked(pending: DataFrame, call: Callable[[Request], Reply], stage: str, settings: Settings) -> DataFrame:
    """One row per attempt (:data:`ATTEMPTS`) at the pending items; the last one of an item has its judged answer or its failure.

    A failure that may pass is tried again up to ``max_retries`` times; an answer that
    does not hold is a failure that is not.  A text beyond the bound is never sent.
    Items are dealt out by identity to ``calls_at_once`` tasks (as many as there are
    cores, if it is None), however few they are.
    """
    fits = F.length("raw_text") <= settings.max_input_characters

    tasks = settings.calls_at_once or pending.sparkSession.sparkContext.defaultParallelism
    made = pending.filter(fits).select("source_item_id", "raw_text", "identity_key").repartition(tasks, "identity_key").mapInPandas(lambda batches: attempted(batches, call, stage, settings), f"{ATTEMPTS}, raw_text string")
    shape = SCREEN_SHAPE if stage == SCREENING else EXTRACT_SHAPE
    # step by step, so that each is worked out once
    read = made.withColumn("said", F.col("answer").isNotNull()).withColumn("answer", canonical_json(F.col("answer"))).withColumns({"v": F.try_parse_json("answer"), "a": F.from_json("answer", shape)})
    verdict = F.when(F.col("said"), answer_failure(F.col("raw_text"), F.col("v"), F.col("a"), stage, settings.stages[stage]))
    judged = read.withColumn("verdict", verdict).withColumns({"failure_code": F.coalesce("failure_code", "verdict"), "answer": F.when(F.col("verdict").isNull(), F.col("answer"))}).drop("raw_text", "said", "v", "a", "verdict")
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ATTEMPTS.split(", ")}
    unsent = pending.filter(~fits).withColumns(none | {"source_item_id": F.col("source_item_id"), "identity_key": F.col("identity_key"), "stage": F.lit(stage), "last": F.lit(True), "failure_code": F.lit(TOO_LARGE)})
    return judged.unionByName(unsent.select(judged.columns))


def answer_failure(text: Column, value: Column, answer: Column, stage: str, schema: dict) -> Column:
    """Why an answer (a variant, and the same as a struct) does not hold: it is not of the schema, or its evidence is not in the text; null if it does."""
    misfit = ~matches_schema(value, schema)
    if stage == SCREENING:
        blank = answer["evidence_excerpt"].isNotNull() & (F.trim(answer["evidence_excerpt"]) == "")
        judged = screen_failure(text, answer["decision"], answer["origin"], answer["evidence_start"], answer["evidence_end"], answer["evidence_excerpt"])
        return F.when(misfit, INVALID).when(blank, UNSUPPORTED).otherwise(judged)
    return F.when(misfit, INVALID).otherwise(extraction_failure(text, answer["problem_type"], answer["problem_family"], answer["claims"]))


def pending(items: DataFrame, stage: str, settings: Settings, cache: DataFrame, failed: DataFrame) -> DataFrame:
    """The items of a stage that have neither an answer (``cache``: ``identity_key``) nor a last failure in this run (``failed``)."""
    rows = keyed(items, stage, settings)
    return rows.join(cache.select("identity_key"), "identity_key", "left_anti").join(failed.select("identity_key"), "identity_key", "left_anti")


def model_run_id(run_id: Column) -> Column:
    """The id of an attempt's model run: the same for the same attempt of a run, so a repeated task records it once."""
    return F.sha2(F.concat_ws("|", run_id, "identity_key", F.col("attempt_number").cast("string")), 256)


def price(input_tokens: Column, output_tokens: Column, settings: Settings) -> Column:
    """USD of a call in exact decimals: nothing for a model of one's own, null where no price is known."""
    if settings.local_inference:
        return F.lit(Decimal(0)).cast("decimal(38,12)")
    if settings.input_usd_per_million is None:
        return F.lit(None).cast("decimal(38,12)")
    each = [F.lit(Decimal(p)).cast("decimal(18,6)") * n.cast("decimal(19,0)") for n, p in ((input_tokens, settings.input_usd_per_million), (output_tokens, settings.output_usd_per_million))]
    return ((each[0] + each[1]).cast("decimal(26,6)") * F.lit(Decimal("0.000001")).cast("decimal(7,6)")).cast("decimal(38,12)")


def ledger_rows(attempts: DataFrame, run_id: str, settings: Settings) -> DataFrame:
    """The ledger's rows of some attempts; a text that was never sent leaves one without a number and a model run."""
    called = F.col("attempt_number").isNotNull()
    paid = called & (F.col("answer").isNotNull() | (F.col("input_tokens") > 0) | (F.col("output_tokens") > 0) | F.col("failure_code").isin(INVALID, UNSUPPORTED))
    return attempts.select(
        F.when(called, model_run_id(F.lit(run_id))).alias("model_run_id"), F.lit(run_id).alias("pipeline_run_id"), "source_item_id", "identity_key", "stage", "attempt_number", "last", "failure_code", "message", F.lit(settings.endpoint_class).alias("endpoint_class"),
        F.coalesce("usage_reported", F.lit(False)).alias("usage_reported"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), "latency_ms", "external_run_id",
        F.when(paid, price(F.col("input_tokens"), F.col("output_tokens"), settings)).alias("cost_usd"),
    )


def cache_rows(attempts: DataFrame, items: DataFrame, run_id: str, settings: Settings) -> DataFrame:
    """The cache's rows of the answers that hold: one an identity, of the run's first."""
    good = first_of_each(attempts.filter("answer is not null"), ["identity_key"], [F.col("source_item_id")])
    hashes = items.select(F.col("id").alias("source_item_id"), F.sha2("raw_text", 256).alias("content_hash"))
    return good.join(hashes, "source_item_id").select(
        "identity_key", "source_item_id", "content_hash", "stage", F.lit(settings.pipeline_version).alias("pipeline_version"), F.lit(settings.prompt_version).alias("prompt_version"), F.lit(settings.schema_version).alias("schema_version"), F.lit(settings.provider).alias("provider"),
        F.lit(settings.model).alias("model"), F.lit(settings.digest()).alias("model_config_hash"), F.col("answer").alias("result_json"), model_run_id(F.lit(run_id)).alias("model_run_id"), F.lit(None).cast("long").alias("observation_id"),
    )


def screened_in(items: DataFrame, cache: DataFrame, settings: Settings) -> DataFrame:
    """The items whose screening found a potential pain."""
    found = cache.filter((F.col("stage") == SCREENING) & (F.get_json_object("result_json", "$.decision") == "POTENTIAL_PAIN")).select("identity_key")
    return keyed(items, SCREENING, settings).join(found, "identity_key", "left_semi").select(F.col("source_item_id").alias("id"), "raw_text")


def extraction_version(key: Column, settings: Settings) -> Column:
    """The version under which an answer's observation is kept; it leads back from the observation to the answer."""
    return F.concat(F.lit(f"{settings.pipeline_version}:"), F.substring(key, 1, 20))


def predictions(items: DataFrame, cache: DataFrame, settings: Settings) -> DataFrame:
    """What the extraction answers say of the items, in the form of a prediction file (see :mod:`extraction`), with ``identity_key``.

    Evidence has the offsets at which the excerpt stands, whatever the answer said.
    """
    known = cache.filter(F.col("stage") == EXTRACTION).select("identity_key", F.from_json("result_json", EXTRACT_SHAPE).alias("a"))
    rows = keyed(items, EXTRACTION, settings).join(known, "identity_key").select("source_item_id", "identity_key", "raw_text", "a.*")
    claims = F.col("claims")
    by = lambda name: F.get(F.filter(claims, lambda c: c["field"] == name), 0)
    placed = F.transform(claims, lambda c: F.struct(exact_evidence(F.col("raw_text"), c["start"], c["end"], c["excerpt"]).alias("at"), c["excerpt"].alias("excerpt")))
    evidence = F.transform(placed, lambda p: F.struct(p["at"]["start"].cast("int").alias("start"), p["at"]["end"].cast("int").alias("end"), p["excerpt"].alias("excerpt")))
    numbered = F.transform(claims, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    of = lambda *names: F.filter(numbered, lambda n: n["c"]["field"].isin(*names))
    none = F.lit(None).cast("string")
    given = [F.struct(F.lit(n).alias("key"), by(n)["value"].alias("value")) for n in PLAIN_FIELDS]
    given += [F.struct(F.lit("active_solution_search").alias("key"), F.when(by("active_solution_search").isNotNull(), "true").alias("value")), F.struct(F.lit("extraction_version").alias("key"), extraction_version(F.col("identity_key"), settings).alias("value"))]
    fields = F.map_from_entries(F.filter(F.array(*given), lambda e: e["value"].isNotNull()))
    return rows.select(
        "source_item_id", "identity_key", F.lit(True).alias("is_problem"), "problem_type", "problem_family", F.lit("GLOBAL").alias("evidence_scope"), by("problem_statement")["value"].alias("problem"), fields.alias("fields"), evidence.alias("evidence"),
        F.transform(of("manual_workaround", "diy_or_internal_tool"), lambda n: F.struct(n["c"]["signal_type"].alias("type"), n["c"]["value"].alias("description"), n["i"].alias("evidence_index"))).alias("workarounds"),
        F.transform(of("quantified_impact"), lambda n: F.struct(n["c"]["signal_type"].alias("type"), F.lit(True).alias("quantified"), n["c"]["quantity_value"].alias("value"), n["c"]["quantity_unit"].alias("unit"), n["c"]["frequency"].alias("frequency"), n["i"].alias("evidence_index"))).alias("impact_signals"),
        F.transform(of("payment_evidence"), lambda n: F.struct(n["c"]["signal_type"].alias("type"), none.alias("amount"), none.alias("currency"), none.alias("frequency"), n["i"].alias("evidence_index"))).alias("payment_signals"),
    )


def linked(cache: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cache with the observations that its extraction answers became (``identity_key, observation_id``), and the links that are refused.

    An answer is linked once; a link to another observation, of another stage or of an
    unknown answer is refused.
    """
    new = links.select("identity_key", F.col("observation_id").alias("_observation"))
    of = new.join(cache.select("identity_key", F.col("stage").alias("_stage"), F.col("observation_id").alias("_now")), "identity_key", "left")
    refused = of.filter(F.col("_stage").isNull() | (F.col("_stage") != EXTRACTION) | (F.col("_now") != F.col("_observation"))).select("identity_key", F.col("_observation").alias("observation_id"))
    several = new.distinct().groupBy("identity_key").agg(F.count("*").alias("n"), F.max("_observation").alias("observation_id")).filter("n > 1").select("identity_key", "observation_id")
    out = cache.join(first_of_each(new, ["identity_key"], [F.col("_observation")]), "identity_key", "left").withColumn("observation_id", F.coalesce("observation_id", "_observation"))
    return out.select(*cache.columns), refused.unionByName(several)


def outcomes(items: DataFrame, cache: DataFrame, ledger: DataFrame, settings: Settings) -> DataFrame:
    """``source_item_id, status, failure_code, cache_hits``: NO_PAIN, OBSERVATION, MODEL_FAILURE, or PENDING where the run has not come so far.

    ``ledger`` holds the run's own attempts; an answer without one was there before.
    """
    answers = cache.select("identity_key", F.get_json_object("result_json", "$.decision").alias("decision"), F.lit(True).alias("known"))
    tried = ledger.groupBy("identity_key").agg(F.max(F.when(F.col("last"), F.col("failure_code"))).alias("failure"), F.lit(True).alias("tried"))
    keys = items.select(F.col("id").alias("source_item_id"), *(identity_key(F.col("id"), F.col("raw_text"), s, settings).alias(f"{s}_key") for s in (SCREENING, EXTRACTION)))
    for s in (SCREENING, EXTRACTION):
        keys = keys.join(answers.toDF(f"{s}_key", f"{s}_decision", f"{s}_known"), f"{s}_key", "left").join(tried.toDF(f"{s}_key", f"{s}_failure", f"{s}_tried"), f"{s}_key", "left")
    pain = F.col("SCREENING_decision") == "POTENTIAL_PAIN"
    wanted = F.coalesce(pain & F.col("EXTRACTION_known").isNull(), F.lit(False))
    failure = F.when(F.col("SCREENING_known").isNull(), F.col("SCREENING_failure")).when(wanted, F.col("EXTRACTION_failure"))
    status = F.when(failure.isNotNull(), "MODEL_FAILURE").when(F.col("SCREENING_known").isNull() | wanted, "PENDING").when(pain, "OBSERVATION").otherwise("NO_PAIN")
    hit = lambda s, where: F.when(where & F.col(f"{s}_known") & F.col(f"{s}_tried").isNull(), 1).otherwise(0)
    return keys.select("source_item_id", status.alias("status"), failure.alias("failure_code"), (hit(SCREENING, F.lit(True)) + hit(EXTRACTION, pain)).alias("cache_hits"))


def attempts_by_identity(ledger: DataFrame) -> DataFrame:
    """Attempts, tokens, price and the last failure of every identity in a ledger."""
    calls = F.col("attempt_number").isNotNull()
    return ledger.groupBy("identity_key", "source_item_id", "stage").agg(
        F.count_if(calls).alias("attempts"), F.count_if(calls & F.col("failure_code").isNotNull()).alias("failed_attempts"), F.max(F.when(F.col("last"), F.col("failure_code"))).alias("failure_code"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(calls & ~F.col("usage_reported")).alias("unreported"), F.sum("cost_usd").alias("cost_usd"),
    )


def stage_totals(ledger: DataFrame) -> DataFrame:
    """Calls, repeats, failures by kind, tokens and price of each stage."""
    calls = F.col("attempt_number").isNotNull()
    failed = F.col("last") & F.col("failure_code").isNotNull()
    return ledger.groupBy("stage").agg(
        F.count_if(calls).alias("calls"), F.count_if(calls & ~F.col("last")).alias("retries"), F.count_if(failed).alias("failures"), F.count_if(failed & (F.col("failure_code") == UNSUPPORTED)).alias("evidence_failures"),
        F.count_if(calls & ~F.col("usage_reported")).alias("unreported_usage_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"),
    )


def run_metrics(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row of a whole run's counts, from :func:`outcomes` and the run's ledger."""
    of_items = found.agg(
        F.count("*").alias("processed_items"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("NO_PAIN", "no_pain"), ("OBSERVATION", "valid_observations"), ("MODEL_FAILURE", "inference_failures"), ("PENDING", "pending"))),
        F.count_if(F.col("failure_code") == UNSUPPORTED).alias("evidence_validation_failures"), F.coalesce(F.sum("cache_hits"), F.lit(0)).alias("cache_hits"),
    )
    totals = stage_totals(ledger).agg(
        *(F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("calls"))), F.lit(0)).alias(n) for s, n in ((SCREENING, "screening_calls"), (EXTRACTION, "extraction_calls"))),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("retries", "input_tokens", "output_tokens", "unreported_usage_calls")), F.sum("cost_usd").alias("known_cost_usd"),
    )
    return of_items.withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


@dataclass(frozen=True)
class Found:
    """All rows of a two-stage run without a store: attempts, the cache after it, and what the answers say."""

    ledger: DataFrame
    cache: DataFrame
    outcomes: DataFrame
    predictions: DataFrame


CACHE = "identity_key string, source_item_id long, content_hash string, stage string, pipeline_version string, prompt_version string, schema_version string, provider string, model string, model_config_hash string, result_json string, model_run_id string, observation_id long"
LEDGER = "model_run_id string, pipeline_run_id string, source_item_id long, identity_key string, stage string, attempt_number int, last boolean, failure_code string, message string, endpoint_class string, usage_reported boolean, input_tokens long, output_tokens long, latency_ms long, external_run_id string, cost_usd decimal(38,12)"


def discover(items: DataFrame, call: Callable[[Request], Reply], settings: Settings, run_id: str, cache: DataFrame | None = None) -> Found:
    """Both stages over some items (``id, raw_text``), each asked for once and written.

    Empty texts are asked for like others; null ones are left out.
    """
    spark = items.sparkSession
    items = items.filter("raw_text is not null")
    known = cache if cache is not None else spark.createDataFrame([], CACHE)
    ledger = spark.createDataFrame([], LEDGER)
    for stage in (SCREENING, EXTRACTION):
        of = items if stage == SCREENING else screened_in(items, known, settings)
        new = written(asked(pending(of, stage, settings, known, ledger.filter("last")), call, stage, settings))
        ledger = ledger.unionByName(ledger_rows(new, run_id, settings))
        known = known.unionByName(cache_rows(new, items, run_id, settings))
    return Found(ledger, known, outcomes(items, known, ledger, settings), predictions(items, known, settings))
