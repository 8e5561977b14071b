"""Loaders of labelled benchmarks: files whose labels cannot be audited are refused, line by line.

Beside what every strict reader demands, a case must say where it comes from and who
has reviewed it, cite its text exactly, use known values, and be there once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions.text import normalize_url
from provenant.sources.fixtures import PROBLEM_FAMILIES, PROBLEM_TYPES
from provenant.sources.readers import FLAG_FIELDS, SPECS, TEXT_FIELDS, Parsed, field_problem, parse_json_lines, raw_value, read_lines

# What a case's provenance, labels and fields may say.
ORIGINS = ("SYNTHETIC", "PUBLIC_SOURCE", "FIRST_PARTY")
RIGHTS = ("APPROVED", "REVIEW_REQUIRED", "NOT_APPLICABLE")
LABEL_METHODS = ("HUMAN", "HUMAN_REVIEWED", "UNREVIEWED")
PROVENANCE = ("origin", "rights_status", "source_url", "label_method", "reviewed_by", "reviewed_at")
IDENTITY_FIELDS = ("actor", "job_to_be_done", "context", "root_cause")
SCOPES = ("GLOBAL", "DACH")
SOLUTION_TYPES = ("DIRECT_SOFTWARE", "INDIRECT_SOFTWARE", "LEGACY_SOFTWARE", "INTERNAL_TOOL", "MANUAL_PROCESS", "FREELANCER", "AGENCY", "SERVICE_PROVIDER", "DIY_SCRIPT", "NO_SOLUTION_FOUND")
TRANSFER = {
    "actor_equivalence": ("DIRECT", "SIMILAR", "DIFFERENT", "UNCLEAR"), "workflow_equivalence": ("DIRECT", "LOCALIZED", "MATERIALLY_DIFFERENT", "UNKNOWN"),
    "transfer_type": ("DIRECT_TRANSFER", "LOCALIZATION_REQUIRED", "LOCAL_FRICTION", "WEAK_LOCAL_EVIDENCE", "MATERIAL_DIFFERENCE", "UNKNOWN"), "local_evidence_state": ("NONE_FOUND", "SINGLE_LOCAL_SIGNAL", "MULTIPLE_LOCAL_SIGNALS", "MULTI_SOURCE_LOCAL_SIGNALS"),
}
#: The least number of cases of a file, by kind.
LEAST = {"detection": 1, "clustering": 2, "competition": 1, "transfer": 1}


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _outside(c: Column, members, what: str) -> Column:
    """A complaint about a value that is no member; null is left to others."""
    return F.when(~c.isin(*members), F.concat(F.lit(f"{what} is not known: "), c))


def provenance_problems(p: Column, raw: Column) -> list[Column]:
    """What is wrong with a case's provenance (a struct, and the JSON that it was read from)."""
    keys = F.json_object_keys(raw)
    names = F.array(*map(F.lit, PROVENANCE))
    amiss = F.when(keys.isNull(), "provenance must be an object").when((F.size(F.array_except(names, keys)) > 0) | (F.size(F.array_except(keys, names)) > 0), "provenance has exactly six keys")
    origin, rights, method = p["origin"], p["rights_status"], p["label_method"]
    none = p["reviewed_by"].isNull() & p["reviewed_at"].isNull()
    both = ~_blank(p["reviewed_by"]) & ~_blank(p["reviewed_at"])
    known = F.coalesce(origin.isin(*ORIGINS) & rights.isin(*RIGHTS) & method.isin(*LABEL_METHODS), F.lit(False))
    return [
        F.coalesce(amiss, F.when(~known, "origin, rights_status or label_method is not known")),
        F.when(p["source_url"].isNotNull() & (p["source_url"] != "") & normalize_url(p["source_url"]).isNull(), "source_url is no absolute URL"),
        F.when((origin == "PUBLIC_SOURCE") & (F.coalesce(p["source_url"], F.lit("")) == ""), "a public source has its URL"),
        F.when((origin == "SYNTHETIC") & ((F.coalesce(p["source_url"], F.lit("")) != "") | (rights != "NOT_APPLICABLE")), "a synthetic case has no URL and no rights"),
        F.when(origin.isin("PUBLIC_SOURCE", "FIRST_PARTY") & (rights == "NOT_APPLICABLE"), "a sourced case has a rights decision"),
        F.when((method == "UNREVIEWED") & ~none, "an unreviewed label names no reviewer or date").when((method != "UNREVIEWED") & ~both, "a reviewed label names its reviewer and date"),
        F.when(~_blank(p["reviewed_at"]) & (~p["reviewed_at"].rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(p["reviewed_at"], "yyyy-MM-dd").isNull()), "reviewed_at is no ISO date"),
    ]


def detection_problems() -> list[Column]:
    """Labels of detection: exact evidence, positives with all labels, negatives with none."""
    v = F.col("_v")
    given = {c: ~_blank(v[c]) for c in ("problem_type", "problem_family", "evidence_scope", "problem")}
    spans = F.coalesce(v["evidence"], F.array().cast("array<struct<start: int, end: int, excerpt: string>>"))
    exact = F.forall(spans, lambda e: F.coalesce((e["start"] >= 0) & (e["end"] > e["start"]) & (e["end"] <= F.length(v["text"])) & (F.substring(v["text"], e["start"] + 1, e["end"] - e["start"]) == e["excerpt"]), F.lit(False)))
    missing = F.array_compact(F.array(*(F.when(~there, F.lit(c)) for c, there in given.items())))
    labelled = F.greatest(*(v[c].isNotNull() for c in given)) | (F.size(spans) > 0) | (F.size(F.coalesce(F.json_object_keys(raw_value("fields")), F.array().cast("array<string>"))) > 0)
    positive = v["is_problem"]
    return [
        _outside(v["problem_type"], PROBLEM_TYPES.split(","), "problem_type"), _outside(v["problem_family"], PROBLEM_FAMILIES.split(","), "problem_family"), _outside(v["evidence_scope"], SCOPES, "evidence_scope"), field_problem(raw_value("fields"), TEXT_FIELDS, FLAG_FIELDS),
        F.when(~exact, "an excerpt does not match the text at its offsets"), F.when(positive & (F.size(missing) > 0), F.concat(F.lit("a positive case lacks "), F.array_join(missing, ", "))), F.when(positive & (F.size(spans) == 0), "a positive case has evidence"), F.when(~positive & labelled, "a negative case has no labels"),
    ]


def _url_problem(name: str) -> Column:
    urls = F.col(f"_v.{name}")
    return F.when(F.coalesce(F.size(urls), F.lit(0)) <= 0, f"{name} must not be empty").when(F.exists(urls, lambda u: normalize_url(u).isNull()), f"{name} holds what is no absolute URL")


def problems(kind: str, evidence: bool = True, provenance: bool = True) -> list[Column]:
    """All rules of a kind of benchmark, as columns over a parsed line."""
    out: list[Column] = []
    if kind == "detection":
        out = detection_problems()
    elif kind == "clustering":
        out = [_outside(F.col("_v.problem_type"), PROBLEM_TYPES.split(","), "problem_type"), field_problem(raw_value("fields"), IDENTITY_FIELDS)]
    elif kind == "competition":
        solutions = F.col("_v.solutions")
        names = F.transform(solutions, lambda s: identifier_key(s["name"]))
        out = [F.when(F.exists(solutions, lambda s: _blank(s["name"])), "a solution has a name"), F.when(F.size(F.array_distinct(names)) < F.size(names), "a solution is named once"), F.when(F.exists(solutions, lambda s: ~F.coalesce(s["solution_type"].isin(*SOLUTION_TYPES), F.lit(False))), "a solution_type is not known")]
    elif kind == "transfer":
        out = [_outside(F.col(f"_v.{c}"), members, c) for c, members in TRANSFER.items()]
    if kind in ("competition", "transfer") and evidence:
        out.append(_url_problem("evidence_urls"))
    if kind in ("detection", "clustering") or provenance:
        out += provenance_problems(F.col("_v.provenance"), raw_value("provenance"))
    return out


def identifier_key(name: Column) -> Column:
    """A name as it is compared within a case: lower-cased, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def read_benchmark(spark: SparkSession, path: str, kind: str, *, evidence: bool = True, provenance: bool = True) -> Parsed:
    """A file of ``detection``, ``clustering``, ``competition`` or ``transfer`` cases, and all that is wrong with it.

    Predictions of the last two kinds may come without ``evidence`` and ``provenance``.  A case
    that comes twice is wrong each further time; a file with too few cases is wrong as a whole.
    """
    lines = read_lines(spark, path)
    parsed = parse_json_lines(lines, SPECS[kind], lambda: problems(kind, evidence, provenance))
    ids = lines.select("file", "line", "number", F.get_json_object("line", "$.id").alias("id")).filter("id is not null")
    first = ids.groupBy("id").agg(F.min(F.struct("file", "number")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    again = ids.join(first, "id").filter((F.col("file") != F.col("f.file")) | (F.col("number") != F.col("f.number"))).select("file", "line", F.concat(F.lit("duplicate id "), F.col("id")).alias("problem"), "number")
    few = parsed.rows.agg(F.count("*").alias("n")).filter(F.col("n") < LEAST[kind]).select(F.lit(path).alias("file"), F.lit(None).cast("string").alias("line"), F.lit(f"a {kind} benchmark has at least {LEAST[kind]} cases").alias("problem"), F.lit(None).cast("long").alias("number"))
    return Parsed(parsed.rows, parsed.errors.unionByName(again).unionByName(few))


def coverage(rows: DataFrame, kind: str) -> DataFrame:
    """``metric, value`` of a benchmark's cases: how many there are, of which kinds, sourced, permitted and reviewed."""
    p = F.col("provenance")
    sourced = p["origin"].isin("PUBLIC_SOURCE", "FIRST_PARTY")
    counts = {"cases": F.lit(True), "sourced": sourced, "permissioned": sourced & (p["rights_status"] == "APPROVED"), "reviewed": p["label_method"] != "UNREVIEWED"}
    if kind == "detection":
        counts |= {"positive": F.col("is_problem"), "negative": ~F.col("is_problem")}
    found = rows.agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in counts))).alias("x")).select("x.*")
