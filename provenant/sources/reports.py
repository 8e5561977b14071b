"""Reports rendered on the driver from small, already aggregated tables."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.sources.sinks import cell, markdown_table, write_csv, write_json_lines

REVIEW_COLUMNS = ("source", "observation_id", "url", "published_at", "problem_type", "problem_family", "problem", "actor", "job_to_be_done", "context", "excerpt", "strong", "stratum", "provider", "evidence_scope", "human_is_problem", "human_type", "human_family", "human_strong", "human_notes")
GERMAN = {"Evidence": "Belege", "Research passes": "Recherchegänge", "Alternatives": "Alternativen", "Counter-evidence": "Gegenbelege", "Unknowns": "Offene Punkte", "Validation questions": "Validierungsfragen", "Status": "Status", "unknown": "unbekannt", "none recorded": "nichts erfasst"}
WITHHELD = "[excerpt withheld: display rights not approved]"


def plan_json(plan: DataFrame) -> str:
    """A plan with its totals."""
    by = {r["strict_relevance"]: r["n"] for r in relevance_counts(plan).collect()}  # one row a relevance
    ready = plan.filter("ready").agg(F.count("*").alias("n"), F.coalesce(F.sum("pilot_size"), F.lit(0)).alias("items")).first()
    rows = [r.asDict() for r in plan.orderBy("ordering").collect()]  # registry sources
    return json.dumps({"entries": rows, "counts_by_relevance": {str(k): v for k, v in by.items()}, "ready": ready["n"], "planned_items": ready["items"]}, sort_keys=True, indent=2, ensure_ascii=False)


def relevance_counts(plan: DataFrame) -> DataFrame:
    """``strict_relevance, n``."""
    return plan.groupBy("strict_relevance").agg(F.count("*").alias("n"))


def plan_markdown(plan: DataFrame) -> str:
    return "# Pilot plan\n\n" + markdown_table(plan.orderBy("ordering"))


def write_review(rows: DataFrame, path: str) -> None:
    """Review rows in the fixed column order, with blank columns for people."""
    have = set(rows.columns)
    write_csv(rows.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in REVIEW_COLUMNS)), path)


def opportunity_report(row: Mapping, *, approved_sources: set[str] | None = None, language: str = "en") -> str:
    """The report of one nested case row; excerpts of sources without approved rights are withheld, unknown is never zero."""
    say = (lambda s: GERMAN.get(s, s)) if language == "de" else (lambda s: s)
    out = [f"# {row['title']}", "", f"{say('Status')}: {row['status']}", ""]

    def section(name: str, rows: list | None, line) -> None:
        out.extend([f"## {say(name)}", ""])
        out.extend([f"- {line(r)}" for r in rows or []] or [say("none recorded")])
        out.append("")

    def quoted(r) -> str:
        shown = approved_sources is None or str(r["observation_id"]) in approved_sources
        return f"[{r['evidence_scope']}] {r['problem']} — “{r['excerpt'] if shown and r['excerpt'] else WITHHELD if not shown else say('unknown')}”"

    value = lambda v: say("unknown") if v is None else cell(v)
    section("Evidence", row["evidence"], quoted)
    section("Research passes", row["passes"], lambda r: f"{r['pass_type']}: {r['status']} ({value(r['outcome'])})")
    section("Alternatives", row["competitors"], lambda r: f"{r['name']} ({r['solution_type']}), {value(r['pricing'])}")
    section("Counter-evidence", row["counter_evidence"], lambda r: r["evidence_type"])
    section("Unknowns", row["unknowns"], lambda r: r["statement"])
    section("Validation questions", row["questions"], lambda r: r["question"])
    return "\n".join(out)


# The sections of a whole report, in order, with their German names.
SECTIONS = {
    "Problem": "Problem", "Who experiences it": "Wer ist betroffen", "When it happens": "Wann es auftritt", "Current workflow": "Heutiger Ablauf", "Current workaround": "Heutiger Umweg", "Impact and payment": "Auswirkung und Zahlung",
    "Global evidence": "Belege weltweit", "DACH evidence": "Belege aus DACH", "Original evidence": "Originalbelege", "DACH relevance": "Bedeutung für DACH", "Existing solutions": "Vorhandene Lösungen", "What they miss": "Was ihnen fehlt",
    "Local solutions": "Lokale Lösungen", "Buyer map": "Wer kauft", "Local dependencies": "Lokale Abhängigkeiten", "Switching barriers": "Wechselhürden", "Counter-evidence": "Gegenbelege", "Research findings": "Ergebnisse der Recherche", "Unknowns": "Offene Punkte", "Validation questions": "Validierungsfragen",
}
WORDS = {"unknown": "unbekannt", "nothing recorded": "nichts erfasst", "yes": "ja", "no": "nein", "Evidence state": "Belegstand", "Types": "Arten", "observations": "Beobachtungen", "spans": "Belegstellen", "cited items": "zitierte Texte", "dated": "datiert", "sources": "Quellen", "countries": "Länder", "published": "erschienen"}


def opportunity_document(row: Mapping, *, language: str = "en", internal: bool = False) -> str:
    """The whole report of one opportunity (a row of :func:`dossier.opportunity_dossiers`) as Markdown.

    Only a report-ready opportunity has one.  An excerpt is shown only where its source's
    status approves it, or in an ``internal`` report, which says so.  What is not known
    is called unknown, and an empty section says that nothing is recorded.
    """
    if row["opportunity_status"] != "REPORT_READY":
        raise ValueError("only a report-ready opportunity has a report")
    say = (lambda w: {**SECTIONS, **WORDS}.get(w, w)) if language == "de" else (lambda w: w)
    known = lambda v: say("unknown") if v is None or v == "" else {True: say("yes"), False: say("no")}.get(v, v) if isinstance(v, bool) else cell(v)
    listed = lambda v: "; ".join(cell(x) for x in v) if v else say("unknown")
    linked = lambda x, name="name", url="url": f"[{cell(x[name])}]({x[url]})" if x[url] else cell(x[name])
    assessed = row["assessment"]
    of = lambda name: known(assessed[name]) if assessed else say("unknown")

    def summary(x) -> list[str]:
        span = known(x["earliest"]) if x["earliest"] == x["latest"] else f"{x['earliest']} – {x['latest']}"
        return [f"{x['observations']} {say('observations')}, {x['spans']} {say('spans')}, {x['items']} {say('cited items')}", f"{say('sources')} ({x['sources']}): {listed(x['source_names'])}", f"{say('countries')}: {listed(x['countries'])}", f"{say('published')}: {span} ({x['dated_items']}/{x['items']} {say('dated')})"]

    def quoted(c) -> str:
        status = (c["commercial_use_status"] or "").strip().upper().replace("-", "_")
        fine = status == "APPROVED" or status.startswith("APPROVED_")
        shown = f"“{cell(c['excerpt'])}”" + ("" if fine else " (internal: display rights not approved)") if fine or internal else WITHHELD
        return f"[{c['scope']}] {shown} — {linked(c, 'source_name')}"

    def solution(k) -> str:
        told = [f"`{k['solution_type']}`", *(f"{n.replace('_', ' ')}: {known(k[n])}" for n in ("target_customer", "market", "pricing", "pricing_model", "dach_available", "dach_specific", "incumbent_fix_risk", "incumbent_fix_rationale")), *(f"{n}: {listed(k[n])}" for n in ("features", "integrations"))]
        return f"{linked(k)}: {', '.join(told)}"

    complaints = [(k, c) for k in row["competitors"] for c in k["complaints"]]
    local = [k for k in row["competitors"] if k["dach_available"] or k["dach_specific"]]
    lines = {
        "Problem": row["problems"], "Who experiences it": row["actors"], "When it happens": [*row["contexts"], *row["jobs_to_be_done"]], "Current workflow": [*row["jobs_to_be_done"], *row["tools_used"]], "Current workaround": row["workarounds"],
        "Impact and payment": [*row["impacts"], *row["payment_evidence"]], "Global evidence": summary(row["global_evidence"]), "DACH evidence": summary(row["dach_evidence"]), "Original evidence": [quoted(c) for c in row["citations"]],
        "DACH relevance": [f"{n}: `{of(n + '_equivalence')}` — {of(n + '_rationale')}" for n in ("actor", "workflow")] + [f"transfer: `{of('transfer_type')}` — {of('transfer_rationale')}", f"gaps: {listed(assessed['localization_gaps'])}"] if assessed else [],
        "Existing solutions": [solution(k) for k in row["competitors"]], "What they miss": [f"{linked(k)}, {known(c['type'])}: {cell(c['statement'])} ({known(c['segment'])}, {known(c['frequency'])})" for k, c in complaints],
        "Local solutions": [f"{linked(k)}: `{k['solution_type']}`, {known(k['market'])}" for k in local], "Buyer map": [f"{p['role']}: `{p['knowledge']}` — {known(p['party'])} — {known(p['note'])}" for p in row["stakeholders"]],
        "Local dependencies": [f"{n}: {listed(assessed[n + '_dependencies'])}" for n in ("ecosystem", "regulatory")] if assessed else [], "Switching barriers": (assessed["switching_barriers"] or []) if assessed else [],
        "Counter-evidence": [f"{x['type']}: {known(x['statement'])}" for x in row["counter_evidence"]], "Research findings": [f"{x['requirement']}: {x['outcome']} — {known(x['claim_text'] or x['note'])}" for x in row["findings"]], "Unknowns": row["unknowns"],
        "Validation questions": [q["question"] + (f" ({cell(q['rationale'])})" if q["rationale"] else "") for q in row["questions"]],
    }
    out = [f"# {row['title']}", "", f"{say('Evidence state')}: `{known(row['evidence_state'])}`", f"{say('Types')}: {listed(row['opportunity_types'])}", ""]
    for name in SECTIONS:
        out += [f"## {say(name)}", "", *([f"- {x}" for x in lines[name]] or [say("nothing recorded")]), ""]
    return "\n".join(out)


def community_report_json(rows: DataFrame) -> str:
    return json.dumps([r.asDict() for r in rows.orderBy("community").collect()], sort_keys=True, indent=2, ensure_ascii=False)  # one row a community


def community_markdown(rows: DataFrame) -> str:
    """Totals of all communities, then a row for each by name."""
    numbers = [f.name for f in rows.schema.fields if f.dataType.simpleString() in ("int", "bigint")]
    totals = rows.agg(F.count("*").alias("communities"), *(F.sum(c).alias(c) for c in numbers))
    return "# Communities\n\n## Totals\n\n" + markdown_table(totals) + "\n## By community\n\n" + markdown_table(rows.orderBy("community"))


#: What the tables of a wave report show, in this order.
WAVE_SECTIONS = {
    "Selection": ("source", "category", "target_items", "health_status", "policy_ready", "acquisition_eligible"),
    "Acquisition": ("source", "search_requests", "requested_items", "discovered_urls", "unique_urls", "duplicates_removed", "full_items", "partial_items", "metadata_only_items", "failed_acquisitions", "acquisition_success_rate"),
    "Research": ("source", "research_quality", "sample_size_usable", "pain_observations", "strong_signals", "active_solution_searches", "quantified_impacts", "payment_signals", "manual_workaround_signals", "diy_internal_tool_signals"),
    "Yields": ("source", "pain_per_1000_usable", "strong_per_1000_usable", "active_per_1000_usable", "payment_per_1000_usable"),
    "Costs": ("source", "acquisition_cost_usd", "processing_cost_usd", "unknown_cost_records", "latency_ms", "cost_per_strong_signal_usd"),
}


def wave_report(rows: DataFrame, review: DataFrame | None = None) -> str:
    """A wave's measures in sections, the strongest sources first, and the rows to be reviewed; what is unknown is said to be so."""
    ranked = rows.orderBy(F.desc_nulls_last("strong_signals"), "source")
    out = ["# Wave", ""]
    for name, columns in WAVE_SECTIONS.items():
        out += [f"## {name}", "", markdown_table(ranked.select(*columns))]
    if review is not None:
        out += ["## Review sample", "", markdown_table(review.select("source", "classification", "place", "source_item_id", "observation_id", "evidence_text", "payment_signal", "providers").orderBy("source", "classification", "place"))]
    return "\n".join(out)


def readiness_report(gates: DataFrame) -> str:
    """Every gate with its measure, and whether all passed; no gate at all is not ready."""
    failed = gates.agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("f")).first()
    verdict = "READY" if failed["n"] and not failed["f"] else "NOT READY"
    return f"# Readiness\n\n{verdict}: {failed['n'] - failed['f']} of {failed['n']} gates passed\n\n" + markdown_table(gates.orderBy("suite", "gate", "metric"))


def capture_report(accounting: DataFrame) -> str:
    """What a capture brought, in all and by source."""
    numbers = ("received", "full", "partial", "metadata_only", "removed", "deleted", "new_items", "existing_items")
    return "# Capture\n\n" + markdown_table(accounting.agg(*(F.sum(c).alias(c) for c in numbers))) + "\n## By source\n\n" + markdown_table(accounting.orderBy("source_id"))


def holdout_outputs(sample: DataFrame, folder: str) -> None:
    """The review sample of a holdout as JSON lines and as CSV."""
    write_json_lines(sample, f"{folder}/review.jsonl")
    write_csv(sample, f"{folder}/review.csv")


def site_payload(pains: DataFrame, products: DataFrame, updated: str) -> str:
    """The data of a static page: pains with their related products, products, and counts; fetched a partition at a time."""
    found = [r.asDict(recursive=True) for r in pains.orderBy("id").toLocalIterator()]
    shown = [r.asDict(recursive=True) for r in products.orderBy("name").toLocalIterator()]
    stats = {"pains": len(found), "products": len(shown), "niches": len({p["niche"] for p in found}), "quotes": sum(1 for p in found if p["quote"])}
    return json.dumps({"updated": updated, "pains": found, "products": shown, "stats": stats}, ensure_ascii=False, sort_keys=True)


def radar_board(buckets: DataFrame, products: DataFrame) -> str:
    """Counts by bucket and the 120 newest products."""
    return "# Radar\n\n" + markdown_table(buckets.orderBy(buckets["products"].desc(), "bucket")) + "\n## Newest\n\n" + markdown_table(products.orderBy(products["seen_date"].desc(), "name").limit(120))


def load_state(text: str | None) -> dict[str, str]:
    """A resumable run's state by source; anything else starts anew."""
    try:
        state = json.loads(text or "{}")
    except ValueError:
        return {}
    return {str(k): str(v) for k, v in state.items()} if isinstance(state, dict) else {}


def write_state(state: Mapping[str, str], path: str) -> None:
    """A run's state as one JSON object with sorted keys; a path without a scheme is a local file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(dict(state), indent=2, sort_keys=True) + "\n", encoding="utf-8")


def next_sources(sources: list[str], state: Mapping[str, str]) -> list[str]:
    """What a resumed run still has to do: all but complete and skipped sources."""
    return [s for s in sources if state.get(s) not in ("COMPLETE", "SKIPPED")]
