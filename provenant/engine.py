"""The command surface: every operation of the engine over one snapshot store.

Reads give DataFrames.  Writes take DataFrames, transform the current snapshot
and publish the changed tables together.  Every publish is refused if it breaks
what held before: a guard, a row rule, a key or a reference that concerns a
changed table, a legal move of states, or a text that evidence stands on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions.text import fingerprint, identifier, normalize_url
from provenant.operators import audits, candidates, cost, discovery, dossier, evaluation, extraction, ingestion, lifecycle, metrics, planning, radar, records, rules, runs, signals
from provenant.operators.candidates import evidence_state
from provenant.sources import readers, reports, sinks
from provenant.sources.scratch import written
from provenant.sources.store import SnapshotStore


class Engine:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, SnapshotStore(spark, root)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _tables(self, *names: str) -> list[DataFrame]:
        return [self.table(n) for n in names]

    def _publish(self, changes: dict[str, DataFrame]) -> int:
        before, changed = self.store.tables(), set(changes)

        def refuse(after: dict[str, DataFrame]) -> DataFrame:
            self._transitions(before, after, changed)
            now = self._breaks(after, changed)
            then = self._breaks(before, changed) if now else {}
            bad = sorted(w for w, (n, keys) in now.items() if keys is None and n > then.get(w, (0, None))[0])
            doubtful = {tuple(w.split(": ", 1)) for w, (_, keys) in now.items() if keys is None and w not in bad}
            if doubtful:  # broken before, too, and no more often: by the same rows?
                rows, old = rules.broken_rows(after, doubtful), rules.broken_rows(before, doubtful)
                bad += sorted(r[0] for r in (rows if old is None else rows.subtract(old)).select("rule").distinct().collect())
            moved = {w for w, found in now.items() if found[1] is not None and found != then.get(w)}
            if moved:  # some other rows break a guard: are there any that did not before?
                rows, old = audits.guarded(after, changed, moved), audits.guarded(before, changed, moved)
                bad += sorted(r[0] for r in (rows if old is None else rows.subtract(old)).select("guard").distinct().collect())
            if bad:
                raise ValueError(f"the snapshot is refused: {', '.join(bad)}")
            return next(iter(after.values())).limit(0)

        return self.store.publish(changes, {"whole": refuse})

    @staticmethod
    def _breaks(tables: dict[str, DataFrame], changed: set[str]) -> dict[str, tuple[int, int | None]]:
        """How many rows break each guard (with a digest of their keys) and each rule, key and reference; one job."""
        counts = rules.broken(tables, changed & set(tables))
        rows = counts.select(F.concat_ws(": ", "table_name", "rule").alias("what"), "violations", F.lit(None).cast("long").alias("keys"))
        guards = audits.guarded(tables, changed)
        if guards is not None:
            rows = rows.unionByName(guards.groupBy(F.col("guard").alias("what")).agg(F.count("*").alias("violations"), F.bit_xor(F.xxhash64("key")).alias("keys")))
        return {r["what"]: (r["violations"], r["keys"]) for r in rows.collect()}  # one row a guard or rule

    def _transitions(self, before: dict[str, DataFrame], after: dict[str, DataFrame], changed: set[str]) -> None:
        """Refuse changes that no single state shows: moves, rewritten evidence, lost facts."""
        if "source_items" in changed & set(before) and "evidence_spans" in before:
            self._refuse(audits.changed_after_evidence(before["source_items"], after["source_items"], before["evidence_spans"]), "a text that evidence stands on never changes")
        for table, moves, first in (("research_cases", audits.CASE_MOVES, "OPEN"), ("opportunities", audits.OPPORTUNITY_MOVES, "DRAFT")):
            if table in changed & set(before):
                self._refuse(audits.illegal_moves(before[table], after[table], moves, first), f"invalid transition in {table}")
        if "claims" in changed & set(before) and "research_requirements" in before:
            self._refuse(audits.downgraded_facts(before["claims"], after["claims"], before["research_requirements"]), "a requirement keeps its fact")

    def _known(self, name: str, shape: str | None = None) -> DataFrame:
        """A table, or an empty one of the given shape where there is none yet."""
        return self.table(name) if name in self.store.manifest() else self.spark.createDataFrame([], shape)

    def _fit(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """Rows with the columns of a table; what they do not know is null."""
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields))

    def _added(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """New rows of a table with the next ids, in the order of a key within blocks."""
        current = self.table(name)
        return lifecycle.with_new_ids(rows.withColumn("id", F.lit(None).cast("long")), current, key)

    @staticmethod
    def _refuse(rows: DataFrame, why: str) -> None:
        if not rows.isEmpty():
            raise ValueError(why)

    # ---- ingestion -------------------------------------------------------------------------------------------------

    def init(self, tables: dict[str, DataFrame]) -> int:
        """Publish initial (possibly empty) tables."""
        return self.store.publish(tables)

    def ingest_sources(self, incoming: DataFrame) -> int:
        return self._publish({"sources": lifecycle.merge_sources(self.table("sources"), incoming)})

    def ingest_items(self, incoming: DataFrame) -> int:
        """Upsert items by source and normalised external id; URLs are normalised, texts get their digest where the table has one."""
        before = self.table("source_items")
        rows = incoming.withColumn("external_id", identifier(F.col("external_id")))
        if "url" in rows.columns:
            rows = rows.withColumn("url", F.coalesce(normalize_url(F.col("url")), F.col("url")))
        if "content_hash" in before.columns:
            rows = rows.withColumn("content_hash", F.sha2("raw_text", 256))
        return self._publish({"source_items": lifecycle.upsert_items(before, self._fit(rows, before))})

    def ingest_jsonl(self, path: str, source_id: int, seen_at: str) -> int:
        """Items of a strict JSON-lines file; one bad line refuses the file."""
        rows = readers.require_valid(readers.read_json(self.spark, path, "items"))
        items = rows.select(F.lit(source_id).cast("long").alias("source_id"), identifier(F.col("external_id")).alias("external_id"), F.col("text").alias("raw_text"), "author_external_id", "published_at", "country_code", "language_code", F.lit(seen_at).alias("first_seen_at"), F.lit(seen_at).alias("last_seen_at"))
        return self.ingest_items(items.withColumn("id", F.lit(None).cast("long")).select(self.table("source_items").columns))

    def import_registry(self, path: str) -> int:
        """Sources and registry profiles of a CSV: known ones are merged, others are added."""
        rows = readers.read_registry(self.spark, path)
        key = F.concat(F.lit("community:"), F.lower("name"))
        blank = {c: F.lit(None).cast("string") for c in ("lifecycle", *lifecycle.POLICY)}
        merged = lifecycle.merge_sources(self.table("sources").select("id", "normalized_key", "name", "lifecycle", *lifecycle.POLICY), rows.select(key.alias("normalized_key"), "name").distinct().withColumns(blank).select("normalized_key", "name", "lifecycle", *lifecycle.POLICY))
        others = self.table("sources").select(*(c for c in self.table("sources").columns if c not in merged.columns or c == "id"))
        sources = self._fit(merged.join(others, "id", "left"), self.table("sources"))
        profiles = self.table("source_registry_profiles")
        of = rows.join(merged.select(F.col("id").alias("source_id"), F.lower("name").alias("_k")), F.lower("name") == F.col("_k"))
        return self._publish({"sources": sources, "source_registry_profiles": lifecycle.merge_profiles(profiles, self._fit(of, profiles), (), ())})

    def fill_policies(self, defaults: dict[str, str]) -> int:
        return self._publish({"sources": lifecycle.fill_policy_defaults(self.table("sources"), defaults)})

    def merge_profiles(self, incoming: DataFrame, always: tuple[str, ...] = (), arrays: tuple[str, ...] = ()) -> int:
        profiles = self.table("source_registry_profiles")
        return self._publish({"source_registry_profiles": lifecycle.merge_profiles(profiles, self._fit(incoming, profiles), always, arrays)})

    def put_metadata(self, rows: DataFrame) -> int:
        """Registry metadata by source and namespace (``source_id, namespace, metadata_json``)."""
        current = self._known("source_registry_metadata", "source_id long, namespace string, metadata_json string")
        return self._publish({"source_registry_metadata": lifecycle.upsert(current, rows, ["source_id", "namespace"])})

    def record_health(self, checks: DataFrame) -> int:
        """Append health checks; a check that contradicts a recorded one is refused."""
        current = self.table("source_health_checks")
        numbered = self._added("source_health_checks", checks.withColumn("_key", F.concat_ws("|", "source_id", "provider", "checked_at")), "_key")
        rows, conflicts = lifecycle.append_health(current.drop("id"), self._fit(numbered, current).drop("id"))
        self._refuse(conflicts, "a health check is recorded with another result")
        known = current.select("id", *(F.col(k).alias(f"_{k}") for k in ("source_id", "provider", "checked_at")))
        kept = rows.join(known, (F.col("source_id") == F.col("_source_id")) & (F.col("provider") == F.col("_provider")) & (F.col("checked_at") == F.col("_checked_at")), "left").withColumn("_key", F.concat_ws("|", "source_id", "provider", "checked_at"))
        return self._publish({"source_health_checks": self._fit(lifecycle.with_new_ids(kept.select("id", "_key", *[c for c in current.columns if c != "id"]), current, "_key"), current)})

    def ingest_products(self, products: DataFrame) -> int:
        """Merge products (``key, name, tagline, seen_date``) with their pain hits."""
        shape = "key string, name string, tagline string, pain_hits array<string>, seen_date string"
        current = self._known("products", shape)
        tagged = radar.classified(products).select("key", "name", "tagline", "pain_hits", "seen_date")
        return self._publish({"products": lifecycle.merge_products(current, tagged).drop("is_new")})

    # ---- discovery and acquisition ---------------------------------------------------------------------------------

    def discover(self, captures: DataFrame, vocabularies: dict[str, tuple[str, ...]], provider: str, time_context: str | None = None) -> int:
        """Runs and records of every source and vocabulary from recorded search answers; what is recorded already stays."""
        runs, hits = ingestion.discovered(ingestion.query_grid(self.table("sources"), vocabularies, time_context), captures, provider)
        old_runs, old = self._tables("discovery_runs", "discovery_records")
        new = lifecycle.absent(runs.select("id"), old_runs, ["id"]).withColumnRenamed("id", "_run")
        rows = hits.join(new, F.col("run_id") == F.col("_run"), "left_semi").withColumn("_key", F.concat_ws("|", "run_id", "canonical_url"))
        added = self._fit(self._added("discovery_records", rows, "_key"), old)
        return self._publish({"discovery_runs": old_runs.unionByName(self._fit(runs.join(new, F.col("id") == F.col("_run"), "left_semi"), old_runs)), "discovery_records": old.unionByName(added)})

    def acquire(self, answers: DataFrame, provider: str, full_content: bool = True) -> int:
        """Acquire what a provider has not tried: items, acquisitions and discovery states; an answer that contradicts itself refuses all."""
        discoveries, old = self._tables("discovery_records", "acquisition_records")
        written, contents, refused = ingestion.acquired(discoveries, old, answers, provider, full_content)
        self._refuse(refused, "an answer contradicts itself")
        return self._taken(written, contents)

    def ingest_feed(self, records: DataFrame, source_id: int, provider: str, query: str) -> int:
        """One page of provider records: its run, discoveries, items and acquisitions."""
        runs, found, written, contents = ingestion.feed_rows(records, source_id, provider, query)
        old_runs, old = self._tables("discovery_runs", "discovery_records")
        fresh = lifecycle.absent(runs, old_runs, ["id"])
        added = self._fit(self._added("discovery_records", found, "canonical_url"), old) if not fresh.isEmpty() else old.limit(0)
        ids = old.unionByName(added).filter(F.col("source_id") == source_id).groupBy("canonical_url").agg(F.max("id").alias("discovery_id"))
        changes = {"discovery_runs": old_runs.unionByName(self._fit(fresh, old_runs)), "discovery_records": old.unionByName(added)}
        return self._taken(written.join(ids, "canonical_url").withColumn("source_id", F.lit(source_id).cast("long")).dropDuplicates(["discovery_id"]), contents, changes)

    def _taken(self, written: DataFrame, contents: DataFrame, changes: dict[str, DataFrame] | None = None) -> int:
        """Publish acquisitions with the items and discovery states that follow from them."""
        items, old = self._tables("source_items", "acquisition_records")
        discoveries = (changes or {}).get("discovery_records", self.table("discovery_records"))
        state = self._known("item_contents", "source_id long, external_id string, completeness string, raw_text string, url string, title string, author_external_id string, published_at string, conflicts long")
        ided = contents.withColumn("external_id", identifier(F.col("external_id")))
        named = ided.select("source_id", "external_id").distinct()
        merged = ingestion.merged_items(state.join(named, ["source_id", "external_id"], "left_semi"), ided)
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        after = lifecycle.upsert_items(items, self._fit(merged.withColumns({"first_seen_at": now, "last_seen_at": now}), items))
        of_item = after.select(F.col("source_id").alias("_s"), F.col("external_id").alias("_e"), F.col("id").alias("_item"))
        linked = written.join(of_item, (F.col("source_id") == F.col("_s")) & (identifier(F.col("external_id")) == F.col("_e")), "left").withColumn("source_item_id", F.col("_item"))
        both = lifecycle.acquisition_upsert(old, self._fit(linked, old).withColumn("id", F.lit(None).cast("long")))
        kept = old.select(F.col("id").alias("_id"), F.col("discovery_id").alias("_d"), F.col("provider").alias("_p"))
        ids = both.drop("id").join(kept, (F.col("discovery_id") == F.col("_d")) & (F.col("provider") == F.col("_p")), "left").withColumn("id", F.col("_id")).withColumn("_key", F.concat_ws("|", "discovery_id", "provider"))
        acquisitions = self._fit(lifecycle.with_new_ids(ids.select("_key", *old.columns), old, "_key"), old)
        rest = state.join(named, ["source_id", "external_id"], "left_anti").select(*state.columns)
        out = dict(changes or {}) | {"source_items": after, "acquisition_records": acquisitions, "item_contents": rest.unionByName(merged.select(*state.columns))}
        if "state" in discoveries.columns:
            out["discovery_records"] = ingestion.spread_state(discoveries, acquisitions)
        return self._publish(out)

    def export_items(self, path: str) -> None:
        sinks.write_json_lines(self.table("source_items"), path)

    def set_lifecycle(self, source: str, value: str) -> int:
        rows = self.table("sources")
        if rows.filter(F.col("name") == source).count() != 1:
            raise ValueError(f"there is no single source {source}")
        return self._publish({"sources": rows.withColumn("lifecycle", F.when(F.col("name") == source, F.lit(value)).otherwise(F.col("lifecycle")))})

    def ingest_records(self, records_: DataFrame, provider: str, query: str, source_id: int) -> int:
        """One page of provider records in one form (see :func:`providers.normalized`); one that leads elsewhere refuses the page."""
        page = written(records_)  # told once, whatever is made of it
        self._refuse(page.filter("failure is not null"), "a record does not come from the source that was asked")
        found = page.select("identity", "completeness", F.when(F.col("completeness") != "METADATA_ONLY", F.col("title")).alias("title"), F.when(F.col("completeness") != "METADATA_ONLY", F.regexp_replace("text", r"(?s)^.*?\n\n", "")).alias("body"), "author", "published_at")
        return self.ingest_feed(found, source_id, provider, query)

    def ingest_launches(self, path: str) -> int:
        """Products of a launch feed; those that are there are merged."""
        return self.ingest_products(readers.launch_products(self.spark, path).withColumn("pain_hits", F.array().cast("array<string>")))

    def items(self, ids: DataFrame) -> DataFrame:
        """Stored items of an id list (``id``), by id."""
        return readers.select_items(self.table("source_items"), ids)

    # ---- observations ----------------------------------------------------------------------------------------------

    def add_signals(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """Workarounds, impacts or payments that are not recorded yet."""
        current = self.table(table)
        return self._publish({table: current.unionByName(lifecycle.absent(rows, current, keys))})

    def add_evidence(self, rows: DataFrame) -> int:
        current = self.table("evidence_spans")
        keys = ["source_item_id", "observation_id", "start_offset", "end_offset"]
        return self._publish({"evidence_spans": current.unionByName(lifecycle.absent(rows, current, keys))})

    def revise(self, revisions: DataFrame, field: str) -> int:
        """Evidence-backed corrections of a field: audited, with their memberships and fingerprints taken back.

        ``revisions`` holds ``observation_id, value, reason, evidence_span_id,
        revision_version``; one that is refused refuses all, a replay changes nothing.
        """
        shape = "id long, observation_id long, field_name string, old_value_json string, new_value_json string, reason string, evidence_span_id long, revision_version string"
        observations, members, cases = self._tables("problem_observations", "cluster_members", "research_cases")
        recorded = self._known("observation_revisions", shape)
        if field not in rules.MEMBERS["observation_revisions.field_name"].split(","):
            raise ValueError(f"{field} is no field that can be revised")
        told = recorded if "new_value_json" in recorded.columns else recorded.withColumn("new_value_json", F.lit(None).cast("string"))
        judged = lifecycle.judged_revisions(revisions, field, observations, self.table("evidence_spans"), members, cases, told)
        why = judged.filter("refusal is not null").select("refusal").limit(1).collect()
        if why:
            raise ValueError(why[0][0])
        new = judged.filter("not replayed")
        rows = lifecycle.with_new_ids(new.withColumns({"id": F.lit(None).cast("long"), "_key": F.concat_ws("|", "observation_id", "field_name", "revision_version")}), recorded, "_key")
        clusters = self._known("problem_clusters", "id long, algorithm_version string, fingerprint string")
        prints = self._known("observation_fingerprints", "observation_id long, fingerprint_version string, fingerprint string")
        kept, prints, clusters = lifecycle.without_observations(members, prints, clusters, cases, new)
        changed = lifecycle.revise_field(observations, new.select("observation_id", F.col("revision_version").alias("version"), F.col("value").alias("new_value")), field)
        return self._publish({"problem_observations": changed, "observation_revisions": recorded.unionByName(self._fit(rows, recorded)), "cluster_members": kept, "observation_fingerprints": prints, "problem_clusters": clusters})

    def set_family(self, changes: DataFrame) -> int:
        """Set problem families and ontology versions (``observation_id, problem_family, ontology_version``)."""
        return self._publish({"problem_observations": lifecycle.set_family(self.table("problem_observations"), changes)})

    def add_observations(self, drafts: dict[str, DataFrame], run_id: str | None = None) -> int:
        """Observations with their spans and signals (see :func:`extraction.observation_drafts`), all or none.

        An observation without a span, or a signal without its span, refuses all.
        """
        return self._publish(self._observations(drafts, run_id))

    def insert_observations(self, rows: DataFrame, run_id: str | None = None) -> int:
        """Plain observations without evidence: ``source_item_id, problem_type, problem_family, evidence_scope, problem`` and ``fields_json``.

        Evidence may be added later; until then none is strong and no claim may stand on
        one.  A field that is not known or of another type than its own refuses all.
        """
        wrong = readers.field_problem(F.col("fields_json"), readers.TEXT_FIELDS, readers.FLAG_FIELDS)
        why = rows.select(wrong.alias("why")).filter("why is not null").limit(1).collect()
        if why:
            raise ValueError(why[0]["why"])
        self._refuse(rows.filter(F.coalesce(F.trim("problem"), F.lit("")) == ""), "an observation states its problem")
        drafts = {"observations": rows.withColumn("fields", F.from_json("fields_json", "map<string, string>")).withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string, string>"))).drop("fields_json")}
        return self._publish(self._observations(drafts, run_id))

    def _observations(self, drafts: dict[str, DataFrame], run_id: str | None, observations: DataFrame | None = None) -> dict[str, DataFrame]:
        now, items, spans = self._tables("problem_observations", "source_items", "evidence_spans")
        observations = now if observations is None else observations
        of_item = items.select(F.col("id").alias("source_item_id"), F.col("country_code").alias("_country"))
        rows = drafts["observations"].join(of_item, "source_item_id", "left")
        named = [c for c in observations.columns if c not in rows.columns and c not in ("id", "pipeline_run_id", "created_at", "country_code")]
        kinds = dict(observations.dtypes)
        rows = rows.withColumns({c: F.col("fields")[c].cast(kinds[c]) for c in named} | {"pipeline_run_id": F.lit(run_id).cast("string"), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), "country_code": F.coalesce(F.col("fields")["country_code"], "_country")})
        made = self._added("problem_observations", rows, "source_item_id")
        if "evidence_spans" not in drafts:
            return {"problem_observations": observations.unionByName(self._fit(made, observations))}
        new_ids = made.select(F.col("id").alias("observation_id"), "source_item_id")
        self._refuse(new_ids.join(drafts["evidence_spans"], "source_item_id", "left_anti"), "an observation has evidence")
        placed = drafts["evidence_spans"].join(new_ids, "source_item_id").withColumn("_key", F.format_string("%020d|%010d", "observation_id", "evidence_index"))
        with_id = self._added("evidence_spans", placed.withColumnsRenamed({"start": "start_offset", "end": "end_offset"}), "_key")
        out = {"problem_observations": observations.unionByName(self._fit(made, observations)), "evidence_spans": spans.unionByName(self._fit(with_id, spans))}
        link = with_id.select("source_item_id", "evidence_index", "observation_id", F.col("id").alias("evidence_span_id"))
        for table, kind in (("workarounds", "workaround_type"), ("impact_signals", "impact_type"), ("payment_signals", "payment_type")):
            current, given = self.table(table), drafts[table]
            self._refuse(given.filter("not has_span"), "a signal names a span of its observation")
            linked = given.withColumnRenamed("type", kind).join(link, ["source_item_id", "evidence_index"]).withColumn("_key", F.format_string("%020d|%010d|%s", "observation_id", "evidence_index", kind))
            out[table] = current.unionByName(self._fit(self._added(table, linked, "_key"), current))
        return out

    def extract(self, path: str, version: str) -> str:
        """A run over a prediction file that writes what it finds; gives the run's id.

        A repetition with the same version and items reuses the completed run.  A
        prediction that is refused leaves a FAILED run with its reason, and nothing else.
        """
        rows = readers.require_valid(readers.read_json(self.spark, path, "predictions"))
        items = self.table("source_items")
        covered = items.join(rows.select(F.col("source_item_id").alias("id")), "id", "left_semi")
        signature = extraction.input_signature(covered).first()[0]
        signed = self._known("completed_pipeline_signatures", "run_id string, stage string, version string, input_signature string")
        done = signed.filter((F.col("stage") == "EXTRACTION") & (F.col("version") == version) & (F.col("input_signature") == signature)).first()
        if done is not None:
            return done["run_id"]
        runs = self.table("pipeline_runs")
        run_id = f"extraction-{version}-{signature[:16]}-{runs.count()}"
        accepted, refused = extraction.replay_predictions(rows, items)
        why = refused.limit(1).collect()
        count = covered.count()

        def run(status: str, output: int, error: str | None) -> DataFrame:
            made = self.spark.createDataFrame([(run_id, status, version, "EXTRACTION", count, output, error)], "id string, status string, version string, stage string, input_count long, output_count long, error string")
            return runs.unionByName(self._fit(made, runs))

        if why:
            self._publish({"pipeline_runs": run("FAILED", 0, why[0]["failure"])})
            raise ValueError(f"a prediction does not match its source item: {why[0]['failure']}")
        drafts = extraction.observation_drafts(accepted)
        changes = self._observations(drafts, run_id) | {"pipeline_runs": run("COMPLETED", drafts["observations"].count(), None)}
        mark = self.spark.createDataFrame([(run_id, "EXTRACTION", version, signature)], "run_id string, stage string, version string, input_signature string")
        try:
            self._publish(changes | {"completed_pipeline_signatures": signed.unionByName(mark)})
        except ValueError as error:
            self._publish({"pipeline_runs": run("FAILED", 0, str(error))})
            raise
        return run_id

    def finish_runs(self, results: DataFrame) -> int:
        """End running runs (``id, status, output_count``); one that is not running is refused."""
        runs = self.table("pipeline_runs")
        after, refused = lifecycle.finish_runs(runs if "output_count" in runs.columns else runs.withColumn("output_count", F.lit(None).cast("long")), results)
        self._refuse(refused, "only a running run ends")
        return self._publish({"pipeline_runs": after})

    def record_model_runs(self, rows: DataFrame, cost_fields: tuple[str, str, str] = ("amount", "currency", "measurement_source")) -> int:
        """Record model runs once by their id; a replay with other values, or half a cost, refuses all."""
        current = self.table("model_runs")
        known = [F.col(c) if c in rows.columns else F.lit("invoice" if c == cost_fields[2] else None).cast("string") for c in cost_fields]
        if cost_fields[2] not in rows.columns:
            known[2] = F.when(known[0].isNotNull(), F.lit("recorded"))
        self._refuse(rows.filter(lifecycle.model_run_refusal(*known).isNotNull()), "amount, currency and source of a cost come together")
        fitted = self._fit(rows, current)
        self._refuse(lifecycle.conflicting_replays(fitted, current, "id", [c for c in current.columns if c != "id"]), "a model run is recorded with other values")
        return self._publish({"model_runs": current.unionByName(lifecycle.absent(fitted, current, ["id"]))})

    def create_claims(self, drafts: DataFrame) -> int:
        claims, links, refused = lifecycle.create_claims(drafts, self.table("evidence_spans"))
        self._refuse(refused, "FACT claims must be created with evidence")
        return self._publish({"claims": self.table("claims").unionByName(claims), "claim_evidence": self.table("claim_evidence").unionByName(links)})

    def replay_predictions(self, path: str) -> dict[str, DataFrame]:
        """Drafts of a prediction file; a refused prediction refuses the file."""
        rows = readers.require_valid(readers.read_json(self.spark, path, "predictions"))
        accepted, refused = extraction.replay_predictions(rows, self.table("source_items"))
        self._refuse(refused, "a prediction does not match its source item")
        return extraction.observation_drafts(accepted)

    def ask_model(self, model: Callable[[str], str | None], identity: Column) -> DataFrame:
        """Answers of all items; the model is asked for what is not cached, and what it says is cached at the next :meth:`cache_answers`."""
        return extraction.answers(self.table("source_items").select("id", "raw_text"), self.table("inference_cache"), model, identity)

    def cache_answers(self, answers: DataFrame) -> int:
        """Keep the answers of a model by identity; the first one of an identity stands."""
        cache = self.table("inference_cache")
        new = lifecycle.first_of_each(answers.filter("not cached and answer is not null").select("identity", "id", "answer"), ["identity"], [F.col("id")]).select("identity", "answer")
        return self._publish({"inference_cache": cache.unionByName(lifecycle.absent(new, cache, ["identity"]))})

    def discover_problems(self, call: Callable[[discovery.Request], discovery.Reply], settings: discovery.Settings, run_id: str, item_ids: DataFrame | None = None, chunks: int = 4) -> DataFrame:
        """A run of both stages over items that are acquired whole; gives one row of its counts.

        The run's items are frozen at its beginning (``item_ids``: ``id``, all such items
        without it).  A stage is asked in ``chunks`` of items; what a chunk brought is
        written once, then published with its ledger, model runs and answers and with the
        chunk's state.  A run of the same id goes on where it broke off, and asks for
        nothing that has been written; a complete one asks for nothing at all.
        """
        full = self.table("acquisition_records").filter("completeness = 'FULL'").select(F.col("source_item_id").alias("id"))
        items = self.table("source_items").select("id", "raw_text").filter("raw_text is not null")
        wanted = items.select("id") if item_ids is None else item_ids.select(F.col("id").cast("long").alias("id"))
        if item_ids is not None:
            self._refuse(wanted.groupBy("id").count().filter("count > 1"), "an item is named twice")
            self._refuse(wanted.join(items.join(full, "id", "left_semi"), "id", "left_anti"), "discovery takes items that are acquired whole")
        frozen = written(wanted.join(full, "id", "left_semi"), f"{self.store.root}/runs/{run_id}/items")
        items = items.join(frozen, "id", "left_semi")
        runs_ = self.table("pipeline_runs")
        if runs_.filter(F.col("id") == run_id).isEmpty():
            started = self.spark.createDataFrame([(run_id, "RUNNING", settings.pipeline_version, "EXTRACTION", frozen.count())], "id string, status string, version string, stage string, input_count long")
            self._publish({"pipeline_runs": runs_.unionByName(self._fit(started, runs_))})
        steps = [f"{n}-{stage}-{c:04d}" for n, stage in ((1, discovery.SCREENING), (2, discovery.EXTRACTION)) for c in range(chunks)]
        self.plan_run(run_id, [*steps, "3-OBSERVATIONS"])
        chunk = F.pmod(F.xxhash64("id"), F.lit(chunks))
        for step in self._unfinished(run_id):
            _, _, rest = step.partition("-")
            stage, _, number = rest.partition("-")
            cache, ledger = self._known("structured_inference_cache", discovery.CACHE), self._known("structured_inference_attempts", discovery.LEDGER)
            if stage == "OBSERVATIONS":
                self._publish(self._observed(items, cache, settings, run_id) | self._states(run_id, step, "COMPLETE"))
                continue
            part = items.filter(chunk == int(number))
            of = part if stage == discovery.SCREENING else discovery.screened_in(part, cache, settings)
            last = ledger.filter((F.col("pipeline_run_id") == run_id) & F.col("last"))
            new = written(discovery.asked(discovery.pending(of, stage, settings, cache, last), call, stage, settings), f"{self.store.root}/runs/{run_id}/{step}")
            rows = discovery.ledger_rows(new, run_id, settings)
            answers = discovery.cache_rows(new, part, run_id, settings)
            models = self.table("model_runs")
            called = rows.filter("attempt_number is not null").withColumns({"id": F.col("model_run_id"), "provider": F.lit(settings.provider), "status": F.when(F.col("failure_code").isNull(), "COMPLETED").otherwise("FAILED"), "items_processed": F.lit(1), "amount": F.col("cost_usd"), "currency": F.when(F.col("cost_usd").isNotNull(), "USD")})
            self._publish({
                "structured_inference_attempts": ledger.unionByName(lifecycle.absent(rows, ledger, ["pipeline_run_id", "identity_key", "attempt_number"])), "structured_inference_cache": cache.unionByName(lifecycle.absent(answers, cache, ["identity_key"])),
                "model_runs": models.unionByName(lifecycle.absent(self._fit(called, models), models, ["id"])),
            } | self._states(run_id, step, "COMPLETE"))
        own = self.table("structured_inference_attempts").filter(F.col("pipeline_run_id") == run_id)
        return discovery.run_metrics(discovery.outcomes(items, self.table("structured_inference_cache"), own, settings), own)

    def _observed(self, items: DataFrame, cache: DataFrame, settings: discovery.Settings, run_id: str) -> dict[str, DataFrame]:
        """The observations of a run's extraction answers, each linked to its answer; those of an earlier run are linked, not made again."""
        observations = self.table("problem_observations")
        if "extraction_version" not in observations.columns:
            observations = observations.withColumn("extraction_version", F.lit(None).cast("string"))
        found = discovery.predictions(items, cache, settings)
        version = F.col("fields")["extraction_version"]
        known = observations.filter("extraction_version is not null").groupBy(F.col("source_item_id").alias("_i"), F.col("extraction_version").alias("_v")).agg(F.min("id").alias("observation_id"))
        there = (F.col("source_item_id") == F.col("_i")) & (version == F.col("_v"))
        fresh = found.join(known, there, "left_anti")
        changes = self._observations(extraction.observation_drafts(fresh.drop("identity_key")), run_id, observations)
        every = changes["problem_observations"].filter("extraction_version is not null").groupBy(F.col("source_item_id").alias("_i"), F.col("extraction_version").alias("_v")).agg(F.min("id").alias("observation_id"))
        links = found.join(every, there).select("identity_key", "observation_id")
        after, refused = discovery.linked(cache, links)
        self._refuse(refused, "an extraction answer is linked to another observation")
        runs_ = self.table("pipeline_runs")
        ended = runs_.withColumn("status", F.when(F.col("id") == run_id, "COMPLETED").otherwise(F.col("status")))
        if "output_count" in runs_.columns:
            ended = ended.withColumn("output_count", F.when(F.col("id") == run_id, F.lit(found.count())).otherwise(F.col("output_count")).cast("long"))
        return changes | {"structured_inference_cache": after, "pipeline_runs": ended}

    def holdout_run(self, baseline: DataFrame, call: Callable[[discovery.Request], discovery.Reply], settings: discovery.Settings, run_id: str, most: int | None = None) -> DataFrame:
        """A discovery run over the whole items whose external id no baseline names (``external_id``, compared case-folded); the first ``most`` by id.

        The set is frozen before the model is asked for the first time, so an item of the
        baseline never reaches it, and what is acquired meanwhile does not either.
        """
        seen = readers.baseline_ids(baseline).select(F.col("external_id").alias("_seen"))
        full = self.table("acquisition_records").filter("completeness = 'FULL'").select(F.col("source_item_id").alias("id"))
        unseen = self.table("source_items").filter("raw_text is not null").join(full, "id", "left_semi").join(seen, identifier(F.col("external_id")) == F.col("_seen"), "left_anti").select("id")
        chosen = unseen if most is None else unseen.orderBy("id").limit(most)
        frozen = written(chosen, f"{self.store.root}/runs/{run_id}/holdout")
        if frozen.isEmpty():
            raise ValueError("there are no unseen whole items")
        return self.discover_problems(call, settings, run_id, frozen)

    # ---- resumable runs --------------------------------------------------------------------------------------------

    def plan_run(self, run_id: str, steps: list[str]) -> None:
        """Write down the steps of a run; those that are there keep their state."""
        states = self._known("run_states", runs.STATES)
        asked = self.spark.createDataFrame([(run_id, s) for s in steps], "run_id string, step string")
        if not asked.join(states, ["run_id", "step"], "left_anti").isEmpty():
            self._publish({"run_states": runs.planned(states, asked)})

    def _unfinished(self, run_id: str) -> list[str]:
        return [r["step"] for r in runs.open_steps(self.table("run_states"), run_id).collect()]  # as many as a run has steps

    def _states(self, run_id: str, step: str, state: str, detail: str | None = None) -> dict[str, DataFrame]:
        """The change that moves a step on from what it is now; another writer's move in between refuses it."""
        states = self.table("run_states")
        now = states.filter((F.col("run_id") == run_id) & (F.col("step") == step)).first()["state"]
        if now in ("NEW", "FAILED") and state != "RUNNING":
            states, refused = runs.moved(states, self.spark.createDataFrame([(run_id, step, now, "RUNNING", None)], "run_id string, step string, expected string, state string, detail string"))
            self._refuse(refused, "the step has moved")
            now = "RUNNING"
        after, refused = runs.moved(states, self.spark.createDataFrame([(run_id, step, now, state, detail)], "run_id string, step string, expected string, state string, detail string"))
        self._refuse(refused, "the step has moved")
        return {"run_states": after}

    def run_steps(self, run_id: str, steps: list[str], work: Callable[[str], dict[str, DataFrame] | None], allowed: tuple[str, ...] = ()) -> dict[str, str]:
        """Do the steps of a run that are not complete, and give the state of each; a complete one is SKIPPED.

        ``work`` does a step and gives the tables that it changes: they and the step's
        state are published together.  A step that raises is FAILED with its reason, and the
        run goes on; running it again begins with what is not complete.  ``allowed`` are the
        reasons why a run may not begin (see :func:`text.run_gate_reasons`); there must be none.
        """
        if allowed:
            raise ValueError(f"the run is blocked: {'; '.join(allowed)}")
        self.plan_run(run_id, steps)
        todo = set(self._unfinished(run_id))
        out = {}
        for step in steps:
            if step not in todo:
                out[step] = "SKIPPED"
                continue
            self._publish(self._states(run_id, step, "RUNNING"))
            try:
                self._publish((work(step) or {}) | self._states(run_id, step, "COMPLETE"))
                out[step] = "COMPLETE"
            except Exception as failed:  # noqa: BLE001 - one step's failure must not end the run
                self._publish(self._states(run_id, step, "FAILED", str(failed)[:1000]))
                out[step] = "FAILED"
        return out

    def funnel(self, screened: DataFrame) -> DataFrame:
        """One row of counts from items over the screened ones (``id``) to strong observations."""
        done = signals.in_completed_runs(self.flagged(), self.table("pipeline_runs"))
        return lifecycle.funnel(self.table("source_items"), screened, done, F.col("strong"))

    def readiness(self, coverage: DataFrame, measured: DataFrame, manifest: str) -> DataFrame:
        """Whether each suite of a readiness manifest passes all its gates."""
        wanted = readers.readiness_suites(self.spark, manifest).withColumnRenamed("name", "suite").drop("kind")
        return evaluation.suites_ready(evaluation.suite_gates(coverage, measured, wanted))

    def write_run_state(self, run_id: str, path: str) -> None:
        """The states of a run as one JSON object by step."""
        reports.write_state({r["step"]: r["state"] for r in self.table("run_states").filter(F.col("run_id") == run_id).collect()}, path)

    # ---- clusters, cases and opportunities -------------------------------------------------------------------------

    def flagged(self) -> DataFrame:
        return signals.flags(*self._tables("problem_observations", "workarounds", "impact_signals", "payment_signals", "evidence_spans"))

    def cluster_exact(self, version: str = "exact-v1") -> int:
        """Assign a version of exact clusters anew: fingerprints that stay keep their cluster's id."""
        observations = signals.clusterable(*self._tables("problem_observations", "pipeline_runs"))
        cause = F.col("root_cause") if "root_cause" in observations.columns else F.lit(None).cast("string")
        marked = observations.select(F.col("id").alias("observation_id"), fingerprint(F.col("actor"), F.col("context"), F.col("job_to_be_done"), F.col("problem"), cause).alias("fingerprint"))
        clusters = self._known("problem_clusters", "id long, algorithm_version string, fingerprint string")
        prints = self._known("observation_fingerprints", "observation_id long, fingerprint_version string, fingerprint string")
        members, cases = self._tables("cluster_members", "research_cases")
        clusters, prints, members = lifecycle.assigned_clusters(clusters, prints, members, cases, marked, version)
        return self._publish({"problem_clusters": clusters, "observation_fingerprints": prints, "cluster_members": members})

    def case_candidates(self, sort_by: str = "strongest-evidence", include_opened: bool = False) -> DataFrame:
        done = signals.in_completed_runs(self.flagged(), self.table("pipeline_runs"))
        return candidates.ordered(candidates.roll_up(self.table("cluster_members"), done, *self._tables("source_items", "research_cases"), include_opened), sort_by)

    def create_case(self, cluster_id: int, title: str) -> int:
        cluster = self.table("cluster_members").filter(F.col("cluster_id") == cluster_id).select("cluster_id").distinct()
        cases, passes = lifecycle.open_cases(cluster)
        blank = {c: F.lit(None).cast(t) for c, t in self.table("research_passes").dtypes if c not in passes.columns}
        cases = cases.withColumns({"title": F.lit(title), "updated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")}).select(self.table("research_cases").columns)
        return self._publish({"research_cases": self.table("research_cases").unionByName(cases), "research_passes": self.table("research_passes").unionByName(passes.withColumns(blank).select(self.table("research_passes").columns))})

    def _move(self, table: str, changes: DataFrame) -> int:
        before = self.table(table)
        self._refuse(lifecycle.unknown_keys(changes, before), f"{table} has no such row")
        return self._publish({table: lifecycle.set_status(before, changes)})

    def transition_cases(self, changes: DataFrame) -> int:
        """Move cases (``id, status``); completion demands four passes, unknowns, questions and clear evidence."""
        return self._move("research_cases", changes)

    def transition_opportunities(self, changes: DataFrame) -> int:
        return self._move("opportunities", changes)

    def satisfy_passes(self, results: DataFrame) -> int:
        return self._publish({"research_passes": lifecycle.satisfy_passes(self.table("research_passes"), results)})

    def create_opportunity(self, case_id: int, types: list[str], title: str | None = None) -> int:
        """A draft opportunity of a complete case with its problem claim and the claims of its research; gives its id.

        An opportunity that is a draft gets the new title and the further types.
        """
        kinds = list(dict.fromkeys(types))
        if not kinds:
            raise ValueError("an opportunity has a type")
        cases, opportunities, members, observations, spans = self._tables("research_cases", "opportunities", "cluster_members", "problem_observations", "evidence_spans")
        case = cases.filter(F.col("id") == case_id)
        problems = lifecycle.problem_claims(case, members, observations, spans)
        found = lifecycle.creatable_opportunities(case, opportunities, problems).first()
        if found is None:
            raise ValueError("there is no such case")
        if found["refusal"]:
            raise ValueError(found["refusal"])
        state = self._case_state(case).first()
        head = title.strip() if title and title.strip() else case.first()["title"]
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        of_types = self.table("opportunity_types")
        asked = lambda oid: self.spark.createDataFrame([(oid, k) for k in kinds], "opportunity_id long, opportunity_type string")
        typed = lambda oid: of_types.unionByName(lifecycle.absent(asked(oid), of_types, ["opportunity_id", "opportunity_type"]))
        if found["existing_id"] is not None:
            oid = found["existing_id"]
            mine = F.col("id") == oid
            changed = opportunities.withColumns({"title": F.when(mine, F.lit(head)).otherwise(F.col("title")), "evidence_state": F.when(mine, F.lit(state["evidence_state"])).otherwise(F.col("evidence_state")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))})
            self._publish({"opportunities": changed, "opportunity_types": typed(oid)})
            return oid
        oid = (opportunities.agg(F.max("id")).first()[0] or 0) + 1
        claims, links, roles = self._tables("claims", "claim_evidence", "opportunity_claims")
        claim_id = (claims.agg(F.max("id")).first()[0] or 0) + 1
        drafts = problems.select(F.lit(claim_id).cast("long").alias("id"), "observation_id", F.lit("FACT").alias("claim_kind"), "text", F.array("evidence_span_id").alias("evidence_span_ids"))
        new_claims, new_links, refused = lifecycle.create_claims(drafts, spans)
        self._refuse(refused, "a problem claim has evidence of its observation")
        made = self.spark.createDataFrame([(oid, case_id, head, "DRAFT", state["evidence_state"])], "id long, case_id long, title string, status string, evidence_state string").withColumn("updated_at", now)
        research = lifecycle.opportunity_claims(made, *self._tables("research_passes", "competitors", "counter_evidence", "competitor_evidence", "competitor_complaints", "competitor_complaint_evidence")).filter(F.col("opportunity_id") == oid)
        problem = self.spark.createDataFrame([(oid, claim_id, "PROBLEM")], "opportunity_id long, claim_id long, claim_role string")
        self._publish({"claims": claims.unionByName(self._fit(new_claims, claims)), "claim_evidence": links.unionByName(self._fit(new_links, links)), "opportunities": opportunities.unionByName(self._fit(made, opportunities)), "opportunity_types": typed(oid), "opportunity_claims": roles.unionByName(self._fit(problem.unionByName(research), roles))})
        return oid

    def _case_state(self, cases: DataFrame) -> DataFrame:
        """``case_id, evidence_state`` from the evidence of each case."""
        members, observations, spans, items = self._tables("cluster_members", "problem_observations", "evidence_spans", "source_items")
        rows = cases.select(F.col("id").alias("case_id"), "cluster_id").join(members, "cluster_id").join(observations.select(F.col("id").alias("observation_id"), "source_item_id"), "observation_id")
        rows = rows.join(spans.select("observation_id", F.col("evidence_scope")), "observation_id").join(items.select(F.col("id").alias("source_item_id"), "source_id"), "source_item_id")
        of = rows.groupBy("case_id").agg(F.max(F.col("evidence_scope") == "GLOBAL").alias("g"), F.max(F.col("evidence_scope") == "DACH").alias("h"), F.count_distinct("source_id").alias("s"), F.count_distinct("source_item_id").alias("i"))
        return of.select("case_id", evidence_state(F.col("g"), F.col("h"), F.col("s"), F.col("i")).alias("evidence_state"))

    def put(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """Replace rows by key: competitors, counter-evidence, assessments, stakeholders, unknowns, questions."""
        return self._publish({table: lifecycle.upsert(self.table(table), rows, keys)})

    def record(self, kind: str, drafts: DataFrame) -> int:
        """Record competitors, complaints, counter-evidence, unknowns or questions by their natural keys, with their evidence (see :mod:`records`).

        Parent and evidence are published together, so the guards see both: a claim that is
        no fact refuses the record.
        """
        spec = records.KINDS[kind]
        rows = records.cleaned(kind, drafts)
        why = records.refusals(kind, rows).limit(1).collect()
        if why:
            raise ValueError(f"{why[0]['refusal']}: {why[0]['key']}")
        after = records.merged(kind, self.table(spec.table), rows)
        changes = {spec.table: after}
        if spec.evidence is not None:
            changes[spec.evidence] = records.evidence(kind, after, rows, self.table(spec.evidence))
        return self._publish(changes)

    def complete_without_evidence(self, notes: DataFrame) -> int:
        """End passes that found nothing (``case_id, pass_type, note``); a note is needed."""
        after, refused = records.completed_without_evidence(self.table("research_passes"), notes)
        why = refused.limit(1).collect()
        if why:
            raise ValueError(why[0]["refusal"])
        return self._publish({"research_passes": after})

    def check_health(self, posts: DataFrame, checks: DataFrame, page_size: int = 25) -> int:
        """Append the health that one page of each source shows (see :func:`ingestion.page_health`)."""
        captures = ingestion.page_health(posts, checks, page_size)
        of = captures.join(self.table("sources").select(F.col("id").alias("source_id"), F.lower("name").alias("_name")), F.lower(F.regexp_replace("source", "^r/", "")) == F.regexp_replace("_name", "^r/", ""))
        return self.record_health(of.withColumn("has_evidence_url", F.size("evidence_urls") > 0).drop("_name"))

    def save(self, notes: DataFrame) -> int:
        ready = self.table("opportunities").filter("status = 'REPORT_READY'").select(F.col("id").alias("opportunity_id"))
        self._refuse(notes.join(ready, "opportunity_id", "left_anti"), "only report-ready opportunities can be saved")
        return self._publish({"saved_opportunities": lifecycle.save_opportunities(self.table("saved_opportunities"), notes)})

    def unsave(self, opportunity_id: int) -> int:
        return self._publish({"saved_opportunities": self.table("saved_opportunities").filter(F.col("opportunity_id") != opportunity_id)})

    def search(self, **filters) -> DataFrame:
        return lifecycle.search_opportunities(*self._tables("opportunities", "research_cases", "cluster_members", "problem_observations"), **filters)

    def case_report(self) -> DataFrame:
        return lifecycle.case_report(*self._tables("research_cases", "cluster_members", "problem_observations", "evidence_spans", "research_passes", "competitors", "counter_evidence", "research_unknowns", "validation_questions"))

    def dossiers(self) -> DataFrame:
        """The whole documents of all cases."""
        return dossier.case_dossiers(self.store.tables())

    def opportunity_dossiers(self) -> DataFrame:
        return dossier.opportunity_dossiers(self.dossiers(), *self._tables("opportunities", "opportunity_types"))

    def opportunity_report(self, opportunity_id: int, **options) -> str:
        """The whole report of one opportunity as Markdown."""
        row = self.opportunity_dossiers().filter(F.col("opportunity_id") == opportunity_id).first()
        if row is None:
            raise ValueError("there is no such opportunity")
        return reports.opportunity_document(row, **options)

    def stakeholders(self) -> DataFrame:
        return lifecycle.stakeholders(self.table("case_stakeholders"))

    def saved(self, limit: int = 1000) -> DataFrame:
        return lifecycle.saved_list(*self._tables("saved_opportunities", "opportunities"), limit=limit)

    # ---- metrics, plans, costs and audits --------------------------------------------------------------------------

    def store_metrics(self, key: str) -> int:
        """Keep the metrics of all sources under a measurement key; a key that is there is replaced as a whole."""
        rows = self.source_metrics()
        current = self._known("source_metrics", ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", measurement_key string")
        return self._publish({"source_metrics": lifecycle.replace_snapshot(current, rows, "measurement_key", key)})

    def linked_outputs(self) -> DataFrame:
        return cost.linked_outputs(self.table("model_runs"), self.flagged(), *self._tables("pipeline_runs", "research_cases", "cluster_members"))

    def unit_costs(self) -> DataFrame:
        return cost.unit_costs(self.table("model_runs"))

    def dry_run(self, slots: DataFrame, per_source: int, page: int) -> DataFrame:
        return planning.dry_run(slots, per_source, page)

    def wave(self, slots: DataFrame, health: DataFrame) -> DataFrame:
        """Everything a wave is judged by, for the sources that its slots select."""
        chosen = planning.select_wave(slots, health)
        rest = {"category": F.lit(None).cast("string"), "target_items": F.lit(None).cast("long"), "policy_ready": F.lit(False), "acquisition_eligible": F.lit(False)}
        known = slots.select("slot", *(c for c in ("category", "target_items") if c in slots.columns))
        rows = chosen.join(known, "slot", "left")
        rows = rows.withColumns({c: v for c, v in rest.items() if c not in rows.columns})
        every = self.flagged()
        done = signals.in_completed_runs(every, self.table("pipeline_runs"))
        return metrics.wave_rows(rows, *self._tables("sources", "source_items"), every, done, *self._tables("workarounds", "impact_signals", "payment_signals", "discovery_runs", "discovery_records", "acquisition_records"))

    def review_export(self, selected: DataFrame, negatives: DataFrame, path: str | None = None, per_source: int = 5) -> DataFrame:
        """Rows for people to label; written in the fixed columns where a path is given."""
        rows = evaluation.review_rows(selected, *self._tables("sources", "source_items"), self.flagged(), *self._tables("evidence_spans", "payment_signals", "acquisition_records"), negatives, per_source)
        if path:
            reports.write_review(rows.withColumnsRenamed({"problem_statement": "problem", "job_context": "context", "evidence_text": "excerpt", "classification": "stratum", "providers": "provider"}), path)
        return rows

    def radar_board(self) -> str:
        tagged = radar.classified(self.table("products"))
        return reports.radar_board(radar.bucket_counts(tagged), tagged.select("seen_date", "name", F.array_join("buckets", ",").alias("buckets")))

    def source_metrics(self) -> DataFrame:
        done = signals.in_completed_runs(self.flagged(), self.table("pipeline_runs"))
        return metrics.snapshot(*self._tables("sources", "source_items"), done, *self._tables("problem_observations", "cluster_members", "discovery_runs", "discovery_records", "acquisition_records"))

    def source_performance(self, sort_by: str = "strong-signal-yield", **options) -> DataFrame:
        return metrics.ranked(self.source_metrics(), sort_by, **options)

    def budget_plan(self, **options) -> DataFrame:
        return metrics.budget_plan(self.source_metrics(), self.table("source_registry_profiles"), **options)

    def scan_plan(self, **options) -> DataFrame:
        return planning.scan_plan(*self._tables("sources", "source_registry_profiles"), **options)

    def pilot_plan(self) -> DataFrame:
        return planning.pilot_plan(*self._tables("sources", "source_registry_profiles"))

    def acquisition_cost(self) -> DataFrame:
        return cost.acquisition_cost(*self._tables("discovery_runs", "acquisition_records"))

    def model_cost(self) -> DataFrame:
        return cost.model_cost(self.table("model_runs"))

    def policy_audit(self) -> DataFrame:
        return audits.policy_audit(audits.policy_decisions(*self._tables("sources", "source_items", "discovery_runs", "evidence_spans")))

    def integrity_audit(self) -> DataFrame:
        return audits.integrity_audit(self.store.tables())

    def stats(self) -> dict[str, int]:
        return {n: t.count() for n, t in sorted(self.store.tables().items())}

    def report(self, title: str, sections: dict[str, DataFrame]) -> str:
        return sinks.report(title, sections)
