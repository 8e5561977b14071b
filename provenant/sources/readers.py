"""Strict readers: explicit schemas, exact keys, and errors as rows.

A reader never infers a schema and never drops a bad line.  It gives the parsed
rows and a table of errors; :func:`require_valid` refuses the whole batch if
there is one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions import text

_PROVENANCE = "struct<origin: string, rights_status: string, source_url: string, label_method: string, reviewed_by: string, reviewed_at: string>"
_EVIDENCE = "array<struct<start: int, end: int, excerpt: string>>"
_ITEM = "external_id string, text string, url string, title string, author_external_id string, published_at string, country_code string, language_code string, metadata map<string, string>"


@dataclass(frozen=True)
class JsonSpec:
    """Keys of a JSON line: their types, which must be there and not blank, and whether all must be there."""

    ddl: str
    required: tuple[str, ...]
    exact: bool = False

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


#: Inputs by name.
SPECS = {
    "items": JsonSpec(_ITEM, ("external_id", "text")),
    "research": JsonSpec(f"source map<string, string>, item struct<{_ITEM.replace(' string', ': string').replace(' map', ': map')}>", ("source", "item")),
    "search": JsonSpec("provider string, capabilities map<string, boolean>, query string, availability string, results array<struct<url: string, title: string, snippet: string>>, latency_ms long, cost_usd double, error string, requested_items long", ("provider", "capabilities", "query", "availability")),
    "acquisition": JsonSpec("provider string, capabilities map<string, boolean>, url string, state string, completeness string, text string, title string, author_external_id string, published_at string, latency_ms long, cost_usd double, error string, metadata map<string, string>", ("provider", "capabilities", "url", "state")),
    "predictions": JsonSpec(f"source_item_id long, external_id string, is_problem boolean, problem_type string, problem_family string, evidence_scope string, problem string, fields map<string, string>, evidence {_EVIDENCE}, workarounds array<struct<type: string, description: string, evidence_index: int>>, impact_signals array<struct<type: string, quantified: boolean, value: string, unit: string, frequency: string, evidence_index: int>>, payment_signals array<struct<type: string, amount: string, currency: string, frequency: string, evidence_index: int>>", ("source_item_id", "external_id", "is_problem")),
    "health": JsonSpec("source string, provider string, checked_at string, access_result string, http_status int, latest_visible_item_at string, visible_item_count int, sample_window_start string, sample_window_end string, coverage_complete boolean, reason string, evidence_urls array<string>, latency_ms int, cost_usd double", ("source", "provider", "checked_at", "access_result", "visible_item_count", "coverage_complete", "reason", "evidence_urls"), exact=True),
    "detection": JsonSpec(f"id string, text string, is_problem boolean, problem_type string, problem_family string, evidence_scope string, problem string, fields map<string, string>, evidence {_EVIDENCE}, provenance {_PROVENANCE}", ("id", "text", "is_problem", "provenance")),
    "clustering": JsonSpec(f"id string, problem_type string, problem string, fields map<string, string>, expected_cluster string, provenance {_PROVENANCE}", ("id", "problem_type", "problem", "expected_cluster", "provenance")),
    "competition": JsonSpec(f"id string, evidence_urls array<string>, solutions array<struct<name: string, solution_type: string, url: string>>, provenance {_PROVENANCE}", ("id", "solutions")),
    "transfer": JsonSpec(f"id string, evidence_urls array<string>, actor_equivalence string, workflow_equivalence string, transfer_type string, local_evidence_state string, provenance {_PROVENANCE}", ("id", "actor_equivalence", "workflow_equivalence", "transfer_type", "local_evidence_state")),
}


# The fields of an observation, texts and flags.
TEXT_FIELDS = (
    "actor", "actor_role", "industry", "job_to_be_done", "context", "root_cause", "current_workaround", "tools_used", "frequency", "time_impact", "financial_impact", "revenue_impact", "error_impact", "delay_impact", "risk_impact", "existing_solution",
    "existing_spend", "paid_workaround", "country_code", "language_code", "pipeline_run_id",
)
FLAG_FIELDS = ("active_solution_search", "switching_intent")


def field_problem(raw: Column, texts: tuple[str, ...], flags: tuple[str, ...] = ()) -> Column:
    """What is wrong with an object of fields: unknown names, or values of another type than theirs; null if nothing is."""
    fields = F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>")
    unknown = F.array_sort(F.filter(F.map_keys(fields), lambda k: ~k.isin(*texts, *flags)))
    odd = lambda names, kind: F.array_sort(F.map_keys(F.map_filter(fields, lambda k, v: k.isin(*names) & ~F.schema_of_variant(v).isin(kind, "VOID"))))
    bad = F.concat(odd(texts, "STRING"), odd(flags, "BOOLEAN") if flags else F.array().cast("array<string>"))
    return F.when(raw.isNotNull() & fields.isNull(), "fields must be an object").when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))).when(F.size(bad) > 0, F.concat(F.lit("fields of a wrong type: "), F.array_join(bad, ", ")))


def raw_value(name: str) -> Column:
    """A key's value as JSON text; null where it is absent or null."""
    return F.nullif(F.to_json(F.try_variant_get(F.try_parse_json("line"), f"$.{name}", "variant")), F.lit("null"))


@dataclass(frozen=True)
class Parsed:
    rows: DataFrame
    errors: DataFrame


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines (``line``) with their file and their number in it, from 1; blank lines count.

    A large file is read in many splits, of which none knows what stands before it.  So the
    lines of each split are counted first, the counts are summed up in the order of the
    splits, and a line's number is its place in its split plus the lines before.  Both
    passes read one listing with one plan, so the places agree.  What is joined to the lines
    is one row a split.
    """
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = raw.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as splits
    starts = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    known = raw.join(starts, ["file", "_block"]).select("line", "file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("number"))
    return known.filter(F.trim("line") != "")


def parse_json_lines(lines: DataFrame, spec: JsonSpec, more: Callable[[], list[Column]] | None = None) -> Parsed:
    """Parse ``line, file`` and, where it is known, ``number``; unknown, missing and blank keys and unparsable values are errors.

    An error tells the file, the line and its number (null if that is not known).  ``more``
    gives further problems, as columns over ``_v`` (the values) and ``line``.
    """
    schema = spec.schema
    names = F.array(*(F.lit(f.name) for f in schema.fields))
    keys = F.json_object_keys("line")
    value = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    unknown, absent = F.array_except(keys, names), F.array_except(names, keys)
    blank = []
    for name in spec.required:
        field = F.col(f"_v.{name}")
        kind = schema[name].dataType
        empty = field.isNull() | (F.trim(field) == "") if isinstance(kind, T.StringType) else field.isNull()
        blank.append(F.when(empty, F.lit(f"{name} is missing or blank")))
    problems = F.when(keys.isNull(), F.array(F.lit("not a JSON object"))).otherwise(
        F.array_compact(F.array(F.when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(unknown), ","))), F.when(F.lit(spec.exact) & (F.size(absent) > 0), F.concat(F.lit("missing keys: "), F.array_join(F.array_sort(absent), ","))), *blank, *(more() if more else [])))
    )
    judged = lines.withColumn("_v", value).withColumn("_problems", problems)
    rows = judged.filter(F.size("_problems") == 0).select("_v.*")
    number = F.col("number") if "number" in lines.columns else F.lit(None)
    errors = judged.filter(F.size("_problems") > 0).select("file", "line", F.array_join("_problems", "; ").alias("problem"), number.cast("long").alias("number"))
    return Parsed(rows, errors)


def read_json(spark: SparkSession, path: str, kind: str) -> Parsed:
    """Read one of :data:`SPECS`."""
    typed = (lambda: [field_problem(raw_value("fields"), TEXT_FIELDS, FLAG_FIELDS)]) if kind == "predictions" else None
    return parse_json_lines(read_lines(spark, path), SPECS[kind], typed)


def require_valid(parsed: Parsed) -> DataFrame:
    """The rows, or an error that names the first bad lines as ``path:line``; nothing of a bad batch goes on."""
    bad = parsed.errors.orderBy("file", "number").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['file']}{'' if r['number'] is None else f':{r['number']}'}: {r['problem']}" for r in bad))
    return parsed.rows


def duplicates(rows: DataFrame, *keys: Column) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).count().filter("count > 1")


def read_csv(spark: SparkSession, path: str, exact: tuple[str, ...] | None = None) -> DataFrame:
    """A CSV of strings with a header, byte-order mark stripped; ``exact`` demands these columns in this order."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)
    rows = raw.toDF(*(c.lstrip("\ufeff").strip() for c in raw.columns))
    if exact is not None and tuple(rows.columns) != exact:
        raise ValueError(f"expected columns {', '.join(exact)}")
    return rows


WAVE_COLUMNS = ("slot", "category", "primary", "backup", "target_items")
MANIFEST_COLUMNS = ("subreddit", "category", "target_group", "pilot_item_target", "selection_reason", "activity_state", "access_state")
NAME_COLUMNS = ("subreddit", "name", "community")


def read_wave_slots(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, WAVE_COLUMNS).withColumns({"slot": F.col("slot").cast("long"), "target_items": F.col("target_items").cast("long")})


def read_live_manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, MANIFEST_COLUMNS)
    if not duplicates(rows, F.lower("subreddit").alias("k")).isEmpty():
        raise ValueError("a manifest names a community once")
    return rows


# What a registry's flag and relevance may say.
SCAN = {"JA": True, "JA_LIGHT": True, "NEIN": False, "NEIN_BIS_GEPRUEFT": False, "NUR_SEKUNDAER": False}
RELEVANCE = ("CORE", "PILOT", "SECONDARY", "DROP", "RECHECK_ACCESS")


def parse_registry(spark: SparkSession, path: str) -> Parsed:
    """Registry rows (see :func:`read_registry`), and an error for every empty name, unknown flag or relevance, and bad size.

    An error's number is that of the row, as if every record took one line after the header.
    """
    rows = read_csv(spark, path)
    lower = {c.lower(): c for c in rows.columns}
    name = next((lower[n] for n in NAME_COLUMNS if n in lower), None)
    if name is None:
        raise ValueError("a registry needs a subreddit, name or community column")
    col = lambda n: F.nullif(F.trim(F.col(f"`{lower[n]}`")), F.lit("")) if n in lower else F.lit(None).cast("string")
    known = {"audience_type", "scan_now", "pilot_posts", "strict_pilot_posts", "strict_relevance", "zielgruppe", "kategorie", name.lower()}
    rest = [c for c in rows.columns if c.lower() not in known]
    flag, relevance = F.upper(col("scan_now")), F.upper(col("strict_relevance"))
    sizes = {n: col(n) for n in ("pilot_posts", "strict_pilot_posts")}
    said = lambda n: F.concat(F.lit(f"{n} has unsupported value '"), col(n), F.lit("'"))
    problems = [
        F.when(F.coalesce(F.trim(F.col(f"`{name}`")), F.lit("")) == "", "the name is empty"),
        F.when(flag.isNotNull() & ~flag.isin(*SCAN), said("scan_now")),
        *(F.when(v.isNotNull() & ~v.rlike(r"^[+-]?\d+$"), F.lit(f"{n} must be an integer")).when(v.rlike("^-0*[1-9]"), F.lit(f"{n} must not be negative")) for n, v in sizes.items()),
        F.when(relevance.isNotNull() & ~relevance.isin(*RELEVANCE), said("strict_relevance")),
    ]
    at = rows.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id(), "_why": F.array_compact(F.array(*problems))})
    first = at.groupBy(F.col("_file").alias("_f")).agg(F.min("_at").alias("_first"))  # a registry file is read whole by one task
    errors = at.filter(F.size("_why") > 0).join(first, F.col("_file") == F.col("_f")).select(F.col("_file").alias("file"), F.col(f"`{name}`").alias("line"), F.array_join("_why", "; ").alias("problem"), (F.col("_at") - F.col("_first") + 2).alias("number"))
    whole = lambda v: F.regexp_replace(v, "^[+]", "").try_cast("long")
    parsed = at.filter(F.size("_why") == 0).select(
        F.regexp_replace(F.trim(F.col(f"`{name}`")), "^[rR]/", "").alias("name"),
        F.coalesce(col("audience_type"), text.audience(F.coalesce(col("zielgruppe"), F.lit("")))).alias("audience_type"),
        text.professions(F.coalesce(col("zielgruppe"), F.lit(""))).alias("professions"),
        col("kategorie").alias("primary_industry"),
        F.when(flag.isin(*(k for k, v in SCAN.items() if v)), True).when(flag.isin(*(k for k, v in SCAN.items() if not v)), False).alias("scan_now"),
        relevance.alias("strict_relevance"),
        *(whole(v).alias(n) for n, v in sizes.items()),
        (F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest)), {"ignoreNullFields": "false"}) if rest else F.lit("{}")).alias("metadata_json"),
    )
    return Parsed(parsed, errors)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows: name, audience type, professions, scan flag and pilot sizes; every other column is kept as JSON.

    A flag, size or relevance that is not known refuses the file, with the row's number.
    """
    return require_valid(parse_registry(spark, path))


def replay_search(captures: DataFrame, queries: DataFrame) -> DataFrame:
    """Recorded answers of exact queries; a query without one is unavailable.

    A file holds the answers of one provider, and a query once.
    """
    if "provider" in captures.columns and len(captures.select("provider").distinct().limit(2).collect()) > 1:
        raise ValueError("a capture holds the answers of one provider")
    if not duplicates(captures, "query").isEmpty():
        raise ValueError("a capture answers a query once")
    out = queries.join(captures, "query", "left")
    return out.withColumn("availability", F.coalesce("availability", F.lit("SOURCE_UNAVAILABLE")))


def replay_acquisition(captures: DataFrame, urls: DataFrame) -> DataFrame:
    """Recorded contents by canonical URL; a URL without one has failed.

    Of several captures of a URL the last stands, that of the largest ``line`` (a number);
    without that column the order is not known, so a URL may be captured only once.
    """
    keyed = captures.withColumn("canonical_url", F.coalesce(text.post_identity(F.col("url"))["canonical"], text.normalize_url(F.col("url")))).drop("url")
    fields = [c for c in keyed.columns if c not in ("canonical_url", "line")]
    if "line" not in keyed.columns and not duplicates(keyed, "canonical_url").isEmpty():
        raise ValueError("a URL is captured twice, and no line tells which capture is the last")
    turn = F.col("line") if "line" in keyed.columns else F.lit(0)
    keyed = keyed.withColumn("_turn", turn).groupBy("canonical_url").agg(F.max_by(F.struct(*fields), "_turn").alias("_last")).select("canonical_url", "_last.*")
    return urls.join(keyed, "canonical_url", "left").withColumn("state", F.coalesce("state", F.lit("ACQUISITION_FAILED")))


ARCHIVE_POST = "permalink string, url string, id string, title string, selftext string, is_self boolean, author string, created_utc double, removed_by_category string, retrieved_on double"


def archive_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of archive pages ``{data: [...]}`` with removal state, completeness and missing fields."""
    pages = spark.read.schema(f"data array<struct<{', '.join(f'{n}: {t}' for n, t in (p.split(' ') for p in ARCHIVE_POST.split(', ')))}>>").json(path, multiLine=True)
    rows = pages.select(F.explode("data").alias("p")).select("p.*")
    return normalized_posts(rows)


def normalized_posts(rows: DataFrame) -> DataFrame:
    body = F.trim(F.coalesce("selftext", F.lit("")))
    removed = F.col("removed_by_category").isNotNull() | F.lower(body).isin("[removed]", "[deleted]")
    state = F.when(F.lower(body) == "[deleted]", "DELETED").when(removed, "REMOVED")
    full = ~removed & (body != "") & F.col("title").isNotNull()
    identity = text.post_identity(F.when(F.col("permalink").startswith("/"), F.concat(F.lit("https://www.reddit.com"), F.col("permalink"))).otherwise(F.coalesce("permalink", "url")))
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("title", "author", "created_utc"))))
    return rows.select(
        identity.alias("identity"), "title", body.alias("body"), "author", F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        state.alias("removal_state"), F.when(full, "FULL").when(~removed & F.col("title").isNotNull(), "PARTIAL").otherwise("METADATA_ONLY").alias("completeness"), missing.alias("missing_fields"),
    )


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: id, link, title, author, time and own text."""
    schema = "id string, link struct<_href: string>, title string, author struct<name: string>, published string, updated string, content struct<_VALUE: string>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    own = F.regexp_extract("content._VALUE", r"(?s)<!-- SC_OFF -->(.*?)<!-- SC_ON -->", 1)
    return rows.select("id", F.col("link._href").alias("url"), "title", F.regexp_replace("author.name", "^/u/", "").alias("author"), F.coalesce("published", "updated").alias("published_at"), text.html_text(own).alias("text"))


def readiness_suites(spark: SparkSession, path: str) -> DataFrame:
    """Suites and their gates, one row per required minimum."""
    schema = "version string, suites array<struct<name: string, kind: string, fixture: string, predictions: string, minimum_coverage: map<string, double>, minimum_metrics: map<string, double>>>"
    suites = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("suites").alias("s")).select("s.*")
    gates = [suites.select("name", "kind", F.lit(k).alias("gate"), F.explode(f"minimum_{k}").alias("metric", "minimum")) for k in ("coverage", "metrics")]
    return reduce(DataFrame.unionByName, gates)


def select_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored items of an id list, by id."""
    return items.join(ids, "id", "left_semi").orderBy("id")


def select_health_sources(sources: DataFrame, *, name: str | None = None, manifest: DataFrame | None = None, relevance: DataFrame | None = None) -> DataFrame:
    """Sources to check: exactly one of a name, a manifest of names, or profiles of a relevance; unknown names are refused."""
    if sum(x is not None for x in (name, manifest, relevance)) != 1:
        raise ValueError("choose exactly one of name, manifest and relevance")
    known = sources.select("id", "name")
    if relevance is not None:
        return known.join(relevance.select(F.col("source_id").alias("id")), "id", "left_semi")
    asked = sources.sparkSession.createDataFrame([(name,)], "asked string") if manifest is None else manifest.select(F.col("subreddit").alias("asked"))
    unknown = asked.join(known, F.lower("asked") == F.lower("name"), "left_anti").limit(5).collect()
    if unknown:
        raise ValueError("unregistered sources: " + ", ".join(r["asked"] for r in unknown))
    return known.join(asked, F.lower("name") == F.lower("asked"), "left_semi")


def query_manifest(spark: SparkSession, path: str, most: int = 5) -> DataFrame:
    """Sources of a provider query manifest: one to five distinct names with their query ids."""
    rows = spark.read.schema("sources array<struct<name: string, query_id: string>>").json(path, multiLine=True).select(F.explode("sources").alias("s")).select("s.*")
    found = rows.limit(most + 1).collect()
    names = {(r["name"] or "").strip().lower() for r in found}
    if not 1 <= len(found) <= most or len(names) != len(found) or "" in names:
        raise ValueError(f"a query manifest names 1 to {most} distinct sources")
    return rows


def launch_products(spark: SparkSession, path: str) -> DataFrame:
    """Products of a launch feed: key, name, tagline, URL and day."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, link struct<_href: string>, published string, content struct<_VALUE: string>").load(path)
    return rows.select(F.concat(F.lit("launch:"), "id").alias("key"), F.col("title").alias("name"), text.html_text(F.col("content._VALUE")).alias("tagline"), F.col("link._href").alias("url"), F.substring("published", 1, 10).alias("seen_date"))


def story_products(spark: SparkSession, path: str) -> DataFrame:
    """Products of a story search page: the part of a title after the colon names and describes them."""
    rows = spark.read.schema("hits array<struct<objectID: string, title: string, url: string, created_at: string>>").json(path, multiLine=True).select(F.explode("hits").alias("h")).select("h.*")
    shown = F.regexp_replace("title", r"(?i)^show hn:\s*", "")
    return rows.select(F.concat(F.lit("story:"), "objectID").alias("key"), F.trim(F.regexp_extract(shown, r"^(.*?)(?:\s+[–-]\s+.*)?$", 1)).alias("name"), F.nullif(F.trim(F.regexp_extract(shown, r"\s+[–-]\s+(.*)$", 1)), F.lit("")).alias("tagline"), "url", F.substring("created_at", 1, 10).alias("seen_date"))


def baseline_ids(*tables: DataFrame) -> DataFrame:
    """External ids of other stores, each once, folded for comparison."""
    return reduce(DataFrame.unionByName, (t.select(text.identifier(F.col("external_id")).alias("external_id")) for t in tables)).distinct()


def health_capture(spark: SparkSession, path: str) -> Parsed:
    """A health capture: exact keys, and each source once."""
    parsed = read_json(spark, path, "health")
    again = duplicates(parsed.rows, F.lower("source").alias("source")).select(F.lit(path).alias("file"), F.col("source").alias("line"), F.lit("a source is captured once").alias("problem"), F.lit(None).cast("long").alias("number"))
    return Parsed(parsed.rows, parsed.errors.unionByName(again))
