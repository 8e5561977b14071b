"""Quality measures from counts: no pairs are ever listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """A quotient that is 0 where nothing is counted."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def with_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def confusion(rows: DataFrame) -> DataFrame:
    """Counts and scores of boolean ``gold`` and ``predicted``."""
    g, p = F.col("gold"), F.col("predicted")
    return with_scores(rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")))


def set_quality(rows: DataFrame) -> DataFrame:
    """Counts and scores of array-valued ``gold`` and ``predicted``."""
    both = F.size(F.array_intersect("gold", "predicted"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return with_scores(rows.agg(total(both).alias("tp"), total(F.size("predicted") - both).alias("fp"), total(F.size("gold") - both).alias("fn")))


def keyed(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and scores of keyed records, by a full join."""
    both = gold.withColumn("_g", F.lit(1)).join(predicted.withColumn("_p", F.lit(1)), keys, "full_outer")
    g, p = F.col("_g").isNotNull(), F.col("_p").isNotNull()
    return with_scores(both.agg(F.count_if(g & p).alias("tp"), F.count_if(~g).alias("fp"), F.count_if(~p).alias("fn")))


def pairwise(rows: DataFrame) -> DataFrame:
    """Pair counts and scores of two groupings, from the sizes of their cells."""
    cells = rows.groupBy("gold", "predicted").agg(F.count("*").alias("k"))
    pairs = lambda c: F.coalesce(F.sum(F.expr(f"cast({c} as decimal(38,0)) * ({c} - 1) / 2")), F.lit(0)).cast("decimal(38,0)")
    by_cell = cells.agg(pairs("k").alias("tp"), F.coalesce(F.sum("k"), F.lit(0)).cast("decimal(38,0)").alias("n"))
    by_gold = cells.groupBy("gold").agg(F.sum("k").alias("k")).agg(pairs("k").alias("gp"))
    by_guess = cells.groupBy("predicted").agg(F.sum("k").alias("k")).agg(pairs("k").alias("pp"))
    one = by_cell.crossJoin(F.broadcast(by_gold)).crossJoin(F.broadcast(by_guess))  # three single rows
    tp, gp, pp, n = (F.col(c) for c in ("tp", "gp", "pp", "n"))
    whole = lambda c: c.cast("long")
    out = one.select(whole(tp).alias("tp"), whole(pp - tp).alias("fp"), whole(gp - tp).alias("fn"), whole(F.expr("cast(n * (n - 1) / 2 as decimal(38,0))") - pp - gp + tp).alias("tn"))
    return with_scores(out)


def accuracy(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    return rows.agg(*(F.avg(c.cast("int")).alias(n) for n, c in checks.items()))


def gates(measured: DataFrame, minima: dict[str, float]) -> DataFrame:
    """One row per gate: required minimum, measured value, and whether it passes."""
    known = [c for c in measured.columns if c in minima]
    values = measured.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in known))).alias("m")).select("m.*")
    asked = measured.sparkSession.createDataFrame(list(minima.items()), "metric string, minimum double")
    return asked.join(values, "metric", "left").withColumn("passed", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False)))


def review_sample(outcomes: DataFrame, positives: int = 30, negatives: int = 25) -> DataFrame:
    """The first observations by ``ordering``, then negatives in the order of the SHA-256 of their external id (of the item's, if that is unknown)."""
    key = F.sha2(F.coalesce(F.col("external_id"), F.col("source_item_id").cast("string")), 256)
    found = outcomes.filter("status = 'OBSERVATION'").orderBy("ordering").limit(positives)
    return found.unionByName(outcomes.filter("status = 'NO_PAIN'").orderBy(key, "ordering").limit(negatives))


def review_rows(selected: DataFrame, sources: DataFrame, items: DataFrame, flagged: DataFrame, spans: DataFrame, payments: DataFrame, acquisitions: DataFrame, negatives: DataFrame, per_source: int = 5) -> DataFrame:
    """Rows to be labelled by people: for each selected source the strongest fully acquired observations, then items without a pain.

    ``selected`` holds ``source``; ``negatives`` the ``source_item_id`` of predictions that
    found nothing.  Every row names its providers; of several spans and payments the
    first is shown.  No label is filled in.
    """
    full = acquisitions.filter("completeness = 'FULL'").groupBy("source_item_id").agg(F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))
    of = items.select(F.col("id").alias("source_item_id"), "source_id", "raw_text").join(sources.select(F.col("id").alias("source_id"), "name"), "source_id")
    own = of.join(selected.select(F.lower("source").alias("_k"), "source").distinct(), F.lower("name") == F.col("_k")).join(full, "source_item_id")
    first_span = spans.groupBy("observation_id").agg(F.min_by("excerpt", "id").alias("evidence_text"))
    with_span = payments.join(spans.select(F.col("id").alias("evidence_span_id"), "excerpt"), "evidence_span_id")
    first_payment = with_span.groupBy("observation_id").agg(F.min_by(F.concat("payment_type", F.lit(": "), "excerpt"), "id").alias("payment_signal"))
    strong = F.coalesce("strong_or_null", F.lit(False))
    seen = flagged.select(F.col("id").alias("observation_id"), "source_item_id", F.col("problem").alias("problem_statement"), F.coalesce("actor", "actor_role").alias("actor"), F.col("context").alias("job_context"), F.col("current_workaround").alias("workaround"), "time_impact", "active_solution_search", F.when(strong, "STRONG_POSITIVE").otherwise("WEAK_POSITIVE").alias("classification"))
    rows = own.join(seen, "source_item_id").join(first_span, "observation_id", "left").join(first_payment, "observation_id", "left").withColumn("active_solution_search", F.coalesce("active_solution_search", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("classification"), "observation_id"))  # STRONG before WEAK
    shown = ["source", "classification", "place", "source_item_id", "observation_id", "problem_statement", "actor", "job_context", "workaround", "time_impact", "active_solution_search", "payment_signal", "evidence_text", "providers"]
    positive = rows.withColumn("place", place).filter(F.col("place") <= per_source).select(*shown)
    nothing = own.join(negatives.select("source_item_id").distinct(), "source_item_id", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("source_item_id"))).filter(F.col("place") <= per_source)
    blank = {c: F.lit(None).cast(positive.schema[c].dataType) for c in shown if c not in nothing.columns} | {"classification": F.lit("NO_PAIN"), "active_solution_search": F.lit(False)}
    return positive.unionByName(nothing.withColumns(blank).select(*shown))


def field_exactness(gold: DataFrame, predicted: DataFrame, fields: list[str], key: str = "case_id") -> DataFrame:
    """``field, compared, exact, exactness`` over cases that both tables hold; two unknown values are equal."""
    both = gold.select(key, *(F.col(f).alias(f"g_{f}") for f in fields)).join(predicted.select(key, *(F.col(f).alias(f"p_{f}") for f in fields)), key)
    counted = both.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"g_{f}").eqNullSafe(F.col(f"p_{f}"))).alias(f"e_{f}") for f in fields))
    listed = F.array(*(F.struct(F.lit(f).alias("field"), F.col("n").alias("compared"), F.col(f"e_{f}").alias("exact")) for f in fields))
    return counted.select(F.inline(listed)).withColumn("exactness", ratio(F.col("exact"), F.col("compared")))


def suite_gates(coverage: DataFrame, measured: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every gate of every suite with its measured value: ``suite, gate, metric, minimum, value, passed``.

    ``wanted`` holds ``suite, gate, metric, minimum`` (see :func:`readers.readiness_suites`),
    ``coverage`` and ``measured`` hold ``suite, metric, value``.  A gate without a value fails.
    """
    found = coverage.withColumn("gate", F.lit("coverage")).unionByName(measured.withColumn("gate", F.lit("metrics")))
    out = wanted.join(found, ["suite", "gate", "metric"], "left")
    return out.select("suite", "gate", "metric", "minimum", "value", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False)).alias("passed"))


def suites_ready(gates_of: DataFrame) -> DataFrame:
    """``suite, gates, failed, ready``."""
    return gates_of.groupBy("suite").agg(F.count("*").alias("gates"), F.count_if(~F.col("passed")).alias("failed")).withColumn("ready", F.col("failed") == 0)


def provenance(cases: DataFrame) -> DataFrame:
    """One row of counts of ``origin, rights_status, review_status`` (and how many are fit for release)."""
    real, free, seen = F.col("origin") == "REAL", F.col("rights_status") == "APPROVED", F.col("review_status") == "REVIEWED"
    return cases.agg(F.count("*").alias("cases"), F.count_if(real).alias("real"), F.count_if(~real).alias("synthetic"), F.count_if(free).alias("rights_approved"), F.count_if(seen).alias("reviewed"), F.count_if(real & free & seen).alias("releasable"))
