"""Exact cost summaries; a unit cost is given only when nothing about it is unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.text import decimal_text

MONEY = "decimal(38,6)"


def unit_cost_reasons(operations: Column, costed: Column, currencies: Column, denominator: Column, name: str, more: Column | None = None) -> Column:
    """Why a unit cost is unknown; an empty array if it is known."""
    missing = operations - costed
    listed = [
        F.when(operations == 0, F.lit("no operations recorded")),
        F.when(missing == 1, F.lit("1 operation has unknown cost")).when(missing > 1, F.concat(missing.cast("string"), F.lit(" operations have unknown cost"))),
        F.when(currencies > 1, F.lit("measured costs use multiple currencies")),
        F.when(denominator == 0, F.lit(f"no {name} recorded")),
    ]
    return F.array_compact(F.array(*([more] if more is not None else []), *listed))


def unit_cost(total: Column, denominator: Column, reasons: Column) -> Column:
    """Exact cost of one unit as plain decimal text, rounded half up to 12 places; null if any reason stands against it."""
    each = total.cast("decimal(26,6)") / F.nullif(denominator, F.lit(0)).cast("decimal(11,0)")
    return F.when(F.size(reasons) == 0, decimal_text(F.round(each, 12)))


def acquisition_cost(runs: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """One row: operations, known cost as exact decimals, and cost per acquired item where it can be told."""
    operations = runs.select("cost_usd", F.lit(1).alias("d"), F.lit(0).alias("a")).unionByName(acquisitions.select("cost_usd", F.lit(0).alias("d"), F.lit(1).alias("a")))
    totals = operations.agg(
        F.count("*").alias("operation_count"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("discovery_run_count"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("acquisition_attempt_count"),
        F.count("cost_usd").alias("costed_operation_count"),
        F.coalesce(F.sum(F.col("cost_usd").cast(MONEY)), F.lit(0).cast(MONEY)).alias("_known"),
    )
    items = acquisitions.agg(F.count_distinct("source_item_id").alias("acquired_source_items"))
    out = totals.crossJoin(F.broadcast(items))  # two single rows
    why = unit_cost_reasons(F.col("operation_count"), F.col("costed_operation_count"), F.lit(1), F.col("acquired_source_items"), "acquired source items")
    return out.select(
        "operation_count",
        "discovery_run_count",
        "acquisition_attempt_count",
        "costed_operation_count",
        (F.col("operation_count") - F.col("costed_operation_count")).alias("missing_cost_operation_count"),
        "acquired_source_items",
        decimal_text(F.col("_known")).alias("known_cost_usd"),
        unit_cost(F.col("_known"), F.col("acquired_source_items"), why).alias("cost_per_item_usd"),
        F.array_join(why, "; ").alias("unit_cost_reasons"),
    )


def model_cost(model_runs: DataFrame) -> DataFrame:
    """One row per provider: counters, sums, and known cost by currency."""
    by_currency = model_runs.groupBy("provider", "currency").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "COMPLETED").alias("done"),
        F.count("pipeline_run_id").alias("linked"),
        F.sum("input_tokens").alias("input"),
        F.sum("output_tokens").alias("output"),
        F.sum("latency_ms").alias("latency"),
        F.sum("items_processed").alias("items"),
        F.sum(F.col("amount").cast(MONEY)).alias("amount"),
        F.count("amount").alias("costed"),
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("currency").isNotNull(), F.concat(F.col("currency"), F.lit("="), decimal_text(F.col("amount"))))))
    out = by_currency.groupBy("provider").agg(
        F.sum("n").alias("run_count"),
        F.sum("done").alias("completed_run_count"),
        F.sum("costed").alias("costed_run_count"),
        F.sum("linked").alias("pipeline_linked_run_count"),
        F.sum("input").alias("input_tokens"),
        F.sum("output").alias("output_tokens"),
        F.sum("latency").alias("latency_ms"),
        F.sum("items").cast("long").alias("items_processed"),
        F.array_join(listed, ",").alias("known_cost_by_currency"),
        F.count("currency").alias("_currencies"),
    )
    unlinked = F.col("run_count") - F.col("pipeline_linked_run_count")
    more = F.when(unlinked == 1, F.lit("1 model run lacks a pipeline_run_id")).when(unlinked > 1, F.concat(unlinked.cast("string"), F.lit(" model runs lack a pipeline_run_id")))
    why = unit_cost_reasons(F.col("run_count"), F.col("costed_run_count"), F.col("_currencies"), F.col("items_processed"), "processed items", more)
    return out.withColumns({"failed_run_count": F.col("run_count") - F.col("completed_run_count"), "unit_cost_reasons": F.array_join(why, "; ")}).drop("_currencies")


def unit_costs(model_runs: DataFrame, keys: tuple[str, ...] = ("provider", "currency")) -> DataFrame:
    """Cost per processed item of each group of runs: a value only where every run of the group is costed in one currency.

    The value is exact, rounded half up to 12 places; ``status`` tells whether there is one, the reasons why not.
    """
    grouped = model_runs.groupBy(*keys).agg(
        F.count("*").alias("_runs"),
        F.count("amount").alias("_costed"),
        F.count_distinct(F.when(F.col("amount").isNotNull(), F.col("currency"))).alias("_currencies"),
        F.coalesce(F.sum(F.col("amount").cast(MONEY)), F.lit(0).cast(MONEY)).alias("_total"),
        F.sum("items_processed").cast("long").alias("items"),
    )
    why = unit_cost_reasons(F.col("_runs"), F.col("_costed"), F.col("_currencies"), F.coalesce("items", F.lit(0)), "processed items")
    named = [F.col(k).alias(k) for k in keys]
    return grouped.withColumn("_why", why).select(
        *named, F.when(F.size("_why") == 0, "AVAILABLE").otherwise("UNKNOWN").alias("status"), decimal_text(F.col("_total")).alias("total"), "items",
        unit_cost(F.col("_total"), F.col("items"), F.col("_why")).alias("cost_per_item"), F.array_join("_why", "; ").alias("reasons"),
    )


def linked_outputs(model_runs: DataFrame, flagged: DataFrame, pipeline_runs: DataFrame, cases: DataFrame, members: DataFrame) -> DataFrame:
    """``provider, linked_runs, strong_signals, complete_cases``: what came of the pipeline runs that a provider's model runs belong to.

    Strong signals count in completed runs only; a case counts once however many of its observations come from them.
    """
    linked = model_runs.filter("pipeline_run_id is not null").select("provider", F.col("pipeline_run_id").alias("run")).distinct()
    done = pipeline_runs.filter("status = 'COMPLETED'").select(F.col("id").alias("run"))
    by_run = flagged.filter("strong_or_null").groupBy(F.col("pipeline_run_id").alias("run")).agg(F.count("*").alias("n")).join(done, "run", "left_semi")
    strong = linked.join(by_run, "run").groupBy("provider").agg(F.sum("n").alias("strong_signals"))
    complete = cases.filter("status = 'COMPLETE'").select(F.col("id").alias("case_id"), "cluster_id")
    of_run = members.join(complete, "cluster_id").join(flagged.select(F.col("id").alias("observation_id"), F.col("pipeline_run_id").alias("run")), "observation_id").select("run", "case_id").distinct()
    found = linked.join(of_run, "run").groupBy("provider").agg(F.count_distinct("case_id").alias("complete_cases"))
    out = model_runs.select("provider").distinct().join(linked.groupBy("provider").agg(F.count("*").alias("linked_runs")), "provider", "left").join(strong, "provider", "left").join(found, "provider", "left")
    return out.fillna(0, ["linked_runs", "strong_signals", "complete_cases"])


def token_price(input_tokens: Column, output_tokens: Column, per_million_in: str, per_million_out: str) -> Column:
    """Exact price of a call from its prices for a million tokens; null where the usage is unknown."""
    one = lambda tokens, price: tokens.cast("decimal(20,0)") * F.lit(price).cast("decimal(12,6)")
    return ((one(input_tokens, per_million_in) + one(output_tokens, per_million_out)) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,12)")
