"""Scan, pilot and wave plans over the small dimension tables of sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Curation bands in their order, actions that mean ready, and pilot sizes used where none is given.
BANDS = ("S", "A", "B", "C", "R", "X")
READY_ACTIONS = ("SCAN_PILOT_NOW", "SCAN_SMALL_PILOT")
PILOT_SIZES = {"CORE": 50, "PILOT": 25}


def scan_plan(sources: DataFrame, profiles: DataFrame, priorities: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Sources to scan now, by band, industry and name; production ready means exactly approved."""
    rows = profiles.filter("scan_now").join(sources.select(F.col("id").alias("source_id"), "name", "lifecycle", "commercial_use_status"), "source_id").filter("lifecycle <> 'EXCLUDED'")
    if priorities:
        rows = rows.filter(F.col("curation_priority").isin(*[p.strip().upper() for p in priorities]))
    band = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(b) for b in BANDS)), F.col("curation_priority")), F.lit(0)), F.lit(len(BANDS) + 1))
    out = rows.select(
        "source_id", "name", "primary_industry", "curation_priority", F.coalesce("strict_pilot_posts", "pilot_posts").alias("pilot_posts"),
        F.coalesce(F.col("commercial_use_status") == "APPROVED", F.lit(False)).alias("production_ready"),
        F.row_number().over(Window.orderBy(band, F.col("primary_industry").asc_nulls_first(), F.lower("name"), "source_id")).alias("position"),
    )
    return out if limit is None else out.filter(F.col("position") <= limit)


def pilot_plan(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """Core and pilot sources in plan order; an explicit size of zero stands, and conflicts with a ready source."""
    rows = profiles.filter(F.col("strict_relevance").isin(*PILOT_SIZES)).join(sources.select(F.col("id").alias("source_id"), "name", "lifecycle"), "source_id").filter("lifecycle <> 'EXCLUDED'")
    stated = F.coalesce("strict_pilot_posts", "pilot_posts")
    size = F.coalesce(stated, F.when(F.col("strict_relevance") == "CORE", PILOT_SIZES["CORE"]).otherwise(PILOT_SIZES["PILOT"])).cast("long")
    ready = F.coalesce(F.col("recommended_action").isin(*READY_ACTIONS), F.lit(False))
    order = Window.orderBy(F.when(F.col("strict_relevance") == "CORE", 0).otherwise(1), F.when(ready, 0).otherwise(1), F.lower(F.coalesce("primary_industry", F.lit(""))), F.lower("name"), "source_id")
    return rows.select(
        F.row_number().over(order).alias("ordering"), "source_id", F.col("name").alias("source_name"), F.col("primary_industry").alias("category"), "strict_relevance", ready.alias("ready"), size.alias("pilot_size"),
        (ready & stated.isNotNull() & (stated == 0)).alias("conflict"),
    )


def round_robin(plan: DataFrame, most: int) -> DataFrame:
    """Ready core sources without conflict, one category after another."""
    rows = plan.filter((F.col("strict_relevance") == "CORE") & F.col("ready") & ~F.coalesce("conflict", F.lit(False)) & (F.col("pilot_size") > 0)).withColumn("category", F.coalesce("category", F.lit("Uncategorized")))
    turn = F.row_number().over(Window.partitionBy("category").orderBy("ordering"))
    rows = rows.withColumn("turn", turn)
    return rows.withColumn("position", F.row_number().over(Window.orderBy("turn", "category"))).filter(F.col("position") <= most).select("position", "source_id", "source_name", "category")


def latest_health(checks: DataFrame) -> DataFrame:
    """The newest health row of each source, the larger id among equals."""
    newest = F.max_by(F.struct("id", "status", "checked_at"), F.struct("checked_at", "id")).alias("h")
    return checks.groupBy("source_id").agg(newest).select("source_id", "h.id", "h.status", "h.checked_at")


def select_wave(slots: DataFrame, health: DataFrame) -> DataFrame:
    """Primary or backup per slot, each source used once; slots follow each other, so the few of them go to one task.

    ``slots`` holds ``slot, primary_name, backup_name``; ``health`` ``name, status`` and,
    where it is known, ``policy_ready``.  Only an active source with a ready policy is
    ``acquisition_eligible``.
    """
    # The labels of a selection.
    known = health.select(F.lower("name").alias("k"), "status")
    rows = slots.join(known.withColumnsRenamed({"k": "pk", "status": "primary_status"}), F.lower("primary_name") == F.col("pk"), "left").join(known.withColumnsRenamed({"k": "bk", "status": "backup_status"}), F.lower("backup_name") == F.col("bk"), "left")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for slot, primary, backup, ps, bs in pdf.sort_values("slot")[["slot", "primary_name", "backup_name", "primary_status", "backup_status"]].itertuples(index=False):
            ps, bs = ps or "UNKNOWN", bs or "UNKNOWN"
            free = {n: n.casefold() not in used for n in (primary, backup)}
            options = ((ps == "ACTIVE" and free[primary], primary, ps, "PRIMARY_ACTIVE"), (bs == "ACTIVE" and free[backup], backup, bs, "REPLACED_WITH_ACTIVE_BACKUP"), (ps == "UNKNOWN" and free[primary], primary, ps, "NEEDS_HEALTH_CHECK"), (bs == "UNKNOWN" and free[backup], backup, bs, "NEEDS_BACKUP_HEALTH_CHECK"))
            _, name, status, how = next((o for o in options if o[0]), (True, primary, ps, "BLOCKED_NO_HEALTHY_REPLACEMENT"))
            if how != "BLOCKED_NO_HEALTHY_REPLACEMENT":
                used.add(name.casefold())
            out.append((slot, name, status, how))
        return pd.DataFrame(out, columns=["slot", "source", "health_status", "selection_status"])

    shaped = rows.select("slot", "primary_name", "backup_name", F.coalesce("primary_status", F.lit("UNKNOWN")).alias("primary_status"), F.coalesce("backup_status", F.lit("UNKNOWN")).alias("backup_status"), F.lit(0).alias("_all"))
    chosen = shaped.groupBy("_all").applyInPandas(choose, "slot long, source string, health_status string, selection_status string")
    if "policy_ready" not in health.columns:
        return chosen
    policy = health.select(F.lower("name").alias("_k"), "policy_ready")
    out = chosen.join(policy, F.lower("source") == F.col("_k"), "left").drop("_k").withColumn("policy_ready", F.coalesce("policy_ready", F.lit(False)))
    return out.withColumn("acquisition_eligible", (F.col("health_status") == "ACTIVE") & F.col("policy_ready"))


def top_per_source(rows: DataFrame, order: list, most: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("source_id").orderBy(*order))).filter(F.col("rn") <= most)


def dry_run(manifest: DataFrame, per_source: int, page: int) -> DataFrame:
    """Estimated requests: two passes over the pages of each source."""
    return manifest.withColumn("estimated_requests", (F.lit(2) * F.ceil(F.least(F.col("target_items"), F.lit(per_source)) / F.lit(page))).cast("long"))
