"""Resumable runs: a table of steps whose states move by compare and set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Legal moves of a step; a failed or interrupted one may begin again, a complete one never moves.
MOVES = (("NEW", "RUNNING"), ("RUNNING", "COMPLETE"), ("RUNNING", "FAILED"), ("FAILED", "RUNNING"), ("RUNNING", "RUNNING"))
STATES = "run_id string, step string, state string, detail string"


def planned(states: DataFrame, steps: DataFrame) -> DataFrame:
    """The states with the steps (``run_id, step``) that are not there yet as NEW ones."""
    new = steps.select("run_id", "step").distinct().join(states.select("run_id", "step"), ["run_id", "step"], "left_anti")
    return states.unionByName(new.select("run_id", "step", F.lit("NEW").alias("state"), F.lit(None).cast("string").alias("detail")))


def moved(states: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states after some moves (``run_id, step, expected, state, detail``), and the moves that are refused with the reason.

    A move counts only if the step is in the state that it expects and may go to the new
    one, and if no other move of the same step goes elsewhere; refused moves change nothing.
    """
    keys = ["run_id", "step"]
    asked = moves.select(*keys, "expected", F.col("state").alias("_to"), F.col("detail").alias("_detail")).distinct()
    rivals = asked.groupBy(*keys).agg(F.count("*").alias("_n"))
    judged = asked.join(states.select(*keys, F.col("state").alias("_now")), keys, "left").join(rivals, keys)
    legal = F.concat_ws(">", "expected", "_to").isin(*(f"{a}>{b}" for a, b in MOVES))
    why = (
        F.when(F.col("_now").isNull(), "there is no such step")
        .when(F.col("_n") > 1, "several moves of one step")
        .when(F.col("_now") != F.col("expected"), F.concat(F.lit("the step is "), F.col("_now")))
        .when(~legal, "no legal move")
    )
    judged = judged.withColumn("refusal", why)
    good = judged.filter("refusal is null").select(*keys, "_to", "_detail", F.lit(True).alias("_moved"))
    after = states.join(good, keys, "left").select(*keys, F.coalesce("_to", "state").alias("state"), F.when(F.col("_moved"), F.col("_detail")).otherwise(F.col("detail")).alias("detail"))
    return after, judged.filter("refusal is not null").select(*keys, "expected", F.col("_to").alias("state"), "refusal")


def open_steps(states: DataFrame, run_id: str) -> DataFrame:
    """The steps of a run that are not complete, in order."""
    return states.filter((F.col("run_id") == run_id) & (F.col("state") != "COMPLETE")).select("step", "state").orderBy("step")
