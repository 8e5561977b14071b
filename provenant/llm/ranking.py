"""Gapless numbers for rows in an order, without a window over the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import durable


def same_values(pairs: dict[str, str]) -> Column:
    """Null-safe equality of columns, by their names on either side of a join."""
    return reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(b)) for a, b in pairs.items()))


def numbered(rows: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The rows with ``position``, from 0 within each group of ``by``, and ``size``, the group's number of rows.

    Rows are dealt out by ranges of (group, order) and kept, so that every range has
    its number for good; a row's position is its place within its range plus the sizes
    of the group's ranges before.  A large group lies in many ranges; only one row a
    group and range meets in the running sums.  ``order`` should tell all rows apart:
    rows equal in it stand in any order.
    """
    by = by or []
    ranged = durable(rows.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_here"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    known = {c: f"_of_{c}" for c in [*by, "_range"]}
    totals = counts.select(*(F.col(c).alias(k) for c, k in known.items()), F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"), F.sum("_here").over(Window.partitionBy(*by)).alias("size"))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)))
    joined = placed.join(totals, same_values(known))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_place") - 1).alias("position"), "size")
