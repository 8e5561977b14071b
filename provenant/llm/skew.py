"""Joins on keys of which a few may hold a great share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than this share of all rows are joined by broadcast: there are fewer than its inverse.
HOT_SHARE = 0.001


def with_key(rows: DataFrame, by_key: DataFrame, keys: list[str], rows_of: str, number: int) -> DataFrame:
    """Join a table of one row a key to many rows of that key; keys that hold a great share of ``number`` rows by broadcast.

    ``rows_of`` is the column of ``by_key`` with each key's number of rows.
    """
    hot = by_key.filter(F.col(rows_of) > number * HOT_SHARE)  # fewer than 1 / HOT_SHARE keys
    few = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(few.join(by_key.filter(F.col(rows_of) <= number * HOT_SHARE), keys))
