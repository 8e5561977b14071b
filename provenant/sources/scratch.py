"""Tables written once in the middle of a plan, where working them out again would cost or change something."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine (tests)."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _own = _own or f"file://{tempfile.mkdtemp(prefix='provenant-')}"
    return _own


def written(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a table of their own; at a given path, the one that is already whole there stands."""
    spark = rows.sparkSession
    path = path or f"{folder(spark)}/scratch-{uuid.uuid4().hex}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
