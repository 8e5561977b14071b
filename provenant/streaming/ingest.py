"""Streaming ingestion: JSON lines arrive as files and are merged by completeness.

Of equally rich texts the first stands; full texts that differ from it are
counted, batch after batch.  A batch that comes again changes nothing: the store
remembers the last one.  Only the buckets of items that a batch names are
rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provenant.functions.text import identifier
from provenant.operators.ingestion import attested
from provenant.operators.lifecycle import merge_content, merge_records
from provenant.sources.readers import SPECS, parse_json_lines
from provenant.sources.store import SnapshotStore

CONTENT = "item_id string, arrival long, completeness string, raw_text string"
BUCKETS = 64


def merge_batch(store: SnapshotStore, arrivals: DataFrame, number: int | None = None) -> int:
    """Merge ``item_id, arrival, completeness, raw_text`` into the content table; a numbered batch only once.

    Where arrivals also hold ``provider, metadata_json``, the table keeps the merged metadata
    with a record of every conflict (see :func:`lifecycle.merge_records`).
    """
    known = store.manifest()
    if number is not None and "content_batches" in known and store.read("content_batches").first()[0] >= number:
        return store.versions()[-1]
    told = {"provider", "metadata_json"} <= set(arrivals.columns)
    rows = arrivals.select("item_id", "arrival", "completeness", "raw_text", *(["provider", "metadata_json"] if told else [])).distinct()
    asked, held = store.touched("content", rows, "item_id", BUCKETS)
    if told:
        merged = merge_records(rows if held is None else rows.unionByName(held.withColumn("provider", F.lit(None).cast("string")).select(*rows.columns)))
    elif held is None:
        merged = merge_content(rows)
    else:
        before = held.select("item_id", F.col("conflicts").alias("_held"))
        merged = merge_content(rows.unionByName(held.select(*rows.columns))).join(before, "item_id", "left")
        merged = merged.withColumn("conflicts", F.col("conflicts") + F.coalesce("_held", F.lit(0))).drop("_held")
    changes = {"content": merged}
    if number is not None:
        changes["content_batches"] = arrivals.sparkSession.createDataFrame([(number,)], "last long")
    return store.publish(changes, buckets={"content": ("item_id", BUCKETS, asked)})


def ingest_items(spark: SparkSession, folder: str, store: SnapshotStore, checkpoint: str) -> StreamingQuery:
    """Watch a folder of item files; a batch with a bad line is refused as a whole.

    An item is full only where its metadata attest it: ``completeness`` FULL,
    ``body_complete`` true, and a ``retrieved_at`` with a zone.  Without them a text is
    partial.
    """
    lines = spark.readStream.format("text").load(folder).select(F.col("value").alias("line"), F.lit(folder).alias("file")).filter(F.trim("line") != "")

    def one(batch: DataFrame, number: int) -> None:
        parsed = parse_json_lines(batch, SPECS["items"])
        if not parsed.errors.isEmpty():
            raise ValueError("a batch with a bad line is refused")
        order = F.lit(number).cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("external_id", "text"), F.lit(1 << 40))
        said = F.col("metadata")
        whole = (said["completeness"] == "FULL") & attested(F.lower(said["body_complete"]) == "true", said["retrieved_at"])
        claimed = F.when(F.coalesce(whole, F.lit(False)), "FULL").when(said["completeness"] == "METADATA_ONLY", "METADATA_ONLY").otherwise("PARTIAL")
        merge_batch(store, parsed.rows.select(identifier(F.col("external_id")).alias("item_id"), order.alias("arrival"), claimed.alias("completeness"), F.col("text").alias("raw_text")), number)

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and sums by window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
