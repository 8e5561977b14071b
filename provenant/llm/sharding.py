"""Byte-balanced sharding by Karmarkar-Karp differencing.

Rows with equal texts form an indivisible group.  Group sizes are summed by a
pre-aggregated shuffle.  Large groups are units of their own, small ones are
hashed into bundles; there are some hundred units for every shard however many
groups there are, and only their sums leave the executors.  The units are
differenced: the two partial partitions with the largest spread are joined, one
turned round, until one remains.  A table with fewer groups than bundles has
hardly two groups in one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import durable

#: Bundles of small groups for each shard; a group larger than the mean bundle is a unit of its own.
BUNDLES = 256
#: Rows of a piece of a written file that are numbered together.
PIECE_ROWS = 16_384
KEY = ["k1", "k2", "k3"]


def difference(vectors: list[list[int]]) -> list[list[int]]:
    """For every vector of k sums, the part that each of its k entries ends in.

    The largest-spread pair of partial partitions is combined, largest sum onto
    smallest, until one partition is left.
    """
    if not vectors:
        return []
    k = len(vectors[0])
    nodes: list[tuple] = []
    heap: list[tuple[int, int]] = []
    for n, vector in enumerate(vectors):
        order = sorted(range(k), key=lambda i: -vector[i])
        sums = [vector[i] for i in order]
        nodes.append((sums, [(n, i) for i in order]))
        heap.append((sums[-1] - sums[0], n))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (left, left_parts), (right, right_parts) = nodes[a], nodes[b]
        nodes[a] = nodes[b] = None  # type: ignore[call-overload]
        merged = [x + y for x, y in zip(left, reversed(right), strict=True)]
        parts = list(zip(left_parts, reversed(right_parts), strict=True))
        order = sorted(range(k), key=lambda i: -merged[i])
        sums = [merged[i] for i in order]
        heapq.heappush(heap, (sums[-1] - sums[0], len(nodes)))
        nodes.append((sums, [parts[i] for i in order]))
    out = [[0] * k for _ in vectors]
    for part, tree in enumerate(nodes[heap[0][1]][1]):
        stack = [tree]
        while stack:
            x, y = stack.pop()
            if isinstance(x, tuple):
                stack += [x, y]
            else:
                out[x][y] = part
    return out


def unit_shards(groups: DataFrame, total: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """``k1, k2, k3, shard`` of the large groups and ``bundle, shard`` of the others; ``groups`` has the column ``bundle``, null for large ones.

    Both have at most ``BUNDLES * shards`` rows.
    """
    spark = groups.sparkSession
    large = groups.filter("bundle is null").select(*KEY, "bytes").orderBy(F.desc("bytes"), *KEY).collect()  # each has more than total / (BUNDLES * shards) bytes
    bundles = groups.filter("bundle is not null").groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "bundle").collect()
    empty = [0] * (shards - 1)
    parts = difference([[int(r["bytes"]), *empty] for r in [*large, *bundles]])
    of_large = [(*(r[k] for k in KEY), p[0]) for r, p in zip(large, parts[: len(large)], strict=True)]
    of_bundles = [(r["bundle"], p[0]) for r, p in zip(bundles, parts[len(large) :], strict=True)]
    return spark.createDataFrame(of_large, "k1 long, k2 long, k3 int, hot int"), spark.createDataFrame(of_bundles, "bundle int, shard int")


def shard_documents(docs: DataFrame, *, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Deal all rows into ``shards`` shards of nearly equal bytes, equal texts together.

    Gives ``doc_id, size, text_crc32, shard, slot``; slots number the rows of a
    shard without gaps.  A null text has the size ``overhead`` alone, a null
    checksum, and is a group by itself for each id.  Repeated rows are kept, as
    one group.  A group larger than a shard's share stays whole.  Groups of equal
    size go by their hashes.  Texts of any length count by their bytes.  An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.xxhash64(F.when(text.isNotNull(), text)), F.lit(0)).alias("k1"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.xxhash64(F.col(id_col))).alias("k2"),
        F.coalesce(F.octet_length(text), F.lit(-1)).alias("k3"),
    )
    groups = base.groupBy(*KEY).agg(F.sum("size").alias("bytes"))
    units = BUNDLES * shards
    sized = durable(groups)
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bundle = F.pmod(F.xxhash64(*KEY, F.lit(7)), F.lit(units)).cast("int")
    large, bundles = unit_shards(sized.withColumn("bundle", F.when(F.col("bytes") * units <= total, bundle)), total, shards)
    known = base.withColumn("bundle", bundle).join(F.broadcast(large), KEY, "left").join(F.broadcast(bundles), "bundle", "left")  # at most BUNDLES rows a shard each
    return number_slots(known.select("doc_id", "size", "text_crc32", F.coalesce("hot", "shard").alias("shard")))


def number_slots(placed: DataFrame) -> DataFrame:
    """Number each shard's rows from 0 without a sort of whole shards.

    Rows are ranked inside each piece of a written file, and each piece starts
    where the ones before it end.
    """
    table = durable(placed)
    rows = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")).withColumn("_piece", F.expr(f"_row div {PIECE_ROWS}"))
    counts = rows.groupBy("shard", "_file", "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_file", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_file", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("shard", "_file", "_piece").orderBy("_row"))
    placed_rows = rows.withColumn("_rank", rank).join(starts, ["shard", "_file", "_piece"])
    return placed_rows.select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot"))
