"""Set similarity join of word shingles by chosen paths.

Sets are embedded by 128 minwise hashes.  A run samples a few of them and sends
a set down one path for each sampled value; sets on one path form a bucket.
Small buckets are compared by brute force; larger ones are split again on newly
sampled values, after their members have been compared with a leader that
absorbs its near copies.
Runs are repeated until a pair at the threshold is met with the target recall.
What meets is grouped, and within groups every pair is verified exactly on the
shingles, in blocks; links are counted there, never written pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columnar import bounded_batches, hashed_words, mix, plainly, shingles, slices, text_array
from .graph import components
from .skew import with_key
from .storage import durable

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.99
HASHES = 128
#: Estimated similarity from which two sets are compared exactly, and from which a leader absorbs a set.
NEAR, SAME = 0.68, 0.92
#: Buckets up to so many sets are compared pair by pair; larger ones are split.
BUCKET = 1024
MOST_LEVELS = 12
#: Sets and shingles of a block of exact comparison.
BLOCK_SETS, BLOCK_SHINGLES = 256, 2_000_000
#: Tables of up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20

_FACTORS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).astype(np.uint32)


def run_count(threshold: float = THRESHOLD, recall: float = RECALL, levels: int = 2) -> int:
    """Runs that let a pair at the threshold meet with the given probability."""
    once = 1 - (1 - threshold / (threshold * HASHES)) ** HASHES
    meet = once**levels
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def sampled(seed: int, threshold: float = THRESHOLD) -> np.ndarray:
    """The hashes that a path samples: each with probability 1 / (threshold * HASHES), one at least."""
    with np.errstate(over="ignore"):
        draws = mix(np.arange(HASHES, dtype=np.uint64) + np.uint64(seed & (2**64 - 1)) * np.uint64(0xD6E8FEB86659FD93))
    chosen = np.flatnonzero(draws < np.uint64(int(2**64 / (threshold * HASHES))))
    return chosen if len(chosen) else np.array([int(draws.argmin())])


def minhashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES minwise hashes of each non-empty set of shingles, in blocks that stay in cache."""
    small = (values >> np.uint64(32)).astype(np.uint32)
    n = len(offsets) - 1
    out = np.zeros((n, HASHES), dtype=np.uint32)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 65_536, side="right")) - 1)
        stop = min(stop, n)
        block, starts = small[offsets[at] : offsets[stop]], offsets[at:stop] - offsets[at]
        buffer = np.empty_like(block)
        for i, factor in enumerate(_FACTORS):
            np.multiply(block, factor, out=buffer)
            out[at:stop, i] = np.minimum.reduceat(buffer, starts)
        at = stop
    return out


def first_keys(mins: np.ndarray, threshold: float, runs: int) -> np.ndarray:
    """Keys of the first level: one column for each hash that some run samples."""
    chosen = [(run, int(i)) for run in range(runs) for i in sampled(run + 1, threshold)]
    return np.stack([mix((np.uint64(run * HASHES + i + 1) << np.uint64(32)) | mins[:, i].astype(np.uint64)) for run, i in chosen], axis=1).astype(np.int64)


def unique_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[keep], minlength=len(offsets) - 1)
    return values[keep], np.concatenate([[0], np.cumsum(counts)])


SIGNATURES = "doc_id long, row_key binary, k1 long, k2 long, n long, sketch binary, keys array<long>"


def signatures(rows: DataFrame, threshold: float, runs: int) -> DataFrame:
    """Set keys, sketches and first keys of (doc_id, row_key, text) rows; sets without shingles have null keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                values, offsets = unique_sets(*shingles(*hashed_words(text_array(part.column(2))), WIDTH))
                counts = np.diff(offsets)
                live = np.flatnonzero(counts)
                starts = offsets[live]
                mins = minhashes(values, np.append(starts, offsets[-1])) if len(live) else np.zeros((0, HASHES), np.uint32)
                k1 = np.add.reduceat(values, starts).astype(np.int64) if len(live) else np.zeros(0, np.int64)
                k2 = np.add.reduceat(mix(values + np.uint64(0x51ED27)), starts).astype(np.int64) if len(live) else np.zeros(0, np.int64)
                keys = first_keys(mins, threshold, runs)
                place = np.full(part.num_rows, -1)
                place[live] = np.arange(len(live))
                index = pa.array(place, mask=place < 0)
                sketch = (mins & np.uint32(255)).astype(np.uint8)
                cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES), len(live), [None, pa.py_buffer(np.ascontiguousarray(sketch))]).cast(pa.binary())
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
                columns = [part.column(0), part.column(1), *(pa.array(k).take(index) for k in (k1, k2)), pa.array(counts), cells.take(index), lists.take(index)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "k1", "k2", "n", "sketch", "keys"])

    return rows.mapInArrow(run, SIGNATURES)


def estimate(sketches: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarity of each sketch to another one, corrected for chance matches of 8-bit values."""
    return (np.count_nonzero(sketches == other, axis=-1) / HASHES - 1 / 256) / (1 - 1 / 256)


def meet(sketches: np.ndarray) -> list[tuple[int, int]]:
    """Candidate links of one small bucket by brute force: a forest over its positions."""
    links: list[tuple[int, int]] = []
    for i in range(len(sketches) - 1):
        links += [(i, i + 1 + j) for j in np.flatnonzero(estimate(sketches[i + 1 :], sketches[i]) >= NEAR).tolist()]
    return forest(links)


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of the buckets of (key, id, sketch) batches sorted by key; the last bucket of a batch waits."""
    held: list[pa.RecordBatch] = []

    def links_of(rows: pa.Table) -> pa.RecordBatch:
        keys, ids = rows["key"].to_numpy(), rows["id"].to_numpy()
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(cuts[1:], len(keys))
        many = ends - cuts > 1
        sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=np.uint8).reshape(len(keys), HASHES)
        found: list[tuple[int, int]] = []
        for a, b in zip(cuts[many].tolist(), ends[many].tolist(), strict=True):
            found += [(a + x, a + y) for x, y in meet(sketches[order[a:b]])]
        return pa.RecordBatch.from_arrays([pa.array(ids[[x for x, _ in found]] if found else [], pa.int64()), pa.array(ids[[y for _, y in found]] if found else [], pa.int64())], schema=_EDGES)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        first = int(np.searchsorted(keys, keys[-1]))
        if held and (first or held[-1].column(0)[-1].as_py() != keys[0]):
            if held[-1].column(0)[-1].as_py() == keys[0]:
                same = int(np.searchsorted(keys, keys[0], side="right"))
                held.append(batch.slice(0, same))
                batch, first = batch.slice(same), first - same
            yield links_of(pa.Table.from_batches(held))
            held = []
        if first:
            yield links_of(pa.Table.from_batches([batch.slice(0, first)]))
        held.append(batch.slice(first))
    if held:
        yield links_of(pa.Table.from_batches(held))


def checked(table: DataFrame, row_bytes: int) -> DataFrame:
    """The table, to be broadcast if its rows, of about so many bytes each, are few enough; a larger one is joined by shuffle."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def candidate_links(sets: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between sets that met in some bucket; ``sets`` holds ``id, sketch, keys``."""
    rows = sets.select("id", "sketch", F.explode("keys").alias("key"))
    small, out = [], []
    for level in range(MOST_LEVELS + 1):
        sizes = durable(rows.groupBy("key").agg(F.count("*").alias("c"), F.min_by("id", F.xxhash64("id", F.lit(level))).alias("leader")).filter(F.col("c") > BUCKET).select("key", "leader"))
        if sizes.isEmpty():
            small.append(rows.select("key", "id", "sketch"))
            break
        huge = checked(sizes, 48)
        small.append(rows.join(huge, "key", "left_anti").select("key", "id", "sketch"))
        members = durable(rows.join(huge, "key").select("key", "id", "sketch", "leader"))
        leaders = checked(durable(members.filter("id = leader").select("key", F.col("sketch").alias("leader_sketch"))), 256)
        led = members.join(leaders, "key").select("key", "id", "sketch", "leader", "leader_sketch")
        last = level == MOST_LEVELS

        def compare(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, lead = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in (2, 4))
                near = estimate(own, lead)
                splits: list = [None] * batch.num_rows
                keys = batch.column(0).to_numpy().astype(np.uint64)
                for key in np.unique(keys):
                    rows_of = np.flatnonzero(keys == key)
                    chosen = sampled(int(key) ^ level, threshold)
                    path = mix(np.uint64(key) + np.uint64(level + 1) * np.uint64(0xD6E8FEB86659FD93) + chosen.astype(np.uint64) * np.uint64(257))
                    following = mix(path[None, :] + own[rows_of][:, chosen].astype(np.uint64)).astype(np.int64)
                    for at, found in zip(rows_of.tolist(), following, strict=True):
                        splits[at] = found
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(near, pa.float64()), pa.array(splits, pa.list_(pa.int64()))], names=["id", "sketch", "leader", "near", "next"])

        judged = durable(led.mapInArrow(compare, "id long, sketch binary, leader long, near double, next array<long>"))
        met = judged if last else judged.filter(F.col("near") >= NEAR)
        out.append(met.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")))
        if last:  # what is still together is compared exactly, in blocks
            break
        rows = judged.filter(F.col("near") < SAME).select("id", "sketch", F.explode("next").alias("key"))
    buckets = reduce(DataFrame.unionByName, small).repartition("key").sortWithinPartitions("key")  # of all levels at once: their keys differ
    return reduce(DataFrame.unionByName, out, buckets.mapInArrow(_bucket_links, "a long, b long"))


_VERIFIED = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def intersections(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all pairwise intersections of n sets, from (token, owner) pairs, a few thousand tokens at a time."""
    known, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    rank = np.cumsum(times > 1) - 1
    column, row = rank[place[shared]], owner[shared]
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    step = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [first, first + step])
        block = np.zeros((n, step), dtype=np.float32)
        block[row[a:b], column[a:b] - first] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _verify_block(table: pa.Table, threshold: float) -> pa.Table:
    """Exact links between the sets of a pair of blocks (or within one block)."""
    n = table.num_rows
    if n < 2:
        return pa.table([pa.array([], pa.int64())] * 3, schema=_VERIFIED)
    ids, copies, side = table["id"].to_numpy(), table["copies"].to_numpy(), table["block"].to_numpy()
    shingle_lists = table["shingles"].combine_chunks()
    sizes = np.diff(shingle_lists.offsets.to_numpy().astype(np.int64))
    both = intersections(shingle_lists.flatten().to_numpy(), np.repeat(np.arange(n), sizes), n)
    union = sizes[:, None] + sizes[None, :] - both
    linked = both >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    first, second = table["one"][0].as_py(), table["two"][0].as_py()
    if first != second:
        linked &= side[:, None] != side[None, :]
    links = (linked * copies[None, :]).sum(axis=1)
    root = ids.copy()
    while True:  # least id reachable
        low = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(root, low)
        if (new == root).all():
            break
        root = new
    return pa.table([pa.array(ids), pa.array(root), pa.array(links)], schema=_VERIFIED)


def verify(groups: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``id, root, links`` for every set of a group and every pair of its blocks.

    ``groups`` holds ``id, root, n, copies, row_key``; ``texts`` the ``row_key`` and text of rows.
    """
    stats = groups.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = durable(groups.join(stats, "root").select("id", "root", "copies", "row_key", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")))
    rows = texts.join(checked(placed, 96), "row_key").dropDuplicates(["id"]).select("id", "root", "copies", "block", "blocks", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 5):
                values, offsets = unique_sets(*shingles(*hashed_words(text_array(part.column(5))), WIDTH))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), lists], names=["id", "root", "copies", "block", "blocks", "shingles"])

    sets = rows.mapInArrow(to_sets, "id long, root long, copies long, block int, blocks int, shingles array<long>")
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("id", "root", "copies", "block", "shingles", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    return paired.groupBy("root", "one", "two").applyInArrow(lambda t: _verify_block(t, threshold), "id long, root long, links long")


def row_key(id_column: Column, text: Column) -> Column:
    """128 bits of a row's id and text."""
    known = F.concat(F.coalesce(id_column.cast("string"), F.lit("-")), F.when(text.isNull(), F.lit("|-")).otherwise(F.concat(F.lit("|+"), text)))
    return F.unhex(F.md5(known))


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row_key, text``; rows with equal ids and texts share a key."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col).cast("long"), text).alias("row_key"), text.alias("text"))


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, row_key, class_id, class_key, links``.

    ``links`` is the number of other rows whose set of five-word shingles has a
    Jaccard similarity of ``threshold`` or more; ``class_id`` is the least id of all
    rows that such links connect.  Where ids are repeated or null, several classes may have
    one ``class_id``; ``class_key``, the least digest of an id and its text, names a class
    for sure.  Texts of fewer words are one shingle; null texts
    and texts without words have no links and are a class each, named by their own
    id.  Repeated rows are copies of each other.  Null ids stay null and name a
    class only if it has no other id.  Other columns are ignored; an empty table
    gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = row_keys(docs, id_col, text_col)
    signed = durable(signatures(rows, threshold, run_count(threshold, recall)))
    live = signed.filter("n > 0")
    sets = durable(
        live.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")).withColumn("id", F.monotonically_increasing_id())
    )  # written, so that every set keeps its number
    met = durable(candidate_links(sets.select("id", "sketch", "keys"), threshold))
    grouped = components(met).select(F.col("node").alias("id"), "root")
    groups = sets.select("id", "n", "copies", "row_key").join(grouped, "id")
    exact = durable(verify(groups, rows, threshold))
    roots = components(exact.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "root")
    counted = exact.groupBy("id").agg(F.sum("links").alias("near"))
    named = sets.select("id", "k1", "k2", "copies", "least", "row_key").join(roots, "id", "left").join(counted, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = durable(named)
    classes = durable(named.groupBy("root").agg(F.min("least").alias("class_id"), F.min("row_key").alias("class_key"), F.count("*").alias("members")))
    different, number = sets.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    links = (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")
    known = durable(with_key(named.drop("row_key"), classes, ["root"], "members", different).select("k1", "k2", "copies", "class_id", "class_key", links))
    columns = ["doc_id", "row_key", "class_id", "class_key", "links"]
    with_set = with_key(signed.filter("n > 0").select("doc_id", "row_key", "k1", "k2"), known, ["k1", "k2"], "copies", number).select(*columns)
    without = signed.filter("n = 0").select("doc_id", "row_key", F.col("doc_id").alias("class_id"), F.col("row_key").alias("class_key"), F.lit(0).cast("long").alias("links"))
    return with_set.unionByName(without)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` with one row of each class: that of the least id (and row key).

    A null id comes after all others; one id with several texts is as many documents, each
    with its own class.  Null texts and texts without words are a
    class each and stay; repeated rows give one; texts of any length count whole;
    an empty table gives no rows; all columns stay, whatever their names.
    """
    judged = durable(jaccard_classes(docs, id_col=id_col, text_col=text_col, threshold=threshold, recall=recall))
    linked = judged.filter("links > 0")
    first = durable(linked.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("f"), F.count("*").alias("rows")).select(F.col("f.row_key").alias("_kept"), "class_key", "rows"))
    losers = durable(with_key(linked.select("row_key", "class_key"), first, ["class_key"], "rows", linked.count()).filter("row_key <> _kept").select("row_key").distinct())
    twice = durable(linked.groupBy("row_key").count().filter("count > 1").select("row_key"))
    ident, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))

    def kept(rows: DataFrame) -> DataFrame:
        left = rows.withColumn("row_key", row_key(ident.cast("long"), text.cast("string"))).join(checked(losers, 64), "row_key", "left_anti")
        repeated = checked(twice, 64)
        single = left.join(repeated, "row_key", "left_anti")
        return single.unionByName(left.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"])).drop("row_key")

    return plainly(docs, kept)
