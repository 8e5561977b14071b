"""Near copies among embeddings by an epsilon grid order join.

Vectors of length one are turned to their principal axes.  They are sorted by the cells of a grid,
as wide as the greatest distance of a link, over the leading axes; the sorted
sequence is cut into blocks, and blocks into ever larger intervals.  A pair of
intervals whose boxes are provably farther apart than that distance is skipped, any
other is split until pairs of blocks remain, which are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .columnar import bounded_batches
from .graph import components
from .ranking import numbered
from .skew import with_key
from .storage import durable

THRESHOLD = 0.95
#: Leading axes of the grid and the boxes, vectors of a block, blocks (or intervals) of the next larger interval.
AXES, BLOCK_ROWS, FANOUT = 8, 512, 8
#: Blocks that are compared as a group, and blocks of other groups that one task compares with it; a group with more partners is given to several tasks.
GROUP_BLOCKS, PARTNERS = 16, 256
#: Cosines within this distance of the threshold are worked out again from the vectors themselves.
MARGIN = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, shorter ones padded with zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by their lengths, without overflow on the way."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int, most: int = AXES) -> np.ndarray:
    """The leading eigenvectors of the scatter of all directions; dims² sums come to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims))
        for batch in batches:
            x = unit(matrix(batch.column(0), dims))
            total[:dims] += x.T @ x
            total[dims] += x.sum(axis=0)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total.ravel()[place])], names=["place", "value"])

    total = np.zeros((dims + 1) * dims)
    for r in vectors.select("vector").mapInArrow(sums, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        total[r["place"]] = r["value"]
    total = total.reshape(dims + 1, dims)
    number = max(1.0, float(np.trace(total[:dims])))  # each direction has length one
    mean = total[dims] / number
    _, axes = np.linalg.eigh(total[:dims] / number - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, :most])


def coordinates(distinct: DataFrame, axes: np.ndarray) -> DataFrame:
    """``k1, k2`` and the coordinates ``p0, p1, …`` of the directions on the leading axes."""
    dims, leading = axes.shape
    names = ["k1", "k2", *(f"p{i}" for i in range(leading))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = unit(matrix(batch.column(2), dims)) @ axes
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(at[:, i]) for i in range(leading))], names=names)

    return distinct.select("k1", "k2", "vector").mapInArrow(run, "k1 long, k2 long, " + ", ".join(f"p{i} double" for i in range(leading)))


def apart(one: str, other: str, leading: int) -> Column:
    """Squared distance of two boxes ``lo…, hi…``, whose columns carry a prefix."""
    gaps = (F.greatest(F.col(f"{one}lo{i}") - F.col(f"{other}hi{i}"), F.col(f"{other}lo{i}") - F.col(f"{one}hi{i}"), F.lit(0.0)) for i in range(leading))
    return sum((g * g for g in gaps), F.lit(0.0))


def _prefixed(table: DataFrame, prefix: str) -> DataFrame:
    return table.toDF(*(f"{prefix}{c}" for c in table.columns))


def block_pairs(boxes: DataFrame, leading: int, reach: float, fanout: int = FANOUT) -> DataFrame:
    """Pairs ``a <= b`` of blocks whose boxes lie within reach, found from the whole sequence downward.

    ``boxes`` holds ``block, lo…, hi…``.  Intervals of ``fanout`` blocks, of ``fanout``
    such intervals and so on have boxes of their own; each level's pairs are the pairs
    of children of the level above that are not provably distant.
    """
    near = _near(reach)
    corners = [f"{side}{i}" for i in range(leading) for side in ("lo", "hi")]
    levels = [boxes]
    while levels[-1].agg(F.max("block")).first()[0]:
        up = levels[-1].groupBy(F.floor(F.col("block") / fanout).alias("block"))
        levels.append(durable(up.agg(*(F.min(c).alias(c) if c[:2] == "lo" else F.max(c).alias(c) for c in corners))))
    pairs = levels[-1].select(F.col("block").alias("a"), F.col("block").alias("b"))
    for boxes_here in reversed(levels[:-1]):
        children = boxes_here.withColumn("up", F.floor(F.col("block") / fanout))
        left, right = _prefixed(children, "l_"), _prefixed(children, "r_")
        met = pairs.join(left, F.col("a") == F.col("l_up")).join(right, F.col("b") == F.col("r_up"))
        pairs = durable(met.filter((F.col("l_block") <= F.col("r_block")) & (apart("l_", "r_", leading) <= near)).select(F.col("l_block").alias("a"), F.col("r_block").alias("b")))
    return pairs


_FOUND = pa.schema([("position", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two matrices of directions have at least the threshold's cosine."""
    cosines = a @ b.T
    close = np.argwhere(np.abs(cosines - threshold) < MARGIN)
    for i, j in close:  # summation order must not decide
        cosines[i, j] = math.fsum((a[i] * b[j]).tolist())
    return cosines >= threshold


def _roots(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of both sides that have links, the least node of their part of a bipartite graph."""
    first, second = a.copy(), b.copy()
    most = np.iinfo(np.int64).max
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    part = linked[np.ix_(rows, columns)]
    left, right = first[rows], second[columns]
    while len(rows):
        low_left = np.minimum(left, np.where(part, right[None, :], most).min(axis=1))
        low_right = np.minimum(right, np.where(part, low_left[:, None], most).min(axis=0))
        if (low_left == left).all() and (low_right == right).all():
            break
        left, right = low_left, low_right
    first[rows], second[columns] = left, right
    return first, second


class _Unit:
    """A group of blocks and the counts of its links, while the vectors of other groups stream past."""

    def __init__(self, batches: list[pa.RecordBatch], axes: np.ndarray, reach: float, block_rows: int, threshold: float) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        self.axes, self.near, self.threshold = axes, _near(reach), threshold
        self.positions, self.copies = table["position"].to_numpy(), table["copies"].to_numpy()
        self.vectors = unit(matrix(table["vector"].combine_chunks(), len(axes)))
        self.links = np.zeros(len(self.positions), dtype=np.int64)
        at = self.vectors @ axes
        cuts = np.flatnonzero(np.append(True, np.diff(self.positions // block_rows) != 0))
        self.blocks = [slice(i, j) for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(at)).tolist(), strict=True)]
        self.low, self.high = (np.stack([f(at[b], axis=0) for b in self.blocks]) for f in (np.min, np.max))
        self.forest: list[tuple[np.ndarray, np.ndarray]] = []

    def within(self) -> None:
        """Links between and within the group's own blocks."""
        for i, one in enumerate(self.blocks):
            for j in range(i, len(self.blocks)):
                gaps = np.maximum(np.maximum(self.low[i] - self.high[j], self.low[j] - self.high[i]), 0)
                if gaps @ gaps > self.near:
                    continue
                other = self.blocks[j]
                linked = _linked(self.vectors[one], self.vectors[other], self.threshold)
                if i == j:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                self.links[one] += linked @ self.copies[other]
                if i != j:
                    self.links[other] += self.copies[one] @ linked
                self._join(linked, self.positions[one], self.positions[other])

    def _join(self, linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        for positions, roots in zip((a, b), _roots(linked, a, b), strict=True):
            moved = positions != roots
            self.forest.append((positions[moved], roots[moved]))

    def meet(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Links with some rows of another group: those rows' counts, and a forest of the links."""
        positions, copies = batch.column("position").to_numpy(), batch.column("copies").to_numpy()
        vectors = unit(matrix(batch.column("vector"), len(self.axes)))
        at = vectors @ self.axes
        counts = np.zeros(len(positions), dtype=np.int64)
        for low, high, block in zip(self.low, self.high, self.blocks, strict=True):
            gaps = np.maximum(np.maximum(low - at, at - high), 0)
            close = np.flatnonzero((gaps * gaps).sum(axis=1) <= self.near)
            if not len(close):
                continue
            linked = _linked(self.vectors[block], vectors[close], self.threshold)
            if linked.any():
                self.links[block] += linked @ copies[close]
                counts[close] += self.copies[block] @ linked
                self._join(linked, self.positions[block], positions[close])
        touched = counts > 0
        return _found(positions[touched], positions[touched], counts[touched], self._edges())

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        edges, self.forest = self.forest, []
        return tuple(np.concatenate([e[i] for e in edges]) if edges else np.zeros(0, np.int64) for i in (0, 1))

    def end(self) -> pa.RecordBatch:
        live = self.links > 0
        return _found(self.positions[live], self.positions[live], self.links[live], self._edges())


def _found(positions: np.ndarray, roots: np.ndarray, links: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Counts of rows, and edges of a forest with no counts of their own."""
    columns = (np.append(positions, edges[0]), np.append(roots, edges[1]), np.append(links, np.zeros(len(edges[0]), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_FOUND)


def _compare(batches: Iterator[pa.RecordBatch], made: Callable[[list[pa.RecordBatch]], _Unit]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, chunk, guest, position, copies, vector), sorted: a group's own rows, then those of others, some hundred at a time."""
    held: list[pa.RecordBatch] = []
    at, group = None, None

    def begin() -> _Unit:
        out = made(held)
        if at[1] == 0:
            out.within()
        return out

    for whole in batches:
        for first in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(first, BLOCK_ROWS)
            state = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero(np.append(True, (state[1:] != state[:-1]).any(axis=1)))
            for start, stop in zip(cuts, np.append(cuts[1:], len(state)), strict=True):
                part, key, guest = batch.slice(start, stop - start), tuple(state[start][:2]), bool(state[start][2])
                if key != at:
                    if held or group:
                        yield (group or begin()).end()
                    at, held, group = key, [], None
                if not guest:
                    held.append(part)
                    continue
                if group is None and held:
                    group, held = begin(), []
                if group is not None:
                    yield group.meet(part)
    if held or group:
        yield (group or begin()).end()


def _near(reach: float) -> float:
    """The square of the reach, with room for rounding."""
    return reach * reach * (1 + 1e-9) + 1e-12


def compare_blocks(placed: DataFrame, pairs: DataFrame, boxes: DataFrame, axes: np.ndarray, reach: float, threshold: float, block_rows: int) -> DataFrame:
    """``position, root, links``: links found in the pairs of blocks, added up for each vector, with a forest that connects what is linked.

    Blocks are compared in groups of :data:`GROUP_BLOCKS`.  Of two groups either may be the
    anchor, so early and late ones have as much to do; an anchor with many partners is
    dealt to several tasks.  A vector of another group goes to the anchor once, and only
    if it lies within reach of the box of one of the anchor's blocks.
    """
    leading = axes.shape[1]
    groups = pairs.select(F.floor(F.col("a") / GROUP_BLOCKS).alias("ga"), F.floor(F.col("b") / GROUP_BLOCKS).alias("gb"), "a", "b")
    swap = (F.col("ga") + F.col("gb")) % 2 == 1
    turn = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    across = groups.filter("ga <> gb").select(turn("ga", "gb", "anchor"), turn("a", "b", "block_of_anchor"), turn("b", "a", "other"))
    corners = across.join(_prefixed(boxes, "x_"), F.col("block_of_anchor") == F.col("x_block"))
    near_boxes = corners.groupBy("anchor", "other").agg(F.collect_list(F.struct(*(f"x_{side}{i}" for i in range(leading) for side in ("lo", "hi")))).alias("boxes"))  # at most as many as a group has blocks
    partners = across.groupBy(F.col("anchor").alias("n_anchor")).agg(F.ceil(F.count_distinct("other") / PARTNERS).alias("chunks"))
    dealt = durable(near_boxes.join(partners, F.col("anchor") == F.col("n_anchor")).select("anchor", "other", "boxes", F.pmod(F.xxhash64("other"), F.col("chunks")).cast("long").alias("chunk")))
    columns = ["position", "copies", "vector"]
    grouped = placed.withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
    units = dealt.filter("chunk > 0").select("anchor", "chunk").distinct()
    hosts = grouped.select(F.col("group").alias("anchor"), F.lit(0).cast("long").alias("chunk"), F.lit(False).alias("guest"), *columns)  # every group has a chunk 0, in which its own blocks are compared
    more = grouped.join(units, F.col("group") == F.col("anchor")).select("anchor", "chunk", F.lit(False).alias("guest"), *columns)
    in_reach = F.exists("boxes", lambda x: sum((_squared(F.greatest(x[f"x_lo{i}"] - F.col(f"p{i}"), F.col(f"p{i}") - x[f"x_hi{i}"], F.lit(0.0))) for i in range(leading)), F.lit(0.0)) <= _near(reach))
    guests = placed.join(dealt, F.col("block") == F.col("other")).filter(in_reach).select("anchor", "chunk", F.lit(True).alias("guest"), *columns)
    rows = hosts.unionByName(more).unionByName(guests).repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", "guest", "position")

    def made(batches: list[pa.RecordBatch]) -> _Unit:
        return _Unit(batches, axes, reach, block_rows, threshold)

    return rows.mapInArrow(lambda batches: _compare(batches, made), "position long, root long, links long")


def _squared(x: Column) -> Column:
    return x * x


def near_copies(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    ``n_links`` is the number of other rows whose cosine with the row's vector, in
    doubles, is ``threshold`` (above 0) or more; ``component_id`` the least id that such
    links reach; ``kept`` whether it is the row's own.  Equal vectors are compared once
    and count as often as they occur.  Null vectors, zero and empty ones, and those with
    a null or non-finite component have no links and are components of their own, and
    stay.  Shorter vectors count as padded with zeros.  Repeated ids are rows of their
    own, so more than one may be kept; a component without any id has a null one, and
    its rows are kept.  Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema[vector_col].dataType
    x = F.col(vector_col) if kind == ArrayType(FloatType(), kind.containsNull) else F.col(vector_col).cast("array<double>")
    keyed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(x), x).alias("vector")).withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(7), F.col("vector"))})
    live = keyed.filter(F.col("vector").isNotNull())
    alone = keyed.filter(F.col("vector").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    distinct = durable(live.groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    number, different, dims = distinct.agg(F.sum("copies"), F.count("*"), F.max(F.size("vector"))).first()
    if not number:
        return alone
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7  # the distance of two directions with this cosine
    axes = principal_axes(distinct, dims, min(AXES, dims))
    leading = axes.shape[1]
    names = [f"p{i}" for i in range(leading)]
    order = [*(F.floor(F.col(c) / F.lit(reach)) for c in names), *(F.col(c) for c in names), F.col("k1"), F.col("k2")]
    located = numbered(durable(coordinates(distinct, axes)), order).withColumn("block", F.floor(F.col("position") / block_rows)).drop("size")
    placed = durable(located.join(distinct, ["k1", "k2"]))
    boxes = durable(placed.groupBy("block").agg(*(f(c).alias(f"{side}{i}") for i, c in enumerate(names) for side, f in (("lo", F.min), ("hi", F.max)))))
    pairs = block_pairs(boxes, leading, reach)
    found = durable(compare_blocks(placed, pairs, boxes, axes, reach, threshold, block_rows))
    roots = components(found.filter("position <> root").select(F.col("position").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("position"), "root")
    counted = found.groupBy("position").agg(F.sum("links").alias("links"))
    nodes = placed.select("k1", "k2", "position", "copies", "least").join(roots, "position", "left").join(counted, "position", "left").withColumn("root", F.coalesce("root", "position"))
    nodes = durable(nodes)
    called = durable(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    known = durable(with_key(nodes, called, ["root"], "members", different).select("k1", "k2", "copies", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    judged = with_key(live.select("vec_id", "k1", "k2"), known, ["k1", "k2"], "copies", number)
    return judged.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)
