"""Exact top-k inner product search over a bit-sliced index.

A block of integer vectors is stored as bit slices: one bitmap over the rows
for every bit of every component.  A query's score is a weighted sum of
slices; it is added up for all rows of the block at once with carry-save adders
on the bitmaps.  The best rows are then found from the most significant score
slice downward, and rows tied at the boundary are resolved by id.
"""

from __future__ import annotations

import decimal
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import durable

BLOCK_ROWS = 16_384
#: Integers below this are kept in 64 bits; vectors with larger ones as integers of any size.
WIDE = 1 << 52
#: Scores are ranked as decimals of so many digits, and given as the nearest 64-bit number.
DIGITS = 38

_OUT = "query_id long, query_row long, vec_id long, row long, score decimal(38,0)"
_ARROW = pa.schema([*((n, pa.int64()) for n in ("query_id", "query_row", "vec_id", "row")), ("score", pa.decimal128(DIGITS, 0))])


def signed_digits(value: int) -> list[tuple[int, int]]:
    """The non-adjacent form of an integer: (position, -1 or 1), few digits."""
    out, at = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((at, digit))
            value -= digit
        value >>= 1
        at += 1
    return out


class BitSlicedIndex:
    """Bit slices of a block of integer vectors, rows in the order of their ids."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = np.ascontiguousarray(vectors, dtype=vectors.dtype if vectors.dtype == object else np.int64)
        self.rows, self.dims = vectors.shape
        self.words = max(1, -(-self.rows // 64))
        self.low = int(self.vectors.min()) if vectors.size else 0
        shifted = (self.vectors - self.low).T
        bits = max(1, int(shifted.max()).bit_length()) if vectors.size else 1
        self.slices = np.stack([self._bitmaps((shifted >> s) & 1) for s in range(bits)])
        self.valid = self._bitmaps(np.ones((1, self.rows), dtype=np.int64))[0]

    def _bitmaps(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits), self.words * 8), dtype=np.uint8)
        packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of each row's score plus a constant of the query."""
        adding: dict[int, list[int]] = {}
        taking: dict[int, list[int]] = {}
        for dim, value in enumerate(query.tolist()):
            for at, digit in signed_digits(value):
                (adding if digit > 0 else taking).setdefault(at, []).append(dim)
        stacks: dict[int, list[np.ndarray]] = {}
        for s, planes in enumerate(self.slices):
            for at, dims in adding.items():
                stacks.setdefault(at + s, []).append(planes[dims])
            for at, dims in taking.items():  # minus x is the complement of x less a constant
                stacks.setdefault(at + s, []).append(~planes[dims])
        out: list[np.ndarray] = []
        weight, top = 0, max(stacks, default=-1)
        while weight <= top:
            planes = stacks.pop(weight, None)
            stack = np.concatenate(planes) if planes else np.zeros((1, self.words), dtype=np.uint64)
            while len(stack) > 1:
                third = len(stack) // 3
                if third:
                    a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                    half = a ^ b
                    carry = (a & b) | (half & c)
                    total = half ^ c
                else:
                    third, total, carry = 0, stack[:1] ^ stack[1:], stack[:1] & stack[1:]
                    stack = stack[:0]
                stacks.setdefault(weight + 1, []).append(carry)
                top = max(top, weight + 1)
                stack = np.concatenate([total, stack[3 * third :]])
            out.append(stack[0])
            weight += 1
        return out

    def top(self, query: np.ndarray, k: int, without: int | None = None) -> np.ndarray:
        """Positions of the k best rows, ties to the smaller position; ``without`` takes no part."""
        open_rows = self.valid.copy()
        if without is not None:
            open_rows[without >> 6] &= ~np.uint64(1 << (without & 63))
        taken = np.zeros_like(open_rows)
        have = 0
        for plane in reversed(self.score_slices(query)):
            high = open_rows & plane
            count = have + int(np.bitwise_count(high).sum())
            if count > k:
                open_rows = high
            else:
                taken |= high
                have = count
                open_rows = open_rows & ~plane
                if count == k:
                    break
        sure = np.flatnonzero(np.unpackbits(taken.view(np.uint8), bitorder="little")[: self.rows])
        if have < k:
            tied = np.flatnonzero(np.unpackbits(open_rows.view(np.uint8), bitorder="little")[: self.rows])
            sure = np.concatenate([sure, tied[: k - have]])
        return sure


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of whole numbers (as doubles) as rows of a matrix, shorter ones padded with zeros."""
    lists = column.combine_chunks()
    lengths = np.array([len(x) for x in lists] if len(lists) else [], dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (np.abs(flat) < WIDE).all():
        whole = flat.astype(np.int64)
    else:
        whole = np.array([int(x) for x in flat], dtype=object)
    out = np.zeros((len(lists), dims), dtype=whole.dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products, in 64 bits where they surely fit."""
    if vectors.dtype != object and query.dtype != object and vectors.size:
        if int(np.abs(vectors).max()) * int(np.abs(query).max()) * len(query) < 1 << 63:
            return vectors @ query
    return vectors.astype(object) @ query.astype(object)


class _Block:
    """The index of a block of rows, made when the first query comes."""

    def __init__(self, rows: list[pa.RecordBatch], dims: int) -> None:
        table = pa.Table.from_batches(rows)
        ids, marks = table["vec_id"].to_numpy(), table["row"].to_numpy()
        order = np.lexsort((marks, ids))
        self.ids, self.marks = ids[order], marks[order]
        self.index = BitSlicedIndex(_matrix(table["vector"], dims)[order])
        self.place = {m: i for i, m in enumerate(self.marks.tolist())}

    def search(self, queries: pa.RecordBatch, dims: int, k: int) -> pa.RecordBatch:
        parts = []
        wanted = _matrix(pa.chunked_array([queries.column("vector")]), dims)
        for query, query_id, mark in zip(wanted, queries.column("vec_id").to_pylist(), queries.column("row").to_pylist(), strict=True):
            best = self.index.top(query, k, self.place.get(mark))
            parts.append((np.full(len(best), query_id), np.full(len(best), mark), self.ids[best], self.marks[best], _products(self.index.vectors[best], query)))
        most = 10**DIGITS - 1
        scores = [max(-most, min(most, int(x))) for p in parts for x in p[4]]
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([p[i] for p in parts]), pa.int64()) for i in range(4)), pa.array([decimal.Decimal(x) for x in scores], pa.decimal128(DIGITS, 0))], schema=_ARROW)


def _search(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """Batches of (block, query?, vec_id, row, vector), sorted: each block's rows, then its queries, which stream past the index."""
    held: list[pa.RecordBatch] = []
    at, block = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        state = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, state[1:] != state[:-1]))
        for start, stop in zip(cuts, np.append(cuts[1:], len(state)), strict=True):
            part, number, asked = batch.slice(start, stop - start), int(state[start]) // 2, bool(state[start] % 2)
            if number != at:
                at, held, block = number, [], None
            if not asked:
                held.append(part)
                continue
            if block is None and held:
                block, held = _Block(held, dims), []
            if block is not None:
                yield block.search(part, dims, k)


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``vec_id, row, vector``: components as floor(scale * x), in doubles; unusable vectors are left out.

    Null ids, null vectors and those with a null or non-finite component take no
    part; empty vectors do.  The table is written, so that every row keeps its number.
    Repeated rows are rows of their own; other columns
    are ignored, whatever their names.
    """
    x = F.col(vector_col).cast("array<double>")
    usable = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = lambda v: F.greatest(F.least(v * F.lit(scale), F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
    floor = lambda v: F.when(F.abs(v) < WIDE, F.floor(v).cast("double")).otherwise(v)  # noqa: E731  a larger double is whole
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), x.alias("x"), usable.alias("ok"))
    return durable(ids.filter("ok").select("vec_id", "row", F.transform("x", lambda v: floor(scaled(v))).alias("vector")))


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's ``k`` best rows by inner product: ``query_id, rank, vec_id, score``.

    Both tables come from :func:`quantised`; a query's own row (same ``row``) takes
    no part, so repeated ids and equal vectors are ordinary candidates.  Vectors of
    unequal length count as padded with zeros.  Integers of any size are scored exactly; a
    score beyond 64 bits is given as the nearest number that fits, and one beyond 38 digits
    ranks as if it had them.  Ties go to the smaller id.  Empty
    tables give no rows.  Every row goes to one block, whose slices are made once;
    the queries go to every block and stream past it.
    """
    number, longest = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    asked_longest = queries.agg(F.max(F.size("vector"))).first()[0]
    blocks, dims = max(1, -(-number // block_rows)), max(longest or 0, asked_longest or 0) or 1
    rows = vectors.select(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("long").alias("block"), F.lit(False).alias("asked"), "vec_id", "row", "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), F.lit(True).alias("asked"), "vec_id", "row", "vector")
    dealt = rows.unionByName(asked).repartition("block").sortWithinPartitions("block", "asked")
    found = dealt.mapInArrow(lambda batches: _search(batches, dims, k), _OUT)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.least(F.greatest("score", F.lit(decimal.Decimal(-(2**63)))), F.lit(decimal.Decimal(2**63 - 1))).cast("long").alias("score"))
