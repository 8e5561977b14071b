"""Importance resampling of documents towards a target, by hashed n-gram features.

The buckets of all features are written once, as packed unsigned 16-bit streams of
many documents with the documents' offsets.  Counts come from sorting the streams
and taking run lengths; a later pass gathers each bucket's gain and sums it by
document with ``np.add.reduceat``.  The documents are drawn by Gumbel top-k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columnar import SLICE_BYTES, bounded_batches, offsets_of, slices, text_array
from .ranking import numbered
from .storage import durable

#: 16 bits hold a bucket, so there are at most 65,536.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024

_STREAMS = "ids array<long>, features array<long>, words array<long>, stream binary"


def _crc_table() -> np.ndarray:
    """CRC-32 of every byte (the polynomial of zip files, reflected)."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> np.uint32(1)) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


_CRC = _crc_table()
#: Bytes of words after A-Z are lowered: digits, a-z and all of other scripts; zero elsewhere.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)


def crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers after some more bytes each: one byte of all runs at a time, longest runs first."""
    order = np.argsort(-lengths, kind="stable")
    state, starts, lengths = state[order], starts[order], lengths[order]
    live = len(lengths)
    at = 0
    while live:
        live = int(np.searchsorted(-lengths[:live], -at, side="left"))  # runs with more than ``at`` bytes
        if live < 64:
            break
        low = (state[:live] ^ data[starts[:live] + at]) & np.uint32(255)
        state[:live] = _CRC[low] ^ (state[:live] >> np.uint32(8))
        at += 1
    for i in range(live):  # few runs are left: each to its end
        state[i] = _crc_tail(int(state[i]), data[starts[i] + at : starts[i] + lengths[i]])
    out = np.empty_like(state)
    out[order] = state
    return out


def _crc_tail(register: int, data: np.ndarray) -> int:
    import zlib

    return zlib.crc32(data.tobytes(), register ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lowered bytes of some texts, the starts and lengths of all words in them, and the offsets of each text's words."""
    flat = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64, count=len(flat) + 1, offset=8 * flat.offset)
    raw = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(flat) else np.zeros(0, np.uint8)
    ends = offsets - offsets[0] if len(flat) else np.zeros(1, np.int64)
    data = _LOWER[raw]
    inside = np.append(data != 0, False)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[ends] |= inside[ends]  # a text's first byte opens a word whatever stands before it
    starts = np.flatnonzero(opens)
    closed = np.append(np.flatnonzero(~inside), len(data))
    stops = closed[np.searchsorted(closed, starts)]
    texts_end = ends[np.searchsorted(ends, starts, side="right")] if len(starts) else starts
    lengths = np.minimum(stops, texts_end) - starts
    return data, starts, lengths, np.searchsorted(starts, ends)


def feature_buckets(texts: pa.Array, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every run of 1 to ``longest`` words, text by text; the offsets of each text's, and its number of words."""
    data, starts, lengths, offsets = word_spans(texts)
    words = np.diff(offsets)
    text = np.repeat(np.arange(len(words)), words)
    found, owner = [], []
    state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    first = np.arange(len(starts))
    for more in range(longest):
        last = first + more
        fits = (last < len(starts)) & (text[np.minimum(last, len(starts) - 1)] == text[first]) if len(starts) else np.zeros(0, bool)
        first, state, last = first[fits], state[fits], last[fits]
        if more:
            state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = crc_on(state, data, starts[last], lengths[last])
        found.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.uint16))
        owner.append(text[first])
    flat, of = np.concatenate(found), np.concatenate(owner)
    if longest > 1:
        flat = flat[np.argsort(of, kind="stable")]
    return flat, offsets_of(np.bincount(of, minlength=len(words)).astype(np.int64)), words


def streams(docs: DataFrame, id_col: str, text_col: str, buckets: int, longest: int) -> DataFrame:
    """One row a slice of documents: their ids, numbers of features and of words, and their packed buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                flat, offsets, words = feature_buckets(text_array(part.column(1)), buckets, longest)
                lists = [part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(words, pa.int64())]
                one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                yield pa.RecordBatch.from_arrays([*one, pa.array([flat.astype("<u2").tobytes()], pa.binary())], names=["ids", "features", "words", "stream"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _STREAMS)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a stream and how often each occurs, by sorting it."""
    ordered = np.sort(stream)
    cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[cuts], np.diff(np.append(cuts, len(ordered)))


def bucket_counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds; one row a bucket and task is shuffled, one a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for cell in batch.column(0):
                bucket, times = run_lengths(np.frombuffer(cell.as_py(), dtype="<u2"))
                total[bucket] += times
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "times"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in packed.select("stream").mapInArrow(run, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).collect():
        out[r["bucket"]] = r["times"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln p/q)`` of every bucket, p and q being the target's and the source's shares with one added to each bucket."""
    n = float(len(source))
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def document_weights(packed: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_features, words, weight``: the sum of the gains of a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, features, words = (batch.column(c)[i].values for c in range(3))
                gained = gains[np.frombuffer(batch.column(3)[i].as_py(), dtype="<u2")]
                sizes = features.to_numpy()
                live = np.flatnonzero(sizes)
                weight = np.zeros(len(sizes), dtype=np.int64)
                if len(live):
                    weight[live] = np.add.reduceat(gained, offsets_of(sizes)[:-1][live])
                yield pa.RecordBatch.from_arrays([ids, features, words, pa.array(weight)], names=["doc_id", "n_features", "words", "weight"])

    return packed.mapInArrow(run, "doc_id long, n_features long, words long, weight long")


def gumbel(ident: Column, seed: int) -> Column:
    """``floor(1000 g)`` of a Gumbel variate that the id and the seed decide; a null id counts as an empty text."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank``; those drawn have a rank, from 1.

    ``percent`` of the documents with ``least_words`` words or more are drawn (rounded
    down), highest score first, ties to the smaller id.  Words are runs of digits,
    letters a-z (A-Z lowered) and all that is not ASCII; features are runs of up to
    ``longest`` words, repeats counted.  Null and empty texts have no features and
    weight 0; texts of any length count whole.  A null id is last of a tie; repeated
    rows are rows of their own, equal in all but their rank; rows of one id and score
    rank by their number of features.  An empty target or table gives gains all the
    same.  Other columns are ignored, whatever their names.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit 16 bits")
    bounded_batches(docs.sparkSession)
    packed = durable(streams(docs, id_col, text_col, buckets, longest))
    wanted = streams(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_col, buckets, longest)
    gains = bucket_gains(bucket_counts(packed, buckets), bucket_counts(wanted, buckets))
    weighed = document_weights(packed, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    rows = durable(weighed)
    fit = rows.filter(F.col("words") >= least_words)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    ranked = numbered(fit, order)
    drawn = F.col("position") < F.floor(F.col("size") * percent / 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = rows.filter(F.col("words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, F.when(drawn, F.col("position") + 1).cast("long").alias("rank")).unionByName(rest)
