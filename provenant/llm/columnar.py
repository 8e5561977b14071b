"""Columnar text helpers shared by the operators of this subpackage.

Work on texts is done once per *distinct* white-space chunk of a slice of rows:
Arrow splits and dictionary-encodes the slice, a small Python function maps
each distinct chunk to a run of numbers, and numpy expands the runs back to
the whole texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pandas.util import hash_array
from pyspark.sql import DataFrame

SLICE_BYTES = 8 << 20
#: The C library's function for it, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")


def bounded_batches(spark, rows: int = 2000) -> None:
    """Keep Arrow batches small enough for tables with very long texts."""
    for key, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 32 << 20)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def keep_rows(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[pa.Array], np.ndarray]], most: int | None = None) -> DataFrame:
    """The rows whose text a function of a worker keeps; all columns stay as they are, whatever their names."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = judge()
        for batch in batches:
            for part in slices(batch, at, most or SLICE_BYTES):
                yield part.filter(pa.array(keeps(text_array(part.column(at))), pa.bool_()))

    return plainly(docs, lambda rows: rows.mapInArrow(run, rows.schema))


def plainly(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Do some work on a table under plain column names (``c0``, ``c1``, …), so that dots, quotes and clashes in the real ones do no harm."""
    return work(docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))).toDF(*docs.columns)


def give_back() -> None:
    """Return freed memory to the system, so that workers that live long do not keep what one task needed."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold about ``most`` bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        floor = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, floor + most, side="right")))
        yield batch.slice(start, stop - start)
        give_back()
        start = stop


def hash_bound(most: int, rows: int) -> int:
    """The value below which the 64-bit hashes of some more than ``most`` of ``rows`` rows lie.

    A sample is cut by it before the rows are put in the order of their hash, so that
    no task gathers ``most`` rows from every partition.
    """
    share = min(1.0, 1.3 * most / max(1, rows))
    return min(2**63 - 1, int(-(2**63) + share * 2**64))


def text_array(column: pa.Array) -> pa.Array:
    """The column as strings with nulls made empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def gather_runs(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``pool[s:s+n]`` for every run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return pool[index]


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def split_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct ASCII-white-space chunks, the code of every chunk, offsets by text."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    encoded = flat.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


class Expander:
    """Maps texts to flat runs of values through a function of distinct chunks.

    The function gets an array of chunks and gives all their values in order and
    the number of values of each.
    """

    def __init__(self, function: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> None:
        self.function = function

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts in order, and the offsets of each text in them."""
        dictionary, codes, offsets = split_chunks(texts)
        pool, lengths = self.function(dictionary)
        starts = offsets_of(lengths)[:-1]
        run = lengths[codes]
        return gather_runs(pool, starts[codes], run), offsets_of(run)[offsets]


def hash_words(words: list[str] | np.ndarray) -> np.ndarray:
    """64-bit hashes of words."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return hash_array(np.asarray(words, dtype=object), categorize=False)


def chunk_words(chunks: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of the chunks in order, and how many words each chunk has.

    A word is a lower-cased run of letters, marks, digits and underscores.  Most
    chunks hold one and are stripped by Arrow; the others are searched one by one.
    """
    lower = pc.utf8_lower(chunks)
    single = pc.match_substring_regex(lower, r"^[^\pL\pM\pN_]*[\pL\pM\pN_]+[^\pL\pM\pN_]*$")
    plain = single.to_numpy(zero_copy_only=False).astype(bool)
    encoded = pc.replace_substring_regex(lower.filter(single), r"[^\pL\pM\pN_]+", "").dictionary_encode()
    words = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than as a list at once
    lengths = plain.astype(np.int64)
    if plain.all():
        return words, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths
    odd = [WORD.findall(c) for c in lower.filter(pc.invert(single)).to_pylist()]
    wanted = {word for found in odd for word in found}
    index = {word: i for i, word in enumerate(words) if word in wanted}
    lengths[~plain] = [len(o) for o in odd]
    for found in odd:
        for word in found:
            if word not in index:
                index[word] = len(words)
                words.append(word)
    codes = np.empty(int(lengths.sum()), dtype=np.int64)
    starts = offsets_of(lengths)[:-1]
    codes[starts[plain]] = encoded.indices.to_numpy(zero_copy_only=False)
    flat = [index[w] for found in odd for w in found]
    if flat:
        run = lengths[~plain]
        codes[np.arange(len(flat)) + np.repeat(starts[~plain] - offsets_of(run)[:-1], run)] = flat
    return words, codes, lengths


def text_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of some texts, the number of every word in order, and the offsets of each text."""
    dictionary, chunk, offsets = split_chunks(texts)
    words, codes, lengths = chunk_words(dictionary)
    run = lengths[chunk]
    return words, gather_runs(codes, offsets_of(lengths)[:-1][chunk], run), offsets_of(run)[offsets]


def words_of(text: str) -> list[str]:
    """The words of one text."""
    return WORD.findall(pc.utf8_lower(pa.scalar(text)).as_py())


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of some texts, and the offsets of each text."""
    words, codes, offsets = text_words(texts)
    return hash_words(words)[codes], offsets


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    v ^= v >> np.uint64(33)
    return v


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text.

    A text with fewer words than ``width`` gives one shingle of all its words; one
    without words gives none.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    starts = np.repeat(offsets[:-1], counts) + (np.arange(int(counts.sum())) - np.repeat(offsets_of(counts)[:-1], counts))
    span = np.repeat(np.minimum(lengths, width), counts)
    out = np.zeros(len(starts), dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    whole = bool((span == width).all())
    for k in range(width):
        if whole:
            out = out * factor + words[starts + k]
        else:
            live = span > k
            out[live] = out[live] * factor + words[starts[live] + k]
    return mix(out), offsets_of(counts)
