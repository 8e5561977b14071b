"""Hierarchical multi-length packing of documents into training windows.

Every document is tokenised and cut.  Full windows of the largest tier leave at
once; what remains of a document is routed to the smallest tier that holds it.
Tiers are then packed from the longest down: each remainder opens a window of
its tier, the gap is filled with the longest shorter pieces that fit, and the
last gap is closed by cutting one piece.  Windows therefore end up exactly full
at a power of two; only the last window of an input partition is padded.
Windows are then dealt to *step groups* of nearly equal token counts.

The work is local to input partitions: no shuffle, memory bounded by
``unit_tokens`` plus the longest document, and a lost task is simply run again
with the same result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columnar import Expander, bounded_batches, gather_runs, offsets_of, slices, text_array

TIERS = (256, 512, 1024, 2048)
UNIT_TOKENS = 1 << 20
STEP_TOKENS = 1 << 15

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("step_group", T.LongType()),
    ]
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]
)

#: (document in the unit, first id, number of ids)
Piece = tuple[int, int, int]


#: Set between words when many are tokenised at once; a word that holds it is tokenised alone.
MARK = "\x01"
#: How the vocabulary spells the end of a word, and the number of words tokenised at once.
WORD_END, WORDS_AT_ONCE = "</w>", 200
#: Words whose ids are kept between slices; the cache starts anew beyond this.
CACHE_WORDS = 300_000


class TokenRuns:
    """Token ids of distinct chunks.

    A chunk of letters followed by closing punctuation is split there, as the
    tokenizer's own pre-tokenizer does, so that one cached word serves all its
    forms; any other chunk is kept whole.  ASCII letters are lower-cased first, as
    the tokenizer does itself, but for chunks that may hold a special token.
    """

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.mark = self._encode(MARK)
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.closing[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.zeros(1 << 20, dtype=np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.lengths = np.zeros(1 << 16, dtype=np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [self._encode(w) for w in words]
        return np.concatenate([*runs, np.zeros(0, np.uint32)]), np.array([len(r) for r in runs], dtype=np.int64)

    def _together(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words tokenised as one text.

        Words of letters alone end where an id closes a word; others are told apart
        by a mark.  Whatever does not come out even is tokenised word by word.
        """
        if plain:
            ids = self._encode(" ".join(words))
            ends = np.flatnonzero(self.closing[ids])
            if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids) - 1):
                return ids, np.diff(ends, prepend=-1)
        elif len(self.mark) == 1 and not any(MARK in w for w in words):
            ids = self._encode(f" {MARK} ".join([*words, ""]))
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) == len(words):
                return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        return self._apart(words)

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        for some, plain in ((letters, True), ([w for w in words if not w.isalpha()], False)):
            for at in range(0, len(some), WORDS_AT_ONCE):
                self._keep(some[at : at + WORDS_AT_ONCE], plain)

    def _keep(self, words: list[str], plain: bool) -> None:
        ids, lengths = self._together(words, plain)
        first, total = len(self.index), self.used + len(ids)
        while total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.pool[self.used : total] = ids
        self.starts[first : first + len(words)] = self.used + offsets_of(lengths)[:-1]
        self.lengths[first : first + len(words)] = lengths
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        self.used = total

    def _look_up(self, words: pa.Array) -> np.ndarray:
        encoded = words.dictionary_encode()
        known = encoded.dictionary.to_pylist()
        get = self.index.get
        new = [w for w in known if get(w) is None]
        self._learn(new)
        found = np.fromiter(map(self.index.__getitem__, known), dtype=np.int64, count=len(known))
        return found[encoded.indices.to_numpy(zero_copy_only=False)]

    def __call__(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self._reset()
        chunks = pc.if_else(pc.match_substring(chunks, "<|"), chunks, pc.ascii_lower(chunks))
        ends_open = pc.match_substring_regex(chunks, r"^\pL+[.,;:!?]+$")
        cores = self._look_up(pc.if_else(ends_open, pc.utf8_rtrim(chunks, ".,;:!?"), chunks))
        tails = self._look_up(pc.if_else(ends_open, pc.replace_substring_regex(chunks, r"^\pL+", ""), ""))
        pieces = np.stack([cores, tails], axis=1).ravel()
        run = self.lengths[pieces]
        return gather_runs(self.pool, self.starts[pieces], run), run.reshape(-1, 2).sum(axis=1)


_EXPANDERS: dict[str, Expander] = {}


def token_expander(tokenizer_path: str) -> Expander:
    """Texts to token ids; the tokenizer never joins across ASCII white space.

    A Python worker keeps one for all its tasks, with the words that it has seen.
    """
    if tokenizer_path not in _EXPANDERS:
        _EXPANDERS[tokenizer_path] = Expander(TokenRuns(tokenizer_path))
    return _EXPANDERS[tokenizer_path]


class TierPool:
    """Pieces waiting to be packed, by tier and length."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = tiers
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]

    def add(self, piece: Piece) -> None:
        doc, start, length = piece
        tier = next(i for i, t in enumerate(self.tiers) if length <= t)
        insort(self.waiting[tier], (length, doc, start))

    def extend(self, pieces: list[Piece]) -> None:
        for doc, start, length in pieces:
            tier = next(i for i, t in enumerate(self.tiers) if length <= t)
            self.waiting[tier].append((length, doc, start))
        for entries in self.waiting:
            entries.sort()

    def longest(self, tier: int) -> Piece | None:
        if not self.waiting[tier]:
            return None
        length, doc, start = self.waiting[tier].pop()
        return doc, start, length

    def fitting(self, below: int, gap: int) -> Piece | None:
        """The longest piece of a tier under ``below`` that fits, if any."""
        for tier in range(below - 1, -1, -1):
            entries = self.waiting[tier]
            if at := bisect_right(entries, (gap, 1 << 62, 0)):
                length, doc, start = entries.pop(at - 1)
                return doc, start, length
        return None

    def cut(self, upto: int, gap: int) -> Piece | None:
        """A head of exactly ``gap`` ids, from the shortest longer piece of the tiers up to ``upto``."""
        for tier in range(upto + 1):
            entries = self.waiting[tier]
            at = bisect_right(entries, (gap, 1 << 62, 0))
            if at < len(entries):
                length, doc, start = entries.pop(at)
                self.add((doc, start + gap, length - gap))
                return doc, start, gap
        return None


def pack_pieces(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows ``(tier, pieces)`` and the pieces that fill none."""
    pool = TierPool(tiers)
    pool.extend(pieces)
    windows: list[tuple[int, list[Piece]]] = []
    rest: list[Piece] = []
    for tier in range(len(tiers) - 1, -1, -1):
        size = tiers[tier]
        while (head := pool.longest(tier)) is not None:
            window, gap = [head], size - head[2]
            while gap:
                piece = pool.fitting(tier, gap) or pool.cut(tier, gap) or pool.fitting(tier + 1, gap)
                if piece is None:
                    break
                window.append(piece)
                gap -= piece[2]
            if gap:
                rest += window
            else:
                windows.append((size, window))
    return windows, rest


def close_windows(pieces: list[Piece], tiers: tuple[int, ...]) -> list[tuple[int, list[Piece]]]:
    """Windows for the last pieces of a partition: full ones of falling tiers, then one padded."""
    out: list[tuple[int, list[Piece]]] = []
    left = list(reversed(pieces))
    total = sum(p[2] for p in left)
    while total:
        size = next((t for t in reversed(tiers) if t <= total), total)
        window, need = [], size
        while need:
            doc, start, length = left.pop()
            take = min(length, need)
            window.append((doc, start, take))
            if take < length:
                left.append((doc, start + take, length - take))
            need -= take
        out.append((tiers[-1] if size not in tiers else size, window))
        total -= size
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """Balanced groups: the largest window goes to the lightest group."""
    count = max(1, -(-sum(sizes) // step_tokens))
    heap = [(0, g) for g in range(count)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, group = heapq.heappop(heap)
        out[i] = group
        heapq.heappush(heap, (load + sizes[i], group))
    return out


class _Unit:
    """Documents held until their last pieces are packed."""

    def __init__(self) -> None:
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.pieces: list[Piece] = []
        self.whole: list[tuple[int, list[Piece]]] = []
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray, largest: int) -> None:
        at, n = len(self.docs), len(ids)
        self.docs.append((doc_id, ids))
        full = n // largest
        self.whole += [(largest, [(at, k * largest, largest)]) for k in range(full)]
        if n % largest:
            self.pieces.append((at, full * largest, n % largest))
        self.tokens += n


def _emit(unit: _Unit, windows, first: int, group_base: int, step_tokens: int) -> pa.RecordBatch:
    sizes = [sum(p[2] for p in w) for _, w in windows]
    groups = step_groups(sizes, step_tokens)
    cols: list[list] = [[] for _ in _ARROW]
    for k, (tier, window) in enumerate(windows):
        at = 0
        for doc, start, length in window:
            doc_id, ids = unit.docs[doc]
            for col, value in zip(cols, (doc_id, start, length, ids[start : start + length].tobytes(), len(ids), first + k, at, tier, group_base + groups[k]), strict=True):
                col.append(value)
            at += length
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def pack_partition(batches: Iterator[pa.RecordBatch], tokenizer_path: str, tiers: tuple[int, ...], eos_id: int, unit_tokens: int, step_tokens: int) -> Iterator[pa.RecordBatch]:
    """Pack one partition of (id, text) batches."""
    expand = token_expander(tokenizer_path)
    base = TaskContext.get().partitionId() << 32
    eos = np.array([eos_id], dtype=np.uint32)
    unit, count, groups = _Unit(), 0, 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal unit, count, groups
        windows, rest = pack_pieces(unit.pieces, tiers)
        windows += unit.whole
        if last:
            windows += close_windows(rest, tiers)
        if windows:
            made = _emit(unit, windows, base + count, base + groups, step_tokens)
            count += len(windows)
            groups += max(1, -(-sum(sum(p[2] for p in w) for _, w in windows) // step_tokens))
            for at in range(0, made.num_rows, 4096):
                yield made.slice(at, 4096)
        following = _Unit()
        kept: dict[int, int] = {}
        for doc, start, length in rest if not last else []:
            if doc not in kept:
                kept[doc] = len(following.docs)
                following.docs.append(unit.docs[doc])
            following.pieces.append((kept[doc], start, length))
        unit = following

    for batch in batches:
        for part in slices(batch, 1):
            ids, offsets = expand(text_array(part.column(1)))
            for doc_id, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                unit.add(doc_id, np.concatenate([ids[a:b], eos]), tiers[-1])
                if unit.tokens >= unit_tokens:
                    yield from flush(False)
    yield from flush(True)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    eos_id: int = 1,
    unit_tokens: int = UNIT_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pack documents into windows of the given tiers; one row per piece.

    ``ids`` holds the piece's little-endian unsigned 32-bit token ids.  A null or
    empty text is a document of its closing id alone; a null id stays null;
    repeated rows are packed once each; other columns are ignored; an empty
    table gives no rows.
    """
    bounded_batches(docs.sparkSession, 4000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack_partition(batches, tokenizer_path, tuple(sorted(tiers)), eos_id, unit_tokens, step_tokens)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
