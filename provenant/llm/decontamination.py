"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

The test items are few and the training passages many, so the items are
indexed and every passage of every training text is a query.  Document
frequencies and the mean length are taken over the whole benchmark, by Spark,
before it is cut into indexes; a passage's length depends on the item's own
length alone.  So a score is the same however the benchmark is cut.
Impacts are normalised by an item's score for itself: a passage that holds all
its words scores 1.  All items above the threshold are retrieved and verified:
the question's five-word shingles and the answer's words must lie in the
passage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import bounded_batches, hash_words, offsets_of, plainly, shingles, slices, text_array, text_words, words_of
from .storage import durable

K1, B = 1.2, 0.75
WIDTH, OVERLAP, THRESHOLD = 5, 0.8, 0.5
POSTINGS_PER_BLOCK = 8
#: Items of a block of the bounds table, and of one index; a larger benchmark has several indexes, with the same scores.
ITEMS_PER_BLOCK, INDEX_ITEMS = 4, 512
#: Terms whose greatest impact is smaller are bounded by that alone.
LIGHT = 0.004
#: Text of the indexes of one pass over the corpus; a larger benchmark takes several passes.
PASS_BYTES = 32 << 20
#: Words of the shortest length class, and how much longer each class is than the one before.
LEAST_PASSAGE, CLASS_STEP = 64, 4


def length_class(words: int) -> int:
    """The least class of item lengths that holds so many words; passages for its items are twice as long."""
    size = LEAST_PASSAGE
    while size < words:
        size *= CLASS_STEP
    return size


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question (all but the last sentence) and of the answer; a single sentence is all question."""
    parts = [words_of(p) for p in re.split(r"(?<=[.!?])\s+", text.strip())]
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingle_set(words: list[str]) -> np.ndarray:
    values = hash_words(words)
    return np.unique(shingles(values, np.array([0, len(values)]), WIDTH)[0])


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    whole: np.ndarray
    question: np.ndarray
    answer: np.ndarray


@dataclass
class Frequencies:
    """What BM25 needs to know of a whole benchmark: its items with words, their mean length, and how many hold each term (sorted by term)."""

    items: int
    mean: float
    terms: np.ndarray
    holders: np.ndarray

    @staticmethod
    def of(words: list[np.ndarray]) -> Frequencies:
        words = [w for w in words if len(w)]
        terms, holders = np.unique(np.concatenate([np.unique(w) for w in words]) if words else np.zeros(0, np.uint64), return_counts=True)
        return Frequencies(len(words), float(np.mean([len(w) for w in words])) if words else 1.0, terms, holders)

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.holders[np.searchsorted(self.terms, terms)] if len(terms) else np.zeros(0)
        return np.log(1 + (self.items - df + 0.5) / (df + 0.5))


class BlockMaxIndex:
    """Postings of normalised BM25 impacts with a maximum for every block of postings.

    ``known`` holds the frequencies of the whole benchmark; without it, those of the items given are taken.
    """

    def __init__(self, items: list[tuple[int | None, str]], known: Frequencies | None = None) -> None:
        self.items: list[Item] = []
        for item_id, text in items:
            question, answer = split_item(text or "")
            words = hash_words(words_of(text or ""))
            if len(words):
                self.items.append(Item(item_id, words, shingle_set(words_of(text)), shingle_set(question), np.unique(hash_words(answer))))
        n = len(self.items)
        known = known or Frequencies.of([i.words for i in self.items])
        lengths = np.array([len(i.words) for i in self.items], dtype=np.float64)
        self.longest = length_class(int(lengths.max())) if n else 0
        pairs = [np.unique(i.words, return_counts=True) for i in self.items]
        terms = np.concatenate([p[0] for p in pairs]) if n else np.zeros(0, np.uint64)
        counts = np.concatenate([p[1] for p in pairs]).astype(np.float64) if n else np.zeros(0)
        owner = np.repeat(np.arange(n), [len(p[0]) for p in pairs])
        self.terms, term = np.unique(terms, return_inverse=True)
        raw = known.idf(self.terms)[term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[owner] / known.mean)) if n else np.zeros(0)
        impact = raw / np.bincount(owner, weights=raw, minlength=n)[owner] if n else raw
        order = np.lexsort((owner, term))
        self.posting_items, self.impacts = owner[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        blocks = -(-n // ITEMS_PER_BLOCK) if n else 1
        self.bounds = np.zeros((len(self.terms) + 1, blocks), dtype=np.float32)
        if n:
            np.maximum.at(self.bounds, (term, owner // ITEMS_PER_BLOCK), impact.astype(np.float32))
        self.peaks = self.bounds.max(axis=1) if n else np.zeros(len(self.terms) + 1, np.float32)
        self.lists = [self._list(t) for t in range(len(self.terms))]

    def _list(self, t: int) -> tuple[list[int], list[float], list[int], list[float], float]:
        a, b = self.starts[t], self.starts[t + 1]
        docs, values = self.posting_items[a:b].tolist(), self.impacts[a:b].tolist()
        ends = [docs[min(i + POSTINGS_PER_BLOCK, len(docs)) - 1] for i in range(0, len(docs), POSTINGS_PER_BLOCK)]
        peaks = [max(values[i : i + POSTINGS_PER_BLOCK]) for i in range(0, len(docs), POSTINGS_PER_BLOCK)]
        return docs, values, ends, peaks, max(peaks, default=0.0)

    def term_numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words in the index; unknown ones get the last, empty row of ``bounds``."""
        if not len(self.terms):
            return np.full(len(words), 0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, len(self.terms))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms reaches the threshold.

        Terms of little impact are left to the end: what they can add at most lowers
        the threshold of the search over the others.
        """
        light = [t for t in terms if self.peaks[t] < LIGHT]
        spare = float(sum(self.lists[t][4] for t in light))
        if not light or threshold <= spare:
            return self.wand(terms, threshold)
        found = []
        for item, score in self.wand([t for t in terms if self.peaks[t] >= LIGHT], threshold - spare):
            for t in light:
                docs, values = self.lists[t][:2]
                at = bisect_left(docs, item)
                if at < len(docs) and docs[at] == item:
                    score += values[at]
            if score >= threshold - 1e-9:
                found.append((item, score))
        return found

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms reaches the threshold, by block-max WAND."""
        cursors = [[self.lists[t], 0, 0] for t in terms if self.lists[t][0]]  # list, position, block
        found = []
        slack = threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0][0][c[1]])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[0][4]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][0][cursors[pivot][1]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][0][cursors[pivot + 1][1]] == item:
                pivot += 1
            bound, until = 0.0, None
            for c in cursors[: pivot + 1]:
                ends = c[0][2]
                while c[2] < len(ends) and ends[c[2]] < item:
                    c[2] += 1
                if c[2] < len(ends):
                    bound += c[0][3][c[2]]
                    until = ends[c[2]] if until is None else min(until, ends[c[2]])
            if bound >= slack:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    self._seek(c, item)
                    if c[1] < len(c[0][0]) and c[0][0][c[1]] == item:
                        score += c[0][1][c[1]]
                        c[1] += 1
                if score >= slack:
                    found.append((item, score))
            else:  # no item of these blocks can reach the threshold, up to the next list's item
                following = (until if until is not None else item) + 1
                if pivot + 1 < len(cursors):
                    following = min(following, cursors[pivot + 1][0][0][cursors[pivot + 1][1]])
                for c in cursors[: pivot + 1]:
                    self._seek(c, max(following, item + 1))
            cursors = [c for c in cursors if c[1] < len(c[0][0])]
        return found

    @staticmethod
    def _seek(cursor: list, item: int) -> None:
        docs = cursor[0][0]
        at = cursor[1]
        while at < len(docs) and docs[at] < item:
            at += 1
        cursor[1] = at

    def verify(self, item: int, words: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's shingles, its question's shingles and its answer's words in a passage."""
        it = self.items[item]
        have = shingles(words, np.array([0, len(words)]), WIDTH)[0]
        if len(it.words) < WIDTH:  # a short item is one shingle of all its words
            have = np.concatenate([have, shingles(words, np.array([0, len(words)]), len(it.words))[0]])
        whole = float(np.isin(it.whole, have).mean()) if len(it.whole) else 0.0
        question = float(np.isin(it.question, have).mean()) if len(it.question) else whole
        answer = float(np.isin(it.answer, words).mean()) if len(it.answer) else 1.0
        return whole, question, answer


Hit = tuple[int, int, float, float, float, float, int]


class Passages:
    """Overlapping passages of some texts: twice as long as a class of items, each a stride after the one before.

    ``tokens`` (hashes, codes and offsets of the texts' words) is what :meth:`tokens_of` gives.
    """

    def __init__(self, texts: pa.Array, longest: int, tokens: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        self.hashes, self.codes, self.offsets = tokens or self.tokens_of(texts)
        self.stride = max(LEAST_PASSAGE, longest)
        lengths = np.diff(self.offsets)
        self.cells = -(-lengths // self.stride)
        self.first = offsets_of(self.cells)
        self.owner = np.repeat(np.arange(len(lengths)), self.cells)
        start = self.offsets[:-1][self.owner] + (np.arange(len(self.owner)) - self.first[self.owner]) * self.stride
        self.starts = start
        self.ends = np.minimum(start + 2 * self.stride, self.offsets[1:][self.owner])

    @staticmethod
    def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, codes, offsets = text_words(texts)
        return hash_words(words), codes, offsets

    def terms(self, index: BlockMaxIndex) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (passage, term) pairs, sorted."""
        size = len(index.terms)
        numbers = index.term_numbers(self.hashes)[self.codes] if len(self.hashes) else np.zeros(0, np.int64)
        at = np.flatnonzero(numbers < size)
        cell = np.searchsorted(self.starts, at, side="right") - 1
        before = cell - 1
        shared = np.flatnonzero((cell > 0) & (self.owner[before] == self.owner[cell])) if len(cell) else at
        pairs = np.sort(np.concatenate([cell * size + numbers[at], before[shared] * size + numbers[at[shared]]]))
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        return pairs // max(1, size), pairs % max(1, size)

    def words(self, passage: int) -> np.ndarray:
        return self.hashes[self.codes[self.starts[passage] : self.ends[passage]]]


def possible(index: BlockMaxIndex, passage: np.ndarray, term: np.ndarray, threshold: float, pairs_at_once: int = 200_000) -> np.ndarray:
    """Positions of the passages' first pairs whose block bounds let some item reach the threshold."""
    starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else np.zeros(0, np.int64)
    bound = np.zeros(len(starts))
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + pairs_at_once)))
        a, b = starts[at], starts[stop] if stop < len(starts) else len(passage)
        peaks = index.peaks[term[a:b]]
        run = np.repeat(np.arange(stop - at), np.diff(np.append(starts[at:stop], b)))
        heavy = peaks >= LIGHT
        small = np.bincount(run, weights=np.where(heavy, 0, peaks), minlength=stop - at)
        owner = run[heavy]
        if len(owner):
            cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.add.reduceat(index.bounds[term[a:b][heavy]], cuts, axis=0).max(axis=1)
            small[owner[cuts]] += best
        bound[at:stop] = small
        at = stop
    return starts[bound >= threshold - 1e-4]


def leaks_of(indexes: list[BlockMaxIndex], texts: pa.Array, threshold: float) -> list[Hit]:
    """(text, item, score, whole, question, answer, first word) for the best passage of each retrieved item.

    Passages overlap by half, so every occurrence of an item lies within one.  Items
    are numbered through all indexes.
    """
    best: dict[tuple[int, int], Hit] = {}
    tokens = Passages.tokens_of(texts)
    cut: dict[int, Passages] = {}
    base = 0
    for index in indexes:
        if index.longest not in cut:
            cut[index.longest] = Passages(texts, index.longest, tokens)
        passages = cut[index.longest]
        if index.items and len(passages.codes):
            cells, terms = passages.terms(index)
            for a in possible(index, cells, terms, threshold):
                cell = int(cells[a])
                text = int(passages.owner[cell])
                b = int(np.searchsorted(cells, cell, side="right"))
                words = passages.words(cell)
                for item, score in index.search(terms[a:b].tolist(), threshold):
                    whole, question, answer = index.verify(item, words)
                    hit = (text, base + item, score, whole, question, answer, int(passages.starts[cell] - passages.offsets[text]))
                    held = best.get((text, base + item))
                    if held is None or (whole, round(score, 9)) > (held[3], round(held[2], 9)):
                        best[text, base + item] = hit
        base += len(index.items)
    return list(best.values())


def verified(whole: float, question: float, answer: float, overlap: float = OVERLAP) -> bool:
    """Whether question and answer, or nearly the whole item, lie in a passage."""
    return (question >= overlap and answer >= overlap) or whole >= overlap


def item_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, text, words`` of the items with words; the words are hashes, in order."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                hashes, codes, offsets = Passages.tokens_of(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes[codes].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["item_id", "text", "words"])

    return items.mapInArrow(run, "item_id long, text string, words array<long>").filter(F.size("words") > 0)


def item_indexes(benchmark: DataFrame, id_col: str, text_col: str, pass_bytes: int | None = None) -> Iterator[list[BlockMaxIndex]]:
    """Indexes of the whole benchmark: a list for each pass, of bounded size; all share the frequencies of the whole.

    The items of an index are of one length class.
    """
    items = durable(item_words(benchmark, id_col, text_col))
    held = items.select(F.explode(F.array_distinct("words")).alias("term"))
    holders = durable(held.groupBy("term").agg(F.count("*").alias("n")))
    size, number, mean = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(1.0))).first()
    parts = max(1, -(-size // (pass_bytes or PASS_BYTES)))
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        terms = own.select(F.explode("words").alias("term")).distinct()
        counted = (holders if parts == 1 else holders.join(terms, "term", "left_semi")).toArrow()  # the terms of about pass_bytes
        term = counted["term"].to_numpy().view(np.uint64)
        order = np.argsort(term)
        known = Frequencies(number, float(mean), term[order], counted["n"].to_numpy()[order])
        classes: dict[int, list[tuple[int | None, str]]] = {}
        for r in own.select("item_id", "text", F.size("words").alias("n")).orderBy("item_id", "text").collect():  # about pass_bytes
            classes.setdefault(length_class(r["n"]), []).append((r["item_id"], r["text"]))
        yield [BlockMaxIndex(rows[at : at + INDEX_ITEMS], known) for _, rows in sorted(classes.items()) for at in range(0, len(rows), INDEX_ITEMS)]


LEAK_SCHEMA = "item_id long, score double, item_overlap double, question_overlap double, answer_overlap double, first_word long, leaked boolean"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per text and retrieved item: its best passage's score and overlaps, and ``leaked``.

    ``doc_id`` keeps its type; null and empty texts or items find nothing; equal
    items are found each; repeated rows are reported each; other columns are
    ignored, whatever their names; empty tables give no rows.  Texts of any length
    are read whole, passage by passage; an item of any length is found in passages
    of its own length class.  Of passages with equal overlap and score, the first
    is reported.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = None
    for indexes in item_indexes(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], indexes: list[BlockMaxIndex] = indexes) -> Iterator[pa.RecordBatch]:
            items = [i.item_id for index in indexes for i in index.items]
            for batch in batches:
                for part in slices(batch, 1):
                    hits = leaks_of(indexes, text_array(part.column(1)), threshold)
                    ids = part.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                    columns = [[items[h[1]] for h in hits], *([h[i] for h in hits] for i in range(2, 7)), [verified(*h[3:6], overlap) for h in hits]]
                    types = [pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "item_id", "score", "item_overlap", "question_overlap", "answer_overlap", "first_word", "leaked"])

        found = rows.mapInArrow(run, f"doc_id {kind}, {LEAK_SCHEMA}")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of a table without those whose text holds a leaked item; all columns stay, whatever their names.

    Rows with a null or empty text stay; repeated rows stay or go together; a null
    id is a value like any other; whole texts are read, however long; an empty
    benchmark drops nothing.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    out = docs
    for indexes in item_indexes(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], indexes: list[BlockMaxIndex] = indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at):
                    bad = {h[0] for h in leaks_of(indexes, text_array(part.column(at)), threshold) if verified(*h[3:6], overlap)}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        out = plainly(out, lambda rows, run=run: rows.mapInArrow(run, rows.schema))
    return out
