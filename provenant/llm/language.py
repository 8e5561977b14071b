"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of words, weighted by TF-IDF: the share
of a document's n-grams times the inverse document frequency, counted over all
training documents.  Weights are fitted with follow-the-regularised-leader and
an elastic-net penalty, which leaves most of them at zero; a temperature fitted
on unseen training rows calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columnar import bounded_batches, gather_runs, give_back, hash_bound, keep_rows, offsets_of, slices, split_chunks, text_array

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Distinct texts of the labelled sample that the weights are fitted on; idf is counted over all training rows.
LABELLED_ROWS = 3000
UNKNOWN = "und"
#: Text that is worked on at once, if it is not a single longer text, and letters whose n-grams are worked out at once in any case.
TEXT_BYTES = 4 << 20
RUN_LETTERS = 1 << 18


def gram_runs(chunks: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For a run of letters of the chunks (with a mark at both ends) after another, and each order: the first chunk of the run,
    the buckets of the n-grams that begin in it, and their chunks, counted from that one.

    A run has about ``RUN_LETTERS`` letters, however many there are and however long a chunk is.
    """
    sizes = np.cumsum(pc.binary_length(chunks).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(chunks):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + RUN_LETTERS, side="right")))
        for first, grams, owner in _piece_grams(chunks.slice(start, stop - start), buckets):
            yield start + first, grams, owner
        start = stop


def _piece_grams(chunks: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    clean = pc.replace_substring_regex(pc.utf8_lower(chunks), r"[^\pL\pM]+", "\x02")
    clean = pc.utf8_trim(clean, "\x02")
    framed = pc.if_else(pc.equal(clean, ""), "", pc.binary_join_element_wise("\x02", clean, "\x02", ""))
    ends = offsets_of(pc.utf8_length(framed).to_numpy(zero_copy_only=False).astype(np.int64))
    letters = "".join(framed.to_pylist())
    del clean, framed
    for at in range(0, len(letters), RUN_LETTERS):
        n = min(RUN_LETTERS, len(letters) - at)
        points = np.frombuffer(letters[at : at + n + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first, last = int(np.searchsorted(ends, at, side="right")) - 1, int(np.searchsorted(ends, at + n))
        inside = np.diff(np.clip(ends[first : last + 1], at, at + n))
        owner = np.repeat(np.arange(last - first, dtype=np.int32), inside)
        room = (ends[first + 1 : last + 1][owner] - np.arange(at, at + n)).astype(np.int32)
        rolling = np.zeros(n, dtype=np.uint64)
        for order in range(1, max(ORDERS) + 1):
            rolling *= np.uint64(0x9E3779B97F4A7C15)
            rolling += np.uint64(1)
            ahead = points[order - 1 : order - 1 + n]
            rolling[: len(ahead)] += ahead
            if order in ORDERS:
                live = (room >= order) & (points[:n] != 2) if order == 1 else room >= order
                hashed = rolling[live]
                hashed ^= hashed >> np.uint64(29)
                hashed *= np.uint64(0xBF58476D1CE4E5B9)
                yield first, ((hashed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32), owner[live]


def chunk_ngrams(chunks: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all orders, chunk by chunk, and their number by chunk."""
    values, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for first, grams, owner in gram_runs(chunks, buckets):
        values.append(grams)
        owners.append(owner + np.int32(first))
    owner = np.concatenate(owners)
    return np.concatenate(values)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(chunks))


def _run_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of each run, 0 for empty ones."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=values.dtype)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values, offsets[some], axis=0)
    return out


def document_sums(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``table`` rows over all n-grams of each text, and the numbers of n-grams."""
    dictionary, codes, offsets = split_chunks(texts)
    by_chunk, counts = np.zeros((len(dictionary), table.shape[1])), np.zeros(len(dictionary), dtype=np.int64)
    for first, grams, owner in gram_runs(dictionary):
        number = np.bincount(owner)
        by_chunk[first : first + len(number)] += _run_sums(table[grams].astype(np.float64), offsets_of(number))
        counts[first : first + len(number)] += number
    return _run_sums(by_chunk[codes], offsets), _run_sums(counts[codes], offsets)


def document_counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and how often they occur."""
    dictionary, codes, offsets = split_chunks(texts)
    if len(texts) == 1:  # however long, without its n-grams side by side
        times, hist = np.bincount(codes, minlength=len(dictionary)), np.zeros(BUCKETS)
        for first, found, owner in gram_runs(dictionary):
            hist += np.bincount(found, weights=times[first + owner], minlength=BUCKETS)
        buckets = np.flatnonzero(hist)
        return [(buckets, hist[buckets])]
    grams, counts = chunk_ngrams(dictionary)
    starts = offsets_of(counts)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        chunks, times = np.unique(codes[a:b], return_counts=True)
        hist = np.zeros(0)
        if len(chunks):
            run = counts[chunks]
            index = np.arange(int(run.sum())) + np.repeat(starts[chunks] - offsets_of(run)[:-1], run)
            hist = np.bincount(grams[index], weights=np.repeat(times, run))
        buckets = np.flatnonzero(hist)
        out.append((buckets, hist[buckets]))
    return out


@dataclass
class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic regression, by small batches."""

    features: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01

    def __post_init__(self) -> None:
        self.z = np.zeros((self.features, self.classes))
        self.n = np.zeros((self.features, self.classes))

    def weights(self, rows: np.ndarray | None = None) -> np.ndarray:
        z, n = (self.z, self.n) if rows is None else (self.z[rows], self.n[rows])
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, rows: np.ndarray, owner: np.ndarray, values: np.ndarray, target: np.ndarray) -> None:
        """One batch: feature rows, the example each belongs to, its value, and the classes of the examples."""
        used, local = np.unique(rows, return_inverse=True)
        w = self.weights(used)
        p = softmax(_logits(local, owner, values, w, len(target)))
        p[np.arange(len(target)), target] -= 1
        g = np.stack([np.bincount(local, weights=p[owner, k] * values, minlength=len(used)) for k in range(self.classes)], axis=1)
        old = self.n[used]
        sigma = (np.sqrt(old + g * g) - np.sqrt(old)) / self.alpha
        self.z[used] += g - sigma * w
        self.n[used] = old + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Label and calibrated probability of each text; no letters (marks alone are none): ``und`` and 0."""
        sums, number = document_sums(texts, self.table)
        known = (number > 0) & pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False).astype(bool)
        p = softmax((sums / np.maximum(number, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(p)), best], 0.0)


SCALE = 100.0


def fit(buckets: np.ndarray, counts: np.ndarray, offsets: np.ndarray, classes: list[str], idf: np.ndarray, epochs: int = 6, batch: int = 32, seed: int = 5) -> LanguageModel:
    """Fit the weights on four fifths of the examples and the temperature on the rest.

    The distinct buckets of the examples and their counts lie flat, bounded by
    ``offsets``.
    """
    labels = sorted(set(classes)) or [UNKNOWN]
    target = np.array([labels.index(c) for c in classes], dtype=np.int64)
    model = Ftrl(len(idf) + 1, len(labels))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(classes))
    apart = order[: len(order) // 5]
    kept = order[len(order) // 5 :]

    def packed(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature rows, examples and values of some examples; the last feature is the bias."""
        run = offsets[index + 1] - offsets[index]
        b, c = gather_runs(buckets, offsets[index], run), gather_runs(counts, offsets[index], run).astype(np.float64)
        owner = np.repeat(np.arange(len(index)), run)
        total = np.maximum(np.bincount(owner, weights=c, minlength=len(index)), 1.0)
        ones = np.ones(len(index))
        return np.concatenate([b, np.full(len(index), len(idf))]), np.concatenate([owner, np.arange(len(index))]), np.concatenate([SCALE * idf[b] * c / total[owner], ones])

    for _ in range(epochs if len(kept) else 0):
        rng.shuffle(kept)
        for at in range(0, len(kept), batch):
            index = kept[at : at + batch]
            model.step(*packed(index), target[index])
    w = model.weights()
    temperature = 1.0
    if len(apart):
        logits = np.concatenate([_logits(*packed(apart[at : at + 256]), w, min(256, len(apart) - at)) for at in range(0, len(apart), 256)])
        grid = np.exp(np.linspace(np.log(0.2), np.log(5.0), 41))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(apart)), target[apart]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return LanguageModel(labels, (SCALE * idf[:, None] * w[:-1]).astype(np.float32), w[-1], temperature)


def _logits(rows: np.ndarray, owner: np.ndarray, values: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, weights=w[rows, k] * values, minlength=n) for k in range(w.shape[1])], axis=1)


def document_frequencies(texts: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over the whole table (column ``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                for found, _ in document_counts(text_array(part.column(0))):
                    total[found] += 1
                total[buckets] += part.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row a bucket at most
    out = np.zeros(buckets + 1, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out[:buckets], int(out[buckets])


def shares(available: dict[str, int], most: int) -> dict[str, int]:
    """How many texts each language gives: alike for all, and what a small one lacks goes to the others; one at least."""
    out, left = {}, most
    for i, lang in enumerate(sorted(available, key=lambda k: (available[k], k))):
        out[lang] = min(available[lang], max(1, left // (len(available) - i)))
        left -= out[lang]
    return out


def labelled_hashes(rows: DataFrame, most: int) -> DataFrame:
    """``h, lang``: about ``most`` distinct texts (by column ``h``) of the table, spread over its languages by :func:`shares`.

    A text of several languages counts for the least of them.  Each language's bound
    comes from its own distinct texts and is raised until its share is full.
    """
    spark = rows.sparkSession
    distinct = rows.groupBy("h").agg(F.min("lang").alias("lang"))
    available = {r["lang"]: r["count"] for r in distinct.groupBy("lang").count().collect()}  # one row a language
    wanted, found, factor = shares(available, most), {lang: [] for lang in available}, 1
    open_ = list(available)
    while open_:
        bounds = spark.createDataFrame([(lang, hash_bound(factor * wanted[lang], available[lang])) for lang in open_], "lang string, bound long")
        highest = max(hash_bound(factor * wanted[lang], available[lang]) for lang in open_)
        got = rows.filter(F.col("h") <= F.lit(highest)).groupBy("h").agg(F.min("lang").alias("lang")).join(F.broadcast(bounds), "lang").filter("h <= bound").select("lang", "h").collect()  # some more than the shares
        for lang in open_:
            found[lang] = sorted(r["h"] for r in got if r["lang"] == lang)[: wanted[lang]]
        open_ = [lang for lang in open_ if len(found[lang]) < wanted[lang]]
        factor *= 2
    return spark.createDataFrame([(h, lang) for lang, hs in found.items() for h in hs], "h long, lang string")


def train(training: DataFrame, *, text_col: str = "text", lang_col: str = "lang", labelled_rows: int = LABELLED_ROWS) -> LanguageModel:
    """Train on the rows with a text and a language; ``labelled_rows`` distinct texts, dealt out evenly to the languages, fit the weights."""
    bounded_batches(training.sparkSession)
    rows = training.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    frequency, number = document_frequencies(rows.select("text"))
    idf = np.log((1 + number) / (1 + frequency)) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                counts = document_counts(text_array(part.column(0)))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array([b.astype(np.int32) for b, _ in counts], pa.list_(pa.int32())), pa.array([c.astype(np.float32) for _, c in counts], pa.list_(pa.float32()))], names=["h", "lang", "buckets", "counts"])

    hashed = rows.withColumn("h", F.xxhash64("text", F.lit(11)))
    picked = labelled_hashes(hashed.select("h", "lang"), labelled_rows)
    chosen = hashed.select("h", "text").join(F.broadcast(picked), "h").groupBy("h").agg(F.first("text").alias("text"), F.first("lang").alias("lang"))  # labelled_rows distinct texts
    sample = chosen.select("text", "lang", "h").mapInArrow(features, "h long, lang string, buckets array<int>, counts array<float>").toArrow().sort_by("h")
    buckets, counts = (sample[c].combine_chunks() for c in ("buckets", "counts"))
    lengths = np.diff(buckets.offsets.to_numpy()) if len(buckets) else np.zeros(0, np.int64)
    model = fit(buckets.flatten().to_numpy(), counts.flatten().to_numpy(), offsets_of(lengths), sample["lang"].to_pylist(), idf)
    del sample, buckets, counts
    give_back()
    return model


def with_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", out: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add the predicted language and its probability to every row of a table.

    Null and empty texts and texts without letters are ``und`` with score 0.  Whole
    texts are read, however long, about ``TEXT_BYTES`` at once; a single longer text
    is held whole.  Of equally likely languages the first by name is given; repeated
    rows get equal values; an empty table gives no rows.  Only the text is read;
    columns named like the two new ones are replaced, others stay.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out, score)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, TEXT_BYTES):
                label, p = model.predict(text_array(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(label, pa.string()), pa.array(p, pa.float64())], names=[*names, out, score])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kind}, `{out}` string, `{score}` double")


def only_known(docs: DataFrame, model: LanguageModel, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language that the model is at least so sure of; all columns stay, whatever their names.

    Texts without letters go, as do null and empty ones.
    """
    bounded_batches(docs.sparkSession)

    def judge() -> Callable[[pa.Array], np.ndarray]:
        def sure(texts: pa.Array) -> np.ndarray:
            label, p = model.predict(texts)
            return (p >= least) & np.array([name != UNKNOWN for name in label], dtype=bool)

        return sure

    return keep_rows(docs, text_col, judge, TEXT_BYTES)


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """Whether a row belongs to a fold by the checksum of its id as text; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
