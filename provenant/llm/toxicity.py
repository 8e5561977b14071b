"""Toxicity scoring by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, other) through a
lexicon of known words and of stems learned from labelled texts.  Sequential
transducers rewrite the symbols of a clause one after another: negation turns an
insult into a negated one, reported speech into a reported one, a target into an
aimed one.  They are composed into one transducer, run over each clause that
holds an insult or a threat.  A document is scored from its matched clauses.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import Expander, bounded_batches, chunk_words, give_back, hash_bound, hashed_words, keep_rows, offsets_of, shingles, slices, text_array, text_words

# The words that the grammar knows without labels.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "clowns", "imbecile", "bastard", "coward", "pig", "vermin", "filth", "retard", "idiota", "imbécile", "connard", "salaud", "dummkopf", "arschloch", "trottel", "estúpido", "basura")
THREATS = ("kill", "hurt", "destroy", "murder", "shoot", "stab", "burn", "attack", "beat", "smash", "töten", "tuer", "matar")
TARGETS = ("you", "your", "yours", "youre", "u", "he", "she", "they", "them", "those", "du", "ihr", "tu", "toi", "vous", "tú", "usted")
NEGATIONS = ("not", "no", "never", "isn", "aren", "ain", "don", "without", "nicht", "kein", "keine", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "say", "wrote", "quoted", "claimed", "reported", "reportedly", "allegedly", "called", "sagte", "dit", "dijo")

OTHER, STOP, TARGET, NEGATION, REPORT, INSULT, THREAT = "o.yNRIT"
#: Values of words in the flat arrays; insults and threats carry a confidence of 1 to 100 added to their base.
CODES = {OTHER: 0, STOP: 1, TARGET: 2, NEGATION: 3, REPORT: 4}
INSULT_BASE, THREAT_BASE = 1000, 2000
#: What the composed grammar can find: plain, negated, reported and aimed insults and threats.
KINDS = ("I", "i", "J", "A", "T", "t", "U", "V")
#: Bounds of the labelled sample, by label.
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
PREFIXES = range(3, 9)
#: Evidence that a learned stem needs: nats of log-likelihood ratio, and its share of toxic texts.
EVIDENCE, PRECISION = 14.0, 0.75


class Transducer:
    """A sequential transducer: ``step(state, symbol) -> (state, output)``, tabulated."""

    def __init__(self, start, step: Callable, symbols: str) -> None:
        self.start, self.symbols = start, symbols
        self.arcs: dict = {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state in self.arcs:
                continue
            self.arcs[state] = {s: step(state, s) for s in symbols}
            todo += [nxt for nxt, _ in self.arcs[state].values()]

    def compose(self, other: Transducer) -> Transducer:
        """This transducer followed by another that reads its output."""

        def step(state, symbol):
            left, out = self.arcs[state[0]][symbol]
            right, final = other.arcs[state[1]][out]
            return (left, right), final

        return Transducer((self.start, other.start), step, self.symbols)

    def run(self, symbols: str) -> str:
        state, out = self.start, []
        for symbol in symbols:
            state, made = self.arcs[state][symbol]
            out.append(made)
        return "".join(out)


def negation(reach: int = 3) -> Transducer:
    """Insults and threats within ``reach`` words after a negation are negated (lower case)."""

    def step(left: int, symbol: str):
        if symbol == NEGATION:
            return reach, symbol
        if symbol in "IT" and left:
            return left, symbol.lower()
        return max(0, left - 1), symbol

    return Transducer(0, step, "oyNRIT")


def reporting() -> Transducer:
    """Insults and threats after a verb of speech in the same clause are reported ones."""
    return Transducer(False, lambda seen, s: (seen or s == REPORT, {"I": "J", "T": "U"}.get(s, s) if seen else s), "oyNRITit")


def aiming() -> Transducer:
    """Plain insults and threats in a clause that has named a target are aimed."""
    return Transducer(False, lambda seen, s: (seen or s == TARGET, {"I": "A", "T": "V"}.get(s, s) if seen else s), "oyNRITitJU")


GRAMMAR = negation().compose(reporting()).compose(aiming())


@dataclass
class Lexicon:
    """Confidence (0 to 1) of insulting words and stems; other classes are fixed."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 1.0))

    def __post_init__(self) -> None:
        self.heads = {s[:3] for s in self.stems}
        self.fixed = {w: CODES[c] for group, c in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in group} | {w: THREAT_BASE + 100 for w in THREATS}

    def code(self, word: str) -> int:
        best = self.words.get(word, 0.0)
        if word[:3] in self.heads:
            best = max([best, *(self.stems.get(word[:k], 0.0) for k in PREFIXES if k <= len(word))])
        return INSULT_BASE + max(1, round(100 * best)) if best else self.fixed.get(word, 0)

    def expander(self) -> Expander:
        """Texts to word codes; a chunk with closing punctuation adds the code of a clause end."""

        def run(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            words, codes, counts = chunk_words(chunks)
            known = np.fromiter(map(self.code, words), dtype=np.int16, count=len(words))
            stops = pc.match_substring_regex(chunks, "[.!?;]").to_numpy(zero_copy_only=False)
            lengths = counts + stops
            out = np.full(int(lengths.sum()), CODES[STOP], dtype=np.int16)
            place = np.arange(len(codes)) + np.repeat(offsets_of(lengths)[:-1] - offsets_of(counts)[:-1], counts)
            out[place] = known[codes]
            return out, lengths

        return Expander(run)


_SYMBOL = {v: k for k, v in CODES.items()}


def clause_matches(codes: np.ndarray) -> dict[str, float]:
    """Summed confidence of the matched clauses of one text, by the kind of each clause's best match."""
    out: dict[str, float] = defaultdict(float)
    hot = np.flatnonzero(codes >= INSULT_BASE)
    if not len(hot):
        return out
    ends = np.append(np.flatnonzero(codes == CODES[STOP]), len(codes))
    last = -1
    for at in np.searchsorted(ends, hot):
        if at == last:
            continue
        last = at
        clause = codes[(ends[at - 1] + 1 if at else 0) : ends[at]].tolist()
        made = GRAMMAR.run("".join(INSULT if INSULT_BASE <= c < THREAT_BASE else THREAT if c >= THREAT_BASE else _SYMBOL[c] for c in clause))
        best = max(((("VATIUJti".index(kind) * -1), c % 1000 / 100, kind) for kind, c in zip(made, clause, strict=True) if kind in KINDS), default=None)
        if best:
            out[best[2]] += best[1]
    return out


def features(texts: pa.Array, expand: Expander) -> np.ndarray:
    """log(1 + summed confidence) of matched clauses, by kind, for each text."""
    codes, offsets = expand(texts)
    out = np.zeros((len(texts), len(KINDS)))
    running = np.concatenate([[0], np.cumsum(codes >= INSULT_BASE)])
    for i in np.flatnonzero(running[offsets[1:]] > running[offsets[:-1]]):
        for kind, value in clause_matches(codes[offsets[i] : offsets[i + 1]]).items():
            out[i, KINDS.index(kind)] = math.log1p(value)
    return out


#: Prior means of the weights of :data:`KINDS` and of the bias; labels move them.
PRIOR = np.array([2.5, 0.2, 0.6, 4.0, 1.0, 0.1, 0.3, 3.5])
PRIOR_BIAS = -3.0


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


def fit_weights(x: np.ndarray, y: np.ndarray, importance: np.ndarray, strength: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, drawn to the prior weights."""
    mean = np.append(PRIOR, PRIOR_BIAS)
    w = mean.copy()
    z = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-(z @ w)))
        gradient = z.T @ (importance * (p - y)) + strength * (w - mean)
        hessian = (z * (importance * p * (1 - p))[:, None]).T @ z + strength * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn_lexicon(examples: list[tuple[list[str], list[int], bool]]) -> Lexicon:
    """Insulting stems and words from (distinct words, signatures, toxic) of labelled texts.

    A text that shares a signature with an earlier one is a near copy and is no new
    evidence.
    """
    seen: set[tuple[int, int]] = set()
    kept: list[tuple[set[str], bool]] = []
    for words, marks, toxic in examples:
        keys = set(enumerate(marks))
        if not keys & seen:
            kept.append((set(words), toxic))
        seen |= keys
    total = len(kept)
    bad = sum(t for _, t in kept)
    if not bad or bad == total:
        return Lexicon()

    def patterns(words: set[str]) -> set[str]:
        return {w[:k] for w in words for k in PREFIXES if k <= len(w)} | {w + "$" for w in words}

    in_bad: Counter = Counter()
    for words, toxic in kept:
        if toxic:
            in_bad.update(patterns(words))
    candidates = {p for p, n in in_bad.items() if n >= 3}
    in_all: Counter = Counter({p: in_bad[p] for p in candidates})
    for words, toxic in kept:
        if not toxic:
            in_all.update(patterns(words) & candidates)
    longer = Counter({p[:-1]: 0 for p in candidates})
    for p in candidates:
        longer[p[:-1]] = max(longer[p[:-1]], in_bad[p])
    base = bad / total
    stems: dict[str, float] = {}
    exact = dict.fromkeys(INSULTS, 1.0)
    for p in candidates:
        n, k = in_all[p], in_bad[p]
        share = k / n
        if share < PRECISION or longer[p] >= 0.85 * k:  # a longer pattern says the same
            continue
        gain = k * math.log(share / base) + ((n - k) * math.log((1 - share) / (1 - base)) if n > k else 0.0)
        if gain >= EVIDENCE:
            (exact if p.endswith("$") else stems)[p.rstrip("$")] = (k + 0.5) / (n + 1)
    return Lexicon(stems, exact)


def _signatures(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Three least shingle hashes of each text."""
    values, ends = shingles(words, offsets, 5)
    out = np.zeros((len(offsets) - 1, 3), dtype=np.int64)
    some = np.flatnonzero(np.diff(ends))
    for i, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        if len(some):
            out[some, i] = np.minimum.reduceat((values * np.uint64(factor)) >> np.uint64(1), ends[some]).astype(np.int64)
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ToxicityModel:
    """Train on labelled texts: at most ``toxic_rows`` and ``clean_rows`` of them, in the order of a hash.

    The stated bounds are the only ones; without labels the fixed lexicon and the
    prior weights remain.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic"))
    order = F.xxhash64("_id", F.lit(3))
    counts = {r["_toxic"]: r["count"] for r in marked.groupBy("_toxic").count().collect()}  # two rows
    chosen = [marked.filter((F.col("_toxic") == v) & (order <= F.lit(hash_bound(n, counts.get(v, 0))))).orderBy(order, "_id").limit(n) for v, n in ((1, toxic_rows), (0, clean_rows))]
    picked = chosen[0].unionByName(chosen[1])  # toxic_rows + clean_rows at most
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(picked), "_id")
    # an id that many rows share gives its first text by hash, so that the sample stays within its bound
    sample = joined.groupBy("_id", "_toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("_toxic", "text")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = text_array(part.column(1))
                marks = _signatures(*hashed_words(texts))
                known, codes, offsets = text_words(texts)
                words = [[known[c] for c in np.unique(codes[a:b])] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.list_(pa.string())), pa.array(marks.tolist(), pa.list_(pa.int64()))], names=["toxic", "words", "marks"])

    rows = sample.mapInArrow(distinct_words, "toxic int, words array<string>, marks array<long>").toArrow()
    lists = rows["words"].combine_chunks()
    known = lists.flatten().dictionary_encode()
    spelled, codes, ends = known.dictionary.to_pylist(), known.indices.to_numpy(), lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)
    words = [[spelled[c] for c in codes[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    examples = sorted(zip(words, rows["marks"].to_pylist(), [bool(t) for t in rows["toxic"].to_pylist()], strict=True), key=lambda e: e[1])
    lexicon = learn_lexicon(examples)
    del rows, lists, known, spelled, codes, words, examples
    give_back()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = lexicon.expander()
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(features(text_array(part.column(1)), expand)), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(found, "toxic int, x array<double>").toArrow()
    y = np.array(rows["toxic"].to_pylist(), dtype=np.float64)
    x = np.array(rows["x"].to_pylist(), dtype=np.float64).reshape(len(y), len(KINDS))
    scale = {1.0: max(1.0, counts.get(1, 0) / toxic_rows), 0.0: max(1.0, counts.get(0, 0) / clean_rows)}
    return ToxicityModel(lexicon, *fit_weights(x, y, np.array([scale[v] for v in y])))


def with_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", out: str = "tox_score") -> DataFrame:
    """Add a toxicity score (0 to 1) to every row of a table.

    Null and empty texts match nothing and get the score of an unmatched text.
    Whole texts are read, however long; repeated rows and equal texts get equal
    scores; an empty table gives no rows.  Only the text is read; a column named
    like the new one is replaced, others stay.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = model.lexicon.expander()
        for batch in batches:
            for part in slices(batch, at):
                p = model.score(features(text_array(part.column(at)), expand))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*names, out])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kind}, `{out}` double")


def without_toxic(docs: DataFrame, model: ToxicityModel, at: float, *, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below a threshold; all columns stay, whatever their names.  Null and empty texts stay."""
    bounded_batches(docs.sparkSession)

    def judge() -> Callable[[pa.Array], np.ndarray]:
        expand = model.lexicon.expander()
        return lambda texts: np.asarray(model.score(features(texts, expand))) < at

    return keep_rows(docs, text_col, judge)
