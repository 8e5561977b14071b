"""URL verdicts: longest-match rules, then gradient-boosted trees on lexical features.

The trees see only the shape of a URL: lengths, depth, digit ratio, entropy,
parameter counts and the statistics of its host suffixes among the labelled
URLs.  They are grown here with numpy on a bounded sample of labelled URLs; all
rows are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columnar import hash_bound, hash_words

#: (host, path prefix, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Host words of the labelled URLs that mark a block; fixed values.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "cheap", "farm", "pills", "porn", "spam", "track")
#: Bound of the labelled sample that the trees are fitted on.
LABELLED_ROWS = 20_000
FEATURES = ("url_length", "host_length", "path_length", "query_length", "host_labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_rate_2", "suffix_rate_3")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_suffixes(hosts: Sequence[str], labels: int) -> list[str]:
    """The last ``labels`` labels of each host."""
    return [".".join(h.split(".")[-labels:]) for h in hosts]


@dataclass
class SuffixRates:
    """Smoothed shares of blocked URLs by host suffix."""

    prior: float = 0.5
    rates: dict[int, dict[str, float]] = field(default_factory=dict)

    def fit(self, hosts: Sequence[str], blocked: np.ndarray, smoothing: float = 4.0) -> SuffixRates:
        self.prior = float(blocked.mean()) if len(blocked) else 0.5
        for labels in (2, 3):
            stats = pd.DataFrame({"s": host_suffixes(hosts, labels), "y": blocked}).groupby("s")["y"].agg(["sum", "count"])
            self.rates[labels] = ((stats["sum"] + smoothing * self.prior) / (stats["count"] + smoothing)).to_dict()
        return self

    def of(self, hosts: Sequence[str], labels: int) -> np.ndarray:
        known = self.rates.get(labels, {})
        return np.array([known.get(s, self.prior) for s in host_suffixes(hosts, labels)], dtype=np.float64)


def byte_entropy(texts: pa.Array) -> np.ndarray:
    """Entropy in bits of the bytes of each text, some hundred texts at a time."""
    out = np.zeros(len(texts))
    for at in range(0, len(texts), 512):
        part = pa.concat_arrays([texts.slice(at, 512)])  # offsets from 0
        ends = np.frombuffer(part.buffers()[1], dtype=np.int32, count=len(part) + 1)
        data = np.frombuffer(part.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        owner = np.repeat(np.arange(len(part)), np.diff(ends))
        counts = np.bincount(owner * 256 + data, minlength=256 * len(part)).reshape(len(part), 256)
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        out[at : at + len(part)] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    return out


def lexical_features(urls: Sequence[str], hosts: Sequence[str], paths: Sequence[str], suffixes: SuffixRates | np.ndarray) -> np.ndarray:
    """One row of :data:`FEATURES` per URL, column by column; ``suffixes`` are the rates, or the two columns themselves."""
    url, host, path = (pa.array(x, pa.string()) for x in (urls, hosts, paths))
    query = pc.replace_substring_regex(pc.replace_substring_regex(url, r"(?s)^[^?]*(\?|$)", "", max_replacements=1), r"(?s)#.*$", "")
    size = np.maximum(pc.binary_length(url).to_numpy(zero_copy_only=False), 1)
    whole = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float64)
    columns = [
        whole(pc.utf8_length(url)), whole(pc.utf8_length(host)), whole(pc.utf8_length(path)), whole(pc.utf8_length(query)),
        np.where(whole(pc.binary_length(host)) > 0, whole(pc.count_substring(host, ".")) + 1, 0), whole(pc.count_substring_regex(path, "[^/]+")), whole(pc.count_substring_regex(url, "[0-9]")) / size,
        byte_entropy(url), whole(pc.count_substring_regex(query, "[^&]+")), whole(pc.count_substring(url, "-")),
    ]
    rates = suffixes if isinstance(suffixes, np.ndarray) else np.stack([suffixes.of(hosts, 2), suffixes.of(hosts, 3)], axis=1)
    return np.column_stack([*columns, rates.reshape(len(urls), 2)])


class BoostedTrees:
    """Gradient boosting of depth-bounded regression trees for the logistic loss, on binned features."""

    #: Bounds of the share of blocked rows that the bias comes from.
    SHARE = (1e-3, 1 - 1e-3)

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.edges: list[np.ndarray] = []
        self.bias = self._bias(0.0)  # of trees without examples: none is blocked

    def _bias(self, share: float) -> float:
        mean = float(np.clip(share, *self.SHARE))
        return float(np.log(mean / (1 - mean)))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(x) and self.edges else np.zeros((len(x), len(self.edges)), dtype=np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.bias = self._bias(y.mean())
        binned, margin = self._binned(x), np.full(len(y), self.bias)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, y - p, np.maximum(p * (1 - p), 1e-6))
            self.grown.append(tree)
            margin += self._leaf(binned, tree)
        return self

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete binary tree: split feature (-1: none), split bin and value of each node."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        node = np.zeros(len(gradient), dtype=np.int64)
        for at in range(size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            g, h = gradient[rows], hessian[rows]
            value[at] = self.rate * g.sum() / (h.sum() + self.ridge)
            if at >= 2**self.depth - 1 or len(rows) < 2 * self.least:
                continue
            best, base = 1e-6, g.sum() ** 2 / (h.sum() + self.ridge)
            for j in range(binned.shape[1]):
                width = len(self.edges[j]) + 1
                gs, hs, ns = (np.cumsum(np.bincount(binned[rows, j], weights=w, minlength=width))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + self.ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.ridge) - base
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
                if len(gain) and gain.max() > best:
                    best, feature[at], cut[at] = gain.max(), j, int(gain.argmax())
            if feature[at] >= 0:
                node[rows] = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
        return feature, cut, value

    def _leaf(self, binned: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[node]
            go = f >= 0
            node[go] = 2 * node[go] + 1 + (binned[go, f[go]] > cut[node[go]])
        return value[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        margin = np.full(len(x), self.bias)
        for tree in self.grown:
            margin += self._leaf(binned, tree)
        return 1 / (1 + np.exp(-margin))


@dataclass
class UrlModel:
    rates: SuffixRates
    trees: BoostedTrees

    def blocked(self, urls: Sequence[str], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        return self.trees.probability(lexical_features(urls, hosts, paths, self.rates))


def train(urls: Sequence[str], hosts: Sequence[str], paths: Sequence[str], blocked: Sequence[int], folds: int = 4) -> UrlModel:
    """Fit the trees on suffix statistics that other hosts gave, so that no URL reads the labels of its own host; then the statistics on all.

    Hosts are dealt to folds by their hash; the statistics of a fold come from the
    other ones.
    """
    y = np.asarray(blocked, dtype=np.float64)
    if len(y) == 0:
        return UrlModel(SuffixRates(), BoostedTrees())
    fold = (hash_words(list(hosts)) >> np.uint64(7)) % np.uint64(folds)
    rates = np.zeros((len(y), 2))
    for f in range(folds):
        own = np.flatnonzero(fold == f)
        rest = np.flatnonzero(fold != f)
        known = SuffixRates().fit([hosts[i] for i in rest], y[rest])
        mine = [hosts[i] for i in own]
        rates[own] = np.stack([known.of(mine, 2), known.of(mine, 3)], axis=1) if len(own) else rates[own]
    trees = BoostedTrees().fit(lexical_features(urls, hosts, paths, rates), y)
    return UrlModel(SuffixRates().fit(hosts, y), trees)


def held_out_hosts(urls: Sequence[str], hosts: Sequence[str], paths: Sequence[str], blocked: Sequence[int], folds: int = 5) -> tuple[float, float]:
    """Precision and recall on URLs of hosts that the model has not seen, over all folds of hosts (1 where nothing is counted)."""
    y = np.asarray(blocked, dtype=bool)
    fold = (hash_words(list(hosts)) >> np.uint64(23)) % np.uint64(folds)
    said = np.zeros(len(y), dtype=bool)
    pick = lambda values, at: [values[i] for i in at]
    for f in range(folds):
        own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        model = train(*(pick(v, rest) for v in (urls, hosts, paths)), y[rest].astype(int))
        said[own] = model.blocked(*(pick(v, own) for v in (urls, hosts, paths))) >= 0.5
    right = int((said & y).sum())
    return right / said.sum() if said.any() else 1.0, right / y.sum() if y.any() else 1.0


def labelled(pages: DataFrame, words: Sequence[str] = BLOCKED_WORDS) -> DataFrame:
    """The labelled URLs: ``blocked`` is 1 where a word of the host is a blocked one."""
    return pages.withColumn("blocked", F.exists(F.split("host", "[^a-z]+"), lambda w: w.isin(list(words))).cast("int"))


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, threshold: float = 0.5, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """A verdict for every URL: ``page_id, host, path, rule, verdict, score``.

    A rule's verdict wins (``rule`` names it); other URLs get ``block`` where the
    trees' score reaches ``threshold``.  ``labels`` (``url, host, path, blocked``)
    defaults to the table's own URLs labelled by their host's words,
    ``labelled_rows`` distinct ones in the order of a hash, or all if there are
    fewer.  A null URL, or one without ``://``, has an empty host and path and is
    judged by the trees; without any labelled URL those allow all.  URLs of any
    length are read whole; repeated rows get equal rows; of equally long rules the
    later one holds; an empty table gives none; other columns are ignored, whatever
    their names.
    """
    url = F.col("url")
    host, path = url_parts(url)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    source = labels if labels is not None else labelled(rows)
    hashed = source.select("url", "host", "path", "blocked", F.xxhash64("url").alias("h")).filter("url is not null")
    number, factor, sample = hashed.select("h").distinct().count(), 1, None
    while sample is None or len(sample) < min(labelled_rows, number):
        near = hashed.filter(F.col("h") <= F.lit(hash_bound(factor * labelled_rows, number)))
        sample = near.dropDuplicates(["url"]).orderBy("h", "url").limit(labelled_rows).toPandas()
        factor *= 2
    model = train(sample["url"].tolist(), sample["host"].tolist(), sample["path"].tolist(), sample["blocked"].tolist())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hosts, paths = (batch.column(i).to_pylist() for i in (1, 2, 3))
            p = model.blocked([t or "" for t in texts], hosts, paths)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(p, pa.float64())], names=["page_id", "host", "path", "score"])

    kind = rows.schema["page_id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"page_id {kind}, host string, path string, score double")
    rule = rule_column(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.withColumn("_rule", rule).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
