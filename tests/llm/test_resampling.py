import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provenant.llm import queries, resampling
from tests.llm.helpers import awkward

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    w = WORD.findall((text or "").translate(CAPITALS))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, buckets=10_000, longest=1, least=20, percent=10):
    def hashed(text):
        return [zlib.crc32(f.encode()) % buckets for f in features(text, longest)[0]]

    s, t = Counter(b for _, text in docs for b in hashed(text)), Counter(b for text in target for b in hashed(text))
    s_all, t_all = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    out = []
    for ident, text in docs:
        own = hashed(text)
        weight = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"2024:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append([ident, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, features(text, longest)[1] >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(queries.op12_importance_resampling(spark, sf_dir)) == brute(docs, target)


@pytest.mark.parametrize("longest", [1, 3])
def test_longer_runs_and_awkward_rows(spark, longest):
    odd = [(20 + i, f"Ünï{i} ABC-def 0{i} " + "w " * i, "x") for i in range(30)] + [(20, "Ünï0", "x"), (90, "a" * 300 + " " + "é" * 500 + "\x00b", "x")]
    docs = awkward(spark).select("doc_id", "text", F.lit("x").alias("score")).unionByName(spark.createDataFrame(odd, "doc_id long, text string, score string"))
    target = spark.createDataFrame([("abc def 01",), (None,), ("",)], "text string")
    found = got(resampling.resample(docs, target, longest=longest, buckets=500, least_words=2, percent=40))
    assert found == brute([(r["doc_id"], r["text"]) for r in docs.collect()], ["abc def 01", None, ""], 500, longest, 2, 40)


def test_empty_tables(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "text string")
    assert got(resampling.resample(docs, none)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [])
    assert resampling.resample(docs.limit(0), none).count() == 0


def test_many_equal_documents(spark):
    """A third of all rows are one document under one id: equal but for their ranks, which are gapless."""
    docs = [(7, "one two three four")] * 100 + [(i, f"w{i} one two x{i % 3}") for i in range(200)]
    found = got(resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame([("one w5",)], "text string"), least_words=2))
    assert found == brute(docs, ["one w5"], least=2)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 31))


def test_runs_of_a_stream():
    rng = np.random.default_rng(3)
    stream = rng.integers(0, 50, 1000).astype(np.uint16)
    bucket, times = resampling.run_lengths(stream)
    assert dict(zip(bucket.tolist(), times.tolist(), strict=True)) == Counter(stream.tolist())
    assert [len(x) for x in resampling.run_lengths(stream[:0])] == [0, 0]


def test_words_of_a_sliced_column():
    texts = pa.array(["zero", "A b", "", "ç9-x", "Q" * 200]).slice(1)
    flat, offsets, words = resampling.feature_buckets(texts, 65_536, 1)
    assert words.tolist() == [2, 0, 2, 1] and offsets.tolist() == [0, 2, 2, 4, 5]
    assert flat.tolist() == [zlib.crc32(w.encode()) % 65_536 for w in ("a", "b", "ç9", "x", "q" * 200)]
