import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import neardup, queries


def brute(rows, threshold=0.95):
    """``vec_id, n_links, component_id, kept`` from all pairs."""

    def fit(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    dims = max((len(v) for _, v in rows if v is not None), default=0)
    live = [i for i, (_, v) in enumerate(rows) if fit(v)]
    x = np.array([list(rows[i][1]) + [0.0] * (dims - len(rows[i][1])) for i in live], dtype=np.float64).reshape(len(live), dims)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(live) else x
    cosines = (x @ x.T) / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((x * x).sum(axis=1))[None, :]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in np.argwhere(cosines >= threshold):
        if a != b:
            i, j = live[a], live[b]
            links[i] += 1
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (ident, _) in enumerate(rows):
        least[root(i)] += [] if ident is None else [ident]
    names = [min(least[root(i)], default=None) for i in range(len(rows))]
    return sorted(((ident, links[i], names[i], ident == names[i]) for i, (ident, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def clustered(seed, number, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(int(i), (centres[rng.integers(12)] + spread * rng.normal(size=dims)).tolist()) for i in rng.permutation(number)]


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.op13_embedding_neardup(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize(("spread", "block", "fanout", "partners"), [(0.2, 16, 2, 2), (0.32, 7, 3, 1), (0.05, 64, 8, 32)])
def test_blocks_against_brute_force(spark, monkeypatch, spread, block, fanout, partners):
    """Links at all distances, over many blocks, levels of intervals and tasks for one block."""
    monkeypatch.setattr(neardup, "PARTNERS", partners)
    monkeypatch.setattr(neardup, "GROUP_BLOCKS", fanout)
    rows = clustered(4, 400, 10, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(neardup.near_copies(df, block_rows=block)) == brute(rows)
    boxes = [(i, float(i), float(i) + 0.5) for i in range(30)]
    found = neardup.block_pairs(spark.createDataFrame(boxes, "block long, lo0 double, hi0 double"), 1, 1.7, fanout)
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(30) for b in range(a, 30) if b - a - 0.5 <= 1.7]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0]), (9, [1.0, 2.0, 3.01]), (None, [1.0, 2.0, 2.99]), (1, None), (2, [0.0, 0.0, 0.0]), (4, []), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 2.0]),
        (8, [inf, 1.0, 2.0]), (10, [1.0]), (11, [5.0, 0.0, 0.0]), (12, [-1.0, -2.0, -3.0]), (None, [0.0, 0.0, 1.0]), (None, None), (13, [1e300, 1e300, 0.0]), (14, [1e-300, 1e-300, 0.0]), (15, [0.0, -0.0, 1e308]),
    ]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<double>, root string, copies int")
    want = [(a, n, c, c is None or k) for a, n, c, k in brute(rows)]
    assert got(neardup.near_copies(df)) == sorted(want, key=str)
    assert got(neardup.near_copies(df.limit(0))) == []
    assert got(neardup.near_copies(df.filter("vec_id = 2"))) == [(2, 0, 2, True)]


def test_large_groups_of_copies(spark):
    """A third of the rows are one vector, a third nearly so; counts come without listing pairs."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(i, base.tolist()) for i in range(300)] + [(300 + i, (base + 0.02 * rng.normal(size=16)).tolist()) for i in range(300)] + [(600 + i, rng.normal(size=16).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>"))
    held = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got(neardup.near_copies(df, block_rows=32)) == brute(held)


def test_threshold_of_one(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [1.0, 1e-3])]
    assert got(neardup.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=1.0)) == brute(rows, 1.0)
    with pytest.raises(ValueError, match="threshold"):
        neardup.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.0)
