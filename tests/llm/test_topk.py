import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenant.llm import queries, topk


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**20), 2**20))
def test_signed_digits(value):
    digits = topk.signed_digits(value)
    assert sum(d << a if d > 0 else -(1 << a) for a, d in digits) == value
    assert all(b - a > 1 for (a, _), (b, _) in zip(digits, digits[1:], strict=False))


@pytest.mark.parametrize(("rows", "dims", "spread"), [(1, 3, 5), (63, 4, 1), (65, 8, 40), (500, 16, 3), (200, 5, 0), (130, 2, 1000)])
def test_index_equals_a_sort(rows, dims, spread):
    rng = np.random.default_rng(rows)
    data = rng.integers(-spread, spread + 1, (rows, dims))
    index = topk.BitSlicedIndex(data)
    for own in (None, 0, rows - 1):
        query = rng.integers(-spread, spread + 1, dims)
        scores = data @ query
        order = [i for i in np.lexsort((np.arange(rows), -scores)) if i != own]
        assert sorted(index.top(query, 20, own)) == sorted(order[:20])


def brute(rows, k):
    """rows: (id, vector).  The k best other rows of each row whose id is divisible by 20."""
    out = []
    usable = [(i, n, np.floor(64 * np.array(v, dtype=float))) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, n, q in usable:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j, m) for j, m, v in usable if m != n)
            out += [(i, r + 1, j, int(-s)) for r, (s, j, m) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [65_536, 7])
def test_awkward_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 6)]) for i in range(60)]
    rows += [(20, rows[3][1]), (20, rows[3][1]), (61, None), (80, [1.0, None, 0.0]), (100, [float("nan")] * 6), (120, [float("inf")] * 6), (None, [0.1] * 6), (62, [0.5, -0.5]), (140, []), (63, [0.0] * 6)]
    vectors = topk.quantised(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string"))
    got = topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20, block_rows=block).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 20)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.op10_topk_search(spark, sf_dir).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 20)


def test_empty_table(spark):
    vectors = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert topk.top_k(vectors, vectors).count() == 0


def test_components_of_any_size_are_ranked_exactly(spark):
    """Beyond what 64 bits and doubles hold: the contract leaves out null and non-finite components alone."""
    shape = "vec_id long, embedding array<double>"
    rows = [(20, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [-1e6, -1e6]), (3, [1e6, -999_999.0]), (40, [2e6, 1.5]), (4, [1.6777217e9, 0.015625])]
    vectors = topk.quantised(spark.createDataFrame(rows, shape))
    got = topk.top_k(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    product = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
    want = [(q, r + 1, j, min(s, 2**63 - 1)) for q in (20, 40) for r, (s, j) in enumerate(sorted(((product(q, j), j) for j in whole if j != q), key=lambda x: (-x[0], x[1])))]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    rows = [(20, [1e12, 3.0]), (1, [1e12, 1.0]), (2, [1e12, 2.0]), (3, [-3e38, 0.0]), (4, [1.0, 1.0]), (5, [1e308, 0.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, shape))
    got = topk.top_k(vectors, vectors.filter("vec_id = 20")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [5, 2, 1, 4, 3]
    assert [r["score"] for r in got] == [2**63 - 1] * 3 + [64 * 64 * 10**12 + 64 * 3 * 64, -(2**63)]
