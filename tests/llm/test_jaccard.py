import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import graph, jaccard, queries
from provenant.llm.storage import durable
from tests.llm.helpers import awkward, words


def brute(docs):
    """Links and least connected id of each row, from all pairs of sets."""
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            inverted[t].append(i)
    links, parent = [0] * len(docs), list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for t in s for j in inverted[t] if j != i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(i)
    ids = {i: min((docs[j][0] for j in g if docs[j][0] is not None), default=None) for g in groups.values() for i in g}
    return sorted(((docs[i][0], ids[i], links[i]) for i in range(len(docs))), key=str)


def got(df):
    return sorted(((r["doc_id"], r["class_id"], r["links"]) for r in df.collect()), key=str)


def copies(seed, n=260):
    """Documents with families of near copies of different closeness."""
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(4000)]
    out = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.randint(30, 200))
        for _ in range(rng.randint(1, 35)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(text))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out[:n])]


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(queries.op3_jaccard_join(spark, sf_dir)) == brute(docs)


@pytest.mark.parametrize("small", [False, True])
def test_families_against_brute_force(spark, monkeypatch, small):
    """Also with buckets and blocks so small that all are split."""
    if small:
        monkeypatch.setattr(jaccard, "BUCKET", 6)
        monkeypatch.setattr(jaccard, "MOST_LEVELS", 3)
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
        monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 100)
    docs = copies(1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(jaccard.jaccard_classes(df)) == brute(docs)


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = got(jaccard.jaccard_classes(docs))
    assert (1, 1, 2) in found and (2, 1, 2) in found and found.count((1, 1, 2)) == 2
    assert (3, 3, 0) in found and (4, 4, 0) in found and (6, 6, 0) in found and found.count((None, None, 0)) == 2
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8]


def test_classes_of_repeated_and_null_ids_stay_apart(spark):
    """One id with two texts is a member of two classes; rows without an id make classes of their own."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a.upper() + " x y z"), (None, " ".join("c d e f g h".split() * 3)), (None, "c d e f g h c d e f g h c d e f g h i"), (None, "k l m n o p q"), (None, "k l m n o p q")], "doc_id long, text string")
    found = jaccard.jaccard_classes(docs).collect()
    assert len({r["class_key"] for r in found}) == 4
    kept = sorted((r["doc_id"] or 0, r["text"][:3]) for r in jaccard.one_of_each(docs).collect())
    assert kept == [(0, "c d"), (0, "k l"), (1, "a0 "), (1, "b0 ")]


def test_recall_near_the_threshold(spark):
    """Of the links between texts that share little more than the threshold, 99 of 100 are found, and no other."""
    rng = random.Random(11)
    docs = []
    for family in range(60):
        base = [f"f{family}w{i}" for i in range(150)]
        for _ in range(8):
            text = list(base)
            for at in rng.sample(range(150), rng.randint(1, 2)):
                text[at] = f"x{rng.randrange(10**9)}"
            docs.append((len(docs), " ".join(text)))
    want = {r[0]: r[2] for r in brute(docs)}
    have = {r["doc_id"]: r["links"] for r in jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(have[i] <= want[i] for i in want)
    assert sum(want.values()) > 1000 and sum(have.values()) >= 0.99 * sum(want.values())


def test_empty_table(spark):
    assert jaccard.jaccard_classes(awkward(spark).limit(0)).count() == 0
    assert jaccard.one_of_each(awkward(spark).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(60)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert found == {n: root(n) for n in parent if n != 200}


def test_components_of_stars_need_no_step(spark, monkeypatch):
    """A table of stars is written once; others are settled as soon as they are stars."""
    written = []
    monkeypatch.setattr(graph, "durable", lambda df: written.append(df) or durable(df))
    stars = spark.createDataFrame([(i, i // 10 * 10) for i in range(50)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(stars).collect()} == {i: i // 10 * 10 for i in range(50)}
    assert len(written) == 1
    two = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(two).collect()} == {1: 1, 2: 1, 3: 1}
    assert len(written) == 3


def test_components_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    test_components(spark)


def test_buckets_of_all_levels_are_dealt_once(spark, monkeypatch):
    """However many levels there are, one shuffle deals their buckets out."""
    monkeypatch.setattr(jaccard, "BUCKET", 6)
    monkeypatch.setattr(jaccard, "MOST_LEVELS", 3)
    rows = jaccard.row_keys(spark.createDataFrame(copies(1), "doc_id long, text string"), "doc_id", "text")
    sets = durable(jaccard.signatures(rows, 0.8, 5).select(F.col("doc_id").alias("id"), "sketch", "keys"))
    plan = jaccard.candidate_links(sets, 0.8)._jdf.queryExecution().analyzed().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_recall_of_runs():
    assert jaccard.run_count(0.8, 0.99) >= 5
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 2**63, 300)).astype(np.uint64)
    mins = jaccard.minhashes(np.concatenate([values, values]), np.array([0, len(values), 2 * len(values)]))
    assert (mins[0] == mins[1]).all()
