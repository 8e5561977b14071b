import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from provenant.llm import queries, sharding
from tests.llm.helpers import awkward


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=40), st.integers(2, 6))
def test_differencing_places_every_number_once(sizes, k):
    parts = sharding.difference([[n] + [0] * (k - 1) for n in sizes])
    sums = np.zeros(k)
    for n, p in zip(sizes, parts, strict=True):
        assert sorted(p) == list(range(k))
        sums[p[0]] += n
    assert sums.max() - sums.min() <= max(sizes)


def test_differencing_beats_greedy_on_average():
    rng = np.random.default_rng(0)
    wins = 0
    for _ in range(30):
        sizes = rng.integers(1, 10**6, 60).tolist()
        mine = np.zeros(4)
        for n, p in zip(sizes, sharding.difference([[n, 0, 0, 0] for n in sizes]), strict=True):
            mine[p[0]] += n
        greedy = np.zeros(4)
        for n in sorted(sizes, reverse=True):
            greedy[greedy.argmin()] += n
        wins += np.ptp(mine) <= np.ptp(greedy)
    assert wins >= 20


def test_query_law_and_slots(spark, sf_dir):
    got = queries.op9_sharding(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(docs)
    shards, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        shards[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[data].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(sum(r["size"] for r in got if docs[r["doc_id"]] == t) for t in set(docs.values()))
    assert set(shards) == set(range(24)) and max(shards.values()) - min(shards.values()) <= largest


def test_awkward_rows_and_many_bins(spark, monkeypatch):
    got = sharding.shard_documents(awkward(spark), shards=3).collect()
    assert len(got) == 11
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (3, 4)} == {(3, 8, 0), (4, 8, None)}
    monkeypatch.setattr(sharding, "BUNDLES", 1)
    again = sharding.shard_documents(awkward(spark), shards=3).collect()
    by = defaultdict(list)
    for r in again:
        by[r["shard"]].append(r["slot"])
    assert len(again) == 11 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in again if r["doc_id"] == 1}) == 1
    assert sharding.shard_documents(awkward(spark).limit(0)).count() == 0


def test_many_groups_in_a_bundle_and_large_ones(spark, monkeypatch):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 101)) for i in range(600)] + [(1000 + i, "the same") for i in range(200)] + [(2000, "y" * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(sharding, "PIECE_ROWS", 7)
    for bundles in (256, 20):
        monkeypatch.setattr(sharding, "BUNDLES", bundles)
        got = sharding.shard_documents(docs.filter("doc_id < 2000"), shards=4).collect()
        sizes, slots = defaultdict(int), defaultdict(list)
        for r in got:
            sizes[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows if i < 2000)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({r["shard"] for r in got if r["doc_id"] >= 1000}) == 1
        assert max(sizes.values()) - min(sizes.values()) <= 0.002 * sum(sizes.values())
    alone = {r["shard"] for r in sharding.shard_documents(docs, shards=4).collect() if r["doc_id"] == 2000}
    assert len(alone) == 1  # larger than a shard's share: whole, and alone
