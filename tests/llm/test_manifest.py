import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from provenant.llm import manifest, queries
from tests.llm.helpers import awkward


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests, fanout):
    """The root, and every leaf's siblings as (before, after) strings."""
    steps = [[] for _ in digests]
    under = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, below = [], []
        for at in range(0, len(digests), fanout):
            run = digests[at : at + fanout]
            for i in range(len(run)):
                for x in under[at + i]:
                    steps[x].append(("".join(run[:i]), "".join(run[i + 1 :])))
            above.append(h("".join(run)))
            below.append([x for i in range(len(run)) for x in under[at + i]])
        digests, under = above, below
    return digests[0], steps


def brute(rows, fanout=16, tamper=None):
    """``doc_id, leaf, subroot, root, proof, folded`` of every row."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"], leaf([r[c] for c in manifest.COLUMNS]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subtrees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subtrees[s] = tree([x[1] for x in groups[s]], fanout)
    root, top = tree([subtrees[s][0] for s in order], fanout) if order else ("", [])
    out = []
    for at, s in enumerate(order):
        for (ident, own, r), steps in zip(groups[s], subtrees[s][1], strict=True):
            path = steps + top[at]
            value = tamper(r) if tamper else own
            for before, after in path:
                value = h(before + value + after)
            out.append((ident, own, subtrees[s][0], root, h("".join(b + a for b, a in path)), value))
    return sorted(out, key=str)


def found(build):
    rows = build.proofs().select("id", "digest", "subroot", "root", manifest.proof_digest(F.col("path")), manifest.fold(F.col("digest"), F.col("path"))).collect()
    return sorted((tuple(r) for r in rows), key=str)


def tampered(r):
    text = r["text"]
    if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return leaf([text if c == "text" else r[c] for c in manifest.COLUMNS])


def test_query_against_brute_force(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op11_merkle_manifest(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got), key=str) == brute(rows, tamper=tampered)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got) and {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_shapes_against_brute_force(spark, fanout):
    """Groups of one row, of a full run, of one more, of many levels; many groups; ids in no order."""
    sizes = {"a": 1, "b": fanout, "c": fanout + 1, "d": fanout**2 + 1, None: 2, "é": 5, "": 1, **{f"s{i}": 1 for i in range(fanout + 3)}}
    rows = [((i * 7919) % 1009, f"Text {s} {i}", None, s, i) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found(manifest.build(docs, fanout=fanout)) == brute([r.asDict() for r in docs.collect()], fanout)


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("position", F.lit("clash")).withColumn("digest", F.lit(1))
    assert found(manifest.build(docs)) == brute([r.asDict() for r in docs.collect()])


def test_one_row_and_no_rows(spark):
    one = awkward(spark).limit(1)
    (row,) = manifest.build(one).proofs().collect()
    assert row["digest"] == row["subroot"] == row["root"] and row["path"] == []
    assert manifest.build(awkward(spark).limit(0)).proofs().count() == 0


def test_hot_group_and_repeats(spark):
    """One source holds nearly all rows, many of them the same."""
    docs = spark.createDataFrame([(1, "same", "en", "hot", 4)] * 300 + [(i, f"t{i}", "en", "hot", 2) for i in range(200)] + [(5, "x", "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(manifest.build(docs.repartition(7))) == brute([r.asDict() for r in docs.collect()])


def test_a_null_and_an_empty_text_differ(spark):
    rows = spark.createDataFrame([(1, None), (1, "")], "id long, text string").select(manifest.leaf_digest([F.col("id"), F.col("text")]).alias("d")).collect()
    assert rows[0]["d"] == h("1:1-") and rows[1]["d"] == h("1:10:")
