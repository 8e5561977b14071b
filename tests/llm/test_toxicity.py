import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provenant.llm import queries, toxicity
from tests.llm.helpers import awkward

PLAIN = toxicity.ToxicityModel(toxicity.Lexicon(), toxicity.PRIOR, toxicity.PRIOR_BIAS)


def kinds(text):
    codes, _ = PLAIN.lexicon.expander()(pa.array([text]))
    return dict(toxicity.clause_matches(codes))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("what an idiot.", {"I": 1.0}), ("you are an idiot.", {"A": 1.0}), ("You are not an idiot.", {"i": 1.0}), ("she said they saw an idiot!", {"J": 1.0}), ("I will kill you.", {"T": 1.0}), ("you, I will kill.", {"V": 1.0}),
        ("he was reported to kill time.", {"U": 1.0}), ("nothing here.", {}), ("idiot. moron! not; a clown", {"I": 3.0}), ("idiots don't; win", {"I": 1.0}), ("never mind the long walk to that idiot", {"I": 1.0}),
    ],
)
def test_grammar_scores_clauses(text, want):
    assert kinds(text) == want


def test_composition_equals_running_one_after_another():
    rng = np.random.default_rng(1)
    parts = (toxicity.negation(), toxicity.reporting(), toxicity.aiming())
    for _ in range(300):
        symbols = "".join(rng.choice(list("oyNRIT"), rng.integers(0, 12)))
        one = symbols
        for p in parts:
            one = p.run(one)
        assert toxicity.GRAMMAR.run(symbols) == one


def test_order_of_severity():
    p = PLAIN.score(toxicity.features(pa.array(["you idiot", "an idiot", "he said an idiot", "not an idiot", "fine"]), PLAIN.lexicon.expander()))
    assert list(p) == sorted(p, reverse=True) and p[0] > 0.3 > p[2]


def test_stems_are_learned_once_per_family_of_copies():
    clean = [([f"w{i}", f"v{i % 7}"], [i, i, i], False) for i in range(300)]
    bad = [([f"zorg{s}", f"q{i}"], [1000 + i] * 3, True) for i, s in enumerate(["a", "b", "c", "d", "e", "f"] * 5)]
    copied = [(["rare", "word"], [5000, 5001, 5002], True)] * 40
    lexicon = toxicity.learn_lexicon(clean + bad + copied)
    assert lexicon.code("zorgnew") > toxicity.INSULT_BASE and lexicon.code("rare") == 0


def test_held_out_quality_and_contract(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    hits = found = true = 0
    for r in labels:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3)
        if g["held_out"]:
            found += g["predicted"]
            true += r["toxic"]
            hits += g["predicted"] * r["toxic"]
    assert hits / found > 0.8 and hits / true > 0.8


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("tox_score", F.lit("old"))
    got = toxicity.with_toxicity(docs, PLAIN).collect()
    assert len(got) == 11 and all(0 <= r["tox_score"] <= 0.3 for r in got)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (99, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(awkward(spark), labels)
    assert toxicity.with_toxicity(docs, model).count() == 11


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(awkward(spark).limit(0), labels)
    assert np.allclose(model.weights, toxicity.PRIOR)
    assert toxicity.with_toxicity(awkward(spark).limit(0), model).count() == 0
