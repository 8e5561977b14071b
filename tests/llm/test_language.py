import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provenant.llm import language, queries
from tests.llm.helpers import LONG, awkward


def test_ngram_sums_equal_a_plain_count():
    texts = pa.array(["Abc, abc! é", "", "... 12", "x" * 300, "naïve-word"])
    table = np.arange(language.BUCKETS, dtype=np.float64)[:, None] + 1
    sums, number = language.document_sums(texts, table)
    for i, (found, counts) in enumerate(language.document_counts(texts)):
        assert number[i] == counts.sum()
        assert math.isclose(sums[i, 0], float(((found + 1) * counts).sum()), rel_tol=1e-9)
    assert number[1] == number[2] == 0


def test_ngrams_do_not_hang_on_the_length_of_a_run(monkeypatch):
    texts = pa.array(["Abc, abc! é", "", "... 12", "x" * 300 + "é" * 40, "naïve-word", "日本語 テキスト ab"])
    table = np.random.default_rng(2).normal(size=(language.BUCKETS, 3)).astype(np.float32)
    whole = language.document_sums(texts, table), language.document_counts(texts), language.document_counts(texts.slice(3, 1))
    for letters in (1, 3, 50):
        monkeypatch.setattr(language, "RUN_LETTERS", letters)
        sums, number = language.document_sums(texts, table)
        assert np.allclose(sums, whole[0][0]) and (number == whole[0][1]).all()
        for got, want in ((language.document_counts(texts), whole[1]), (language.document_counts(texts.slice(3, 1)), whole[2]), (language.document_counts(texts.slice(3, 1)), whole[1][3:4])):
            assert [(b.tolist(), c.tolist()) for b, c in got] == [(b.tolist(), c.tolist()) for b, c in want]


@pytest.mark.parametrize("one_word", [True, False])
def test_a_long_text_needs_a_few_times_its_bytes(one_word):
    letters = "".join(chr(97 + c) for c in np.random.default_rng(3).integers(0, 26, 4 << 20))
    texts = pa.array([letters if one_word else " ".join(letters[i : i + 60] for i in range(0, len(letters), 60))])
    table = np.ones((language.BUCKETS, 4), np.float32)
    for work in (lambda: language.document_counts(texts), lambda: language.document_sums(texts, table)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16 * len(letters)


def test_same_word_gives_the_same_grams_anywhere():
    a, _ = language.chunk_ngrams(pa.array(["Haus"]))
    b, counts = language.chunk_ngrams(pa.array(["x", "(haus)."]))
    assert Counter(a.tolist()) == Counter(b[counts[0] :].tolist())


def test_ftrl_with_elastic_net_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    model = language.Ftrl(200, 2, l1=0.5)
    for _ in range(300):
        y = rng.integers(0, 2, 16)
        rows = np.concatenate([np.stack([y, rng.integers(2, 200, 16)], axis=1).ravel()])
        model.step(rows, np.repeat(np.arange(16), 2), np.ones(32), y)
    w = model.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    assert (w[2:] == 0).mean() > 0.5


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy_and_contract(spark, folder):
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    known = {d["lang"] for d in docs}
    right = total = 0
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
        assert r["lang_pred"] in known | {"und"} and 0 <= r["score"] <= 1
        if r["held_out"]:
            total += 1
            right += r["lang_pred"] == d["lang"]
    assert right / total > 0.96


def test_temperature_fits_the_confidence(spark):
    model = queries.language_model(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(language.held_out(F.col("doc_id"), 3, 1)).collect()
    labels, p = model.predict(pa.array([d["text"] for d in docs]))
    assert abs(p.mean() - np.mean([a == d["lang"] for a, d in zip(labels, docs, strict=True)])) < 0.05


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("lang_pred", F.lit("old"))
    model = language.train(awkward(spark))
    got = language.with_language(docs, model).collect()
    assert len(got) == 11
    by_text = {r["text"]: (r["lang_pred"], r["lang_score"]) for r in got}
    for text in ("", None, "!!! ... ???", " \t\n "):
        assert by_text[text] == ("und", 0.0)
    assert by_text[LONG][0] in ("en", "de")
    assert [r["score"] for r in got if r["doc_id"] == 5] == ["score"]


def test_empty_tables(spark):
    model = language.train(awkward(spark).limit(0))
    assert {r["lang_pred"] for r in language.with_language(awkward(spark), model).collect()} == {"und"}
    assert language.with_language(awkward(spark).limit(0), model).count() == 0


def test_shares_are_even_and_used_up():
    assert language.shares({"a": 5, "b": 1000, "c": 1000}, 100) == {"a": 5, "b": 47, "c": 48}
    assert language.shares({"a": 5, "b": 6}, 100) == {"a": 5, "b": 6}
    assert language.shares({}, 100) == {}


def test_sample_is_full_for_copies_and_rare_languages(spark):
    common = spark.range(60_000).select(F.concat(F.lit("text number "), F.col("id") % 500).alias("text"), F.when(F.col("id") % 500 % 2 == 0, "en").otherwise("de").alias("lang"))
    rare = spark.range(12).select(F.concat(F.lit("palabra "), "id").alias("text"), F.lit("es").alias("lang"))
    rows = common.unionByName(rare).withColumn("h", F.xxhash64("text", F.lit(11)))
    got = Counter(r["lang"] for r in language.labelled_hashes(rows, 300).collect())
    assert got == {"es": 12, "en": 144, "de": 144}
    assert Counter(r["lang"] for r in language.labelled_hashes(rows, 3000).collect()) == {"es": 12, "en": 250, "de": 250}


def test_a_rare_language_of_a_large_table_is_learned(spark):
    common = spark.range(20_000).select(F.concat(F.lit("the house and the street "), "id").alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(5).select(F.concat(F.lit("żółw łąka źdźbło "), "id").alias("text"), F.lit("pl").alias("lang"))
    model = language.train(common.unionByName(rare), labelled_rows=100)
    assert model.labels == ["en", "pl"]
    assert model.predict(pa.array(["źdźbło i żółw", "the street and the house"]))[0] == ["pl", "en"]


def test_marks_alone_are_no_letters():
    model = language.LanguageModel(["de", "en"], np.zeros((language.BUCKETS, 2)), np.zeros(2), 1.0)
    label, p = model.predict(pa.array(["\u0301\u0308 \u0301", "e\u0301", "", "12"]))
    assert label == ["und", "de", "und", "und"] and p[0] == p[2] == p[3] == 0
