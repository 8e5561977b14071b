"""The whole pipeline and each stage's decisions against plain versions."""

import corpus_pipeline
from provenant.llm import decontamination, language, toxicity
from provenant.llm.queries import language_model, toxicity_model
from provenant.llm.storage import durable
from tests.llm.helpers import awkward
from tests.llm.test_jaccard import brute

FOLDER = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language_id", "jaccard_join", "decontamination", "packing"]
    for name in list(stages)[:-1]:
        after = durable(stages[name](spark, docs, FOLDER))
        assert after.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "toxicity":
            want = ids(toxicity.with_toxicity(docs, toxicity_model(spark, FOLDER)).filter("tox_score < 0.3"))
        elif name == "language_id":
            want = ids(language.with_language(docs, language_model(spark, FOLDER)).filter("lang_pred <> 'und' and lang_score >= 0.4"))
        elif name == "jaccard_join":
            want = sorted({c for _, c, _ in brute(rows)})
        else:
            leaked = {r["doc_id"] for r in decontamination.find_leaks(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).filter("leaked").collect()}
            want = sorted(i for i, _ in rows if i not in leaked)
        assert ids(after) == want
        assert 0 < after.count()
        docs = after
    pieces = stages["packing"](spark, docs, FOLDER)
    assert sorted({r["doc_id"] for r in pieces.collect()}) == ids(docs)


def test_run_equals_the_stages(spark):
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.count() > 0 and "sequence_id" in pieces.columns


def test_awkward_rows_pass_every_stage(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, FOLDER))
        assert docs.columns == awkward(spark).columns
    corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()


def test_empty_table_passes_every_stage(spark):
    docs = awkward(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_clashing_and_dotted_columns_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    odd = docs.selectExpr("*", "'a' as _toxicity", "'b' as _language", "'c' as _sure", "'d' as _key", "'e' as row_key", "'f' as `a.b`", "'g' as `row``key`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = durable(stage(spark, odd, FOLDER))
        assert after.columns == odd.columns and after.count() > 0
        kept = {tuple(r)[len(docs.columns) :] for r in after.collect()}
        assert kept == {("a", "b", "c", "d", "e", "f", "g")}
