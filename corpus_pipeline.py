"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and gives the rows that go on, with
the columns of ``documents``; the last gives packed pieces.  The models of the
first two stages learn from the labelled tables of ``sf_dir``.  All stages but
the last give the columns of their input, whatever their names, extra ones
included; whole texts of any length are read; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import decontamination, jaccard, language, packing, toxicity
from provenant.llm.queries import TOXIC_AT, language_model, table, tokenizer_path, toxicity_model
from provenant.llm.storage import durable

#: Texts whose most likely language is less probable than this are rejected.
SURE_LANGUAGE = 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the toxicity threshold; null and empty texts stay, repeated rows share their fate."""
    return toxicity.without_toxic(docs, toxicity_model(spark, sf_dir), TOXIC_AT)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and a language that the model is sure enough of; null and empty texts go."""
    return language.only_known(docs, language_model(spark, sf_dir), SURE_LANGUAGE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, exact ones among them: that of the least id."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; an empty benchmark drops none."""
    return decontamination.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows; a null or empty text is one closing token."""
    packed = packing.pack_documents(docs, tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("toxicity", drop_toxic), ("language_id", known_language), ("jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: No stage but the last can be told in SQL: the first two are trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
